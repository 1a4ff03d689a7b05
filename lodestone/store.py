"""Stored generations of the index: a publish writes the buckets that change, then replaces the manifest in one rename.

Files, objects, postings and corpus statistics are dealt into buckets by the hash of their path; the manifest names the
generation that holds each bucket, so a small change rewrites its buckets only. Vectors are keyed by content and only
ever added, in a part for each generation, until there are MOST_PARTS of them. What was never published is invisible and
goes with the next clean-up; one writer at a time."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 3
BUCKETED = ("file", "object", "posting", "stats")
BUCKETS = 16
#: Parts of the vectors that are kept before a publish joins them.
MOST_PARTS = 16
STATS = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])


class Store:
    def __init__(self, spark: SparkSession, path: str | os.PathLike, buckets: int = BUCKETS):
        self.spark, self.path, self._buckets = spark, Path(path), buckets

    @property
    def manifest(self) -> dict | None:
        """The current manifest; None where there is none, or one of an older version: all of it derives from the tree, so it is
        built anew."""
        try:
            m = json.loads((self.path / "manifest.json").read_text())
        except FileNotFoundError:
            return None
        if m["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the index has schema version {m['schema_version']}, newer than {SCHEMA_VERSION}")
        return m if m["schema_version"] == SCHEMA_VERSION else None

    @property
    def generation(self) -> str | None:
        m = self.manifest
        return m and m["generation"]

    @property
    def buckets(self) -> int:
        m = self.manifest
        return m["buckets"] if m else self._buckets

    @property
    def vector_parts(self) -> int:
        m = self.manifest
        return len(m["vectors"]) if m else 0

    def bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def read(self, name: str, schema, buckets: set[int] | None = None) -> DataFrame:
        """A table, or some buckets of it; a column `bucket` can be asked for in the schema."""
        m = self.manifest
        if m is None:
            where = []
        elif name == "embedding":
            where = [self.path / g / name for g in m["vectors"]]
        else:
            where = [self.path / g / name / f"part={b}" for b, g in m["tables"][name].items() if buckets is None or int(b) in buckets]
        if not where:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*map(str, where))

    def corpus_stats(self) -> DataFrame:
        """One row: n, avgdl."""
        return self.read("stats", STATS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """df written beside the generations and read back: one evaluation, which lost executors can read again."""
        path = self.path / "scratch" / f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(str(path))
        return self.spark.read.schema(df.schema).parquet(str(path))

    def drop_scratch(self) -> None:
        shutil.rmtree(self.path / "scratch", ignore_errors=True)

    def publish(self, tables: dict[str, DataFrame], touched: set[int], vectors: DataFrame | None = None, all_vectors: bool = False) -> str:
        """Write the touched buckets of the tables (each with a column `bucket`, all rows of these buckets) and new vectors (or, with
        `all_vectors`, those that take the place of all) as a generation and make it the current one; on any failure nothing changes."""
        g, m = uuid.uuid4().hex, self.manifest or {"tables": {name: {} for name in BUCKETED}, "vectors": []}
        try:
            now = {name: {b: old for b, old in m["tables"][name].items() if int(b) not in touched} for name in BUCKETED}
            for name in BUCKETED if touched else ():
                df = tables[name].withColumn("part", F.col("bucket"))
                if name == "posting":  # grams side by side, so that a search reads few row groups; the id deals a common gram over tasks
                    df = df.repartitionByRange("bucket", "gram", "object_id").sortWithinPartitions("bucket", "gram", "object_id")
                else:
                    df = df.repartition("bucket").sortWithinPartitions("bucket", *(["path"] if "path" in df.columns else []))
                df.write.partitionBy("part").parquet(str(self.path / g / name))
                now[name] |= {p.name.removeprefix("part="): g for p in (self.path / g / name).glob("part=*")}
            parts = [] if all_vectors else list(m["vectors"])
            if vectors is not None:
                vectors.write.parquet(str(self.path / g / "embedding"))
                parts.append(g)
            (self.path / g).mkdir(parents=True, exist_ok=True)
            fresh = self.path / f"manifest-{g}"
            fresh.write_text(json.dumps({"schema_version": SCHEMA_VERSION, "generation": g, "buckets": self.buckets, "tables": now, "vectors": parts}))
            os.replace(fresh, self.path / "manifest.json")
        except BaseException:
            shutil.rmtree(self.path / g, ignore_errors=True)
            (self.path / f"manifest-{g}").unlink(missing_ok=True)
            raise
        return g

    def clean(self, keep: tuple[str, ...] = ()) -> None:
        """Remove generations that the current one takes nothing from, but for those kept."""
        m = self.manifest
        used = {*keep} | ({m["generation"], *m["vectors"], *(g for t in m["tables"].values() for g in t.values())} if m else set())
        for p in self.path.iterdir() if self.path.exists() else ():
            if p.is_dir() and p.name not in used:
                shutil.rmtree(p, ignore_errors=True)


def deterministic_id():
    """An object's id: of its path, kind, name and place."""
    return F.xxhash64("path", "kind", "name", F.col("byte_range.start"), F.col("byte_range.end"))
