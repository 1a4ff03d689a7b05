"""Shared pieces of the training-data operators: word splitting, table reading, shared work tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character but digits and lower-case letters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched. Pure ASCII strings take the fast built-in, which agrees there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct `_row` beside columns of our own, whose names can't clash with the caller's then.

    `_row.*` gives the row back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(c.alias(k) for k, c in columns.items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Where it is unset a local master gets a temporary folder; a cluster has none that is sure to be shared, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(shared_dir, "fallback", None)
        if root is None:
            root = shared_dir.fallback = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return root.rstrip("/")


@contextlib.contextmanager
def _swept(spark: SparkSession):
    """Queries that start here remove their shuffle files when they end; else these stay until the driver's memory is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def work_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage, survives lost executors.

    The files go with discard(), or when the application ends."""
    path = f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    there, system = _path(spark, path)
    system.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def _path(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame | None) -> None:
    """Remove work tables that nothing reads any more: neither an unfinished query nor one that a lost executor may repeat."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            there, system = _path(df.sparkSession, path)
            system.delete(there, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits(df: DataFrame, rows: int, size: Column, most: int) -> bool:
    """Whether df has at most `rows` rows that take at most `most` bytes by `size`; reads no more rows than that takes."""
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and total <= most


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; reads no more of it than that takes."""
    return df.limit(most + 1).count() <= most


def by_size(batches, column: int, most: int = 1 << 20):
    """Slices of Arrow batches whose values in a text or binary column come to about `most` bytes; a longer value is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
