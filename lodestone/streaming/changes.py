"""Live changes of a tree as a stream, applied to the index in micro-batches.

The source compares snapshots of the tree; an offset is the number of a snapshot that is kept in the state folder, so
a restarted query replays the same differences. Unlike a file-name source it reports deletions and hidden names."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lodestone.sources.scan import walk

CHANGES = "path string, change string"


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root, self.state = options["path"], Path(options["state"])

    def _snapshot(self, number: int) -> dict[str, list[int]]:
        p = self.state / f"{number}.json"
        return json.loads(p.read_text()) if number and p.exists() else {}

    def initialOffset(self):
        return {"snapshot": 0}

    def _differences(self, old, new):
        for path in sorted({*old, *new}):
            if path not in new:
                yield path, "deleted"
            elif path not in old:
                yield path, "created"
            elif old[path] != new[path]:
                yield path, "modified"

    def read(self, start):
        old = self._snapshot(start["snapshot"])
        new = {path: [size, time] for path, size, time in walk(self.root)}
        if new == old:
            return iter(()), start
        end = {"snapshot": start["snapshot"] + 1}
        self.state.mkdir(parents=True, exist_ok=True)
        fresh = self.state / f".{end['snapshot']}.tmp"
        fresh.write_text(json.dumps(new))
        os.replace(fresh, self.state / f"{end['snapshot']}.json")
        return iter(list(self._differences(old, new))), end

    def readBetweenOffsets(self, start, end):
        return self._differences(self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"]))

    def commit(self, end):
        for p in self.state.glob("*.json"):
            if p.stem.isdigit() and int(p.stem) < end["snapshot"] - 1:
                p.unlink(missing_ok=True)


class ChangeSource(DataSource):
    @classmethod
    def name(cls):
        return "filetree_changes"

    def schema(self):
        return CHANGES

    def simpleStreamReader(self, schema):
        return ChangeReader(self.options)


def changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("filetree_changes").option("state", str(state)).load(str(root))


def event_paths(events: DataFrame) -> DataFrame:
    """(path) of watcher events (type, src, dest, is_directory): a move gives both ends, directories and other types none."""
    files = events.where(~F.col("is_directory") & F.col("type").isin("created", "deleted", "modified", "moved"))
    return files.select(F.explode(F.when(F.col("type") == "moved", F.array("src", "dest")).otherwise(F.array("src"))).alias("path"))


def keep_index_live(index, stream: DataFrame, checkpoint: str, trigger: str = "100 milliseconds"):
    """A running query that applies each micro-batch's distinct paths to the index."""

    def apply(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # the names of one micro-batch
        if paths:
            index.refresh(paths)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def bursts(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Debounced events: sessions that end when nothing comes for `gap`; works on streams and tables."""
    out = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
