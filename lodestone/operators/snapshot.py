"""Snapshots of the stored relations: what changed, and the next generation of each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_REQUESTS, BATCH_TOKENS = 2048, 400_000


def changes(stored: DataFrame, scanned: DataFrame, total: bool = True) -> DataFrame:
    """(path, change): new, changed, touched (same digest), same, deleted, of two (path, size_bytes, last_modified_ns, sha256_digest).

    Without `total` the scan covers some paths only and what it lacks isn't deleted."""
    s = stored.select("path", *(F.col(c).alias(f"_{c}") for c in ("size_bytes", "last_modified_ns", "sha256_digest")), F.lit(True).alias("_stored"))
    n = scanned.select("path", "size_bytes", "last_modified_ns", "sha256_digest", F.lit(True).alias("_now"))
    both = s.join(n, "path", "full_outer" if total else "right")
    change = (
        F.when(F.col("_stored").isNull(), "new")
        .when(F.col("_now").isNull(), "deleted")
        .when((F.col("_size_bytes") == F.col("size_bytes")) & (F.col("_last_modified_ns") == F.col("last_modified_ns")), "same")
        .when(F.col("_sha256_digest").eqNullSafe(F.col("sha256_digest")), "touched")
        .otherwise("changed")
    )
    return both.select("path", change.alias("change"))


def stale_by_metadata(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Of a listing (path, size_bytes, last_modified_ns), the files whose bytes must be read: new ones and those whose size or time differ."""
    known = stored.select("path", F.col("size_bytes").alias("_s"), F.col("last_modified_ns").alias("_t"))
    same = (F.col("_s") == F.col("size_bytes")) & (F.col("_t") == F.col("last_modified_ns"))
    return listed.join(known, "path", "left").where(~F.coalesce(same, F.lit(False))).drop("_s", "_t")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")


def not_visited(stored: DataFrame, visited: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(visited.select(key), key, "left_anti")


def embedding_requests(objects: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(content_sha256, rendered) that have no vector yet: one row per text, whatever number of objects share it."""
    have = cache.where(F.col("model") == model).select("content_sha256")
    return objects.where("rendered <> ''").groupBy("content_sha256").agg(F.first("rendered").alias("rendered")).join(have, "content_sha256", "left_anti")


def vectors_of_objects(vectors: DataFrame, objects: DataFrame, vector_id: str = "object_id") -> DataFrame:
    """The vectors whose object still exists."""
    return vectors.join(objects.select(F.col("id").alias(vector_id)), vector_id, "left_semi")


def reuse_vectors(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (object_id, content_sha256) with the cached vector of the same content, that of the least object."""
    first = cache.groupBy("content_sha256").agg(F.min_by("data", "object_id").alias("data"), F.min("object_id").alias("from_id"))
    return requests.join(first, "content_sha256", "left")


class Filler:
    """Numbers requests by batch: a batch closes when it is full or the next request would overfill it."""

    def __init__(self, most_requests: int = BATCH_REQUESTS, most_tokens: int = BATCH_TOKENS):
        self.most_requests, self.most_tokens = most_requests, most_tokens
        self.batch = self.count = self.total = 0

    def put(self, tokens: int) -> int:
        if self.count and (self.count >= self.most_requests or self.total + tokens > self.most_tokens):
            self.batch, self.count, self.total = self.batch + 1, 0, 0
        self.count, self.total = self.count + 1, self.total + int(tokens)
        return self.batch


def fill_batches(sizes: Iterable[int], most_requests: int = BATCH_REQUESTS, most_tokens: int = BATCH_TOKENS) -> Iterator[int]:
    filler = Filler(most_requests, most_tokens)
    return map(filler.put, sizes)


def token_batches(requests: DataFrame, key: str, tokens: str = "tokens", groups: int = 16, lane: Column | None = None, most_requests: int = BATCH_REQUESTS, most_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The rows with `lane` and `batch`. A request's lane is a hash of its key (or as given), so batches don't depend on how rows are
    partitioned; each lane fills its batches on its own, in key order."""
    lane = (F.pmod(F.xxhash64(key), F.lit(groups)) if lane is None else lane).cast("int")
    dealt = requests.withColumn("lane", lane).repartition("lane").sortWithinPartitions("lane", key)

    def run(parts):
        lanes: dict[int, Filler] = {}
        for pdf in parts:
            yield pdf.assign(batch=[lanes.setdefault(a, Filler(most_requests, most_tokens)).put(n) for a, n in zip(pdf["lane"], pdf[tokens])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", batch long"
    return dealt.mapInPandas(run, schema)
