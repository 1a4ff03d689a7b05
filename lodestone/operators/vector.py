"""Exact vector range search by squared Euclidean distance."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.options import DEFAULT_RADIUS, DEFAULT_TOP_K

#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4096


def squared_distance(a: Column, b: Column) -> Column:
    """In double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def distances(vectors: DataFrame, query: list[float], data: str = "data") -> DataFrame:
    """The rows with `dist` to one query vector, a matrix product per Arrow batch."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        m = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.empty((0, len(q)))
        return pd.Series(((m - q) ** 2).sum(1))

    return vectors.withColumn("dist", run(F.col(data)))


def range_search(vectors: DataFrame, query: Column | list[float], radius: float = DEFAULT_RADIUS, top_k: int = DEFAULT_TOP_K, id_column: str = "object_id", data: str = "data") -> DataFrame:
    """(id, dist): the nearest top_k of those nearer than the radius, which is compared with squared distances."""
    near = vectors.withColumn("dist", squared_distance(F.col(data), query)) if isinstance(query, Column) else distances(vectors, query, data)
    return near.where(F.col("dist") < radius).select(F.col(id_column).alias("id"), "dist").orderBy("dist", "id").limit(top_k)


def range_join(vectors: DataFrame, queries: DataFrame, radius: float = DEFAULT_RADIUS, id_column: str = "object_id", data: str = "data", block_rows: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, dist) for a stated set of query vectors (query_id, query) against all vectors.

    Queries are dealt by hash into blocks of about `block_rows`; each block is broadcast and meets all vectors in turn,
    so what is broadcast at once stays near that size; the plan grows by one scan of the vectors with each block."""
    n = max(1, -(-queries.count() // block_rows))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    out = None
    for i in range(n):
        part = vectors.crossJoin(F.broadcast(queries.where(block == i))).withColumn("dist", squared_distance(F.col(data), F.col("query")))
        part = part.where(F.col("dist") < radius).select("query_id", F.col(id_column).alias("id"), "dist")
        out = part if out is None else out.unionByName(part)
    return out


def pack_vector(values: list[float]) -> bytes:
    """Native-endian float32 bytes."""
    return struct.pack(f"{len(values)}f", *values)


def unpack_vector(raw: bytes) -> list[float]:
    return list(struct.unpack(f"{len(raw) // 4}f", raw))
