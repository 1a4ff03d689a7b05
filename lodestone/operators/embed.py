"""Pluggable embedders and rerankers; the defaults need no network."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import TOKEN_LIMIT, token_count
from lodestone.operators.snapshot import BATCH_REQUESTS, BATCH_TOKENS, Filler

Embedder = Callable[[list[str]], list[list[float]]]
#: (query, [(id, path, name, kind)]) -> ids, best first; ids left out are filtered.
Reranker = Callable[[str, list[tuple]], list[int]]


class HashedTrigrams:
    """Unit vectors of signed, hashed counts of case-folded trigrams: alike texts are near each other."""

    def __init__(self, dimensions: int = 256):
        self.dimensions, self.name = dimensions, f"hashed-trigrams-{dimensions}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            low, v = t.lower(), np.zeros(self.dimensions)
            for i in range(len(low) - 2):
                h = zlib.crc32(low[i : i + 3].encode())
                v[h % self.dimensions] += 1 if h >> 31 else -1
            v = np.sign(v) * np.log1p(np.abs(v))
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


def keep_order(query: str, results: list[tuple]) -> list[int]:
    return [r[0] for r in results]


def within_limit(requests: DataFrame, text: str = "rendered") -> DataFrame:
    """Requests that a model takes: not empty and not over its token limit."""
    return requests.where((F.length(text) > 0) & (token_count(F.col(text)) <= TOKEN_LIMIT))


def embed(requests: DataFrame, embedder: Embedder, text: str = "rendered", most_requests: int = BATCH_REQUESTS, most_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(content_sha256, text) to (content_sha256, data): calls of at most so many requests and tokens, filled in row order per partition."""

    def call(keys: list[str], texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"content_sha256": keys, "data": embedder(texts)})

    def run(parts):
        filler, now, keys, texts = Filler(most_requests, most_tokens), 0, [], []
        for pdf in parts:
            for key, body in zip(pdf["content_sha256"], pdf[text]):
                batch = filler.put(-(-len(body.encode()) // 4))
                if batch != now:
                    yield call(keys, texts)
                    now, keys, texts = batch, [], []
                keys.append(key)
                texts.append(body)
        if keys:
            yield call(keys, texts)

    return requests.select("content_sha256", text).mapInPandas(run, "content_sha256 string, data array<float>")
