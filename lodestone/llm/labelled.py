"""Bounded samples of labelled documents for fitting classifiers, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_chars: int, words_of=None) -> list[tuple[str, int]]:
    """At most per_class (text, label) of each class among usable rows, those of least xxhash64(doc_id).

    The bound holds before any text is read: ids are chosen from the labels alone, and their texts found by a
    broadcast of those ids. Longer texts than max_chars aren't sampled (scoring reads texts whole). Rows with null
    labels or ids are ignored; an id with several labels counts with the least; repeated texts of an id once."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("doc_id is not null and _y is not null").where(usable)
    own = own.groupBy("doc_id").agg(F.min("_y").alias("_y"))
    picked = None
    for y in (0, 1):
        part = own.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    text = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    got = text.join(F.broadcast(picked), "doc_id").where(F.char_length("_text") <= max_chars)
    got = got.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    out = F.col("_text") if words_of is None else words_of(F.col("_text"))
    rows = got.select("doc_id", out.alias("_out"), "_y").collect()  # at most 2 * per_class rows of bounded length
    return [(r["_out"], r["_y"]) for r in sorted(rows, key=lambda r: str(r["doc_id"]))]


def share(labels: DataFrame, label: str, usable: Column) -> float | None:
    """The share of label 1 among all usable labelled ids (an id with several labels counts with the least); None without any."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("doc_id is not null and _y is not null").where(usable)
    return own.groupBy("doc_id").agg(F.min("_y").alias("_y")).agg(F.avg(F.col("_y").cast("double"))).first()[0]


class Logistic:
    """Logistic regression by Newton steps with a small ridge; plain numbers, so it travels to executors cheaply."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = self._rows(x)
        w = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
            step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
            w -= step / max(1.0, float(np.abs(step).max()) / 5)
            if np.abs(step).max() < 1e-9:
                break
        self.w = w

    def shift(self, had: float, has: float) -> None:
        """Move the probabilities from rows of which a share `had` is 1 to a population where that is `has`; both strictly between 0 and 1."""
        self.w[-1] += np.log(has / (1 - has)) - np.log(had / (1 - had))

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A row's result is the same whatever the other rows are: sums go by column, as a library's product may order them by place."""
        return 1 / (1 + np.exp(-np.clip(sum(c * w for c, w in zip(self._rows(x).T, self.w)), -30, 30)))
