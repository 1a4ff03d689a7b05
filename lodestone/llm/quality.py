"""Quality by compression: zstandard dictionaries built from good and from bad labelled texts.

A text is compressed piece by piece, whole, with either dictionary and with none. The normalised difference of the
sizes with a dictionary and without it tells how much that dictionary helps; the two differences (and their squares
and product, as junk that repeats itself needs no help from either), each also scaled down for short texts, whose differences say less, are
calibrated to a probability on labelled texts that no dictionary has seen, and moved to the share of good texts among all
labelled ones. Neither length nor the plain compression ratio enters a score by itself.

Fitting uses a sample bounded by `per_class` texts of at most `max_chars` characters. Scoring is a map over whole
texts. Cases: null counts as empty, for which no dictionary helps, and gets the calibrated score of that; very long
texts are read whole, a piece at a time; equal texts get equal scores (ties stay ties); with no labelled rows of
either class, as with empty tables, every score is the share of label 1 (1 if there are no labels at all); extra columns are
kept by `score_quality`, which refuses an output name that is taken; repeated rows are scored each.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.labelled import Logistic, fold, sample, share

PER_CLASS = 4000
MAX_CHARS = 20_000
DICTIONARY_BYTES = 1 << 15
#: Bytes that are compressed at once: short enough for the dictionary to matter in all of them.
PIECE = 1024
#: Bytes at which a text's differences count half in the scaled features.
SCALE = 100
LEVEL = 3
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


@functools.lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-size:]


class QualityModel:
    def __init__(self, rows: list[tuple[str, int]], share_good: float | None = None, dictionary_bytes: int = DICTIONARY_BYTES):
        parts = {y: [t.encode() for t, label in rows if label == y] for y in (0, 1)}
        self.constant = None
        if min(map(len, parts.values())) < 4:
            self.constant = len(parts[1]) / max(1, len(rows)) if rows else 1.0
            return
        # a third of each class calibrates; the rest builds the dictionary
        build = {y: [t for i, t in enumerate(p) if i % 3] for y, p in parts.items()}
        self.good, self.bad = (_dictionary(build[y], dictionary_bytes) for y in (1, 0))
        x, y = [], []
        for label, p in parts.items():
            for t in p[::3]:
                x.append(self.features(t))
                y.append(label)
        self.calibrated = Logistic(np.array(x), np.array(y, dtype=float))
        if share_good is not None and 0 < share_good < 1:
            self.calibrated.shift(float(np.mean(y)), share_good)

    def features(self, raw: bytes) -> list[float]:
        good = bad = plain = 0
        with_good, with_bad, without = (_compressor(d).compress for d in (self.good, self.bad, b""))
        for at in range(0, max(1, len(raw)), PIECE):
            piece = raw[at : at + PIECE]
            good += len(with_good(piece))
            bad += len(with_bad(piece))
            plain += len(without(piece))
        a, b = (plain - good) / plain, (plain - bad) / plain
        saved, scale = [a, b, a * a, b * b, a * b], len(raw) / (len(raw) + SCALE)
        return [*saved, *(x * scale for x in saved)]

    def scores(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.calibrated(np.array([self.features((t or "").encode()) for t in texts]).reshape(len(texts), -1))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> QualityModel:
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return QualityModel(sample(documents, labels, "quality", usable, per_class, max_chars), share(labels, "quality", usable))


def score_quality(documents: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """The documents with a column `out` of scores from 0 to 1; higher is better."""
    if out.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"the documents have a column {out} already")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(text.tolist()))

    return documents.withColumn(out, score(F.col("text")))
