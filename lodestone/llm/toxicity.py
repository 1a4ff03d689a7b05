"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: the log odds of the word itself, and the largest, second kind of largest and mean log odds of its
character n-grams (3 to 6 UTF-8 bytes, word ends included), all looked up in hashed tables of label counts. For fitting, the labelled sample is
dealt into three parts: each part's inputs come from counts of the other two, the network learns from two parts and is
calibrated on the third. For each document, the window that scores highest so far carries its label. A document's
score is its highest window's logit, calibrated together with the number of windows. Windows of `WINDOW` words overlap
by a quarter and cover every text from end to end.

Fitting is bounded by `per_class` texts of at most `max_chars` characters. Scoring is a map over whole texts.
Cases: null counts as empty; texts without words are one empty window; very long texts are read whole, all windows of
them; equal texts get equal scores (ties stay ties); without eight labelled rows of each class, as with empty tables, every
score is the share of label 1 (0 if there are none); repeated rows are scored each; extra columns are kept by
`score_toxicity`, which refuses an output name that is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import words
from lodestone.llm.labelled import Logistic, fold, sample

PER_CLASS = 2500
MAX_CHARS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
WINDOW, STRIDE = 32, 24
HIDDEN = 8
GRAMS = (3, 4, 5, 6)
#: Slots of each hashed table: one table for each n-gram length and one for words.
SLOTS = 1 << 17
INPUTS = 2 + len(GRAMS) + 1
SEED = 20240229
#: Texts that hold something at which its log odds count half.
FEW = 4
_R = np.random.default_rng(SEED)
_GRAM_MULT = {n: _R.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in GRAMS}
_WORD_MULT = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = 32


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Words:
    """Words of texts that are single-spaced, laid out flat: bounds of each word and text, hashed slots of words and n-grams."""

    def __init__(self, texts: list[str]):
        raw = [b" " + t.encode() + b" " if t else b" " for t in texts]
        self.bytes = np.frombuffer(b"".join(raw) + b" " * 8, dtype=np.uint8)
        size = len(self.bytes) - 8
        space = self.bytes[: size + 1] == _SPACE
        letter = ~space
        self.start = np.flatnonzero(letter[:size] & np.concatenate([[True], space[: size - 1]]))
        self.end = np.flatnonzero(letter[:size] & space[1 : size + 1]) + 1
        ends = np.cumsum([len(x) for x in raw])
        self.text_end = np.searchsorted(self.start, ends)
        self.space, self.size = space, size

    def word_slots(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, dtype=np.int64)
        n = self.end - self.start
        at = np.repeat(self.start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        within = (at - np.repeat(self.start, n)) & 255
        parts = (self.bytes[at].astype(np.uint64) + np.uint64(1)) * _WORD_MULT[within]
        return _slot(np.add.reduceat(parts, np.concatenate([[0], np.cumsum(n)[:-1]])))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(slot, word) of each run of n bytes that lies in a word with the space on either side."""
        if not len(self.start):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        count = np.maximum(self.end - self.start + 3 - n, 0)
        word = np.repeat(np.arange(len(count)), count)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        at = self.start[word] - 1 + np.arange(len(word)) - first[word]
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            h += (self.bytes[at + j].astype(np.uint64) + np.uint64(1)) * _GRAM_MULT[n][j]
        return _slot(h), word


def word_inputs(w: Words, tables: np.ndarray) -> np.ndarray:
    """The network's inputs of each word: word log odds, the largest of each n-gram length, their mean, a constant."""
    n = len(w.start)
    x = np.zeros((n, INPUTS), dtype=np.float32)
    x[:, 0] = tables[0][w.word_slots()]
    total, count = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
    for k, size in enumerate(GRAMS):
        slot, word = w.grams(size)
        if len(slot):
            odds = tables[k + 1][slot]
            new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            x[word[new], k + 1] = np.maximum.reduceat(odds, new)
            total[word[new]] += np.add.reduceat(odds, new)
            count[word[new]] += np.diff(np.append(new, len(word)))
    x[:, -2] = total / np.maximum(count, 1)
    x[:, -1] = 1
    return x


def count_texts(texts: list[str], y: np.ndarray) -> np.ndarray:
    """How many texts of either label hold what falls in each hashed slot, and (last slot) how many there are."""
    seen = np.zeros((2, 1 + len(GRAMS), SLOTS + 1), dtype=np.float32)
    for at in range(0, len(texts), 256):
        w = Words(texts[at : at + 256])
        text_of = np.searchsorted(w.text_end, np.arange(len(w.start)), side="right")
        for k in range(1 + len(GRAMS)):
            slot, word = (w.word_slots(), np.arange(len(w.start))) if k == 0 else w.grams(GRAMS[k - 1])
            both = np.unique(slot * 256 + text_of[word])
            label = y[at + (both & 255)]
            for c in (0, 1):
                seen[c, k, :SLOTS] += np.bincount((both >> 8)[label == c], minlength=SLOTS)
    for c in (0, 1):
        seen[c, :, SLOTS] = (y == c).sum()
    return seen


def log_odds(seen: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a text's being toxic by what it contains, per hashed slot; what few texts hold counts for less."""
    n, held = np.maximum(seen[:, :, SLOTS:], 1), seen.sum(0)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return (odds * (held / (held + FEW))).astype(np.float32)[:, :SLOTS]


def windows(text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, text): for each overlapping window the word at each place (-1: none) and whose it is."""
    begin = np.concatenate([[0], text_end[:-1]])
    size = text_end - begin
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = nth[:, None] * STRIDE + np.arange(WINDOW)
    return np.where(at < size[text][:, None], begin[text][:, None] + at, -1), text


def _sigmoid(x):
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _times(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """w.T @ x, each sum in the order of the rows. A library's product may add in another order at the edges of its blocks, so that a
    column's result would depend on its neighbours."""
    out = w[0][:, None] * x[0]
    for a, b in zip(w[1:], x[1:]):
        out += a[:, None] * b
    return out


def _sum(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in order."""
    out = x[0].copy()
    for y in x[1:]:
        out += y
    return out


class GatedNet:
    """The two directions, attention pooling and output; `p` maps names to float32 arrays."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        small = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"att": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": small(INPUTS, 3 * HIDDEN), f"U{d}": small(HIDDEN, 3 * HIDDEN)}

    def forward(self, proj: dict[str, np.ndarray], index: np.ndarray, keep: bool = False):
        """proj: W times the inputs of each direction, a word a column, with a column of zeros last (for places without a word).

        A window is a column too, and comes out the same whatever the others are."""
        n, h = len(index), HIDDEN
        mask = (index >= 0).astype(np.float32)
        states = np.zeros((WINDOW, 2 * h, n), dtype=np.float32)
        tape = {}
        for k, d in enumerate("fb"):
            u, now = self.p[f"U{d}"], np.zeros((h, n), dtype=np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, m = proj[d][:, index[:, t]], mask[:, t]
                zr = _sigmoid(g[: 2 * h] + _times(u[:, : 2 * h], now))
                z, r = zr[:h], zr[h:]
                c = np.tanh(g[2 * h :] + _times(u[:, 2 * h :], r * now))
                if keep:
                    tape[d, t] = (now.T, z.T, r.T, c.T)
                now = now + m * z * (c - now)
                states[t, k * h : (k + 1) * h] = now
        e = np.stack([_times(self.p["att"][:, None], np.tanh(s))[0] for s in states])
        e = np.where(mask.T > 0, e, -1e9)
        e[0] = np.where(mask.sum(1) > 0, e[0], 0)
        a = np.exp(e - e.max(0))
        a /= _sum(a)
        pooled = _sum(a[:, None, :] * states)
        logit = _times(self.p["out"][:, None], pooled)[0] + self.p["bias"][0]
        return (logit, states.transpose(0, 2, 1), a, pooled.T, mask, tape) if keep else logit

    def project(self, x: np.ndarray, step: int = 2048) -> dict[str, np.ndarray]:
        out = {d: np.zeros((3 * HIDDEN, len(x) + 1), dtype=np.float32) for d in "fb"}
        for i in range(0, len(x), step):
            part = np.ascontiguousarray(x[i : i + step].T)
            for d in "fb":
                out[d][:, i : i + part.shape[1]] = _times(self.p[f"W{d}"], part)
        return out

    def logits(self, x: np.ndarray, index: np.ndarray, step: int = 2048) -> np.ndarray:
        """Of windows whose words come in order: each step projects the words that it spans only."""
        out = [np.empty(0, np.float32)]
        for i in range(0, len(index), step):
            part = index[i : i + step]
            used = part[part >= 0]
            low, high = (int(used.min()), int(used.max()) + 1) if len(used) else (0, 0)
            out.append(self.forward(self.project(x[low:high]), np.where(part >= 0, part - low, -1)))
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN
        x, index = x[np.maximum(index, 0).ravel()], np.where(index >= 0, np.arange(index.size).reshape(index.shape), -1)
        logit, states, a, pooled, mask, tape = self.forward(self.project(x), index, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = (_sigmoid(logit) - y) * weight
        g["out"], g["bias"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * self.p["out"]
        ds = a[:, :, None] * dpool
        da = (states * dpool).sum(2)
        de = a * (da - (a * da).sum(0)) * (mask.T > 0)
        th = np.tanh(states)
        g["att"] = np.einsum("tn,tnk->k", de, th)
        ds += de[:, :, None] * self.p["att"] * (1 - th * th)
        wide = np.concatenate([x, np.zeros((1, INPUTS), np.float32)])
        for k, d in enumerate("fb"):
            u, back = self.p[f"U{d}"], np.zeros((len(index), h), dtype=np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
                prev, z, r, c = tape[d, t]
                m = mask[:, t : t + 1]
                back = back + ds[t, :, k * h : (k + 1) * h]
                dc = back * m * z * (1 - c * c)
                dz = back * m * (c - prev) * z * (1 - z)
                drh = dc @ u[:, 2 * h :].T
                dr = drh * prev * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], axis=1)
                g[f"W{d}"] += wide[index[:, t]].T @ dg
                g[f"U{d}"] += np.concatenate([prev.T @ dg[:, : 2 * h], (r * prev).T @ dc], axis=1)
                back = back * (1 - m * z) + drh * r + dg[:, : 2 * h] @ u[:, : 2 * h].T
        return g


class ToxicityModel:
    def __init__(self, rows: list[tuple[str, int]], rounds: int = 3, epochs: int = 6, rate: float = 0.02):
        y = np.array([label for _, label in rows], dtype=np.int64)
        self.constant = None
        if min((y == 0).sum(), (y == 1).sum()) < 8:
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        # three parts, classes dealt evenly: the inputs of each come from counts of the others, so that no label tells of itself;
        # the network learns from two parts and is calibrated on the third
        part = np.zeros(len(y), dtype=np.int64)
        for c in (0, 1):
            at = np.flatnonzero(y == c)
            part[at] = np.arange(len(at)) % 3
        order = np.argsort(part, kind="stable")
        texts, y, part = [rows[i][0] for i in order], y[order], part[order]
        bounds = np.searchsorted(part, np.arange(4))
        counts = [count_texts(texts[a:b], y[a:b]) for a, b in zip(bounds, bounds[1:])]
        inputs, ends, n = [], [], 0
        for p in range(3):
            own = log_odds(sum(c for i, c in enumerate(counts) if i != p))
            for a in range(bounds[p], bounds[p + 1], 256):
                w = Words(texts[a : min(a + 256, bounds[p + 1])])
                inputs.append(word_inputs(w, own))
                ends.append(w.text_end + n)
                n += len(w.start)
        self.tables, x_all = log_odds(sum(counts)), np.concatenate(inputs)
        del counts, inputs
        self.net = GatedNet()
        all_index, all_text = windows(np.concatenate(ends))
        split = int(np.searchsorted(all_text, bounds[2]))
        index, text, own = all_index[:split], all_text[:split], y
        wide = np.append(x_all[:, :-1].max(1), 0.0)
        lead = wide[index].max(1)
        r = np.random.default_rng(SEED)
        weight = np.where(own == 1, 0.5 / (own == 1).mean(), 0.5 / (own == 0).mean()).astype(np.float32)
        short_rng = np.random.default_rng(SEED + 1)
        mean = {k: np.zeros_like(v) for k, v in self.net.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.net.p.items()}
        step = 0
        for _ in range(rounds):
            order = np.lexsort((-lead, text))
            best = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
            also = r.integers(0, len(index), len(best))  # a second window each: any, with the label only where it is clean
            also = also[own[text[also]] == 0]
            # and its beginning alone, from nothing to half a window, so that short and empty texts are known too
            few = also[::5]
            short = self._beginnings(index[few], r)
            seen, whose = np.concatenate([index, short]), np.concatenate([text, text[few]])
            pick = np.concatenate([best, also, np.arange(len(index), len(seen))])
            for _ in range(epochs):
                for part in np.array_split(r.permutation(pick), max(1, len(pick) // min(256, max(16, len(pick) // 24)))):
                    g = self.net.gradients(x_all, seen[part], own[whose[part]].astype(np.float32), weight[whose[part]] / len(part))
                    step += 1
                    for k, v in g.items():
                        mean[k] = 0.9 * mean[k] + 0.1 * v
                        square[k] = 0.99 * square[k] + 0.01 * v * v
                        self.net.p[k] = (self.net.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            lead = self.net.logits(x_all, index)
        # longer texts than calibration knows count as its long ones
        index, text = all_index[split:], all_text[split:] - bounds[2]
        self.most = float(np.quantile(np.bincount(text), 0.95))
        top = self._features(self.net.logits(x_all, index), text, len(y) - bounds[2])
        brief = self._beginnings(index[:: max(1, 5 * len(index) // max(1, len(short)))], short_rng)
        brief = np.stack([self.net.logits(x_all, brief).astype(np.float64), np.zeros(len(brief))], axis=1)
        self.calibrated = Logistic(np.concatenate([top, brief]), np.concatenate([y[bounds[2] :].astype(float), np.zeros(len(brief))]))

    @staticmethod
    def _beginnings(index: np.ndarray, r: np.random.Generator) -> np.ndarray:
        """The windows cut to their beginnings, from nothing to half; every fourth is empty."""
        out = np.where(np.arange(WINDOW) < r.integers(0, WINDOW // 2, len(index))[:, None], index, -1)
        out[::4] = -1
        return out

    def _features(self, logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        first = np.searchsorted(text, np.arange(n))
        return np.stack([np.maximum.reduceat(logits.astype(np.float64), first), np.log(np.minimum(np.diff(np.append(first, len(text))), self.most))], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of texts given as single-spaced words."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        w = Words(texts)
        index, text = windows(w.text_end)
        return self.calibrated(self._features(self.net.logits(word_inputs(w, self.tables), index), text, len(texts)))


def joined_words(text):
    return F.array_join(words(text), " ")


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return ToxicityModel(sample(documents, labels, "toxic", usable, per_class, max_chars, joined_words))


def score_toxicity(documents: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """The documents with a column `out` of scores from 0 to 1; higher is more toxic."""
    if out.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"the documents have a column {out} already")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # tables and weights of a fixed size

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        texts, out, at = text.to_pylist(), [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= 500_000):
                size += len(texts[end])
                end += 1
            out.append(shared.value.scores(texts[at:end]))
            at = end
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return documents.withColumn(out, score(joined_words(F.col("text"))))
