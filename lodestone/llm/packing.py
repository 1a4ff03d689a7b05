"""Packing along a space-filling curve.

Each document's tokens are hashed into a vector, projected to three dimensions, and ordered by Hilbert key; the
documents are range-partitioned by (key, doc_id) and each partition is cut into sequences of `length` tokens in that
order, so neighbours on the curve share sequences. The rest of a partition that doesn't fill a sequence becomes
sequences at powers of two, which need no padding.

Plan: tokens are made once and written, as 2-byte ids where the vocabulary allows, to the shared folder; the range
exchange samples that table, not the tokenizer. Ties on the key are dealt by doc_id, so a hot group of equal
documents spreads over partitions. A packing task holds one open sequence.

Cases: null text counts as empty; an empty text is the single end id; a null doc_id stays null; repeated rows are
packed each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import work_table

LENGTH = 2048
END = 1
#: Hashed dimensions of a document vector, dimensions it is projected to, bits of each on the curve, seed of the projection.
HASHED, DIMS, BITS, SEED = 512, 3, 16, 20240229
#: Texts are tokenized in pieces of about so many characters, cut where no token can span.
PIECE = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable bytes as themselves, others from U+0100 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The usual byte-level pre-token pattern, and the same for texts that have no two white-space characters in a row,
#: where the look-ahead never matters and the faster regular-expression engine can run.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=\s)")


class ByteTokenizer:
    """Ids as the `tokenizers` library gives them for a byte-level BPE file, by the quicker library when that is sure to agree.

    It agrees where the merges come in the order of their ids; otherwise, or for other kinds of files, `tokenizers` runs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        self.special = {x["content"]: x["id"] for x in added}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = 1 + max([*model["vocab"].values(), *self.special.values()])
        letters = _byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        if plain and ids == sorted(ids) and -1 not in ids and not any(x.get("normalized") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
            import tiktoken

            ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in self.special}
            self.any = tiktoken.Encoding("any", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            self.single = tiktoken.Encoding("single", pat_str=PATTERN_SINGLE, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            self.slow = None
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            cut = _CUT.search(text, at + PIECE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        if self.slow:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                run = self.any if _RUN.search(part) else self.single
                for piece in self._pieces(part):
                    out += run(piece)
        return np.array(out, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of non-negative integer coordinates below 2**bits; dims * bits is at most 62.

    Axes to transposed index by undoing the curve's rotations from the top bit down, then the bits interleaved."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        below = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(flip, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray = np.zeros(x.shape[1], dtype=np.int64)
    q = top
    while q > 1:
        gray = np.where((x[n - 1] & q) != 0, gray ^ (q - 1), gray)
        q >>= 1
    x ^= gray
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@functools.lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((HASHED, DIMS)).astype(np.float32)


def document_point(ids: np.ndarray) -> np.ndarray:
    """Curve coordinates of a document: hashed log counts on the unit sphere, projected, squashed into the grid."""
    buckets = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - HASHED.bit_length() + 1)
    v = np.log1p(np.bincount(buckets, minlength=HASHED).astype(np.float32))
    v /= max(float(np.sqrt(v @ v)), 1e-9)
    p = v @ _projection()
    return np.clip((0.5 + np.arctan(p) / np.pi) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


TOKENS = "doc_id {id}, key long, tokens binary"
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenize(path: str, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("key", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        t = tokenizer(path)
        kind = np.uint16 if t.size <= 1 << 16 else np.uint32
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                all_ids = [np.append(t.encode(x or ""), np.uint32(END)) for x in part.column(1).to_pylist()]
                keys = hilbert_keys(np.array([document_point(x) for x in all_ids]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([x.astype(kind).tobytes() for x in all_ids], pa.binary())], schema=schema)

    return run


def _cut(length: int, wide: bool, id_type: pa.DataType):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, id_type if n == "doc_id" else pa.int64()) for n in names])

    def run(batches):
        sequence = TaskContext.get().partitionId() << 33
        filled, open_pieces, rows = 0, [], []

        def put(doc, start, ids, total, seq, offset):
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, offset))

        def flush():
            cols = list(zip(*rows))
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_buffer(), dtype=np.uint32 if wide else np.uint16)
                start = 0
                while start < len(ids):
                    take = min(length - filled, len(ids) - start)
                    open_pieces.append((doc, start, ids[start : start + take], len(ids), filled))
                    start, filled = start + take, filled + take
                    if filled == length:
                        for d, s, x, n, o in open_pieces:
                            put(d, s, x, n, sequence, o)
                        sequence, filled = sequence + 1, 0
                        open_pieces.clear()
                if len(rows) >= 4096:
                    yield flush()
        # what is left: sequences at the powers of two that make it up, largest first
        ends = []
        for b in range(filled.bit_length() - 1, -1, -1):
            if filled >> b & 1:
                ends.append((ends[-1] if ends else 0) + (1 << b))
        begin = 0
        for end in ends:
            for d, s, x, n, o in open_pieces:
                lo, hi = max(begin, o), min(end, o + len(x))
                if lo < hi:
                    put(d, s + lo - o, x[lo - o : hi - o], n, sequence, lo - begin)
            sequence, begin = sequence + 1, end
        if rows:
            yield flush()

    return run


def pack(documents: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    tokens = documents.select("doc_id", "text").mapInArrow(_tokenize(tokenizer_path, arrow), TOKENS.format(id=name))
    tokens = work_table(spark, tokens, "tokens")
    along = tokens.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "tokens")
    return along.mapInArrow(_cut(length, tokenizer(tokenizer_path).size > 1 << 16, arrow), PIECES.format(id=name))
