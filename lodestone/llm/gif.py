"""Media columns: GIF encoding and decoding of byte payloads as 8-bit samples.

The writer lays a payload out as rows of 192 grey samples, up to 64 rows to a frame, each frame LZW-compressed with
its place, delay and disposal. The reader is a GIF reader in its own right: it walks the blocks, decodes the LZW code
streams (interlaced or not), applies global or local palettes, transparency and the disposal rules, and gives timed
frames with colour histograms.

LZW decoding works on all codes of a table period at once: between two clear codes the width of the i-th code depends
on i only, each table entry is a slice of the output that was made so far, and the copies are resolved by pointer
doubling, so the time is linear in the output with a small logarithmic factor.

Cases: null text is an empty payload (192 spaces); equal texts give equal media and values (ties too); very long texts
are stored whole, frame after frame; truncated or malformed media raise ValueError; a null doc_id stays null; repeated
rows give a row each; an empty table gives an empty one; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import by_size

WIDTH = 192
ROWS = 64
#: Hundredths of a second that each frame shows.
DELAY = 4
MAX_CODE = 4096


def pad(payload: bytes) -> bytes:
    """Spaces appended up to a positive multiple of WIDTH."""
    return payload.ljust(max(1, -(-len(payload) // WIDTH)) * WIDTH, b" ")


def _widths(depth: int) -> np.ndarray:
    """Bits of the i-th code after a clear code, as the reader's table grows by one entry with each code but the first."""
    entries = (1 << depth) + 2 + np.maximum(np.arange(MAX_CODE - (1 << depth) - 1) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)


_WIDTHS = {d: _widths(d) for d in range(2, 9)}


def lzw_encode(samples: bytes, depth: int = 8) -> bytes:
    clear, end = 1 << depth, (1 << depth) + 1
    periods: list[list[int]] = []
    table: dict[int, int] = {}
    codes, free, prefix = [], clear + 2, -1
    get, limit = table.get, MAX_CODE - 2
    for b in samples:
        if prefix < 0:
            prefix = b
            continue
        pair = prefix << 8 | b
        code = get(pair)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = b
        if free < limit:
            table[pair] = free
            free += 1
        else:  # the table is full: start over, before any reader could disagree about its size
            periods.append(codes)
            codes, free = [], clear + 2
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    periods.append(codes)
    values, bits = [np.array([clear])], [np.array([depth + 1])]
    widths = _WIDTHS[depth]
    for k, codes in enumerate(periods):
        last = k == len(periods) - 1
        values.append(np.array([*codes, end if last else clear]))
        bits.append(widths[: len(codes) + 1])
    return _pack_bits(np.concatenate(values), np.concatenate(bits))


def _pack_bits(values: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes of given widths, least significant bit first."""
    lanes = (values[:, None] >> np.arange(12)) & 1
    return np.packbits(lanes[np.arange(12) < bits[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, depth: int, size: int) -> np.ndarray:
    """The first `size` samples of a code stream."""
    clear, end = 1 << depth, (1 << depth) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    total, at, made, out = 8 * len(data), 0, 0, []
    all_widths, base = _WIDTHS[depth], clear + 2
    starts = np.concatenate([[0], np.cumsum(all_widths)])
    over = False
    while made < size and not over:
        # every code up to the next clear code, at most a table's worth; a full table goes on with 12 bits
        n = int(np.searchsorted(starts, total - at, side="right")) - 1
        if n <= 0:
            break
        off = at + starts[:n]
        byte = off >> 3
        window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (window >> (off & 7)) & ((1 << all_widths[:n]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if len(stop):
            first = int(stop[0])
            over = codes[first] == end
            at += int(starts[first + 1])
            codes = codes[:first]
            more = np.empty(0, dtype=np.int64)
        else:
            at += int(starts[n])
            more = np.empty(0, dtype=np.int64)
            if n == len(all_widths):
                m = (total - at) // 12
                off = at + 12 * np.arange(m)
                byte = off >> 3
                more = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (off & 7)) & 4095
                stop = np.flatnonzero((more == clear) | (more == end))
                if len(stop):
                    over = more[stop[0]] == end
                    at += 12 * (int(stop[0]) + 1)
                    more = more[: int(stop[0])]
                else:
                    over = True
            else:
                over = True
        if len(codes) or len(more):
            part = _expand(np.concatenate([codes, more]), clear, base, MAX_CODE - base)
            out.append(part)
            made += len(part)
    found = np.concatenate(out) if out else np.empty(0, dtype=np.uint8)
    if len(found) < size:
        raise ValueError("image data ends early")
    return found[:size]


def _expand(codes: np.ndarray, clear: int, base: int, room: int) -> np.ndarray:
    """The samples that the codes of one table period stand for."""
    n = len(codes)
    entry = codes - base
    where = np.arange(n)
    if (entry >= np.minimum(where, room)).any():
        raise ValueError("a code before its table entry")
    # lengths: an entry is one longer than the code it was made after; chains of codes are resolved by doubling
    up = np.where(entry >= 0, entry, where)
    length = (entry >= 0).astype(np.int64)
    while True:
        nxt = up[up]
        if (nxt == up).all():
            break
        length = length + length[up]
        up = nxt
    length += 1
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    total = int(start[-1] + length[-1])
    owner = np.repeat(where, length)
    inside = np.arange(total) - start[owner]
    own = entry[owner]
    source = np.where(own >= 0, start[np.maximum(own, 0)] + inside, np.arange(total))
    while True:
        nxt = source[source]
        if (nxt == source).all():
            break
        source = nxt
    literal = np.zeros(total, dtype=np.uint8)
    heads = entry < 0
    literal[start[heads]] = codes[heads]
    return literal[source]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes) -> bytes:
    """A grey animated GIF whose frames hold the payload's samples in order."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload isn't padded")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(rows, ROWS).to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for at in range(0, rows, ROWS):
        n = min(ROWS, rows - at)
        out.append(b"\x21\xf9\x04" + bytes([1 << 2]) + DELAY.to_bytes(2, "little") + b"\0\0")
        out.append(b"\x2c\0\0\0\0" + WIDTH.to_bytes(2, "little") + n.to_bytes(2, "little") + b"\0\x08")
        out.append(_blocks(lzw_encode(payload[at * WIDTH : (at + n) * WIDTH])))
    return b"".join([*out, b";"])


@dataclass
class Frame:
    index: int
    start_cs: int
    delay_cs: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    canvas: np.ndarray  # height x width x 4 (RGBA) after this frame is drawn
    samples: np.ndarray  # the frame's own colour indices, in image order


def _interlaced(height: int) -> np.ndarray:
    """Row order of an interlaced image: passes over every 8th, 8th from 4, 4th from 2, 2nd from 1."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes) -> Iterator[Frame]:
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    w, h, flags = int.from_bytes(media[6:8], "little"), int.from_bytes(media[8:10], "little"), media[10]
    at, palette = 13, None

    def colours(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        table = np.frombuffer(media[at : at + 3 * n], dtype=np.uint8)
        if len(table) < 3 * n:
            raise ValueError("the palette ends early")
        at += 3 * n
        return table.reshape(n, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while True:
            if at >= len(media):
                raise ValueError("a block ends early")
            n = media[at]
            at += 1
            if not n:
                return b"".join(parts)
            parts.append(media[at : at + n])
            at += n

    if flags & 0x80:
        palette = colours(flags & 7)
    canvas = np.zeros((h, w, 4), dtype=np.uint8)
    clock, index, control = 0, 0, None
    while at < len(media) and media[at] != 0x3B:
        kind = media[at]
        at += 1
        if kind == 0x21:
            label = media[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None)
        elif kind == 0x2C:
            x, y, fw, fh = (int.from_bytes(media[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
            local = media[at + 8]
            at += 9
            table = colours(local & 7) if local & 0x80 else palette
            if table is None:
                raise ValueError("no palette")
            depth = media[at]
            at += 1
            if not 2 <= depth <= 8:
                raise ValueError("bad code size")
            samples = lzw_decode(blocks(), depth, fw * fh)
            rows = samples.reshape(fh, fw)
            if local & 0x40:
                straight = np.empty_like(rows)
                straight[_interlaced(fh)] = rows
                rows = straight
            disposal, delay, clear = control or (0, 0, None)
            before = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + fh, x : x + fw]
            seen = rows[: part.shape[0], : part.shape[1]]
            if int(seen.max(initial=0)) >= len(table):
                raise ValueError("a colour outside the palette")
            drawn = np.dstack([table[seen], np.full(seen.shape, 255, dtype=np.uint8)])
            if clear is None:
                part[:] = drawn
            else:
                shown = seen != clear
                part[shown] = drawn[shown]
            yield Frame(index, clock, delay, x, y, fw, fh, disposal, canvas.copy(), rows.reshape(-1))
            clock, index, control = clock + delay, index + 1, None
            if disposal == 2:
                part[:] = 0
            elif before is not None:
                canvas = before
        else:
            raise ValueError("unknown block")


def histogram(canvas: np.ndarray, bits: int = 2) -> np.ndarray:
    """Pixels of each colour cell (the top `bits` of red, green and blue) among those drawn."""
    seen = canvas[canvas[..., 3] > 0][:, :3] >> (8 - bits)
    cell = (seen[:, 0].astype(np.int64) << 2 * bits) | (seen[:, 1].astype(np.int64) << bits) | seen[:, 2]
    return np.bincount(cell, minlength=1 << 3 * bits)


def read_payload(media: bytes) -> bytes:
    """What encode() stored: the red samples of each frame's rectangle, in frame order."""
    return b"".join(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes() for f in decode(media))


def _store(batches):
    for b in by_size(batches, 1):
        raw = [(x or "").encode() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded UTF-8 bytes as a GIF."""
    return documents.select("doc_id", "text").mapInArrow(_store, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FRAME = "index:int,start_cs:bigint,delay_cs:int,left:int,top:int,width:int,height:int,disposal:int,histogram:array<int>"
DECODED = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{FRAME}>>"


def _decoded(id_type: pa.DataType):
    frame = pa.struct([(n, pa.list_(pa.int32()) if n == "histogram" else pa.int64() if n == "start_cs" else pa.int32()) for n in (x.split(":")[0] for x in FRAME.split(","))])
    names = ("doc_id", *(x.split()[0] for x in DECODED.split(", ")))
    schema = pa.schema(list(zip(names, (id_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(frame)))))

    def run(batches):
        for b in by_size(batches, 2):
            rows = []
            for doc, size, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                sha, n, tail, frames = hashlib.sha256(), 0, b"", []
                for f in decode(media):
                    part = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
                    sha.update(part)
                    n, tail = n + len(part), (tail + part)[-16:]
                    frames.append({"index": f.index, "start_cs": f.start_cs, "delay_cs": f.delay_cs, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "histogram": histogram(f.canvas).astype(np.int32)})
                rows.append((doc, size, n, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), frames))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def decode_media(media: DataFrame) -> DataFrame:
    """One row per stored medium (doc_id, n_bytes, media): digests of the medium and of the payload read back from it, and its
    timed frames, each with its place, disposal and the colour histogram of what it shows. Rows without media are left out."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = media.schema["doc_id"].dataType
    return media.select("doc_id", "n_bytes", "media").where("media is not null").mapInArrow(_decoded(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {DECODED}")


def frames(decoded: DataFrame) -> DataFrame:
    """One row per frame."""
    return decoded.select("doc_id", F.explode("frames").alias("f")).select("doc_id", "f.*")
