import numpy as np
import pytest

from lodestone.llm import gif


def plain_lzw(data, depth, size):
    """A code-by-code decoder to compare with."""
    clear, end, bits, pos, out, table, old = 1 << depth, (1 << depth) + 1, int.from_bytes(data, "little"), 0, [], [], None
    width = depth + 1
    while len(out) < size:
        code = bits >> pos & ((1 << width) - 1)
        pos += width
        if code == clear:
            table, width, old = [bytes([i]) for i in range(clear)] + [b"", b""], depth + 1, None
            continue
        if code == end:
            break
        s = table[code] if code < len(table) else old + old[:1]
        out += s
        if old is not None and len(table) < 4096:
            table.append(old + s[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        old = s
    return bytes(out[:size])


@pytest.mark.parametrize("data", [b" " * 192, bytes(range(256)) * 60, b"ab" * 96 * 500, np.random.default_rng(1).integers(0, 256, 192 * 300, dtype=np.uint8).tobytes(), np.random.default_rng(2).integers(97, 101, 192 * 900, dtype=np.uint8).tobytes(), b"a" * 192 * 400])
def test_round_trip(data):
    stored = gif.encode(gif.pad(data))
    assert gif.read_payload(stored) == gif.pad(data)
    codes = gif.lzw_encode(data)
    assert plain_lzw(codes, 8, len(data)) == data
    assert gif.lzw_decode(codes, 8, len(data)).tobytes() == data


def test_small_depth_and_full_table_without_clear():
    # a writer that never clears: the table stays full at 12 bits
    data = np.random.default_rng(3).integers(0, 4, 60_000, dtype=np.uint8).tobytes()
    clear, table, codes, prefix = 4, {bytes([i]): i for i in range(4)}, [4], b""
    free = 6
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        codes.append(table[prefix])
        if free < 4096:
            table[prefix + bytes([b])] = free
            free += 1
        prefix = bytes([b])
    codes += [table[prefix], 5]
    size, width, n, bits, pos = 6, 3, 0, 0, 0
    for k, c in enumerate(codes):
        bits |= c << pos
        pos += width
        if k >= 2 and size < 4096:
            size += 1
            if size == 1 << width and width < 12:
                width += 1
    raw = bits.to_bytes(-(-pos // 8), "little")
    assert plain_lzw(raw, 2, len(data)) == data
    assert gif.lzw_decode(raw, 2, len(data)).tobytes() == data


def frame(x, y, w, h, samples, disposal=0, clear=None, delay=5, interlaced=False):
    head = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
    place = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([0x40 * interlaced, 2])
    return head + place + gif._blocks(gif.lzw_encode(bytes(samples), 2))


def test_palette_transparency_disposal_and_time():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + b"\xf1\0\0" + palette
    media = head + frame(0, 0, 2, 2, [1, 1, 1, 1]) + frame(0, 0, 2, 1, [2, 3], disposal=3, clear=3) + frame(1, 1, 1, 1, [3], disposal=2) + frame(0, 0, 1, 1, [2]) + b";"
    got = list(gif.decode(media))
    assert [f.start_cs for f in got] == [0, 5, 10, 15]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert got[1].canvas.tolist() == [[green, red], [red, red]]
    assert got[2].canvas.tolist() == [[red, red], [red, blue]]
    assert got[3].canvas.tolist() == [[green, red], [red, none]]
    assert gif.histogram(got[3].canvas).sum() == 3


def test_interlaced_rows():
    head = b"GIF89a" + (1).to_bytes(2, "little") + (9).to_bytes(2, "little") + b"\xf1\0\0" + bytes(range(12))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    media = head + frame(0, 0, 1, 9, [r % 4 for r in order], interlaced=True) + b";"
    assert next(gif.decode(media)).samples.tolist() == [r % 4 for r in range(9)]


@pytest.mark.parametrize("broken", [b"", b"GIF89a", gif.encode(b" " * 192)[:-20], b"PNG" + b"\0" * 20])
def test_malformed_raises(broken):
    with pytest.raises(ValueError):
        list(gif.decode(broken))
        gif.read_payload(broken)


def test_table(spark):
    import hashlib
    import zlib

    texts = ["", None, "ä" * 500, "word " * 30_000, "word " * 30_000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1)], "doc_id long, text string, media string, frames int")
    decoded = gif.decode_media(gif.store_texts(docs))
    rows = {r.doc_id: r for r in decoded.collect()}
    for i, t in enumerate(texts):
        raw = gif.pad((t or "").encode())
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len((t or "").encode()), len(raw))
        assert rows[i].payload_sha256 == hashlib.sha256(raw).hexdigest() and rows[i].tail_crc32 == zlib.crc32(raw[-16:])
    assert rows[3].media_sha256 == rows[4].media_sha256
    assert rows[None].n_bytes == 5 and len(rows) == 6
    timed = gif.frames(decoded).where("doc_id = 3").orderBy("index").collect()
    assert len(timed) == len(rows[3].frames) > 1 and [f.start_cs for f in timed] == [gif.DELAY * i for i in range(len(timed))]
    assert sum(timed[0].histogram) == gif.WIDTH * gif.ROWS
    assert gif.decode_media(gif.store_texts(docs.limit(0))).count() == 0


def test_query_reads_stored_media(spark, monkeypatch):
    from lodestone.llm import queries

    made, write = [], queries.work_table
    monkeypatch.setattr(queries, "work_table", lambda spark, df, name: made.append(write(spark, df, name)) or made[-1])
    out = queries.op6_gif(spark, "/root/testdata/sf0.001")
    media, frames = made
    assert "media" in media.columns and media.count() == out.count() == frames.count()
    assert set(frames.inputFiles()) == set(out.inputFiles()) and frames.where("size(frames) = 0").count() == 0
