"""Line dedup, WARC, packing, URL filter, quality, toxicity and decontamination on small fixtures."""

import base64
import glob
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from lodestone.llm import common, line_dedup, packing, quality, queries, toxicity, url_filter, warc
from lodestone.llm.decontaminate import decontaminate, drop_contaminated, gram_sizes


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("t", range(1, 14))
def test_gram_sizes(t):
    k, w = gram_sizes(t)
    assert k + w - 1 == t and k & (k - 1) == 0 and k >= 1 and w >= 1


def contaminated(docs, items, t=13):
    out = []
    for _, text in docs:
        w, hit, names = words(text), set(), set()
        for item, body in items:
            b = words(body)
            if item is None or not b:
                continue
            n = min(t, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    names.add(str(item))
        out.append((len(w), len(hit), sorted(names)))
    return out


def holds_window(docs, items, t=13):
    long_items = [(i, b) for i, b in items if len(words(b)) >= t]
    return [bool(hit) for _, hit, _ in contaminated(docs, long_items, t)]


@pytest.mark.parametrize("broadcast_rows", [10**6, 1])
def test_decontamination(spark, broadcast_rows):
    r = random.Random(1)
    prose = lambda n, v=60: " ".join(r.choice("ab Éé0") .strip() + f"w{r.randrange(v)}" for _ in range(n))
    items = [(1, prose(40)), (2, prose(13)), (3, "Two words"), (4, ""), (None, "alpha beta"), (5, None), (6, "solo"), (2, "another text of item two")]
    docs = [(i, prose(50)) for i in range(5)] + [(9, items[0][1].upper()), (9, items[0][1].upper()), (10, "x " + items[1][1] + " y, TWO, words; " + prose(30)), (11, None), (12, ""), (None, "solo"), (13, "ha " * 500), (14, items[0][1][:60]), (15, prose(900, 9000) + " " + items[1][1]), (16, "q " * 200_000)]
    df = spark.createDataFrame([(*d, "extra", 1, 2, 3) for d in docs], "doc_id long, text string, items string, t int, _row int, _key int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(df, bench, broadcast_rows=broadcast_rows).collect()
    want = contaminated(docs, items)
    key = lambda i, x: (i is None, i or 0, x)
    assert sorted(key(g.doc_id, (g.n_words, g.n_hit, g["items"])) for g in got) == sorted(key(d[0], w) for d, w in zip(docs, want))
    assert all(g.contaminated == (g.n_hit > 0 and 20 * g.n_hit >= g.n_words) for g in got)
    kept = drop_contaminated(df, bench, broadcast_rows=broadcast_rows)
    stay = [d[0] for d, (n, h, _), whole in zip(docs, want, holds_window(docs, items)) if not whole and not (h > 0 and 20 * h >= n)]
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, stay)) and 15 not in stay
    assert decontaminate(df.limit(0), bench).count() == 0 and decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_line_dedup(spark, broadcast_rows):
    foot = "all rights kept"
    rows = [("h", f"line {i}\n{foot}\n\nline {i}") for i in range(20)] + [("h", "copy of one")] * 30 + [("few", f"{foot}\nz"), ("few", f"{foot}\ny"), ("one", foot), (None, foot), ("h", None), ("h", "")]
    rows += [("even", f"tie\nown {i}" if i == 0 else f"own {i}") for i in range(10)] + [("long", "\n".join(f"l{i}" for i in range(50_000)))]
    df = spark.createDataFrame([(s, t, 1, "k", 2, 3, 4) for s, t in rows], "source string, text string, _other int, host string, _bad int, _site int, _n_lines int")
    pages = {}
    for s, t in rows:
        if s is not None and t is not None:
            pages.setdefault(s, []).append(t)

    def stays(s, x):
        having = [t for t in pages.get(s, []) if x in t.split("\n")]
        return not x.strip() or len(set(having)) < 2 or len(having) / len(pages[s]) <= 0.1

    want = [(s, None if t is None else "\n".join(x for x in t.split("\n") if stays(s, x))) for s, t in rows[:-1]] + [rows[-1]]
    got = line_dedup.drop_boilerplate(df, counts=("n", "gone"), broadcast_rows=broadcast_rows)
    assert got.columns == [*df.columns, "n", "gone"]
    got = got.collect()
    assert sorted(((r.source, r.text) for r in got), key=repr) == sorted(want, key=repr) and all(tuple(r)[2:7] == (1, "k", 2, 3, 4) for r in got)
    lines = lambda t: 0 if t is None else len(t.split("\n"))
    assert sum(r.gone for r in got) == 20 + 2 and sum(r.n for r in got) == sum(lines(t) for _, t in rows)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_boilerplate(df, counts=("_N_lines", "x"))


def test_warc(spark):
    rows = [(3, "http://a/", "same"), (1, "http://b/\n", "same"), (2, None, None), (7, "u", ""), (5, "v", "ä" * 300_000), (5, "v", "ä" * 300_000), (None, "w", "same"), (9, "http://c/%20?a b", "other")]
    pages = spark.createDataFrame([(*r, b"x", "y") for r in rows], "page_id long, url string, html string, archive binary, first string")
    got = warc.read_archives(warc.write_archives(pages, segment_bytes=500)).collect()
    assert len(got) == len(rows) and all(g.ok for g in got)
    by = {g.page_id: g for g in got}
    assert (by["1"].record_type, by["3"].record_type, by["3"].refers_to, by[None].refers_to) == ("response", "revisit", "1", "1")
    assert (by["2"].record_type, by["7"].refers_to, by["7"].payload_bytes) == ("response", "2", 0)
    assert by["5"].payload_bytes == 600_000 and by["5"].payload_digest == base64.b32encode(hashlib.sha1(("ä" * 300_000).encode()).digest()).decode()
    assert by["1"].url == "http://b/%0A" and by["9"].url == "http://c/%20?a b" and bytes(by["1"].payload) == b"same" and by["3"].payload is None
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_detects_damage():
    good = warc.record_parts(1, "u", b"payload")
    read = lambda parts: [r["ok"] for r in warc.read_archive(warc.gzip_member(parts))]
    assert read(good) == [True]
    assert read([x.replace(b"payload", b"pAyload") for x in good]) == [False]
    assert read([*good, b"more"]) == [False] and read(good[:-1]) == [False] and read([*good[:2], b"pay"]) == [False]
    with pytest.raises(ValueError):
        list(warc.read_archive(warc.gzip_member(good)[:-9]))


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_warc_reads_in_pieces(monkeypatch, size):
    monkeypatch.setattr(warc, "READ_BYTES", size)
    monkeypatch.setattr(warc, "INFLATED", max(1, size // 3))
    payloads = [b"", b"\r\n\r\n" * 50, bytes(range(256)) * 40]
    archive = b"".join(warc.gzip_member(warc.record_parts(i, None, p)) for i, p in enumerate(payloads))
    got = list(warc.read_archive(archive))
    assert [g["payload"] for g in got] == payloads and all(g["ok"] for g in got)


def test_warc_record_ids(spark):
    pages = spark.createDataFrame([(i % 7, "u", f"text {i % 3}") for i in range(20)] + [(None, "u", "text 0")], "page_id long, url string, html string")
    ids = [r["fields"]["warc-record-id"] for a in warc.write_archives(pages.repartition(3)).collect() for r in warc.read_archive(bytes(a.archive))]
    repeats = sum(n - 1 for n in __import__("collections").Counter(i for i in ids).values())
    assert len(ids) == 21 and repeats <= 2 and all(i.startswith("<urn:page:") for i in ids)


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, mine = Tokenizer.from_file(path), packing.ByteTokenizer(path)
    assert mine.slow is None
    texts = ["", " ", "a  b\n\n c", "it's I'LL 123 ñandú!!", "x<|endoftext|>y <|endoftext|>", "  x\t\ty", "日本語 text\r\n", "word " * 300_000, "  lead", "\x1c\x1f a"]
    for x in texts:
        assert mine.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, x[:20]


def test_hilbert_neighbours_are_adjacent():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_packing(spark):
    texts = ["", None, "hello world", "a b c " * 3000, "hello world", "tail"]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, key int, tokens string")
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    t = packing.ByteTokenizer(queries.tokenizer_path())
    ids = {i if i != 5 else None: np.append(t.encode(x or ""), np.uint32(1)) for i, x in enumerate(texts)}
    for doc, want in ids.items():
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))] and sum(r.length for r in mine) == len(want)
        assert all(r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].astype("<u4").tobytes()) and r.doc_tokens == len(want) for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_url_rules_and_propagation(spark):
    def page(i, url, *links):
        return (i, url, "".join(f"<a href='http://{x}/'>x</a>" for x in links), "extra")

    rows = [page(1, "http://EXAMPLE.com/en/712?x"), page(2, "https://a.example.net/de/81"), page(3, "https://a.example.net/de/7"), page(4, "http://x.org/es/"), page(5, None), page(6, "no scheme"),
            page(7, "http://good.net/de/", "Linked.test"), page(8, "http://linked.test/a#b"), page(9, "http://bad.com/en/"), page(10, "http://points.test/q?r", "bad.com"), page(11, "http://example.com"), page(13, "http://LONG.example.com/" + "y" * 300_000, *["far.test"] * 20_000), page(13, "http://LONG.example.com/" + "y" * 300_000), page(12, "http://com/en/1")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), threshold=0.1).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("example.com", "/en/712", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict) == ("example.net/de/8", "block", "net/de/", "allow")
    assert got[4].verdict == "block" and (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("", "", None, "allow") == (got[6].host, got[6].path, got[6].rule, got[6].verdict)
    assert got[8].verdict == "allow" and got[8].path == "/a" and got[10].verdict == "block" and got[10].rule is None
    assert got[12].rule == "com/en/" and got[11].path == "" and got[13].host == "long.example.com" and len(got[13].path) == 300_001
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def labelled(n, seed=3):
    r = random.Random(seed)
    syllables = ["ta", "ri", "on", "el", "mi", "so", "ka", "ne"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["slurp", "slurpy", "grubs"]))
        low = i % 3 == 0
        if low:
            w = [x + r.choice(["!!", "$$", "%%"]) for x in w]
        rows.append((i, " ".join(w), 0 if low else 1, int(toxic)))
    return rows


def test_quality_and_toxicity_on_held_out_rows():
    train, held = labelled(400), labelled(200, seed=4)
    q = quality.QualityModel([(t, y) for _, t, y, _ in train]).scores([t for _, t, _, _ in held])
    assert np.mean((q >= 0.7) == [y == 1 for _, _, y, _ in held]) > 0.95 and ((0 <= q) & (q <= 1)).all()
    join = lambda t: " ".join(words(t))
    m = toxicity.ToxicityModel([(join(t), y) for _, t, _, y in train])
    x = m.scores([join(t) for _, t, _, _ in held])
    assert np.mean((x >= 0.5) == [y == 1 for _, _, _, y in held]) > 0.95
    one = m.scores(["", "ta ri", "ta ri", "ta rion " * 5000 + "slurp mika grubs so slurpy"])
    assert one[1] == one[2] and one[3] > 0.5 > one[0]


def test_scores_do_not_depend_on_the_batch():
    rows = labelled(60)
    for model in (quality.QualityModel([(t, y) for _, t, y, _ in rows]), toxicity.ToxicityModel([(t, y) for _, t, _, y in rows])):
        texts = [t for _, t, _, _ in rows]
        alone = [model.scores([t])[0] for t in texts]
        for n in (2, 3, 7, 60):
            assert alone == [x for at in range(0, 60, n) for x in model.scores(texts[at : at + n])]


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    x, index = r.standard_normal((40, toxicity.INPUTS)).astype(np.float32), np.where(r.random((5, toxicity.WINDOW)) < 0.8, r.integers(0, 40, (5, toxicity.WINDOW)), -1)
    y, weight, net = np.array([0, 1, 1, 0, 1], np.float32), np.full(5, 0.2, np.float32), toxicity.GatedNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.logits(x, index).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    g = net.gradients(x, index, y, weight)
    for k, v in net.p.items():
        at = tuple(s // 2 for s in v.shape)
        keep = v[at]
        v[at] = keep + 1e-2
        up = loss()
        v[at] = keep - 1e-2
        down = loss()
        v[at] = keep
        assert (up - down) / 2e-2 == pytest.approx(float(g[k][at]), abs=2e-3, rel=0.05)


def test_scores_of_tables(spark):
    rows = labelled(120)
    docs = spark.createDataFrame([(i, t, "e") for i, t, _, _ in rows] + [(None, None, "e"), (5, "", "e"), (-1, "so mi taon! " * 100_000, "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, fit, score in ((quality, quality.fit, quality.score_quality), (toxicity, toxicity.fit, toxicity.score_toxicity)):
        out = score(docs, fit(docs, labels), "_s").collect()
        assert len(out) == 123 and all(0 <= r["_s"] <= 1 for r in out)
        none = score(docs, fit(docs, labels.limit(0)), "_s").select("_s").distinct().collect()
        assert len(none) == 1
        assert score(docs.limit(0), fit(docs, labels), "_s").count() == 0
        with pytest.raises(ValueError):
            score(docs, fit(docs, labels), "Score")


def test_work_tables_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    local = lambda: {f for top in spark.sparkContext._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf()) for f in glob.glob(f"{top}/**/shuffle_*", recursive=True)}
    old = local()
    out = common.work_table(spark, spark.range(50_000).repartition(7, "id"), "swept")
    for _ in range(50):
        if not local() - old:
            break
        time.sleep(0.2)
    assert not local() - old
    assert out.count() == 50_000 and spark.conf.get(name, None) == before
    common.discard(out)
