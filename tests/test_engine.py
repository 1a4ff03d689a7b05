import json
import os
import random
import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.api import Index
from lodestone.functions import text as tx
from lodestone.functions.highlight import highlight, highlighted_lines, mark
from lodestone.operators import fulltext as ft
from lodestone.operators import hybrid as hy
from lodestone.operators import vector as vc
from lodestone.operators import embed as em
from lodestone.operators import snapshot as sn
from lodestone.operators.snapshot import fill_batches
from lodestone.options import Query, SearchOptions, match_phrases, searchable
from lodestone.sources.ignore import IgnoreTree, opinion, parse_rules
from lodestone.sources.scan import find_root, look, scan, walk
from lodestone.sources.settings import Settings
from lodestone.streaming import changes as ch


def make(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    (root / ".git").mkdir(exist_ok=True)
    return root


NESTED = {
    ".gitignore": "*.txt\n", "README.md": "# hi", "skip.txt": "x", "app/.gitignore": "node_modules/\n", "app/index.js": "run();", "app/package.json": "{}",
    "app/node_modules/a/b.js": "x", "server/.gitignore": "venv/\n__pycache__/\n", "server/__init__.py": "", "server/main.py": "import os\n", "server/a.md": "a",
    "server/venv/x.py": "x", "server/__pycache__/m.pyc": "x", "server/note.txt": "n", ".venv/y.py": "y", "lib/u.go": "package u\n",
}
KEPT = {k for k in NESTED if not any(x in k for x in (".txt", "node_modules", "venv/", "__pycache__"))}


def test_walk_and_source_agree(spark, tmp_path):
    root = make(tmp_path, NESTED)
    os.symlink(root / "README.md", root / "link.md")
    assert {p for p, _, _ in walk(root)} == KEPT
    assert {r.path: bytes(r.content).decode() for r in scan(spark, root).collect()} == {k: NESTED[k] for k in KEPT}


def test_root(tmp_path):
    make(tmp_path, {"a/b/c.py": "", "a/.git": "gitdir: elsewhere"})
    assert find_root(tmp_path / "a" / "b") == tmp_path
    assert find_root(tmp_path / "a" / "b" / "c.py") == tmp_path
    assert find_root("/proc") is None


@pytest.mark.parametrize("rules,path,want", [
    ("*.py", "a/b.py", True), ("*.py", "a.pyc", None), ("/a.py", "b/a.py", None), ("/a.py", "a.py", True), ("a/b", "x/a/b", None), ("a/b", "a/b", True),
    ("**/c", "a/b/c", True), ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("build/", "build/x", True), ("build/", "src/build/x", True), ("*.py\n!k.py", "k.py", False),
    ("!k.py\n*.py", "k.py", True), ("doc/**", "doc/a/b", True), ("doc/**", "doc", None), ("**", "any/where", True), ("a\\*b", "a*b", True), ("a\\*b", "axb", None), ("[a/b]c", "ac", None), ("x\\ ", "x ", True), ("![", "[", False), ("/d/", "x/d/y", None), ("**/m/n", "q/m/n", True), ("#x", "#x", None), ("\\#x", "#x", True), ("a?c", "abc", True), ("a?c", "a/c", None), ("[ab].c", "b.c", True), ("[!ab].c", "b.c", None),
    ("[!ab].c", "d.c", True), ("x ", "x", True), ("/", "a", None), ("foo*/bar", "foox/bar", True), ("a**b", "axxb", True), ("[x", "[x", True),
])
def test_rules(rules, path, want):
    assert opinion(parse_rules(rules), path) is want


def test_nearest_rules_decide():
    t = IgnoreTree()
    t.add("", "*.log\n")
    t.add("a", "!keep.log\n")
    assert t.ignored("x.log") and t.ignored("a/x.log") and not t.ignored("a/keep.log") and not t.ignored("b.txt")


@pytest.mark.parametrize("text,phrases,keywords", [
    ("", (), ()), ('""', (), ()), ('"print(\\"hello world\\")"', ('print("hello world")',), ()), ('hello "world" how are you', ("world",), ("hello", "how", "are", "you")),
    ('"hello world" test "foo bar" baz', ("hello world", "foo bar"), ("test", "baz")), ('hello! "world?" how_are_you', ("world?",), ("hello!", "how_are_you")),
])
def test_query_parse(text, phrases, keywords):
    q = Query.parse(text)
    assert (q.phrases, q.keywords) == (phrases, keywords)


def test_query_parse_is_quick():
    t = time.time()
    q = Query.parse('"' + "a" * 100_000 + '" ' + "b" * 100_000)
    assert (len(q.phrases), len(q.keywords)) == (1, 1) and time.time() - t < 1


def test_match_phrases():
    assert match_phrases('print("x y") of') == ["print(", "x y"] and match_phrases('a "two\nlines" b') == ["two", "lines"]
    assert searchable(" abc ") and not searchable("ab ")
    assert match_phrases('"of the" Tion') == ["of the", "tion"] and match_phrases("a of") == [] and match_phrases('"open') == ["open"]


@pytest.mark.parametrize("query,text,spans,lines", [
    ("", "abc", [], []), ("hello world", "hello, world", [(0, 5), (7, 12)], [(0, 0), (0, 0)]), ('"b c"', "a b c", [(2, 5)], [(0, 0)]), ("b a", "a b", [(0, 1), (2, 3)], [(0, 0)] * 2),
    ("one two", "\none\ntwo", [(1, 4), (5, 8)], [(1, 1), (2, 2)]), ("HeLLo", "hello HELLO", [(0, 5), (6, 11)], [(0, 0)] * 2), ("hell ello", "hello", [(0, 5)], [(0, 0)]), ("ere", "erered", [(0, 3)], [(0, 0)]),
])
def test_highlights(query, text, spans, lines):
    marks = mark(Query.parse(query).terms, text)
    assert (marks.spans, marks.lines) == (spans, lines)


def test_marks_equal_a_plain_search():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("abAB\n ") for _ in range(r.randrange(60)))
        terms = tuple("".join(r.choice("ab ") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4)))
        hit = [False] * len(text)
        for t in terms:
            at = 0
            while (at := text.lower().find(t, at)) >= 0:
                hit[at : at + len(t)] = [True] * len(t)
                at += len(t)
        m = mark(terms, text)
        covered = [any(a <= i < b for a, b in m.spans) for i in range(len(text))]
        assert covered == hit and all(a < b for a, b in m.spans) and all(x[1] < y[0] for x, y in zip(m.spans, m.spans[1:]))
        assert m.lines == [(text[:a].count("\n"), text[: b - 1].count("\n")) for a, b in m.spans]


def test_highlight_column(spark):
    rows = spark.createDataFrame([(1, "Of the nation"), (2, None), (3, "x\nOF THE")], "id long, text string")
    got = {r.id: r for r in rows.select("id", highlight(F.col("text"), '"of the" tion').alias("h")).select("id", "h.*", highlighted_lines(F.col("h.lines")).alias("n")).collect()}
    assert [tuple(x) for x in got[1].spans] == [(0, 6), (9, 13)] and got[2].spans == [] and got[3].n == [1]


def test_ranking_agrees_with_sqlite(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(path, name, content, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    rows = [(r.doc_id, f"{r.source}/{r.doc_id}", r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    db.executemany("insert into f(rowid, path, name, content) values (?, ?, ?, ?)", [(i + 1, p, n, c) for i, p, n, c in rows])
    objects = spark.createDataFrame(rows, "id long, path string, name string, content string").persist()
    for query in ('"the"', '"erer" "tion"', '"src1"', '"ing" "an"'):
        want = {i - 1: r for i, r in db.execute("select rowid, rank from f(?)", (query,))}
        got = {r.id: r["rank"] for r in ft.match(objects, match_phrases(query)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    want = {i - 1: r for i, r in db.execute("select rowid, rank from f where name match ?", ('"src1"',))}
    got = {r.id: r["rank"] for r in ft.match(objects, ["src1"], ("name",)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert ft.full_text_hits(objects, "of").count() == 0 and ft.full_text_hits(objects, "").count() == 0


def test_batches():
    assert list(fill_batches([5, 5, 5, 20, 1], 2, 12)) == [0, 0, 1, 2, 3]


def test_batches_of_a_table_do_not_depend_on_its_partitions(spark):
    rows = spark.range(500).selectExpr("id", "1 + id % 9 AS tokens")
    got = [sorted(map(tuple, sn.token_batches(x, "id", groups=3, most_requests=20, most_tokens=60).collect())) for x in (rows.repartition(1), rows.repartition(7))]
    assert got[0] == got[1]
    for lane in range(3):
        mine = [r for r in got[0] if r[2] == lane]
        assert [r[3] for r in mine] == list(fill_batches([r[1] for r in mine], 20, 60))


def test_embedding_calls_are_bounded(spark):
    def embedder(texts):
        return [[float(len(texts)), float(sum(len(t) for t in texts))]] * len(texts)

    rows = spark.range(100).selectExpr("cast(id AS string) AS content_sha256", "repeat('x', 40) AS rendered").coalesce(1)
    got = em.embed(rows, embedder, most_requests=8, most_tokens=60).collect()
    assert len(got) == 100 and max(r.data[0] for r in got) == 6 and em.embed(rows.limit(0), embedder).count() == 0


def test_render_equals_a_plain_cut(spark):
    text = "a\r\nb\n\nd\ne"
    point = "named_struct('row', {}, 'col', 0)".format
    rows = spark.createDataFrame([(text,)], "t string").selectExpr("t", f"named_struct('start', {point(1)}, 'end', {point(9)}) AS c", "array(0, 7) AS before")
    out = rows.select(tx.render(F.lit("p"), F.col("t"), F.col("before"), F.col("c")), tx.render(F.lit("p"), F.col("t"), F.col("before"), F.col("c"), file=False, line_numbers=True)).first()
    assert out[0] == "p\n\na\r\nb\n\nd\ne" and out[1] == " 1 a\r\n 2 b\n 3 \n 4 d\n 5 e"


def test_render_is_linear(spark):
    def took(n):
        rows = spark.range(1).selectExpr(f"array_join(transform(sequence(1, {n}), x -> 'line'), chr(10)) AS t", f"named_struct('start', named_struct('row', 0, 'col', 0), 'end', named_struct('row', {n}, 'col', 0)) AS c")
        began = time.perf_counter()
        rows.select(tx.render(F.lit("p"), F.col("t"), F.array().cast("array<int>"), F.col("c")).alias("r")).selectExpr("length(r)").collect()
        return time.perf_counter() - began

    took(100)
    assert took(64_000) < 5


@pytest.mark.parametrize("raw,text,kind", [(b"abc", "abc", "utf-8"), ("ü€".encode(), "ü€", "utf-8"), (b"\xfc\x80", "ü€", "windows-1252"), (b"\xfc\x81", "ü\x81", "iso-8859-1"), (b"", "", "utf-8")])
def test_decoding(spark, raw, text, kind):
    from lodestone.parsing.objects import decode

    got = spark.createDataFrame([(bytearray(raw),)], "b binary").select(tx.decode_text(F.col("b")), tx.encoding(F.col("b"))).first()
    assert tuple(got) == (text, kind) and decode(raw) == text


def test_small_functions(spark):
    row = spark.range(1).select(tx.relative_path(F.lit("/r/a/b"), "/r/"), tx.relative_path(F.lit("/x/a"), "/r"), tx.byte_length(F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")))).first()
    assert tuple(row) == ("a/b", "/x/a", 6)
    assert vc.unpack_vector(vc.pack_vector([1.0, -2.5])) == [1.0, -2.5]


def test_look_agrees_with_walk(tmp_path):
    root = make(tmp_path, NESTED)
    every = [*NESTED, "gone.py", "../x", "app", ".git/config", ""]
    assert sorted(look(root, every)) == sorted(walk(root))


def test_crlf_files_have_vectors(spark, tmp_path):
    root = make(tmp_path, {"dos.py": "def dos():\r\n    return 1\r\n", "unix.py": "def unix():\n    return 1\n"})
    index = Index(spark, root)
    index.refresh()
    n = index.objects.count()
    assert index.vectors().count() == n == 4
    rendered = {r.content_sha256 for r in index._rendered(index.objects).select(tx.content_hash(F.col("rendered")).alias("content_sha256")).collect()}
    assert rendered == {r.content_sha256 for r in index.objects.collect()}  # both renderers agree
    hits = index.search(SearchOptions("def dos(): return 1", full_text=False, radius=2.0)).collect()
    assert hits[0]["path"] == "dos.py"


def invariants(index):
    c = index.counts()
    assert c["object"] == c["embedding"] == c["fts"] and c["file"] == index.objects.where("kind = 'file'").count()


def test_index_follows_its_tree(spark, tmp_path, monkeypatch):
    root = make(tmp_path, {"a.py": "def one(): pass\n", "b.md": "text b", "sub/c.go": "package c\n"})
    index = Index(spark, root)
    assert index.counts()["object"] == 0
    index.refresh()
    invariants(index)
    (root / "b.md").write_bytes(b"now\0binary")
    (root / "sub/d.rs").write_text("fn d() {}")
    assert index.refresh() == {"changed": 1, "new": 1, "same": 2}
    invariants(index)
    assert {r.path for r in index.files.collect()} == {"a.py", "sub/c.go", "sub/d.rs"}
    # a failure while publishing leaves the index as it was
    before, rows = index.store.generation, sorted(r.id for r in index.objects.collect())
    (root / "a.py").write_text("def two(): pass\n")
    with monkeypatch.context() as m:
        m.setattr(os, "replace", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            index.refresh()
    assert index.store.generation == before and sorted(r.id for r in index.objects.collect()) == rows
    (root / ".gitignore").write_text("sub/\n")
    hits = index.search(SearchOptions("two", semantic=False, refresh=True)).collect()
    assert [h["name"] for h in hits][0] == "two" and {r.path for r in index.files.collect()} == {"a.py", ".gitignore"}
    invariants(index)
    made = index.stats["embedded"]
    index.search(SearchOptions("two", semantic=False, rebuild_vectors=True))
    assert index.stats["embedded"] > made and json.loads(index.dump_stats())["seconds"]["search"] > 0
    invariants(index)
    index.store.clean()
    invariants(index)
    # one changed file rewrites its bucket; the others stay in the generations that wrote them
    held = dict(index.store.manifest["tables"]["object"])
    (root / "a.py").write_text("def three(): pass\n")
    index.refresh(["a.py"])
    moved = [b for b, g in index.store.manifest["tables"]["object"].items() if held.get(b) != g]
    assert len(moved) == 1 and index.search(SearchOptions("three", semantic=False)).first()["name"] == "three"
    monkeypatch.setattr("lodestone.api.MOST_PARTS", 1)
    (root / "a.py").write_text("def four(): pass\n")
    index.refresh()
    assert index.store.vector_parts == 1
    index.store.clean()
    invariants(index)
    (index.store.path / "manifest.json").write_text('{"schema_version": 1, "generation": "old"}')
    assert index.counts()["object"] == 0  # an older version's store counts as none
    index.refresh()
    invariants(index)
    (index.store.path / "manifest.json").write_text('{"schema_version": 99, "generation": "new"}')
    with pytest.raises(ValueError):
        index.counts()


def test_live_index(spark, tmp_path):
    root = make(tmp_path / "tree", {"a.py": "def a(): pass\n"})
    index = Index(spark, root, path=tmp_path / "index")
    q = ch.keep_index_live(index, ch.changes(spark, root, tmp_path / "state"), str(tmp_path / "cp"))
    try:
        wait = lambda ready: any(ready() or time.sleep(0.3) for _ in range(200))
        assert wait(lambda: index.store.generation is not None and index.files.count() == 1)
        (root / "b.py").write_text("def b(): pass\n")
        os.remove(root / "a.py")
        assert wait(lambda: {r.path for r in index.files.collect()} == {"b.py"})
    finally:
        q.stop()
    invariants(index)


def test_bursts(spark):
    rows = [("u", 0), ("u", 1), ("u", 5), ("v", 0), ("v", 30)]
    events = spark.createDataFrame(rows, "user string, s int").selectExpr("user", "timestamp_seconds(s) AS ts")
    got = sorted((r.user, r.n) for r in ch.bursts(events, "ts", "3 seconds", "user").collect())
    assert got == [("u", 1), ("u", 2), ("v", 1), ("v", 1)]


def test_settings(tmp_path):
    p = tmp_path / "c" / "s.toml"
    assert Settings.load(p) == Settings() and p.exists()
    Settings(dimensions=64).save(p)
    assert Settings.load(p).dimensions == 64
    odd = Settings(model='a "b" \\ c\n\x7f\t é', editor="\\")
    odd.save(p)
    assert Settings.load(p) == odd


def test_index_life_cycle(spark, tmp_path):
    root = make(tmp_path, {"README.md": "Hello world", "a/code.py": "def greet():\n    print('Hello world')\n", "bin.dat": b"a\0b", ".gitignore": "*.tmp\n", "x.tmp": "Hello"})
    index = Index(spark, root)
    assert index.refresh() == {"new": 4}
    assert index.counts() == {"file": 3, "object": 4, "embedding": 4, "fts": 4}
    before = index.store.generation
    index.refresh()
    hits = index.render("Hello world")
    assert {(h["name"], h["kind"]) for h in hits} >= {("README.md", "file"), ("greet", "definition.function"), ("a/code.py", "file")}
    assert all(h["highlights"] for h in hits if h["bm25"] is not None)
    assert [r.name for r in index.search(SearchOptions("greet", semantic=False)).collect()][0] == "greet"
    again = index.search(SearchOptions("greet", semantic=False))
    assert index.stats["cache_hits"] == 1 and again.count() >= 1
    os.remove(root / "a/code.py")
    (root / "README.md").write_text("Goodbye")
    assert index.render("Hello world") == []  # stale hits are left out
    assert index.refresh(["README.md", "a/code.py"]).items() >= {"changed": 1, "deleted": 1}.items()
    assert index.store.generation != before and index.counts()["object"] == 2
    index.search(SearchOptions('print("Hello', semantic=True, rerank=True)).collect()


def test_changes_stream_reports_deletions(spark, tmp_path):
    root, state = make(tmp_path / "tree", {"a.py": "a", "_b.py": "b"}), tmp_path / "state"
    seen = []
    q = ch.changes(spark, root, state).writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(100):
            if len(seen) >= 2:
                break
            time.sleep(0.2)
        os.remove(root / "a.py")
        (root / ".c").write_text("c")
        for _ in range(100):
            if len(seen) >= 4:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(seen) == [(".c", "created"), ("_b.py", "created"), ("a.py", "created"), ("a.py", "deleted")]


def test_event_paths(spark):
    rows = [("moved", "a", "b", False), ("created", "c", None, False), ("opened", "d", None, False), ("deleted", "e", None, True)]
    got = ch.event_paths(spark.createDataFrame(rows, "type string, src string, dest string, is_directory boolean"))
    assert sorted(r.path for r in got.collect()) == ["a", "b", "c"]


def test_range_join_blocks_equal_one_block(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "object_id long, data array<float>")
    queries = vectors.where("object_id % 20 = 0").selectExpr("object_id AS query_id", "data AS query")
    want = sorted((q, i, sum((x - y) ** 2 for x, y in zip(a, b))) for q, a in rows if q % 20 == 0 for i, b in rows if sum((x - y) ** 2 for x, y in zip(a, b)) < 3.0)
    for block_rows in (1, 4096):
        assert sorted(map(tuple, vc.range_join(vectors, queries, 3.0, block_rows=block_rows).collect())) == want
    assert vc.range_join(vectors, queries.limit(0), 3.0).count() == 0


def test_command_line(spark, tmp_path, capsys):
    root = make(tmp_path / "tree", {"a.py": "def greet():\n    return 'hello'\n", "b.md": "nothing"})
    at = ["--root", str(root), "--index", str(tmp_path / "index")]
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip()
    assert cli.main(["search", "x", "--root", "/proc"], spark) == 2
    assert cli.main(["search", "greet", "--cached-only", "--no-semantic", *at], spark) == 0 and "greet" not in capsys.readouterr().out
    assert cli.main(["search", "greet", "--no-semantic", "--reasons", "--stats", *at], spark) == 0
    out = capsys.readouterr().out
    assert "a.py [definition.function] greet (rank -" in out and "return 'hello'" in out and '"searches": 1' in out and re.search(r"search \d+\.\d+ s", out)
    assert cli.main(["debug", *at], spark) == 0 and "object 3" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["search", "x", "--radius", "3"])
    assert cli.latency({"a": 0.0004, "b": 0.5}) == "b 0.500 s"


def test_disagreeing_digests(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, file_digest string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "q")], "id long, file_digest string")
    assert [r.id for r in hy.disagreeing(a, b).collect()] == [2]
