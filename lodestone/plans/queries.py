"""Queries over the shared tables, one or more for each operator, and the SQL that gives the same rows.

`documents` serve as files and objects (path = source/doc_id, name = source, content = text), `embeddings` as their
vectors, `events` as the change log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.api import parse_files
from lodestone.functions import text as tx
from lodestone.functions.highlight import highlight, highlighted_lines, merge_span_rows
from lodestone.operators import fulltext as ft
from lodestone.operators import hybrid as hy
from lodestone.operators import snapshot as sn
from lodestone.operators import vector as vc
from lodestone.options import match_phrases
from lodestone.sources.ignore import IgnoreTree, with_ignored
from lodestone.streaming.changes import bursts

QUERY = '"of the" tion'
NAME_QUERY = "src1"
TOP_K = 32
#: Vectors nearer than this (squared) to that of vec_id 0; the default radius keeps few of random unit vectors.
RADIUS = 1.8
NESTED_RULES = "!4*\n*7*\n"
TERMS = ("the", "hen")
RULES = "*.html\n/en/4*\nfr/\n!*0.html\nde/[1-3]*\n"
#: Source files by suffix: a text (@ stands for the document's number, # for its length), and its objects in order: name, kind, rows, context.
SOURCES = {
    "py": (
        "SIZE = #\n\n\nclass Page@:\n    def size(self):\n        return #\n\n\ndef main@():\n    return Page@()\n",
        [("SIZE", "definition.constant", "0-0", ";"), ("Page@", "definition.class", "3-5", ";"), ("size", "definition.function", "4-5", "3;"), ("main@", "definition.function", "8-9", ";")],
    ),
    "go": (
        "package p@\n\ntype Page struct {\n\tsize int\n}\n\nfunc (p *Page) Size() int {\n\treturn # // }\n}\n",
        [("Page", "definition.type", "2-4", ";"), ("Size", "definition.method", "6-8", ";")],
    ),
    "rs": (
        "struct Page@ {\n    size: u64,\n}\n\nimpl Page@ {\n    fn size(&self) -> u64 {\n        #\n    }\n}\n",
        [("Page@", "definition.struct", "0-2", ";"), ("Page@", "definition.struct.impl", "4-8", ";"), ("size", "definition.function", "5-7", "4;8")],
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("path"), F.col("source").alias("name"), F.col("text").alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256_digest"))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


OBJECTS = "(SELECT doc_id AS id, source || '/' || doc_id AS path, source AS name, text AS content FROM documents)"


def _match_sql(phrases: list[str], columns: tuple[str, ...], name: str) -> str:
    """CTEs that end in `name`(id, rank); phrases must not overlap themselves, for replace() to count them."""
    count = lambda c, p: f"(length(lower({c})) - length(replace(lower({c}), '{p}', ''))) // {len(p)}"
    f = [" + ".join(count(c, p) for c in columns) for p in phrases]
    dl = " + ".join(f"greatest(length({c}) - 2, 0)" for c in ft.COLUMNS)
    parts = [f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases))]
    return f"""
{name}_f AS (SELECT id, {dl} AS dl, {", ".join(f"{x} AS f{i}" for i, x in enumerate(f))} FROM {OBJECTS}),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(f)))} FROM {name}_f),
{name} AS (SELECT id, -({" + ".join(parts)}) AS rank FROM {name}_f, {name}_s WHERE {" AND ".join(f"f{i} > 0" for i in range(len(f)))})"""


def _hits_sql(query: str, k: int = TOP_K) -> str:
    p = match_phrases(query)
    return f"""{_match_sql(p, ("name",), "named")}, {_match_sql(p, ft.COLUMNS, "anywhere")},
hits AS (
  SELECT id, max(nm) AS name_match, min(rank) AS rank FROM (
    SELECT * FROM (SELECT id, true AS nm, rank FROM named ORDER BY rank, id LIMIT {k}) UNION ALL
    SELECT * FROM (SELECT id, false, rank FROM anywhere ORDER BY rank, id LIMIT {k}))
  GROUP BY id ORDER BY name_match DESC, rank, id LIMIT {k})"""


def fts_any_column_topk(spark, sf_dir):
    return _round(ft.top(ft.match(objects(spark, sf_dir), match_phrases(QUERY)), TOP_K), "rank")


def fts_name_topk(spark, sf_dir):
    return _round(ft.top(ft.match(objects(spark, sf_dir), match_phrases(NAME_QUERY), ("name",)), TOP_K), "rank")


def fts_union_dedupe(spark, sf_dir):
    return _round(ft.full_text_hits(objects(spark, sf_dir), NAME_QUERY, TOP_K), "rank")


def fts_postings_pruned(spark, sf_dir):
    own = objects(spark, sf_dir)
    return _round(ft.full_text_hits(own, QUERY, TOP_K, ft.corpus_stats(own), ft.postings(own)), "rank")


def fts_objects_with_digest(spark, sf_dir):
    out = ft.full_text_search(objects(spark, sf_dir), files(spark, sf_dir), NAME_QUERY, TOP_K)
    return _round(out.select("id", "path", "name_match", "rank", "file_digest"), "rank")


def fts_short_phrase_dropped(spark, sf_dir):
    return _round(ft.top(ft.match(objects(spark, sf_dir), match_phrases('tion "of"')), TOP_K), "rank")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), F.col("embedding").alias("data"))


def _query_vector(spark, sf_dir) -> list[float]:
    return list(_vectors(spark, sf_dir).where("object_id = 0").first()["data"])


def vector_range_topk(spark, sf_dir):
    return _round(vc.range_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), RADIUS, TOP_K), "dist")


def vector_range_join(spark, sf_dir):
    some = _vectors(spark, sf_dir).where("object_id % 20 = 0").select(F.col("object_id").alias("query_id"), F.col("data").alias("query"))
    return _round(vc.range_join(_vectors(spark, sf_dir), some, 1.5), "dist")


def hybrid_merge_tiers(spark, sf_dir):
    semantic = vc.range_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), RADIUS, TOP_K)
    return _round(hy.merge(semantic, ft.full_text_hits(objects(spark, sf_dir), NAME_QUERY, TOP_K)), "l2", "bm25")


def rerank_filter_reorder(spark, sf_dir):
    answer = spark.createDataFrame([("Sure: [7, 3, 9999999, 3, 11] done",)], "answer string")
    return hy.rerank(objects(spark, sf_dir).select("id", "path"), hy.answer_order(answer)).select("id", "path", "position")


def newest_wins(spark, sf_dir):
    return hy.newest(table(spark, sf_dir, "events").where("value is not null"), "user_id", "event_id", F.col("value"))


def _snapshots(spark, sf_dir):
    """Two states of the files: some gone, some new, some touched, some changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.char_length("text").cast("long").alias("size_bytes"), "text")
    stored = d.where("doc_id % 10 <> 0").select("path", "size_bytes", F.col("doc_id").alias("last_modified_ns"), F.sha2("text", 256).alias("sha256_digest"))
    time = F.when(F.col("doc_id") % 5 == 1, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    text = F.when(F.col("doc_id") % 15 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = d.where("doc_id % 10 <> 3").select("path", "size_bytes", time.alias("last_modified_ns"), F.sha2(text, 256).alias("sha256_digest"))
    return stored, now


SNAPSHOTS = """
d AS (SELECT doc_id, source || '/' || doc_id AS path, length(text) AS size_bytes, text FROM documents),
stored AS (SELECT path, size_bytes, doc_id AS t, sha256(text) AS h FROM d WHERE doc_id % 10 <> 0),
now AS (
  SELECT path, size_bytes, CASE WHEN doc_id % 5 = 1 THEN doc_id + 1 ELSE doc_id END AS t,
         sha256(CASE WHEN doc_id % 15 = 1 THEN text || '!' ELSE text END) AS h FROM d WHERE doc_id % 10 <> 3)"""


def snapshot_changes(spark, sf_dir):
    return sn.changes(*_snapshots(spark, sf_dir))


def snapshot_stale_files(spark, sf_dir):
    stored, now = _snapshots(spark, sf_dir)
    return sn.stale_by_metadata(stored, now).select("path", "last_modified_ns")


def delete_not_visited(spark, sf_dir):
    stored, now = _snapshots(spark, sf_dir)
    return sn.not_visited(stored, now).select("path", "size_bytes")


def upsert_files(spark, sf_dir):
    stored, now = _snapshots(spark, sf_dir)
    return sn.upsert(stored, now)


def embedding_cache_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_sha256"))
    cache = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("object_id"), "content_sha256", F.col("doc_id").alias("data"))
    return sn.reuse_vectors(d.select(F.col("doc_id").alias("object_id"), "content_sha256"), cache).select("object_id", "content_sha256", F.coalesce("from_id", F.lit(-1)).alias("from_id"))


def embedding_requests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("rendered"), tx.content_hash(F.col("text")).alias("content_sha256"), "doc_id")
    cache = d.where("doc_id % 2 = 0").select("content_sha256", F.lit("m").alias("model"))
    return sn.embedding_requests(d, cache, "m").select("content_sha256", F.char_length("rendered").alias("n"))


def embeddings_semi_objects(spark, sf_dir):
    return sn.vectors_of_objects(table(spark, sf_dir, "embeddings").select("vec_id", "label"), objects(spark, sf_dir), "vec_id")


def text_coordinates(spark, sf_dir):
    c = tx.text_coordinates(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c["end"]["row"].alias("last_row"), c["end"]["col"].alias("last_col"), tx.line_length(c).alias("n_lines"), tx.token_count(F.col("text")).alias("tokens"))


def language_dispatch(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("py", "rs", "h", "tsx", "mjs", "rb", "txt", "PY"))), (F.col("page_id") % 8 + 1).cast("int"))
    path = F.concat(F.lit("a/.b/"), "page_id", F.when(F.col("page_id") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("."), kinds)))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("language", tx.language(F.col("path")))


def _page_path():
    return F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1)


def ignored_paths(spark, sf_dir):
    tree = IgnoreTree()
    tree.add("", RULES)
    return with_ignored(table(spark, sf_dir, "pages").select("page_id", _page_path().alias("path")), tree)


def ignored_paths_nested(spark, sf_dir):
    """The rules of a directory come before those above it."""
    tree = IgnoreTree()
    tree.add("", RULES)
    tree.add("en", NESTED_RULES)
    return with_ignored(table(spark, sf_dir, "pages").select("page_id", _page_path().alias("path")), tree)


def decoded_text(spark, sf_dir):
    """Every third text as ISO-8859-1 bytes, told apart by its bytes alone."""
    latin = F.col("doc_id") % 3 == 0
    raw = F.when(latin, F.encode(F.translate("text", "œŒ", "oO"), "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    d = table(spark, sf_dir, "documents").select("doc_id", raw.alias("content"))
    return d.select("doc_id", tx.encoding(F.col("content")).alias("encoding"), F.sha2(tx.decode_text(F.col("content")), 256).alias("text_sha256"))


def binary_filter(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text").cast("binary"), F.lit(bytes([0, 65])))).otherwise(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("content")).where(~tx.is_binary(F.col("content"))).select("doc_id", F.octet_length("content").alias("n_bytes"), tx.decode_text(F.col("content")).alias("content"))


def render_context(spark, sf_dir):
    """The second half of each text's lines, from the middle one on, with its first line as context, numbered."""
    lines = F.size(F.split("text", "\n", -1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text", lines.alias("n"))
    point = lambda row: F.struct(row.cast("int").alias("row"), F.lit(0).alias("col"))
    coordinates = F.struct(point(F.floor(F.col("n") / 2)).alias("start"), point(F.col("n") - 1).alias("end"))
    out = tx.render(F.col("path"), F.col("text"), F.array(F.lit(0)), coordinates, line_numbers=True)
    return d.select("doc_id", F.sha2(out, 256).alias("rendered_sha256"))


def highlight_spans_merged(spark, sf_dir):
    """Spans of two terms that can't overlap themselves, in every text."""
    d = table(spark, sf_dir, "documents").select("doc_id", highlight(F.col("text"), " ".join(TERMS)).alias("h"))
    return d.select("doc_id", F.explode("h.spans").alias("s")).select("doc_id", "s.start", "s.end")


def highlight_span_islands(spark, sf_dir):
    """The same spans, each term's rows apart and merged as islands."""
    d = table(spark, sf_dir, "documents")
    spans = None
    for term in TERMS:
        part = d.select("doc_id", F.explode(highlight(F.col("text"), term)["spans"]).alias("s")).select("doc_id", "s.start", "s.end")
        spans = part if spans is None else spans.unionByName(part)
    return merge_span_rows(spans, "doc_id")


def highlighted_line_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", highlighted_lines(highlight(F.col("text"), " ".join(TERMS))["lines"]).alias("l"))
    return d.select("doc_id", F.size("l").alias("n"), F.array_join(F.col("l").cast("array<string>"), ",").alias("lines"))


def debounced_batches(spark, sf_dir):
    """Events of a user in bursts: an hour without one ends a burst."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = bursts(e, "ts", "1 hour", "user_id")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _sources(spark, sf_dir):
    """A small source file for each document, in three languages; its names and numbers come from the document."""
    which = F.element_at(F.array(*(F.lit(x) for x in SOURCES)), (F.col("doc_id") % len(SOURCES) + 1).cast("int"))
    body = F.lit("")
    for suffix, (text, _) in SOURCES.items():
        parts = [F.col("doc_id").cast("string") if x == "@" else F.col("n_chars").cast("string") if x == "#" else F.lit(x) for x in re.split("([@#])", text) if x]
        body = F.when(F.col("_s") == suffix, F.concat(*parts)).otherwise(body)
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", which.alias("_s"))
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), F.col("_s")).alias("path"), body.cast("binary").alias("content"))


def source_definitions(spark, sf_dir):
    """Files parsed into objects: what they are, where, and in what context."""
    out = parse_files(_sources(spark, sf_dir))
    rows = F.concat_ws("-", "coordinates.start.row", "coordinates.end.row")
    around = F.concat_ws(";", F.array_join(F.col("context_before").cast("array<string>"), ","), F.array_join(F.col("context_after").cast("array<string>"), ","))
    return out.select("path", "ordinal", "name", "kind", "language", rows.alias("line_range"), around.alias("context"), F.char_length("content").alias("n_chars"))


def source_objects_rendered(spark, sf_dir):
    """The hash by which an object's vector is found is that of what the column renderer shows."""
    out = parse_files(_sources(spark, sf_dir))
    whole = out.where("kind = 'file'").select("path", F.col("content").alias("_text"))
    shown = tx.render(F.col("path"), F.col("_text"), F.col("context_before"), F.col("coordinates"))
    return out.join(whole, "path").select("path", "ordinal", (tx.content_hash(shown) == F.col("content_sha256")).alias("agrees"), F.length(shown).alias("n_chars"))


def trigram_postings(spark, sf_dir):
    d = objects(spark, sf_dir).select("id", F.lit("").alias("path"), F.lit("").alias("name"), "content")
    return ft.postings(d).groupBy("gram").agg(F.count("*").alias("n"), F.min("object_id").alias("first_id"))


def batch_token_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens")).where(F.col("tokens") <= tx.TOKEN_LIMIT)
    return sn.token_batches(d, "doc_id", lane=F.col("doc_id") % 16, most_requests=64, most_tokens=40_000)


def object_labels(spark, sf_dir):
    own = objects(spark, sf_dir).withColumn("kind", F.when(F.col("id") % 3 == 0, "file").otherwise("definition.function"))
    return own.select("id", tx.label(F.col("path"), F.col("kind"), F.col("name")).alias("label"), F.sha2("content", 256).alias("content_sha256"))


QUERIES = {f.__name__: f for f in (
    fts_any_column_topk, fts_name_topk, fts_union_dedupe, fts_postings_pruned, fts_objects_with_digest, fts_short_phrase_dropped, vector_range_topk,
    vector_range_join, hybrid_merge_tiers, rerank_filter_reorder, newest_wins, snapshot_changes, snapshot_stale_files, delete_not_visited, upsert_files,
    embedding_cache_reuse, embedding_requests, embeddings_semi_objects, text_coordinates, language_dispatch, ignored_paths, ignored_paths_nested,
    binary_filter, decoded_text, render_context, highlight_spans_merged, highlight_span_islands, highlighted_line_numbers, debounced_batches,
    source_definitions, source_objects_rendered, trigram_postings, batch_token_fill, object_labels,
)}

_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))"
_VSS = f"""
vss AS (
  SELECT id, dist FROM (SELECT e.vec_id AS id, {_DIST.format(a="e.embedding", b="q.embedding")} AS dist
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
  WHERE dist < {RADIUS} ORDER BY dist, id LIMIT {TOP_K})"""
#: The rules spelled out by hand on a path's elements, last rule first.
_IGNORED = """CASE WHEN len(e) = 2 AND e[1] = 'de' AND substr(e[2], 1, 1) IN ('1', '2', '3') THEN true
  WHEN e[-1] LIKE '%0.html' THEN false WHEN list_contains(e, 'fr') THEN true WHEN len(e) = 2 AND e[1] = 'en' AND e[2] LIKE '4%' THEN true
  WHEN e[-1] LIKE '%.html' THEN true ELSE false END"""
_PATHS = "(SELECT *, string_split(path, '/') AS e FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages))"
_PYTHON_LIKE = lambda text: " || ".join("CAST(doc_id AS VARCHAR)" if x == "@" else "CAST(n_chars AS VARCHAR)" if x == "#" else "'" + x.replace("'", "''") + "'" for x in re.split("([@#])", text) if x) or "''"
_LANGUAGES = {"py": "python", "go": "go", "rs": "rust"}


def _lines_sql(first: int, last: int) -> str:
    return f"array_to_string(list_slice(l, {first + 1}, {last + 1}), chr(10))"


def _definitions_sql() -> str:
    """One SELECT for each object of each language: what is listed beside the sources, and lengths cut from the text by lines."""
    parts = []
    for k, (suffix, (text, rows)) in enumerate(SOURCES.items()):
        files = f"(SELECT doc_id, n_chars, source || '/' || doc_id || '.{suffix}' AS path, string_split({_PYTHON_LIKE(text)}, chr(10)) AS l FROM documents WHERE doc_id % {len(SOURCES)} = {k})"
        for i, (name, kind, lines, context) in enumerate([("", "file", f"0-{text.count(chr(10))}", ";"), *rows]):
            first, last = map(int, lines.split("-"))
            indent = len(text.split("\n")[first]) - len(text.split("\n")[first].lstrip())
            called = "path" if kind == "file" else _PYTHON_LIKE(name)
            shown = "".join(f" + length(l[{int(x) + 1}]) + 1" for x in context.split(";")[0].split(",") if x)
            parts.append(f"SELECT path, {i} AS ordinal, {called} AS name, '{kind}' AS kind, '{_LANGUAGES[suffix]}' AS language, '{lines}' AS line_range, '{context}' AS context, "
                         f"length({_lines_sql(first, last)}) - {indent} AS n_chars, length(path) + 2{shown} + length({_lines_sql(first, last)}) AS n_shown FROM {files}")
    return " UNION ALL ".join(parts)


#: Where a text is split at a term, the parts before each place add up to where it starts.
_SPANS = """p AS (
  SELECT doc_id, term, unnest(e) AS part, generate_subscripts(e, 1) AS k, len(e) AS parts
  FROM (SELECT doc_id, term, string_split(lower(text), term) AS e FROM documents, (VALUES ('the'), ('hen')) v(term))),
s AS (
  SELECT doc_id, start, start + 3 AS "end" FROM (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id, term ORDER BY k) + 3 * (k - 1) AS start FROM p) WHERE k < parts),
w AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w),
m AS (SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end" FROM g GROUP BY doc_id, island)"""

ORACLE_SQL = {
    "fts_any_column_topk": f"WITH {_match_sql(match_phrases(QUERY), ft.COLUMNS, 'm')} SELECT id, round(rank, 6) AS rank FROM (SELECT * FROM m ORDER BY rank, id LIMIT {TOP_K})",
    "fts_name_topk": f"WITH {_match_sql(match_phrases(NAME_QUERY), ('name',), 'm')} SELECT id, round(rank, 6) AS rank FROM (SELECT * FROM m ORDER BY rank, id LIMIT {TOP_K})",
    "fts_union_dedupe": f"WITH {_hits_sql(NAME_QUERY)} SELECT id, name_match, round(rank, 6) AS rank FROM hits",
    "fts_postings_pruned": f"WITH {_hits_sql(QUERY)} SELECT id, name_match, round(rank, 6) AS rank FROM hits",
    "fts_objects_with_digest": f"WITH {_hits_sql(NAME_QUERY)} SELECT id, path, name_match, round(rank, 6) AS rank, sha256(content) AS file_digest FROM hits JOIN {OBJECTS} o USING (id)",
    "fts_short_phrase_dropped": f"WITH {_match_sql(['tion'], ft.COLUMNS, 'm')} SELECT id, round(rank, 6) AS rank FROM (SELECT * FROM m ORDER BY rank, id LIMIT {TOP_K})",
    "vector_range_topk": f"WITH {_VSS} SELECT id, round(dist, 6) AS dist FROM vss",
    "vector_range_join": f"SELECT query_id, id, round(dist, 6) AS dist FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DIST.format(a='e.embedding', b='q.embedding')} AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE dist < 1.5",
    "hybrid_merge_tiers": f"""WITH {_VSS}, {_hits_sql(NAME_QUERY)},
s AS (SELECT id, dist, row_number() OVER (ORDER BY dist, id) - 1 AS i FROM vss),
f AS (SELECT id, rank, name_match, row_number() OVER (ORDER BY name_match DESC, rank, id) - 1 AS i FROM hits)
SELECT coalesce(s.id, f.id) AS id, round(dist, 6) AS l2, round(rank, 6) AS bm25,
  CASE WHEN coalesce(name_match, false) THEN -1 WHEN s.id IS NOT NULL AND f.id IS NOT NULL THEN 0 ELSE 1 END AS tier,
  CAST(CASE WHEN coalesce(name_match, false) THEN f.i ELSE least(coalesce(s.i, f.i), coalesce(f.i, s.i)) END AS INTEGER) AS pos,
  CASE WHEN s.id IS NOT NULL AND f.id IS NOT NULL THEN 0 WHEN f.id IS NOT NULL THEN 1 ELSE 2 END AS src
FROM s FULL JOIN f ON s.id = f.id""",
    "rerank_filter_reorder": "SELECT doc_id AS id, source || '/' || doc_id AS path, CAST(position AS INTEGER) AS position FROM documents JOIN (VALUES (7, 0), (3, 1), (11, 4)) v(id, position) ON doc_id = v.id",
    "newest_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id",
    "snapshot_changes": f"""WITH {SNAPSHOTS}
SELECT coalesce(s.path, n.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
  WHEN s.size_bytes = n.size_bytes AND s.t = n.t THEN 'same' WHEN s.h IS NOT DISTINCT FROM n.h THEN 'touched' ELSE 'changed' END AS change
FROM stored s FULL JOIN now n ON s.path = n.path""",
    "snapshot_stale_files": f"WITH {SNAPSHOTS} SELECT n.path, n.t AS last_modified_ns FROM now n LEFT JOIN stored s ON s.path = n.path WHERE s.path IS NULL OR s.size_bytes <> n.size_bytes OR s.t <> n.t",
    "delete_not_visited": f"WITH {SNAPSHOTS} SELECT path, size_bytes FROM stored WHERE path NOT IN (SELECT path FROM now)",
    "upsert_files": f"WITH {SNAPSHOTS} SELECT path, size_bytes, t AS last_modified_ns, h AS sha256_digest FROM stored WHERE path NOT IN (SELECT path FROM now) UNION ALL SELECT path, size_bytes, t, h FROM now",
    "embedding_cache_reuse": "SELECT d.doc_id AS object_id, sha256(text) AS content_sha256, coalesce(from_id, -1) AS from_id FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(doc_id) AS from_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) c ON sha256(d.text) = c.h",
    "embedding_requests": "SELECT sha256(text) AS content_sha256, CAST(any_value(length(text)) AS INTEGER) AS n FROM documents WHERE text <> '' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1",
    "embeddings_semi_objects": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
    "text_coordinates": "SELECT doc_id, CAST(len(string_split(text, chr(10))) - 1 AS INTEGER) AS last_row, CAST(strlen(string_split(text, chr(10))[-1]) AS INTEGER) AS last_col, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens FROM documents",
    "language_dispatch": """SELECT page_id, path, CASE regexp_extract(path, '[^/]\\.([^./]*)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'h' THEN 'cpp'
  WHEN 'tsx' THEN 'tsx' WHEN 'mjs' THEN 'javascript' WHEN 'rb' THEN 'ruby' ELSE 'text' END AS language
FROM (SELECT page_id, 'a/.b/' || page_id || CASE WHEN page_id % 9 = 0 THEN '' ELSE '.' || ['py', 'rs', 'h', 'tsx', 'mjs', 'rb', 'txt', 'PY'][page_id % 8 + 1] END AS path FROM pages)""",
    "ignored_paths": f"SELECT page_id, path, {_IGNORED} AS ignored FROM {_PATHS}",
    "ignored_paths_nested": f"""SELECT page_id, path, CASE WHEN e[1] = 'en' AND len(e) > 1 AND contains(e[-1], '7') THEN true
  WHEN e[1] = 'en' AND len(e) > 1 AND e[-1] LIKE '4%' THEN false ELSE {_IGNORED} END AS ignored FROM {_PATHS}""",
    "decoded_text": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND strlen(t) <> length(t) THEN 'windows-1252' ELSE 'utf-8' END AS encoding, sha256(t) AS text_sha256
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'œŒ', 'oO') ELSE text END AS t FROM documents)""",
    "binary_filter": "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes, text AS content FROM documents WHERE doc_id % 7 <> 0",
    "render_context": """SELECT doc_id, sha256(array_to_string(list_concat([source, '', lpad('1', w, ' ') || ' ' || l[1]],
  list_transform(range(n // 2, n), lambda i: lpad(CAST(i + 1 AS VARCHAR), w, ' ') || ' ' || l[i + 1])), chr(10))) AS rendered_sha256
FROM (SELECT *, len(l) AS n, CAST(length(CAST(len(l) AS VARCHAR)) AS INTEGER) AS w FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))""",
    "highlight_spans_merged": f'WITH {_SPANS} SELECT doc_id, start, "end" FROM m',
    "highlight_span_islands": f'WITH {_SPANS} SELECT doc_id, start, "end" FROM m',
    "highlighted_line_numbers": f"""WITH {_SPANS},
ends AS (SELECT doc_id, unnest([start, "end" - 1]) AS p FROM m),
n AS (SELECT DISTINCT doc_id, length(h) - length(replace(h, chr(10), '')) AS line FROM (SELECT doc_id, substr(text, 1, p) AS h FROM ends JOIN documents USING (doc_id)))
SELECT doc_id, CAST(count(line) AS INTEGER) AS n, coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line), '') AS lines FROM documents LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "debounced_batches": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM b GROUP BY user_id, burst""",
    "source_definitions": f"SELECT path, CAST(ordinal AS INTEGER) AS ordinal, name, kind, language, line_range, context, CAST(n_chars AS INTEGER) AS n_chars FROM ({_definitions_sql()})",
    "source_objects_rendered": f"SELECT path, CAST(ordinal AS INTEGER) AS ordinal, true AS agrees, CAST(n_shown AS INTEGER) AS n_chars FROM ({_definitions_sql()})",
    "trigram_postings": "SELECT gram, count(*) AS n, min(doc_id) AS first_id FROM (SELECT DISTINCT doc_id, substr(lower(text), i, 3) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents)) GROUP BY gram",
    "batch_token_fill": """WITH RECURSIVE d AS (
  SELECT doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, CAST(doc_id % 16 AS INTEGER) AS lane, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS i
  FROM documents WHERE ceil(strlen(text) / 4) <= 8192),
f AS (
  SELECT doc_id, tokens, lane, i, CAST(0 AS BIGINT) AS batch, 1 AS c, tokens AS t FROM d WHERE i = 1 UNION ALL
  SELECT doc_id, tokens, lane, i, batch + over, CASE over WHEN 1 THEN 1 ELSE c + 1 END, CASE over WHEN 1 THEN tokens ELSE t + tokens END
  FROM (SELECT d.*, f.batch, f.c, f.t, CASE WHEN f.c >= 64 OR f.t + d.tokens > 40000 THEN 1 ELSE 0 END AS over FROM f JOIN d ON d.lane = f.lane AND d.i = f.i + 1))
SELECT doc_id, tokens, lane, batch FROM f""",
    "object_labels": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id ELSE source || '/' || doc_id || ' [definition.function] ' || source END AS label, sha256(text) AS content_sha256 FROM documents",
}
