"""The opN_ queries over the shared tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import quality, toxicity
from lodestone.llm.common import LOWER, UPPER, table, work_table
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.gif import decode_media, store_texts
from lodestone.llm.html_extract import extract_pages
from lodestone.llm.labelled import fold
from lodestone.llm.line_dedup import drop_boilerplate
from lodestone.llm.near_dup import near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.url_filter import DAMPING, ITERATIONS, LINK, RULES, THRESHOLD, judge
from lodestone.llm.warc import read_archives, write_archives

#: The public tokenizer of op10: a file name in the installed collection, or a path.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return name if "/" in name else str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = work_table(spark, store_texts(table(spark, sf_dir, "documents")), "media")
    out = work_table(spark, decode_media(media), "frames")  # the timed frames with their histograms, read back from the stored media
    length = F.aggregate("frames", F.lit(0).cast("long"), lambda s, f: s + f["delay_cs"])
    colours = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 64), lambda s, f: F.zip_with(s, f["histogram"], lambda a, b: a + b))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("cs="), length), F.concat(F.lit("hist="), F.array_join(colours.cast("array<string>"), ",")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    out = read_archives(write_archives(pages), payloads=False)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.col("ok").alias("digests_hold"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


#: DuckDB's words of a text, as common.words() has them.
SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, t, array_to_string(w[p:p + t - 1], ' ') AS g
  FROM (SELECT item, w, t, unnest(range(1, len(w) - t + 2)) AS p
        FROM (SELECT item, w, least(13, len(w)) AS t FROM i WHERE len(w) > 0))),
grams AS (
  SELECT rid, t, p, array_to_string(w[p:p + t - 1], ' ') AS g
  FROM (SELECT rid, w, t, unnest(range(1, len(w) - t + 2)) AS p FROM d, (SELECT DISTINCT t FROM win) WHERE len(w) >= t)),
hits AS (SELECT rid, p, t, item FROM grams JOIN win USING (t, g)),
covered AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(p, p + t)) AS k FROM hits) GROUP BY rid),
named AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, text, lines FROM d WHERE source IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT source, count(*) AS n_all FROM pages GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS n, count(DISTINCT md5(text)) AS n_texts
  FROM (SELECT source, text, unnest(list_distinct(list_filter(lines, lambda x: trim(x) <> ''))) AS line FROM pages)
  GROUP BY source, line),
bad AS (
  SELECT source, list(line) AS bad FROM counts JOIN totals USING (source)
  WHERE n_texts > 1 AND n / n_all > 0.1 GROUP BY source),
kept AS (
  SELECT doc_id, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept
  FROM d LEFT JOIN bad USING (source))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       CAST(length(coalesce(array_to_string(kept, chr(10)), '')) AS BIGINT) AS n_chars,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256
FROM kept
"""

#: Base32 of a SHA-1 in hexadecimal: five hexadecimal digits make four letters.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS digests_hold
FROM h
"""


def _op2_sql() -> str:
    fits = "WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v}'"
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "CASE " + " ".join(fits.format(h=h, p=p, v=pick(v, h, p)) for v, h, p in by_length) + " END"
    links = LINK.replace("'", "''")
    steps = [f"""r{i + 1} AS MATERIALIZED (
  SELECT kind, host, sum(r) AS r FROM (SELECT * FROM seeds UNION ALL
    SELECT w.kind, w.host, r.r * w.w FROM w JOIN r{i} r ON r.kind = w.kind AND r.host = w.f) GROUP BY kind, host)""" for i in range(ITERATIONS)]
    return rf"""
WITH parts AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM parts),
urls AS (
  SELECT page_id, html, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
judged AS (SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM urls),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad
  FROM judged WHERE host <> '' GROUP BY host),
linked AS (
  SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst
  FROM (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{links}', 1)) AS dst FROM urls)),
up AS (
  SELECT * FROM (SELECT host AS src, regexp_replace(host, '^[^.]*\.', '') AS dst FROM hosts)
  WHERE src <> dst AND dst IN (SELECT host FROM hosts)),
edges AS (
  SELECT DISTINCT src, dst FROM (SELECT * FROM linked UNION ALL SELECT * FROM up UNION ALL SELECT dst, src FROM up)
  WHERE src <> '' AND dst <> '' AND src <> dst),
ways AS (SELECT 'trust' AS kind, src AS f, dst AS host FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
w AS MATERIALIZED (SELECT kind, f, host, {DAMPING}::DOUBLE / count(*) OVER (PARTITION BY kind, f) AS w FROM ways),
s AS (SELECT 'trust' AS kind, host FROM hosts WHERE 2 * good > n UNION ALL SELECT 'distrust', host FROM hosts WHERE 2 * bad > n),
seeds AS MATERIALIZED (SELECT kind, host, (1 - {DAMPING}::DOUBLE) / count(*) OVER (PARTITION BY kind) AS r FROM s),
r0 AS (SELECT * FROM seeds),
{",".join(steps)},
scores AS (
  SELECT host, coalesce(sum(r) FILTER (kind = 'trust'), 0) * (SELECT count(*) FROM hosts) AS trust,
         coalesce(sum(r) FILTER (kind = 'distrust'), 0) * (SELECT count(*) FROM hosts) AS distrust
  FROM r{ITERATIONS} GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN distrust >= {THRESHOLD} AND distrust > trust THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN scores USING (host)
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_near_dup": op4_near_dup,
    "op5_html": op5_html,
    "op6_gif": op6_gif,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

#: The others can't be said in SQL and are tested against brute force, round trips or held-out rows.
ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op2_url_filter": _op2_sql(), "op7_line_dedup": OP7_SQL, "op8_warc": OP8_SQL}
