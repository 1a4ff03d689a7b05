"""Benchmark decontamination by winnowing, in DataFrame functions only.

A benchmark item's windows are its runs of `window` consecutive words (the whole item where it is shorter). With
k-grams of k words and w = t + 1 - k of them to a winnowing window, each run of t words has exactly one winnowing
minimum, so a shared run always shares its minimum: no span of t or more shared words is missed. Document positions
whose minimum is among the benchmark's are extended to the full t words and compared as text, so hash collisions
never count. Shorter items form classes of their own t (at most `window` - 1 classes whatever the table's size).

Plan: one scan of the documents; the exploded minima meet the benchmark's in a broadcast hash join while the row's
word array stays in place; all that is shuffled is about one row per document plus its verified hits. Where the
benchmark's minima or windows pass the broadcast bounds, the probe is a shuffled join on (class, minimum) instead.

Cases: null or empty text has no words and no hits; items with null id or no words are ignored; items that repeat a
text or an id count once per id; repeated document rows give a result row each; very long texts are read whole, their
windows in one array of the row; windows that several items share (ties) count for each; an empty benchmark hits
nothing, no documents give no rows; extra columns of any name are ignored (decontaminate) or kept (drop_contaminated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fits, packed, small_enough, words, work_table

WINDOW = 13
#: Up to so many distinct benchmark minima and windows are broadcast, the windows up to so many bytes with their item ids.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: A stand-in minimum that keeps one row for every document in the probe.
ALWAYS = -(2**63)


def _shift_join(a: Column, b: Column, shift: int, fold) -> Column:
    """fold(a[i], b[i + shift]) wherever both exist."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), fold)


def _spread(df: DataFrame, column: str, length: int, fold) -> DataFrame:
    """Folds each run of `length` neighbours of an array column by doubling; every step is a column of its own.

    The last step may overlap what is folded already, which an idempotent fold (a minimum) allows."""
    have = 1
    while have < length:
        step = min(have, length - have)
        df = df.withColumn(column, _shift_join(F.col(column), F.col(column), step, fold))
        have += step
    return df


def gram_sizes(t: int) -> tuple[int, int]:
    """(k, w): the largest power of two k with 2k <= t + 3 and k <= t, and w = t + 1 - k."""
    k = 1
    while 4 * k <= t + 3 and 2 * k <= t:
        k *= 2
    return k, t + 1 - k


def minima(df: DataFrame, t: int, out: str) -> DataFrame:
    """Adds `out`: for each run of t words (column `_h` has their hashes) the least hash of its k-grams."""
    k, w = gram_sizes(t)
    df = df.withColumn(out, F.col("_h"))
    df = _spread(df, out, k, lambda a, b: F.xxhash64(a, b))  # k is a power of two: nothing overlaps
    return _spread(df, out, w, lambda a, b: F.least(a, b))


def window_table(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(t, gram, items): each distinct window text, with the ids (as strings) of the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("_item"), words(F.col("text")).alias("_w")).where("_item is not null and size(_w) > 0")
    items = items.withColumn("t", F.least(F.size("_w"), F.lit(window)))
    starts = items.select("_item", "_w", "t", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("t") + 1)).alias("_p"))
    grams = starts.select("_item", "t", F.array_join(F.slice("_w", F.col("_p"), F.col("t")), " ").alias("gram"))
    return grams.groupBy("t", "gram").agg(F.sort_array(F.collect_set("_item")).alias("items"))


def window_minima(grams: DataFrame, t: int) -> DataFrame:
    """The distinct winnowing minima (column `m`) of the windows of t words."""
    g = grams.where(F.col("t") == t).select(F.transform(F.split("gram", " "), lambda x: F.xxhash64(x)).alias("_h"))
    return minima(g, t, "_m").select(F.explode_outer("_m").alias("m")).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: doc_id, text_key (md5 of the text), n_words, n_hit, n_full, n_items, items, spans, contaminated.

    n_full counts the spans of whole windows (those of items of `window` words or more)."""
    spark = documents.sparkSession
    grams = work_table(spark, window_table(benchmark, window), "windows")
    lengths = sorted(r["t"] for r in grams.select("t").distinct().collect())  # at most `window` numbers
    docs = documents.select("doc_id", F.col("text").alias("_text"))
    docs = docs.select("doc_id", F.md5(F.coalesce("_text", F.lit(""))).alias("text_key"), words(F.col("_text")).alias("_w"))
    docs = docs.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    mark = spark.range(1).select(F.lit(0).alias("t"), F.lit(ALWAYS).cast("long").alias("m"))
    probes = []
    for t in lengths:
        docs = minima(docs, t, f"_m{t}")
        mark = mark.unionByName(window_minima(grams, t).select(F.lit(t).alias("t"), "m"))
        probes.append(F.array(F.struct(F.lit(t).alias("t"), F.col(f"_m{t}").alias("all"))))
    always = F.array(F.struct(F.lit(0).alias("t"), F.array(F.lit(ALWAYS).cast("long")).alias("all")))
    mark = work_table(spark, mark, "minima")
    weight = F.octet_length("gram") + F.octet_length(F.array_join("items", "")) + 24 * F.size("items")
    if small_enough(mark, broadcast_rows) and fits(grams, broadcast_rows, weight, broadcast_bytes):
        # the row's words stay in place; `_row` is made and grouped in one evaluation
        docs = docs.withColumn("_row", F.monotonically_increasing_id())
        found = _runs(docs, F.concat(always, *probes), "_row", "doc_id", "text_key", "n_words", "_w").join(F.broadcast(mark), ["t", "m"])
        hit = found.select("_row", "doc_id", "text_key", "n_words", "t", "_p", _gram()).join(F.broadcast(grams), ["t", "gram"], "left")
        out = _spans(hit, "_row", "doc_id", "text_key", "n_words")
    else:
        # beyond the bounds the minima alone are shuffled; the words meet what is left by text, which equal rows share
        none = F.array(F.struct(F.lit(0).alias("t"), F.array().cast("array<long>").alias("all")))
        hits = _runs(docs, F.concat(none, *probes), "text_key").join(mark, ["t", "m"]).select("text_key", "t", "_p").distinct()
        found = docs.select("text_key", "_w").join(hits, "text_key").select("text_key", "t", "_p", _gram())
        told = _spans(found.join(grams, ["t", "gram"]), "text_key")
        out = docs.select("doc_id", "text_key", "n_words").join(told, "text_key", "left")
        out = out.withColumn("spans", F.coalesce("spans", F.array().cast(told.schema["spans"].dataType))).withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(x["end"] - F.greatest(s["upto"], x["start"]), F.lit(0))).cast("long").alias("n")),
        lambda s: s["n"],
    )
    out = out.withColumn("n_hit", covered).withColumn("items", F.array_sort(F.array_distinct("_items")))
    return out.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size(F.filter("spans", lambda x: x["end"] - x["start"] >= window)).cast("long").alias("n_full"),
        F.size("items").cast("long").alias("n_items"), "items", "spans", ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _runs(docs: DataFrame, probes: Column, *keep: str) -> DataFrame:
    """(*keep, t, _p, m): the minimum m of the run of t words from _p on. The outer forms keep the optimizer from adding size()
    filters that repeat the whole hash expression below it."""
    each = docs.select(*keep, F.explode_outer(probes).alias("_c"))
    return each.select(*keep, F.col("_c.t").alias("t"), F.posexplode_outer("_c.all").alias("_p", "m"))


def _gram() -> Column:
    return F.array_join(F.slice("_w", F.col("_p") + 1, F.greatest("t", F.lit(1))), " ").alias("gram")


def _spans(hit: DataFrame, *keys: str) -> DataFrame:
    span = F.when(F.col("items").isNotNull(), F.struct(F.col("_p").alias("start"), (F.col("_p") + F.col("t")).alias("end")))
    return hit.groupBy(*keys).agg(F.array_sort(F.collect_set(span)).alias("spans"), F.flatten(F.collect_set("items")).alias("_items"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The documents, all columns, without those that hold a whole benchmark window, however long they are, and those that are
    contaminated by the weight of shorter items. Equal texts share their fate, so the text's md5 is the key."""
    spark = documents.sparkSession
    bad = decontaminate(documents, benchmark, broadcast_rows=broadcast_rows, **options).where("n_full > 0 or contaminated").select("text_key").distinct()
    bad = work_table(spark, bad, "contaminated")
    mine = packed(documents, _key=F.md5(F.coalesce("text", F.lit(""))))
    few = small_enough(bad, broadcast_rows)
    return mine.join(F.broadcast(bad) if few else bad, F.col("_key") == F.col("text_key"), "left_anti").select("_row.*")
