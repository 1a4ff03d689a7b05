"""Full-text search: substring phrases over path, name and content, ranked by BM25 over trigram lengths.

A phrase may be found in any of the three columns, each in a different one; the name branch looks at names only but
keeps whole-row lengths. With a postings table, candidates come from the rows that have all trigrams of the phrases;
without it, from two scans, one that counts and one that ranks. Corpus size and mean length are taken from `stats` where
the caller has them stored, so a search with postings reads only candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import occurrences, trigram_length, trigrams
from lodestone.options import DEFAULT_TOP_K, match_phrases

COLUMNS = ("path", "name", "content")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def row_length() -> Column:
    return reduce(lambda a, b: a + b, (trigram_length(F.col(c)) for c in COLUMNS))


def corpus_stats(objects: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return objects.agg(F.count("*").alias("n"), F.avg(row_length()).alias("avgdl"))


def postings(objects: DataFrame, *keep: str) -> DataFrame:
    """(gram, object_id, *keep): each distinct trigram of each row."""
    # the outer form: the optimizer would otherwise repeat the whole expression in a filter on its size
    each = F.explode_outer(F.array_distinct(F.concat(*(trigrams(F.col(c)) for c in COLUMNS))))
    return objects.select(each.alias("gram"), F.col("id").alias("object_id"), *keep).where("gram is not null")


def candidates(posted: DataFrame, phrases: list[str]) -> DataFrame:
    """(id): rows that have every trigram of every phrase; the grams are literals, so they are pushed to the scan."""
    grams = sorted({p[i : i + 3] for p in phrases for i in range(len(p) - 2)})
    hit = posted.where(F.col("gram").isin(grams)).groupBy("object_id").agg(F.count("*").alias("_n"))
    return hit.where(F.col("_n") == len(grams)).select(F.col("object_id").alias("id"))


def counted(objects: DataFrame, phrases: list[str], sets: dict[str, tuple[str, ...]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, _dl, <set><i>): a row's length, and how often each phrase starts in each set of columns. Each text is folded once."""
    used = [c for c in COLUMNS if any(c in columns for columns in sets.values())]
    low = objects.select("id", *keep, row_length().alias("_dl"), *(F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in used))
    each = low.select("id", *keep, "_dl", *(occurrences(F.col(f"_{c}"), p).alias(f"_{c}{i}") for c in used for i, p in enumerate(phrases)))
    total = lambda columns, i: reduce(lambda a, b: a + b, (F.col(f"_{c}{i}") for c in columns)).alias
    return each.select("id", *keep, "_dl", *(total(columns, i)(f"{name}{i}") for name, columns in sets.items() for i in range(len(phrases))))


def _known(found: DataFrame, objects: DataFrame, n: int, names: list[str], stats: DataFrame | None) -> DataFrame:
    """One row: n and avgdl of the corpus, and for each set and phrase the number of rows that hold it; one pass over `found`."""
    df = [F.count_if(F.col(f"{s}{i}") > 0).alias(f"_d{s}{i}") for s in names for i in range(n)]
    if stats is None:
        return found.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *df)
    return stats.select("n", "avgdl").crossJoin(found.agg(*df))  # one row each


def _rank(name: str, n: int) -> Column:
    def part(i: int) -> Column:
        df, f = F.col(f"_d{name}{i}"), F.col(f"{name}{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("avgdl")))

    return -reduce(lambda a, b: a + b, map(part, range(n)))


def _all(name: str, n: int) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{name}{i}") > 0 for i in range(n)))


def match(objects: DataFrame, phrases: list[str], columns: tuple[str, ...] = COLUMNS, stats: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, rank, *keep): rows with every phrase in the given columns, rank ascending is better."""
    if not phrases:
        return objects.select("id", F.lit(0.0).alias("rank"), *keep).where(F.lit(False))
    n, found = len(phrases), counted(objects, phrases, {"f": columns}, keep)
    known = _known(found, objects, n, ["f"], stats)
    return found.where(_all("f", n)).crossJoin(F.broadcast(known)).select("id", _rank("f", n).alias("rank"), *keep)


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy("rank", "id").limit(k)


def full_text_hits(objects: DataFrame, query: str, top_k: int = DEFAULT_TOP_K, stats: DataFrame | None = None, posted: DataFrame | None = None) -> DataFrame:
    """(id, name_match, rank): the best of the name branch and of the any-column branch, each limited first.

    Both branches come from the same pass: a row is told once for each branch it matches, and each branch is cut to its
    best before anything is shuffled. A pass before it counts the corpus and the phrases."""
    phrases = match_phrases(query)
    if not phrases:
        return objects.select("id", F.lit(False).alias("name_match"), F.lit(0.0).alias("rank")).where(F.lit(False))
    if posted is not None:
        stats = stats if stats is not None else corpus_stats(objects)
        # a phrase's document frequency needs the rows of that phrase alone, so rows with any one phrase stay
        some = reduce(DataFrame.union, (candidates(posted, [p]) for p in phrases)).distinct()
        objects = objects.join(some, "id", "left_semi")
    n = len(phrases)
    found = counted(objects, phrases, {"name": ("name",), "any": COLUMNS})
    known = _known(found, objects, n, ["name", "any"], stats)
    told = found.where(_all("any", n)).crossJoin(F.broadcast(known))
    branch = lambda name: F.when(_all(name, n), F.struct(F.lit(name == "name").alias("name_match"), _rank(name, n).alias("rank")))
    told = told.select("id", F.explode(F.filter(F.array(branch("name"), branch("any")), lambda x: x.isNotNull())).alias("_b")).select("id", "_b.*")
    place = F.row_number().over(Window.partitionBy("name_match").orderBy("rank", "id"))
    best = told.withColumn("_place", place).where(F.col("_place") <= top_k)
    both = best.groupBy("id").agg(F.max("name_match").alias("name_match"), F.min("rank").alias("rank"))
    return both.orderBy(F.desc("name_match"), "rank", "id").limit(top_k)


def full_text_search(objects: DataFrame, files: DataFrame, query: str, top_k: int = DEFAULT_TOP_K, **known) -> DataFrame:
    """The hits with their objects and their files' digests (null where the file is gone)."""
    hits = full_text_hits(objects, query, top_k, **known)  # at most top_k rows
    return objects.join(F.broadcast(hits), "id").join(files.select("path", F.col("sha256_digest").alias("file_digest")), "path", "left")
