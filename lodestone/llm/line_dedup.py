"""Line dedup by site-relative frequency.

Per host, the number of its pages that contain a line over the number of all its pages; lines whose share exceeds
`ratio` are boilerplate there and go from that host's pages. Copies count like any page, but a line that only copies
of one text hold doesn't repeat across pages and stays.

Plan: one scan explodes each page's distinct line hashes (never the lines) and counts them per (host, hash), combined
before the shuffle. The few hashes over the ratio are confirmed as text: a second scan counts the lines that have them,
and only lines that exceed the ratio by themselves are boilerplate. Per-host lists of them are short (at most lines
per page / ratio) and meet the pages in a broadcast join within `broadcast_rows` and `broadcast_bytes`, else in a join
that adaptive execution can split on a hot host. Removal itself is a filter inside the row: the texts are never shuffled.

Cases: a null text stays null and isn't a page; a null host has no site, its pages keep all lines; blank lines are
never boilerplate; a share that equals the ratio (a tie) doesn't exceed it; a page that loses all its lines stays, with
empty text; very long texts are split whole; repeated rows are pages each; an empty table gives an empty one; extra
columns of any name stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, fits, packed, work_table

RATIO = 0.1
#: Boilerplate lines and their bytes up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _distinct_lines(text: Column) -> Column:
    return F.array_distinct(F.filter(_lines(text), lambda x: F.trim(x) != ""))


def _lists(lines: DataFrame, column: str, broadcast_rows: int, broadcast_bytes: int) -> DataFrame:
    """(_site, _bad): the values of a column of `lines` per _host."""
    size = F.octet_length(column) + 24 if dict(lines.dtypes)[column] == "string" else F.lit(24)
    few = fits(lines, broadcast_rows, size, broadcast_bytes)
    out = lines.groupBy(F.col("_host").alias("_site")).agg(F.collect_set(column).alias("_bad"))
    return F.broadcast(out) if few else out


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(_host, _line, n_pages, share): the boilerplate lines of each host."""
    spark = pages.sparkSession
    own = pages.select(F.col(host).alias("_host"), F.col(text).alias("_text")).where("_host is not null and _text is not null").withColumn("_page", F.xxhash64("_text"))
    totals = work_table(spark, own.groupBy("_host").agg(F.count("*").alias("_all")), "totals")

    def over(each: DataFrame) -> DataFrame:
        counts = each.groupBy("_host", "_line").agg(F.count("*").alias("n_pages"), F.min("_page").alias("_a"), F.max("_page").alias("_b")).where("_a <> _b")
        return counts.join(totals, "_host").withColumn("share", F.col("n_pages") / F.col("_all")).where(F.col("share") > ratio).select("_host", "_line", "n_pages", "share")

    marks = F.array_distinct(F.transform(_distinct_lines(F.col("_text")), lambda x: F.xxhash64(x)))
    likely = work_table(spark, over(own.select("_host", "_page", F.explode_outer(marks).alias("_line")).where("_line is not null")), "likely")
    near = own.join(_lists(likely, "_line", broadcast_rows, broadcast_bytes), F.col("_host") == F.col("_site"))
    some = F.filter(_distinct_lines(F.col("_text")), lambda x: F.array_contains("_bad", F.xxhash64(x)))
    out = work_table(spark, over(near.select("_host", "_page", F.explode_outer(some).alias("_line")).where("_line is not null")), "boilerplate")
    discard(totals, likely)
    return out


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, counts: tuple[str, str] | None = None, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The pages, `text` without boilerplate lines; `counts` names two more columns, of a page's lines and of those dropped."""
    if counts and {c.lower() for c in counts} & {c.lower() for c in pages.columns}:
        raise ValueError(f"the pages have a column {counts[0]} or {counts[1]} already")
    found = boilerplate(pages, host, text, ratio, broadcast_rows, broadcast_bytes)
    own = packed(pages, _host=F.col(f"`{host}`"), _lines=_lines(F.col(f"`{text}`")))
    own = own.join(_lists(found, "_line", broadcast_rows, broadcast_bytes), F.col("_host") == F.col("_site"), "left")
    own = own.withColumn("_kept", F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_bad", x))))
    columns = [F.array_join("_kept", "\n").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in pages.columns]
    if counts:
        n = F.coalesce(F.size("_lines"), F.lit(-1))
        columns.append(F.greatest(n, F.lit(0)).cast("long").alias(counts[0]))
        columns.append(F.when(F.col("_lines").isNull(), 0).otherwise(n - F.size("_kept")).cast("long").alias(counts[1]))
    return own.select(*columns)
