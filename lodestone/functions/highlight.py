"""What a query marks in texts: an Arrow-batched function, and the merge as a window over span rows."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.options import Query

SPANS = "struct<spans:array<struct<start:int,end:int>>,lines:array<struct<first:int,last:int>>>"


@dataclass
class Marks:
    """Marked code points [start, end) of a text, in order and apart from each other, and the lines each begins and ends on."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    lines: list[tuple[int, int]] = field(default_factory=list)

    @property
    def marked_lines(self) -> list[int]:
        return sorted({n for pair in self.lines for n in pair})


@functools.lru_cache(maxsize=256)
def _matcher(terms: tuple[str, ...]) -> re.Pattern | None:
    """Stops where any term begins, with a group for each of them: terms may begin at one place and overlap."""
    if not terms:
        return None
    quoted = [re.escape(t) for t in terms]
    return re.compile(f"(?={'|'.join(quoted)})" + "".join(f"(?=({q})?)" for q in quoted), re.IGNORECASE)


def mark(terms: tuple[str, ...], text: str) -> Marks:
    """Literal matches of the terms, case folded. A term's own matches don't overlap; what overlaps or touches is one span."""
    matcher, out = _matcher(terms), Marks()
    if matcher is None:
        return out
    free = [0] * len(terms)  # where each term may match again
    for m in matcher.finditer(text):
        at = m.start()
        for i in range(len(terms)):
            end = m.end(i + 1)
            if end < 0 or at < free[i]:
                continue
            free[i] = end
            if out.spans and at <= out.spans[-1][1]:
                out.spans[-1] = (out.spans[-1][0], max(out.spans[-1][1], end))
            else:
                out.spans.append((at, end))
    row = seen = 0
    for start, end in out.spans:
        row += text.count("\n", seen, start)
        last = row + text.count("\n", start, end - 1)
        out.lines.append((row, last))
        row, seen = last, end - 1
    return out


def highlight(text: Column, query: Query | str) -> Column:
    """Spans and lines of each text, as SPANS."""
    terms = (query if isinstance(query, Query) else Query.parse(query)).terms

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [mark(terms, t or "") for t in texts]
        return pd.DataFrame({
            "spans": [[{"start": a, "end": b} for a, b in m.spans] for m in found],
            "lines": [[{"first": a, "last": b} for a, b in m.lines] for m in found],
        })

    return run(text)


def highlighted_lines(lines: Column) -> Column:
    """The distinct line numbers, in order, of a column of (first, last) lines."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(lines, lambda x: F.array(x["first"], x["last"])))))


def merge_span_rows(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end) rows with overlapping or touching ones merged: islands where no earlier end reaches the start."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
