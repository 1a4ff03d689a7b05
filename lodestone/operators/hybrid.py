"""Tiered fusion of the two ranked lists, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import json_ids


def positions(hits: DataFrame, *order, name: str = "pos") -> DataFrame:
    """The (few) hits with their position from 0."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def merge(semantic: DataFrame, full_text: DataFrame) -> DataFrame:
    """(id, l2, bm25, tier, pos, src) of (id, dist) and (id, name_match, rank).

    Tier -1: name matches, in full-text order; 0: in both lists, by the better position; 1: in one list. At equal
    positions full-text comes before semantic. Up to the sum of both lists comes out."""
    s = positions(semantic.select("id", F.col("dist").alias("l2")), "l2", "id", name="_s")
    f = positions(full_text.select("id", F.col("rank").alias("bm25"), "name_match"), F.desc("name_match"), "bm25", "id", name="_f")
    both = s.join(f, "id", "full_outer")
    named, in_both = F.coalesce("name_match", F.lit(False)), F.col("_s").isNotNull() & F.col("_f").isNotNull()
    tier = F.when(named, -1).when(in_both, 0).otherwise(1)
    pos = F.when(named, F.col("_f")).otherwise(F.least("_s", "_f"))
    src = F.when(in_both, 0).when(F.col("_f").isNotNull(), 1).otherwise(2)
    return both.select("id", "l2", "bm25", tier.alias("tier"), pos.cast("int").alias("pos"), src.alias("src"))


def disagreeing(semantic: DataFrame, full_text: DataFrame, column: str = "file_digest") -> DataFrame:
    """The objects that both lists (id, column) hold with different values: none unless they saw different states of the files."""
    other = full_text.select("id", F.col(column).alias("_other"))
    return semantic.join(other, "id").where(~F.col(column).eqNullSafe(F.col("_other"))).select("id")


def ordered(merged: DataFrame) -> DataFrame:
    return merged.orderBy("tier", "pos", "src", "id")


def rerank(results: DataFrame, order: DataFrame) -> DataFrame:
    """results (id, ...) filtered and reordered by (position, id): unknown ids drop, repeated ones count once.

    The join is left to the planner, as an answer's length isn't known."""
    first = order.groupBy("id").agg(F.min("position").alias("position"))
    return results.join(first, "id").orderBy("position")


def answer_order(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(position, id) of a model's answer text."""
    return answers.select(F.posexplode(json_ids(F.col(answer))).alias("position", "id"))


def newest(events: DataFrame, key: str, started: str, value: Column) -> DataFrame:
    """Per key the value that was started last: a high-water mark over answers that arrive late."""
    return events.groupBy(key).agg(F.max(started).alias(started), F.max_by(value, F.col(started)).alias("value"))
