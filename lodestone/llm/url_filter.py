"""URL filter: rules by host and path, and trust and distrust propagated over the host graph.

A rule fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule decides.
Hosts with more than half of their pages allowed (blocked) by rules are trusted (blocked) seeds. Personalised PageRank
carries trust from the trusted seeds along host edges and distrust from the blocked seeds along reversed edges; a url
that no rule fits is blocked if its host's distrust, times the number of hosts, is at least `threshold` and more than
its trust. Host edges are links between hosts found in the pages' html, and those between a host and the host it is a
subdomain of, both ways, where both have pages.

Plan: urls are judged without reading html; links are pre-aggregated per page partition before they are shuffled;
ranks and edges stay in Spark, one join and one aggregation an iteration; the per-host verdicts meet the pages in a
join that adaptive execution can split on a hot host.

Cases: null or malformed urls have empty host and path, no rule and the default verdict (allow); null html has no
links; hosts without seeds in reach have no trust or distrust and are allowed; repeated rows count and return each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, small_enough, work_table

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING, ITERATIONS, THRESHOLD = 0.85, 10, 0.5
BROADCAST_ROWS = 500_000
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) columns; both empty for null urls and those without `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between different hosts."""
    linked = pages.select(split_url(F.col("url"))[0].alias("src"), F.explode_outer(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("_to"))
    linked = linked.select("src", ascii_lower(F.col("_to")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()
    up = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where("src <> dst and dst <> ''")
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    return linked.union(up).union(up.select("dst", "src")).distinct()


def host_scores(pages: DataFrame, judged: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust), each times the number of hosts; only hosts that have either."""
    spark = pages.sparkSession
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    hosts = work_table(spark, hosts, "hosts")
    edges = host_edges(pages, hosts)
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("f"), F.col("dst").alias("host")).union(edges.select(F.lit("distrust"), "dst", "src"))
    degree = ways.groupBy("kind", "f").agg(F.count("*").alias("_d"))
    ways = work_table(spark, ways.join(degree, ["kind", "f"]).select("kind", "f", "host", (F.lit(damping) / F.col("_d")).alias("w")), "edges")
    seeds = hosts.select(F.lit("trust").alias("kind"), "host").where("2 * good > n").union(hosts.select(F.lit("distrust"), "host").where("2 * bad > n"))
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("_n"))  # two rows at most
    seeds = work_table(spark, seeds.join(F.broadcast(sizes), "kind").select("kind", "host", (F.lit(1 - damping) / F.col("_n")).alias("r")), "seeds")
    rank = seeds
    for i in range(iterations):
        moved = ways.join(rank.select("kind", F.col("host").alias("f"), F.col("r").alias("_r")), ["kind", "f"]).select("kind", "host", (F.col("_r") * F.col("w")).alias("r"))
        rank = seeds.union(moved).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % 4 == 3:
            rank = work_table(spark, rank, "rank")
    n = hosts.agg(F.count("*")).first()[0]
    return rank.groupBy("host").agg(*((F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)) * n).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, **options) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url, html)."""
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("ruled", ruled)
    scores = host_scores(pages.select("url", "html"), judged, **options)
    bad = scores.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("_host"))
    bad = work_table(pages.sparkSession, bad, "blocked-hosts").withColumn("_bad", F.lit(True))
    if small_enough(bad, BROADCAST_ROWS):
        bad = F.broadcast(bad)
    out = judged.join(bad, F.col("host") == F.col("_host"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("_bad"), "block"), F.lit("allow")).alias("verdict"))
