"""The index of a tree: build, refresh, apply changes, search, render."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Iterable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schema as S
from lodestone.functions import text as tx
from lodestone.functions.highlight import mark
from lodestone.operators import embed as em
from lodestone.operators import fulltext as ft
from lodestone.operators import hybrid as hy
from lodestone.operators import snapshot as sn
from lodestone.operators import vector as vc
from lodestone.options import Query, SearchOptions
from lodestone.parsing.objects import decode, parse
from lodestone.sources import scan as sc
from lodestone.store import MOST_PARTS, Store, deterministic_id

BUCKETED_POSTING = T.StructType([*S.POSTING.fields, T.StructField("bucket", T.IntegerType())])
PARSED = "path string, ordinal int, name string, kind string, language string, context_before array<int>, context_after array<int>, byte_range struct<start:int,end:int>, coordinates struct<start:struct<row:int,col:int>,end:struct<row:int,col:int>>, content string, rendered string, content_sha256 string"
#: Paths that one refresh looks up by name; more are found by listing the tree.
NAMED_PATHS = 10_000


def render_lines(path: str, lines: list[str], row: dict) -> str:
    """What functions.text.render() gives with its defaults, of a text that is split already."""
    out = [path, "", *(lines[i] for i in row["context_before"] if i < len(lines))]
    a, b = row["coordinates"]["start"]["row"], row["coordinates"]["end"]["row"]
    return "\n".join([*out, *lines[a : b + 1]])


def parse_files(scanned: DataFrame) -> DataFrame:
    """(path, content) to one row per object, with its decoded bytes, what is embedded, and the hash of that."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", PARSED)]

    def run(parts):
        for pdf in parts:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                raw = bytes(raw)
                lines = decode(raw).split("\n")
                for i, o in enumerate(parse(path, raw)):
                    body, shown = decode(raw[o["byte_range"]["start"] : o["byte_range"]["end"]]), render_lines(path, lines, o)
                    rows.append({"path": path, "ordinal": i, **o, "content": body, "rendered": shown, "content_sha256": hashlib.sha256(shown.encode()).hexdigest()})
            yield pd.DataFrame(rows, columns=names)

    return scanned.select("path", "content").mapInPandas(run, PARSED)


class Index:
    def __init__(self, spark: SparkSession, root: str | os.PathLike, path: str | os.PathLike | None = None, embedder=None, reranker: em.Reranker = em.keep_order):
        self.spark, self.root = spark, str(root)
        self.store = Store(spark, path or os.path.join(self.root, ".lodestone"))
        self.embedder, self.reranker = embedder or em.HashedTrigrams(), reranker
        self.cache: dict = {}
        #: Counters, and seconds by what they were spent on.
        self.stats = {"refreshes": 0, "searches": 0, "cache_hits": 0, "embedded": 0, "skipped": 0, "files_read": 0}
        self.times: dict[str, float] = {}

    @contextmanager
    def timed(self, what: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.times[what] = self.times.get(what, 0.0) + time.perf_counter() - began

    @property
    def files(self) -> DataFrame:
        return self.store.read("file", S.FILE)

    @property
    def objects(self) -> DataFrame:
        return self.store.read("object", S.OBJECT)

    @property
    def embeddings(self) -> DataFrame:
        return self.store.read("embedding", S.EMBEDDING)

    @property
    def postings(self) -> DataFrame:
        return self.store.read("posting", S.POSTING)

    def _listed(self, paths: set[str] | None) -> DataFrame:
        """The listing of the tree, or of some paths of it, fixed by a written table: all that follows sees one state."""
        if paths is not None and len(paths) <= NAMED_PATHS:
            listed = self.spark.createDataFrame(sc.look(self.root, paths), sc.LISTING)
        else:
            listed = sc.list_files(self.spark, self.root)
        return self.store.scratch(listed, "listed")

    def refresh(self, paths: Iterable[str] | None = None, rebuild_vectors: bool = False) -> dict[str, int]:
        """Bring the index up to date with the tree, or with some relative paths of it; counts of changes by kind.

        `rebuild_vectors` forgets the cached vectors and embeds all texts anew. On a failure the index stays as it was."""
        with self.timed("refresh"):
            try:
                return self._refresh(None if paths is None else set(paths), rebuild_vectors)
            finally:
                self.store.drop_scratch()

    def _refresh(self, paths: set[str] | None, rebuild_vectors: bool) -> dict[str, int]:
        listed, stored = self._listed(paths), self.files
        if paths is not None:
            named = self.store.scratch(self.spark.createDataFrame([(p,) for p in sorted(paths)], "path string"), "named")
            listed, stored_part = listed.join(named, "path", "left_semi"), stored.join(named, "path", "left_semi")
        else:
            stored_part = stored
        # the bytes of new and altered files are read once
        stale = sn.stale_by_metadata(stored, listed)
        read = self.store.scratch(sc.read_contents(stale, self.root).withColumn("sha256_digest", F.unhex(F.sha2("content", 256))), "read")
        now = read.drop("content").unionByName(listed.join(read.select("path"), "path", "left_anti").join(stored.select("path", "sha256_digest"), "path"))
        change = self.store.scratch(sn.changes(stored_part, now), "change")
        counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
        if set(counts) <= {"same"} and self.store.generation is not None and not rebuild_vectors:
            return counts
        altered = change.where("change in ('new', 'changed')").select("path")
        replaced = change.where("change in ('new', 'changed', 'deleted')").select("path")
        bucket = self.store.bucket(F.col("path"))
        # what follows reads and writes the buckets of the changed paths only
        touched = {r["b"] for r in change.where("change <> 'same'").select(bucket.alias("b")).distinct().collect()}  # at most as many as there are buckets
        fresh = sc.text_files(read.join(altered, "path", "left_semi"))
        parsed = self.store.scratch(parse_files(fresh).withColumn("id", deterministic_id()).withColumn("bucket", bucket), "parsed")
        # a file that has become binary loses its objects and its row
        before = self.store.read("file", S.FILE, touched)
        files = sn.delete(sn.delete(before, replaced), read).unionByName(sc.text_files(read).select(*S.FILE.names)).withColumn("bucket", bucket)
        old_objects = self.store.read("object", S.OBJECT, touched)
        objects = sn.delete(old_objects, replaced).withColumn("bucket", bucket).unionByName(parsed.select(*S.OBJECT.names, "bucket"))
        old = old_objects.join(replaced, "path", "left_semi").select(F.col("id").alias("object_id"))
        kept = self.store.read("posting", BUCKETED_POSTING, touched).join(old, "object_id", "left_anti")
        posted = kept.unionByName(ft.postings(parsed, "bucket"))
        stats = objects.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(ft.row_length()).cast("long").alias("total"))
        known, requests = self.embeddings, parsed.select("content_sha256", "rendered")
        if rebuild_vectors:
            every = self.store.read("object", S.OBJECT, set(range(self.store.buckets)) - touched).unionByName(objects.select(*S.OBJECT.names))
            known, requests = known.where(F.col("model") != self.embedder.name), self._rendered(every)
        taken = em.within_limit(requests)
        wanted = self.store.scratch(sn.embedding_requests(taken, known, self.embedder.name), "wanted")
        made, n_made = em.embed(wanted, self.embedder).withColumn("model", F.lit(self.embedder.name)), wanted.count()
        self.stats["embedded"] += n_made
        self.stats["skipped"] += requests.count() - taken.count()
        self.stats["files_read"] += read.count()
        whole = rebuild_vectors or self.store.vector_parts >= MOST_PARTS
        if whole:  # vectors that no object has any more go
            every = self.store.read("object", S.OBJECT, set(range(self.store.buckets)) - touched).select("content_sha256").union(objects.select("content_sha256"))
            vectors = known.unionByName(made).join(every, "content_sha256", "left_semi")
        else:
            vectors = made if n_made else None
        self.store.publish({"file": files, "object": objects, "posting": posted, "stats": stats}, touched, vectors, whole)
        self.cache.clear()
        self.stats["refreshes"] += 1
        return counts

    def vectors(self) -> DataFrame:
        """(object_id, data): each object's vector, found by the stored hash of its rendered text; nothing is rendered for it."""
        mine = self.embeddings.where(F.col("model") == self.embedder.name).select("content_sha256", "data")
        return self.objects.select(F.col("id").alias("object_id"), "content_sha256").join(mine, "content_sha256").select("object_id", "data")

    def _rendered(self, objects: DataFrame) -> DataFrame:
        """(content_sha256, rendered): objects' texts, cut from the file object's content."""
        whole = objects.where("kind = 'file'").select("path", F.col("content").alias("_text"))
        text = tx.render(F.col("path"), F.col("_text"), F.col("context_before"), F.col("coordinates"))
        return objects.join(whole, "path").select("content_sha256", text.alias("rendered"))

    def search(self, options: SearchOptions | str) -> DataFrame:
        """Merged hits with their objects, ordered; at most twice top_k rows."""
        o = SearchOptions(options) if isinstance(options, str) else options
        if o.refresh or o.rebuild_vectors:
            self.refresh(rebuild_vectors=o.rebuild_vectors)
        with self.timed("search"):
            out = self._search(o)
        if o.stats:
            print(self.dump_stats())
        return out

    def _search(self, o: SearchOptions) -> DataFrame:
        key = (o, self.store.generation)
        self.stats["searches"] += 1
        if key in self.cache:
            self.stats["cache_hits"] += 1
            return self.cache[key]
        known = self.store.corpus_stats()
        empty = self.spark.createDataFrame([], "id long, name_match boolean, rank double")
        named = ft.full_text_hits(self.objects, o.query, o.top_k, known, self.postings) if o.full_text else empty
        near = vc.range_search(self.vectors(), self.embedder([o.query])[0], o.radius, o.top_k) if o.semantic and o.query else self.spark.createDataFrame([], "id long, dist double")
        hits = hy.merge(near, named)
        digests = self.files.select("path", "sha256_digest")
        out = self.objects.join(F.broadcast(hits), "id").join(digests, "path", "left")
        rows = sorted(out.collect(), key=lambda r: (r["tier"], r["pos"], r["src"], r["id"]))  # at most 2 * top_k rows
        if o.rerank and rows:
            answer = self.reranker(o.query, [(r["id"], r["path"], r["name"], r["kind"]) for r in rows])
            by_id = {r["id"]: r for r in rows}
            rows = [by_id[i] for i in dict.fromkeys(answer) if i in by_id]
        result = self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([*out.schema.fields, T.StructField("position", T.IntegerType())])).orderBy("position")
        self.cache[key] = result
        return result

    def render(self, options: SearchOptions | str) -> list[dict]:
        """Hits whose file is still what was indexed, with text, highlight spans and highlighted lines."""
        o = SearchOptions(options) if isinstance(options, str) else options
        query, out = Query.parse(o.query), []
        for r in self.search(o).collect():
            try:
                with open(os.path.join(self.root, r["path"]), "rb") as f:
                    raw = f.read()
            except FileNotFoundError:
                continue
            if r["sha256_digest"] is None or bytes(r["sha256_digest"]) != hashlib.sha256(raw).digest():
                continue
            row = r.asDict(recursive=True)
            text = render_lines(r["path"], decode(raw).split("\n"), row)
            marks = mark(query.terms, text)
            out.append(row | {"rendered": text, "highlights": marks.spans, "highlighted_lines": marks.marked_lines})
        return out

    def counts(self) -> dict[str, int]:
        return {"file": self.files.count(), "object": self.objects.count(), "embedding": self.vectors().count(), "fts": self.postings.select("object_id").distinct().count()}

    def dump_stats(self) -> str:
        """The counters, the share of searches answered from the cache, and the seconds spent, as JSON."""
        rate = self.stats["cache_hits"] / self.stats["searches"] if self.stats["searches"] else 0.0
        return json.dumps(self.stats | {"cache_rate": round(rate, 4), "seconds": {k: round(v, 3) for k, v in self.times.items()}}, sort_keys=True)
