"""The registered queries over a whole small table: columns, keys, and what can be recomputed plainly or by SQL."""

import hashlib
import re
import zlib

import duckdb
import pytest

from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_near_dup": ["doc_id", "class_id", "class_size"],
    "op5_html": ["page_id", "url", "text", "n_chars"],
    "op6_gif": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_line_dedup": ["doc_id", "n_lines", "n_dropped", "n_chars", "text_sha256"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, con, name):
    out = queries.QUERIES[name](spark, SF)
    assert [c for c in out.columns if c in COLUMNS[name]] == COLUMNS[name]
    rows = out.collect()
    source, key = ("pages", "page_id") if "page_id" in out.columns else ("documents", "doc_id")
    ids = [r[0] for r in con.sql(f"SELECT {key} FROM {source}").fetchall()]
    if name != "op10_packing":
        assert sorted(r[key] for r in rows) == sorted(ids)
    if name in queries.ORACLE_SQL:
        want = con.sql(queries.ORACLE_SQL[name])
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        assert sorted(out.columns) == sorted(want.columns)
        assert sorted(tuple(str(r[c]) for c in sorted(out.columns)) for r in rows) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())
    texts = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()) if source == "documents" else {}
    if "held_out" in out.columns:
        folds, left, least = (4, 2, 0.7) if name == "op3_quality" else (5, 0, 0.5)
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == left)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        same = {}
        assert all(same.setdefault(texts[r.doc_id], r.score) == r.score for r in rows)
    if name == "op6_gif":
        for r in rows:
            raw = texts[r.doc_id].encode()
            padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
            assert re.fullmatch(r"frames=[1-9]\d*;cs=\d+;hist=\d+(,\d+){63}", r.feature)
    if name == "op10_packing":
        total = {}
        for r in rows:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert 0 < r.length <= 2048 - r.offset
        assert set(total) == set(ids) and all(total[r.doc_id] == r.doc_tokens for r in rows)
    if name == "op5_html":
        assert all(r.n_chars == len(r.text) for r in rows)
