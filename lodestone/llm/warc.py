"""WARC archives of web pages: write one gzip member per record, read back sequentially.

Writing: payload digests are taken in the scan and grouped to find payloads that several pages share; the row with
the smallest id carries the payload (response), the others refer to it (revisit, no payload stored). Each task
appends its records to archive segments of about `segment_bytes`, which become rows of a table in the shared folder.
Reading: each segment is inflated incrementally, member by member; the record's header gives the content length that
frames its block while it is inflated; block and payload digests are computed from the pieces and compared with the stored ones.

Plan: only (digest, id) is shuffled, pre-aggregated; the few shared digests meet the pages in a broadcast join if
there are at most `broadcast_rows` of them, else in a join that adaptive execution can split on a hot digest.

Cases: null html is an empty payload; a null url leaves the target header out; a null id is written as `null` and is
never the smallest unless all are null, then each row is a response; rows that repeat id and payload (ties) are all
responses when that id is the smallest, and share its record id; very long payloads are framed and verified in pieces;
extra columns of any name are ignored; empty tables give empty archives and results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_enough, work_table

SEGMENT_BYTES = 8 << 20
BROADCAST_ROWS = 500_000
MIN_REVISIT_BYTES = 0
#: Fixed record date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
READ_BYTES, INFLATED = 1 << 16, 1 << 20
LEVEL = 6


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page, nth: str = "") -> str:
    """A record's id: of its page, and of its place among the records where it isn't the page that others refer to."""
    return f"<urn:page:{'null' if page is None else 'id:' + quote(str(page), safe='')}{nth}>"


def record_parts(page, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, nth: str = "") -> list[bytes]:
    """One record, not compressed, in parts: WARC header, HTTP header, and the body that only a response record keeps.

    Line breaks in a url are written as %0D and %0A; nothing else in it changes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = b"" if revisit else payload
    digest = hashlib.sha1(http)
    digest.update(body)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page, nth)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(digest.digest()).decode()}")
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return ["\r\n".join(lines).encode() + b"\r\n\r\n", http, body, b"\r\n\r\n"]


def gzip_member(parts: list[bytes], level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*map(c.compress, parts), c.flush()])


class Member:
    """One gzip member of an archive, inflated as it is read, at most INFLATED bytes ahead."""

    def __init__(self, view: memoryview, at: int):
        self.view, self.at, self.z, self.held = view, at, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate some more; False at the member's end."""
        if self.z.eof:
            return False
        piece = self.z.unconsumed_tail
        if not piece:
            piece = self.view[self.at : self.at + READ_BYTES]
            if not piece:
                raise ValueError("archive ends inside a gzip member")
            self.at += len(piece)
        self.held += self.z.decompress(piece, INFLATED)
        if self.z.eof:
            self.at -= len(self.z.unused_data)
        return True

    def upto(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What comes before the mark, which is passed over; None if the member (or its first `most` bytes) has none."""
        start = 0
        while True:
            found = self.held.find(mark, start, most)
            if found >= 0:
                out = bytes(self.held[:found])
                del self.held[: found + len(mark)]
                return out
            start = max(0, len(self.held) - len(mark) + 1)
            if most is not None and len(self.held) >= most or not self.more():
                return None

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, fewer at the member's end."""
        while n > 0 and (self.held or self.more()):
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def read_record(member: Member, keep: bool = True) -> dict:
    """Header fields (lower-case names), payload (where `keep`), and whether framing and digests hold.

    The block is framed by the content length as it is inflated; digests are computed piece by piece."""
    head = member.upto(b"\r\n\r\n")
    if head is None or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields["content-length"])
    block, body, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
    http = member.upto(b"\r\n\r\n", n)
    if http is not None:
        block.update(http + b"\r\n\r\n")
        for piece in member.pieces(n - len(http) - 4):
            block.update(piece)
            body.update(piece)
            size += len(piece)
            if keep:
                kept.append(piece)
    framed = http is not None and len(http) + 4 + size == n and b"".join(member.pieces(5)) == b"\r\n\r\n"
    told = next((int(x.split(b":")[1]) for x in (http or b"").split(b"\r\n") if x.lower().startswith(b"content-length:")), size)
    revisit = fields["warc-type"] == "revisit"
    named = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
    ok = framed and fields["warc-block-digest"] == named(block) and (revisit or (fields["warc-payload-digest"] == named(body) and told == size))
    return {"fields": fields, "type": fields["warc-type"], "payload": b"".join(kept) if keep and not revisit else None, "payload_bytes": told, "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "ok": ok}


def read_archive(archive: bytes | memoryview, keep: bool = True) -> Iterator[dict]:
    """The records of an archive in turn, one gzip member each."""
    view, at = memoryview(archive), 0
    while at < len(view):
        member = Member(view, at)
        yield read_record(member, keep)
        while member.more():  # what stands behind a record that isn't framed well
            member.held.clear()
        at = member.at


def _page(urn: str | None):
    value = re.fullmatch(r"<urn:page:id:([^;>]*)(?:;[^>]*)?>", urn or "")
    return unquote(value[1]) if value else None


def _write(segment_bytes: int, level: int):
    schema = pa.schema([("n_records", pa.int64()), ("archive", pa.binary())])

    def run(batches):
        held, size, task = [], 0, TaskContext.get().partitionId()
        nth = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([len(held)]), pa.array([b"".join(held)], pa.binary())], schema=schema)

        for batch in batches:
            for page, url, html, first, revisit in zip(*(batch.column(i) for i in range(5))):
                page, first, nth = page.as_py(), first.as_py(), nth + 1
                place = "" if page is not None and page == first else f";{task}.{nth}"
                member = gzip_member(record_parts(page, url.as_py(), (html.as_py() or "").encode(), first, revisit.as_py(), place), level)
                held.append(member)
                size += len(member)
                if size >= segment_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def write_archives(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES, broadcast_rows: int = BROADCAST_ROWS, level: int = LEVEL) -> DataFrame:
    """(n_records, archive): archive segments with a record for each row of pages (page_id, url, html), in the shared folder."""
    spark = pages.sparkSession
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = own.withColumn("_key", F.when(F.octet_length("html") >= min_revisit_bytes, F.sha2("html", 256)))
    shared = keyed.where("_key is not null").groupBy("_key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    shared = work_table(spark, shared, "payloads")
    if small_enough(shared, broadcast_rows):
        shared = F.broadcast(shared)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = keyed.join(shared, "_key", "left").select("page_id", "url", "html", "first", revisit.alias("revisit"))
    return work_table(spark, rows.mapInArrow(_write(segment_bytes, level), "n_records long, archive binary"), "warc")


RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, ok boolean, payload binary"


def _read(payloads: bool):
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("ok", pa.bool_()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for r in read_archive(archive.as_buffer(), payloads):
                    f = r["fields"]
                    rows.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), r["type"], r["payload_bytes"], r["digest"], _page(f.get("warc-refers-to")), r["ok"], r["payload"]))
                    held += r["payload_bytes"] if payloads else 100
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archive segments; `ok` tells whether framing and digests hold. Broken archives raise."""
    return archives.select("archive").mapInArrow(_read(payloads), RECORDS)
