"""WARC records as a chunked record table.

An archive is a table of rows (archive, record, chunk, last, head, data, digest, bytes_so_far, digest_so_far). A record's
payload is in pieces of at most ``CHUNK`` bytes, the first in the row of its header; every piece has its own SHA-1, so it
can be checked alone and a broken check can go on at any piece, and the SHA-1 of the payload up to its end. Rows in the
order of (archive, record, chunk), header before data, are the archives' WARC files, which ``export`` writes and ``load``
reads. Payloads that were met before are revisit records: their header names the first record and no payload follows.

No Python code is given more of a payload than a piece: Spark cuts payloads where it reads them, and a digest goes from
piece to piece. Nearly all records are one row, and are read and checked where they lie; only those of several rows are
dealt by record, so that their digests can be streamed.

Defined results: null html is an empty payload; a page_id that repeats is a record each (and so is its record name), and
all rows with the smallest id of equal payloads are responses; null page_ids come after all others and are responses where
there is no other; a table without rows gives none. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table
from kelvora.llm.shingles import trimmed

CHUNK = 1 << 18
#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Rows and bytes that a task holds before it hands them on.
OUT_ROWS, OUT_BYTES = 2000, 1 << 22
_SCHEMA = "archive bigint, record bigint, chunk int, last boolean, head binary, data binary, digest string, bytes_so_far bigint, digest_so_far string"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.string()]
_READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_READ_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(kind: str, page_id: int | None, url: str | None, digest: str, n: int, refers_to: int | None) -> bytes:
    """The header's payload length is the full payload's; Content-Length is what follows."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {n}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if kind == 'revisit' else n}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def first_of_payload(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, sha, first): first is the smallest page_id with the same payload, null for small payloads."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html")).withColumn("sha", F.sha1("html"))
    first = own.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    # Equal payloads may be a third of all rows; the side with one row a digest lets Spark split the other.
    return own.join(first, "sha", "left")


def write(pages: DataFrame, least_bytes: int = LEAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """The written chunk table. Payloads move once, to those that equal them."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record, rows, held, running, seen = TaskContext.get().partitionId(), -1, [], 0, hashlib.sha1(), 0
        for batch in batches:
            for page_id, url, sha, n, revisit, first, k, last, piece in zip(*batch.columns, strict=True):
                data, k = piece.as_buffer().to_pybytes() if piece.is_valid else b"", k.as_py()
                own = hashlib.sha1(data)
                if k == 0:
                    record, running, seen = record + 1, own.copy(), len(data)
                    head = _header("revisit" if revisit.as_py() else "response", page_id.as_py(), url.as_py(), _b32(bytes.fromhex(sha.as_py())), n.as_py(), first.as_py())
                else:
                    head, seen = None, seen + len(data)
                    running.update(data)
                rows.append((archive, record, k, last.as_py(), head, data, _b32(own.digest()), seen, _b32(running.digest())))
                held += len(data)
                if held >= OUT_BYTES or len(rows) >= OUT_ROWS:
                    yield _batch(rows, _SCHEMA, _KINDS)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _SCHEMA, _KINDS)

    told = first_of_payload(pages, least_bytes).withColumn("n", F.octet_length("html").cast("bigint")).withColumn("revisit", F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull()))
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("html"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("body") / F.lit(chunk)).cast("int") - 1))
    cut = told.withColumn("body", body).withColumn("most", F.size(places) - 1).select("page_id", "url", "sha", "n", "revisit", "first", F.posexplode(F.transform(places, lambda i: F.substring("body", i * chunk + 1, F.lit(chunk)))).alias("k", "piece"), "most")
    return materialise(cut.select("page_id", "url", "sha", "n", "revisit", "first", "k", (F.col("k") == F.col("most")).alias("last"), "piece").mapInArrow(trimmed(records), _SCHEMA), "warc")


def _told(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().rstrip("\r\n").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines)


def _number(urn: str) -> int | None:
    return int(x) if (x := urn[len("<urn:page:") : -1]) else None


def _row(head: dict[str, str], seen: int, digest: str) -> tuple:
    """What a record says, if the bytes that followed fit it."""
    kind, told, n = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
    if seen != int(head["Content-Length"]) or kind == "response" and (digest != told or seen != n):
        raise ValueError(f"record {head['WARC-Record-ID']}: {seen} bytes don't fit its header")
    return _number(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, told, kind, _number(head["WARC-Refers-To"]) if kind == "revisit" else None


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one row."""
    for batch in batches:
        out = []
        for head, data, digest in zip(*batch.columns, strict=True):
            own = _b32(hashlib.sha1(data.as_buffer()).digest())
            if own != digest.as_py():
                raise ValueError("a piece is damaged")
            out.append(_row(_told(head.as_py()), len(data.as_buffer()), own))
        if out:
            yield _batch(out, _READ, _READ_KINDS)


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of several rows, in order."""
    head, running, seen, at = None, hashlib.sha1(), 0, 0
    for batch in batches:
        out = []
        for chunk, last, first, data, total, digest in zip(*batch.columns, strict=True):
            if chunk.as_py() == 0:
                if head is not None:
                    raise ValueError(f"record {head['WARC-Record-ID']} has no end")
                head, running, seen, at = _told(first.as_py()), hashlib.sha1(), 0, 0
            piece = data.as_buffer()
            running.update(piece)
            seen += len(piece)
            if head is None or chunk.as_py() != at or seen != total.as_py() or _b32(running.digest()) != digest.as_py():
                raise ValueError("a piece is missing or damaged")
            at += 1
            if last.as_py():
                out.append(_row(head, seen, _b32(running.digest())))
                head = None
        if out:
            yield _batch(out, _READ, _READ_KINDS)
    if head is not None:
        raise ValueError(f"record {head['WARC-Record-ID']} has no end")


def read(chunks: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record. Lengths and digests are
    checked piece by piece, and one that doesn't fit its header raises."""
    one = F.col("last") & (F.col("chunk") == 0)
    short = chunks.where(one).select("head", "data", "digest").mapInArrow(trimmed(_short), _READ)
    dealt = chunks.where(~one).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return short.union(dealt.select("chunk", "last", "head", "data", "bytes_so_far", "digest_so_far").mapInArrow(trimmed(_long), _READ))


def damaged(chunks: DataFrame) -> DataFrame:
    """(archive, record, chunk) of pieces whose bytes aren't those of their own digest, each checked alone."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [_b32(hashlib.sha1(d.as_buffer()).digest()) != x.as_py() for d, x in zip(batch.column(3), batch.column(4), strict=True)]
            yield batch.select(["archive", "record", "chunk"]).filter(pa.array(bad, pa.bool_()))

    return chunks.select("archive", "record", "chunk", "data", "digest").mapInArrow(find, "archive bigint, record bigint, chunk int")


def export(chunks: DataFrame, folder: str) -> list[str]:
    """Plain .warc files, one per archive, streamed piece by piece into a folder that the driver can write to."""
    out: dict[int, Path] = {}
    Path(folder).mkdir(parents=True, exist_ok=True)
    for r in chunks.orderBy("archive", "record", "chunk").select("archive", "head", "data", "last").toLocalIterator():
        path = out.setdefault(r["archive"], Path(folder, f"{r['archive']:05d}.warc"))
        with path.open("ab") as f:
            f.write((r["head"] or b"") + r["data"] + (b"\r\n\r\n" if r["last"] else b""))
    return [str(p) for p in out.values()]


def load(spark: SparkSession, paths: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of plain .warc files. A file is Spark's unit of reading and has to fit a task; its records are cut
    without copying them whole. archive is a hash of the file's path."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*batch.columns, strict=True):
                data, at, record, rows, held = memoryview(content.as_buffer()), 0, 0, [], 0
                while at < len(data):
                    end, have = -1, 1 << 12
                    while end < 0:
                        end = bytes(data[at : at + have]).find(b"\r\n\r\n")
                        if end < 0 and at + have >= len(data):
                            raise ValueError("a header has no end")
                        have *= 4
                    head = bytes(data[at : at + end + 4])
                    begin, n = at + end + 4, int(_told(head)["Content-Length"])
                    running = hashlib.sha1()
                    for k, a in enumerate(range(0, max(1, n), chunk)):
                        piece = bytes(data[begin + a : begin + min(n, a + chunk)])
                        running.update(piece)
                        rows.append((archive.as_py(), record, k, a + chunk >= n, head if k == 0 else None, piece, _b32(hashlib.sha1(piece).digest()), a + len(piece), _b32(running.digest())))
                        held += len(piece)
                        if held >= OUT_BYTES or len(rows) >= OUT_ROWS:
                            yield _batch(rows, _SCHEMA, _KINDS)
                            rows, held = [], 0
                    at, record = begin + n + 4, record + 1
                if rows:
                    yield _batch(rows, _SCHEMA, _KINDS)

    files = spark.read.format("binaryFile").load(paths).select(F.xxhash64("path").alias("archive"), "content")
    return files.mapInArrow(trimmed(records), _SCHEMA)


#: The archives' rows as SQL tells them; base32 from the digest's bits, five at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT sha, min(page_id) AS first FROM p GROUP BY sha
), b AS (
  SELECT sha, array_to_string(list_transform(range(0, 8), lambda g:
    array_to_string(list_transform(range(0, 4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + g * 5, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT, 1)), '')), '') AS digest
  FROM f
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (sha) JOIN b USING (sha)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"))).drop("url")
