"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing: each task writes gzip-compressed WARC 1.1 files, a member per record, and returns an index row for each
record: file, offset, length, URL and digest. The index is a Parquet table; it is made before anything is read, and
only files of attempts that succeeded are in it. Pages with equal payloads (by SHA-1) are one response, that of the
smallest page_id, and revisit records that refer to it; the groups are found by a count per digest on the map side,
and only digests that occur twice or more are joined back. A digest with more than 1/HOT of all rows (of such there
are less than HOT, so they are broadcast) never draws its pages into one task: these are dealt by page instead.

Reading: the selected index rows are dealt by file and stretch of the file, in tasks of about the same number of bytes,
sorted by offset, and neighbouring ranges are read in one request when the gap between them is small. Payloads of
responses are checked against their digests.

Edge cases: null and empty payloads are equal payloads of 0 bytes; a null URL leaves its header out; rows with equal
page_id and payload are responses each; a null page_id never is a group's response unless all are null (then each is
a response); an empty table gives no archive and an empty index; only page_id, url and html are read, so other columns
may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dealt, new_path, stored
from millrace.llm.files import attempt_name, opened, output

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 1 << 30
#: Bytes between two records that are read rather than skipped, and bytes of one request at most.
GAP = 1 << 16
REQUEST = 1 << 23
#: A digest of more than this part of all rows is hot.
HOT = 1000
_INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _written(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    payload = (html or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    refers_to = None if first is None or first == page_id else first
                    data = _member(_record(page_id, url, payload, digest, refers_to))
                    if stream is None or at > ROLL:
                        if stream is not None:
                            stream.close()
                        stream, name = output(folder, attempt_name(".warc.gz"))
                        at = 0
                    stream.write(data)
                    rows.append((page_id, url, name, at, len(data), len(payload), digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(data)
                yield _table(rows)
        finally:
            if stream is not None:
                stream.close()

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * 9
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _INDEX.split(", ")])


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) and returns the index."""
    folder = folder or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    groups = stored(rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "warc-digests")
    many = (groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]) // HOT
    again = groups.where("n > 1")
    hot = again.where(F.col("n") > many).where(F.col("n") >= HOT).select(F.col("sha").alias("h_sha"), F.col("first").alias("h_first"))
    rest = again.where((F.col("n") <= many) | (F.col("n") < HOT)).select(F.col("sha").alias("g_sha"), F.col("first").alias("g_first"))
    marked = rows.join(F.broadcast(hot), F.col("sha") == F.col("h_sha"), "left")
    # Pages of a hot digest look for no further partner: a longer key, another for each page, matches none.
    key = F.when(F.col("h_sha").isNull(), F.col("sha")).otherwise(F.concat("sha", F.encode(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "UTF-8")))
    marked = marked.withColumn("key", key).join(rest, F.col("key") == F.col("g_sha"), "left").select("page_id", "url", "html", F.coalesce("h_first", "g_first").alias("first"))
    return stored(marked.mapInArrow(_written(folder), _INDEX), "warc-index")


def _parsed(data: bytes) -> tuple[int | None, str | None, bytes | None, int, str, str, int | None]:
    """page_id, url, payload, its length, digest, type, refers_to of one compressed record."""
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    page = lambda name: int(x) if (x := fields.get(name, "<urn:x-page:>")[len("<urn:x-page:") : -1]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return page("WARC-Record-ID"), fields.get("WARC-Target-URI"), None, length, digest, "revisit", page("WARC-Refers-To")
    if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return page("WARC-Record-ID"), fields.get("WARC-Target-URI"), payload, length, digest, "response", None


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = REQUEST) -> Iterator[tuple[int, int, list[int]]]:
    """Requests (start, end, which ranges) that cover sorted (offset, length) ranges."""
    start = end = 0
    held: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if held and (offset - end > gap or offset + length - start > most):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        end = max(end, offset + length)
        held.append(i)
    if held:
        yield start, end, held


def _read(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, None
        try:
            for batch in batches:
                wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
                i = 0
                while i < len(wanted):
                    j = i
                    while j < len(wanted) and wanted[j][0] == wanted[i][0]:
                        j += 1
                    if name != wanted[i][0]:
                        if source is not None:
                            source.close()
                        name = wanted[i][0]
                        where, path = opened(name)
                        source = where.open_input_file(path)
                    part = [(o, n) for _, o, n in wanted[i:j]]
                    for start, end, held in coalesced(part):
                        data = source.read_at(end - start, start)
                        found = [_parsed(data[part[k][0] - start : part[k][0] - start + part[k][1]]) for k in held]
                        ids, urls, bodies, lengths, digests, kinds, refers = zip(*found)
                        out = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.int64())]
                        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                        if payloads:
                            out.append(pa.array(bodies, pa.binary()))
                            names.append("payload")
                        yield pa.record_batch(out, names=names)
                    i = j
        finally:
            if source is not None:
                source.close()

    return run


def read_warc(index: DataFrame, where: Column | None = None, payloads: bool = True, stretch: int = 1 << 25) -> DataFrame:
    """The records of the index rows that `where` selects: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits)."""
    chosen = (index if where is None else index.where(where)).select("file", "offset", "length")
    total = chosen.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).collect()[0]["n"]
    parts = dealt(chosen.withColumn("stretch", F.floor(F.col("offset") / stretch)), total, "file", "stretch")
    parts = parts.sortWithinPartitions("file", "offset").select("file", "offset", "length")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return parts.mapInArrow(_read(payloads), schema + ", payload binary" * payloads)


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(CAST('0x' || substr(d, CAST(i AS INT), 1) AS INT)), 4, '0')), '') AS bits FROM s),
c AS (SELECT *, list_transform(range(0, 32), lambda j: list_sum(list_transform(range(1, 6), lambda k: CAST(substr(bits, CAST(5 * j + k AS INT), 1) AS INT) * CAST(power(2, 5 - k) AS INT)))) AS fives FROM b)
SELECT page_id, url, payload_bytes, array_to_string(list_transform(fives, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM c
"""
