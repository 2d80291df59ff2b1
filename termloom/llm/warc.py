"""WARC archives: write captures, read them back, assemble each capture from its records.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. Request and
metadata name the response by WARC-Concurrent-To. Archives are written by Spark's own text writer and
read by its binaryFile reader, so any store that Spark can reach will do.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import passing, repeated, shared_dir, staged

CRLF = "\r\n"
#: Smallest payload, in bytes, for which a revisit record is written.
MIN_REVISIT = 100
#: Captures in one archive file at most, payload bytes in one file (about), and payload bytes from which a capture counts as large.
#: A file of others holds PER_FILE * LARGE bytes at most, one of large captures FILE_BYTES, or a single capture.
PER_FILE, FILE_BYTES, LARGE = 1000, 1 << 28, 1 << 18
RECORDS = "record_id string, record_type string, concurrent_to string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, page_id string, payload string"


def _urn(role: str, page_id: Column, digest: Column, url: Column, copy: Column) -> Column:
    """A record id made from the capture's role and content and its number among equal ones: reruns and lost tasks give the same one."""
    named = F.coalesce(F.concat(F.lit("="), page_id.cast("string")), F.lit(""))
    h = F.md5(F.concat_ws(":", F.lit(role), copy.cast("string"), digest, F.length(url).cast("string"), url, named).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, rid: Column, uri: Column, mime: str, body: Column, *more: Column) -> Column:
    head = [F.lit(f"WARC/1.0{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), rid, F.lit(f"{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), uri]
    return F.concat(*head, *more, F.lit(f"{CRLF}Content-Type: {mime}{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body, F.lit(CRLF))


def write_captures(pages: DataFrame, folder: str) -> None:
    """Write three records for each row of pages (page_id, url, html); a null html is an empty payload.

    Every row is a capture with ids of its own, also where page_id is null or repeats; page_id is metadata only. Rows equal
    in page_id, url and payload are told apart by a number. Of equal payloads of MIN_REVISIT bytes or more, that with the
    smallest page_id, then url becomes a response, the others revisits that refer to it; rows that tie on that page_id stay
    responses. A null page_id counts as larger than all others, a null url is written as empty, line ends within a url are dropped.
    page_id may have any atomic type; it is written URL-encoded, null as the word null. An empty table gives no record.
    """
    html, most = F.coalesce("html", F.lit("")), Observation()
    base = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # digests that occur again, in narrow rows; the rest, nearly all, passes by
    lead = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("lead")
    seen = base.observe(most, F.max(F.octet_length("html")).alias("bytes"))
    again = seen.select("page_id", "url", "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), lead).where("n > 1")
    again = staged(again.select("digest", F.col("lead.page_id").alias("first_id"), F.col("lead.url").alias("first_url")), "payloads")
    rows = base.join(again, "digest", "left_anti").select("*", F.lit(None).cast(pages.schema["page_id"].dataType).alias("first_id"), F.lit(None).cast("string").alias("first_url"), F.lit(0).cast("long").alias("copy"))
    if not again.isEmpty():
        # equal rows are counted, then written as often, so no group is gathered
        counted = base.join(again, "digest").groupBy("page_id", "url", "digest", "first_id", "first_url").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
        rows = rows.unionByName(repeated(counted, "n", "copy"))
    key = F.coalesce(F.url_encode(F.col("page_id").cast("string")), F.lit("null"))
    key = F.when(F.col("page_id").cast("string") == "null", F.lit("%6Eull")).otherwise(key)
    large = F.octet_length("html") >= MIN_REVISIT
    revisit = F.coalesce(large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"))
    refers = F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _urn("response", F.col("first_id"), F.col("digest"), F.col("first_url"), F.lit(0)))
    own = [F.col(c) for c in ("page_id", "digest", "url", "copy")]
    rid = _urn("response", *own)
    near = F.concat(F.lit(f"{CRLF}WARC-Concurrent-To: "), rid)
    url = F.col("url")
    request = _record("request", _urn("request", *own), url, "application/http; msgtype=request", F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF * 2}")), near)
    response = F.when(revisit, _record("revisit", rid, url, "application/http; msgtype=response", http, digest, refers)).otherwise(_record("response", rid, url, "application/http; msgtype=response", F.concat(http, "html"), digest))
    metadata = _record("metadata", _urn("metadata", *own), url, "application/warc-fields", F.concat(F.lit("page-id: "), key, F.lit(CRLF)), near)
    largest = most.get["bytes"] or 0
    parts = [(None, PER_FILE)] if largest < LARGE else [(F.octet_length("html") < LARGE, PER_FILE), (F.octet_length("html") >= LARGE, max(1, FILE_BYTES // largest))]
    for which, per_file in parts:
        some = rows if which is None else rows.where(which)
        some.select(F.concat_ws(CRLF, request, response, metadata).alias("value")).write.mode("append").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, all its members (one for each record, in many archives), piece by piece; bytes that aren't gzip pass as they are."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + step] for k in range(0, len(data), step))
        return
    rest = data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(rest, step)
            rest = member.unconsumed_tail
            yield piece
            if not piece and not rest and not member.eof:
                raise ValueError("an archive ends within a gzip member")
        rest = member.unused_data.lstrip(b"\x00")


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive that comes in pieces: named fields in lower case, and the block. Content-Length alone bounds a
    block. One record is held at a time."""
    held, more = bytearray(), True
    while True:
        begin = held.find(b"WARC/1.")
        stop = held.find(b"\r\n\r\n", max(begin, 0))
        if begin >= 0 and stop >= 0:
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[begin:stop].decode("utf-8").split(CRLF)[1:])}
            end = stop + 4 + int(fields["content-length"])
            while len(held) < end:
                piece = next(pieces, None)
                if piece is None:
                    raise ValueError("an archive ends within a record")
                held += piece
            yield fields, bytes(held[stop + 4 : end])
            del held[:end]
            continue
        piece = next(pieces, None)
        if piece is None:
            if bytes(held).strip():
                raise ValueError("an archive ends within a record")
            return
        held += piece


def read_records(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row for each record of the archives in folder; payloads are digested anew, and returned if asked.

    A file is unpacked piece by piece and one record is held at a time; a broken file or a payload unlike its digest ends the job.
    """

    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, zip(*rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                rows = []
                for f, block in parse(inflated(cell.as_py())):
                    kind, body, page = f["warc-type"], None, None
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        if (own := hashlib.sha256(body).hexdigest()) != f["warc-payload-digest"].removeprefix("sha256:"):
                            raise ValueError(f"the payload of {f['warc-record-id']} doesn't have the digest written: {own}")
                    elif kind == "metadata":
                        page = next((v.strip() for k, _, v in (x.partition(":") for x in block.decode().split(CRLF)) if k == "page-id"), None)
                    said = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    rows.append((f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-target-uri"), said, None if body is None else len(body), f.get("warc-refers-to"), page, body.decode("utf-8") if payload and body is not None else None))
                    if len(rows) >= (8 if payload else 4096):
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, request, response, metadata (structs; null where a record is missing).

    Records meet under the id that they are concurrent to, or their own where they name none. Copies of a
    record fall together; of different records of one role in a capture, the smallest (by struct order) is kept.
    """
    role = F.when(F.col("record_type").isin("response", "revisit"), "response").otherwise(F.col("record_type"))
    whole = F.struct("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "page_id", "payload")
    keyed = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), role.alias("role"), whole.alias("record"))
    return keyed.groupBy("capture_id").agg(*(F.min(F.when(F.col("role") == r, F.col("record"))).alias(r) for r in ("request", "response", "metadata")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, read them, assemble captures and resolve revisits.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id of the response), a row for each
    row of pages.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_captures(pages, folder)
    passing(spark, folder)
    captures = staged(assemble(read_records(spark, folder)).select(
        "capture_id", F.col("metadata.page_id").alias("key"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("target")
    ), "captures")
    there = captures.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("key").alias("there_key"), F.col("own_bytes").alias("there_bytes"))
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "null", F.url_decode(c)).cast(kind)
    return captures.join(there, "target", "left").select(
        number("key").alias("page_id"), F.coalesce("own_bytes", "there_bytes").cast("long").alias("payload_bytes"), "payload_digest", "record_type", number("there_key").alias("refers_to")
    )
