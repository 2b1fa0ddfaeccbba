"""WARC archives of pages: writing with revisits, and reading with segment reassembly.

Writing.  A page is a response record whose block is an HTTP response with
chunked transfer framing.  Of pages with equal payloads of at least
``MIN_REVISIT`` bytes the one with the smallest id is the response; the others
are revisit records that refer to it.  Blocks longer than ``segment_bytes`` are
cut: the first segment keeps the record's type, continuation records follow with
the origin's id and their segment number, and the last states the total length.
Spark's own text writer stores the records (two line ends after a record are the
row separator), so archives reach any file system that Spark reaches, with its
commit protocol.

Reading.  Archives are parsed as streams.  Whole records are finished on the
spot; segments are grouped by their origin's id, ordered by number, checked for
gaps and against the total length, and joined.  Chunked framing is then undone
and the payload is checked against its digest.

A record's id is made of the page's id, its payload's digest and, for repeated
rows, a number; so it does not depend on partitions, and what a revisit refers to
is the id of a response record.  Files hold so many records of at most one
segment each that they stay below ``FILE_BYTES`` before compression.

Null html is an empty payload.  Rows with a null id are responses that nothing
refers to.  Of repeated rows with the smallest id all are responses.  Records
that fail a check come back with a null payload and the reason in ``problem``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, column, quoted

MIN_REVISIT = 100
SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
FILE_BYTES = 128 << 20
#: What the head of a record may take, its target URI left out.
HEAD_BYTES = 2048
BATCH_BYTES = 8 << 20
END = b"\r\n"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# Framing


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, END]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over.  ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip() or b"?", 16)
        at = end + 1
        if size < 0 or at + size > len(body):
            raise ValueError("chunk is cut off")
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size
        if body[at : at + 2] == END:
            at += 2
        elif body[at : at + 1] == b"\n":
            at += 1
        else:
            raise ValueError("chunk is longer than its size")


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response block, with chunked framing undone."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP head is not ended")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(END)[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding", b"").endswith(b"chunked") else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return b"".join([VERSION, END, head, b"Content-Length: %d\r\n\r\n" % len(block), block])


def segments(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes, size: int) -> list[bytes]:
    """The record, or its segments if the block is longer than ``size``."""
    first = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields]
    if len(block) <= size:
        return [record(first, block)]
    out = [record([*first, ("WARC-Segment-Number", 1)], block[:size])]
    count = -(-len(block) // size)
    for k in range(1, count):
        total = [("WARC-Segment-Total-Length", len(block))] if k == count - 1 else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:segment:{k + 1}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", k + 1), *total]
        out.append(record(own, block[k * size : (k + 1) * size]))
    return out


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a binary stream."""
    while line := stream.readline():
        line = line.strip()
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.partition(b":")
            fields[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
        yield fields, stream.read(int(fields["content-length"]))


# Writing


def record_uri(page_id, digest, again):
    """The id of a page's record; ``again`` numbers rows that repeat page and payload from 0."""
    return F.concat(F.lit("urn:boxfield:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.when(again > 0, F.concat(F.lit(":copy:"), again.cast("string"))).otherwise(F.lit("")))


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with again: 0, 1, ... of rows that repeat page_id and payload_digest; only such rows are gathered by them."""
    key = ["page_id", "payload_digest"]
    several = scratch.write(rows.groupBy(*key).count().where("count > 1").select(*(F.col(k).alias(f"__{k}") for k in key)))
    if several.isEmpty():
        return rows.withColumn("again", F.lit(0))
    same = F.col("page_id").eqNullSafe(F.col("__page_id")) & (F.col("payload_digest") == F.col("__payload_digest"))
    order = Window.partitionBy(*key).orderBy("url")
    twice = rows.join(several, same, "left_semi").withColumn("again", F.row_number().over(order) - 1)
    return rows.join(several, same, "left_anti").withColumn("again", F.lit(0)).unionByName(twice)


def record_types(pages: DataFrame, scratch: Scratch, *, page_id="page_id", html="html", url: str | None = "url") -> DataFrame:
    """(page_id, url, payload, payload_digest, record_uri, refers_to): refers_to, the id of the response's record, is set for revisits.

    Only digests that occur twice or more are joined back; a frequent digest is
    one row there, and its pages are plain join rows that may be split.
    """
    payload = F.coalesce(column(pages, html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(column(pages, page_id).cast("bigint").alias("page_id"), (column(pages, url).cast("string") if url else F.lit(None).cast("string")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "payload_digest")
    again = scratch.write(large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    revisit = (F.col("page_id") != F.col("first")) & (F.octet_length("payload") >= MIN_REVISIT)
    refers = F.when(revisit, record_uri(F.col("first"), F.col("payload_digest"), F.lit(0)))
    own = record_uri(F.col("page_id"), F.col("payload_digest"), F.col("again"))
    return numbered(rows, scratch).join(again, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", own.alias("record_uri"), refers.alias("refers_to"))


def one_line(text: str) -> str:
    return " ".join(text.split())


def write_archives(typed: DataFrame, path: str, *, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages of ``record_types`` as gzipped WARC files below ``path``."""
    records_per_file = max(1, file_bytes // (segment_bytes + HEAD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for url, payload, digest, own, refers in zip(*(b.column(c).to_pylist() for c in ("url", "payload", "payload_digest", "record_uri", "refers_to"))):
                fields = [("WARC-Target-URI", one_line(url) if url else None), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if refers is None:
                    found = segments("response", own, fields, HTTP_HEAD + chunked(payload), segment_bytes)
                else:
                    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>"), ("WARC-Payload-Length", len(payload))]
                    found = segments("revisit", own, fields + more, HTTP_HEAD, segment_bytes)
                out += found
                held += sum(map(len, found))
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = typed.mapInArrow(run, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# Reading

RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length bigint, n_segments int, payload binary, problem string"
PARTS = RECORDS + ", origin string, number int, total bigint, block binary"


def plain(uri: str | None) -> str | None:
    return uri.strip("<>") if uri else None


def finish(fields: dict, block: bytes | None, n_segments: int, problem: str | None = None) -> dict:
    """A result row from the fields of a record's first segment and its whole block."""
    kind = fields.get("warc-type")
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None
    payload, length = None, fields.get("warc-payload-length")
    if problem is None and kind == "response":
        try:
            payload = http_payload(block)
            length = len(payload)
            if digest and hashlib.sha256(payload).hexdigest() != digest:
                payload, problem = None, "payload digest differs"
        except ValueError as e:
            problem = str(e)
    return {"record_id": plain(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": plain(fields.get("warc-refers-to")), "payload_digest": digest, "payload_length": None if length is None else int(length), "n_segments": n_segments, "payload": payload, "problem": problem}


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    from .common import struct_type

    return to_arrow_schema(struct_type(ddl))


def read_archives(spark: SparkSession, path: str, scratch: Scratch, *, with_payload: bool = True) -> DataFrame:
    """Records of all archives below ``path``, segments put together (RECORDS).

    Without payloads, these are still decoded and checked, and then left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = arrow_schema(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for fields, block in parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 16)):
                    if number := fields.get("warc-segment-number"):
                        row = finish(fields, None, 0, "segment")
                        total = fields.get("warc-segment-total-length")
                        row |= {"origin": plain(fields.get("warc-segment-origin-id")) or row["record_id"], "number": int(number), "total": int(total) if total else None, "block": block}
                        held += len(block)
                    else:
                        row = finish(fields, block, 1)
                        if not with_payload:
                            row["payload"] = None
                        held += len(row["payload"] or b"")
                    rows.append(row)
                    if held >= BATCH_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    every = scratch.write(files.mapInArrow(run, PARTS))
    names = [f.split()[0] for f in RECORDS.split(", ")]
    whole = every.where("origin is null").select(*names)
    return whole.unionByName(reassembled(every.where("origin is not null"), with_payload))


def reassembled(parts: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records from segments: grouped by origin, ordered, checked and decoded.

    A group is one record, as long as its writer made it.
    """
    first = ("record_type", "target_uri", "refers_to", "payload_digest", "payload_length")
    groups = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("segments"),
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in first),
    )
    schema = arrow_schema(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                yield pa.RecordBatch.from_pylist([joined(r, with_payload)], schema=schema)

    return groups.mapInArrow(run, RECORDS)


def joined(r: dict, with_payload: bool = True) -> dict:
    numbers = [s["number"] for s in r["segments"]]
    block = b"".join(s["block"] for s in r["segments"])
    problem = None
    if numbers != list(range(1, len(numbers) + 1)):
        problem = "a segment is missing or repeated"
    elif r["total"] is None:
        problem = "the last segment is missing"
    elif r["total"] != len(block):
        problem = "the segments' length differs from the total"
    digest = r["payload_digest"]
    fields = {"warc-type": r["record_type"], "warc-record-id": r["origin"], "warc-target-uri": r["target_uri"], "warc-refers-to": r["refers_to"], "warc-payload-digest": f"sha256:{digest}" if digest else None, "warc-payload-length": r["payload_length"]}
    out = finish(fields, block, len(numbers), problem)
    if not with_payload:
        out["payload"] = None
    return out


def resolved(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Records with the payload of revisits taken from the response that they refer to by its id."""
    rows = scratch.write(records)
    wanted = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("__r")).distinct()
    have = rows.where("record_type = 'response' and problem is null").join(wanted, F.col("record_id") == F.col("__r"), "left_semi").select(F.col("record_id").alias("__r"), F.col("payload").alias("__p"))
    return rows.join(have, F.col("refers_to") == F.col("__r"), "left").withColumn("payload", F.coalesce("payload", "__p")).drop("__p", "__r")


def digest(records: DataFrame) -> DataFrame:
    """The columns of the op3 contract, and the number of segments and the problem, from records read back."""
    page = lambda c: F.regexp_extract(c, r"^urn:boxfield:page:(-?\d+)", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("bigint"))
    return records.select(number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "n_segments", "problem")


def write_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives in the shared folder and read these back."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = scratch.path()
    write_archives(record_types(pages, scratch), path, **options)
    return read_archives(spark, path, scratch, with_payload=False)
