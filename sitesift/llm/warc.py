"""WARC archives of captured pages: writing, and transaction assembly.

Writing. Each page is one capture of three records: request, response (or
revisit) and metadata; request and metadata name the capture's main record by
WARC-Concurrent-To. Captures with equal payloads of at least ``DEDUP_BYTES``
bytes share one response (the largest page_id); the others are revisit records
that refer to it and hold no payload. The records are text lines of Spark's
own writer whose line end is the two CRLF that close a WARC record, gzipped: a
lost task is simply run again. Captures go to files by the size of their
payload (``SIZES``): so many of a size a file that it holds about 128 MB of
payloads at most, or one capture alone.

Reading. Files are inflated and cut piece by piece, and records leave in
batches of ``BATCH_BYTES``, so a worker holds a compressed file, one record
and one batch. They are cut by Content-Length only, so no payload content can
be mistaken for a boundary. Assembly groups
the records by the main record's id, which the others give as concurrent-to,
and emits one nested row per capture. Payloads stay out of the shuffle unless
they are asked for; a revisit's payload size comes from the response it
refers to.

Hot groups: equal payloads meet in a partial maximum, and the join back has
one row a digest on its other side.

Defined cases: null html is an empty payload; a null url gives no target URI;
control characters of a url are percent-encoded. Rows that repeat a page_id
and payload are captures of the same id: each gives a row back, all of them
responses if theirs is the largest id. A null page_id sorts below every
number. Other columns are ignored. An empty table gives empty archives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import scratch

DEDUP_BYTES = 1000
#: Greatest payload and captures of a file of that size.
SIZES = ((64 << 10, 2000), (1 << 20, 128), (16 << 20, 8), (1 << 62, 1))
PIECE, BATCH_BYTES = 1 << 20, 8 << 20
#: Fixed values of the format.
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in
                    ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid),
             F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]     # null values leave the line out
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(RECORD_END), block)


def records(pages: DataFrame) -> DataFrame:
    """The records of each capture, three rows a page: ``value``, and the
    payload's size as ``bytes``."""
    html = F.coalesce("html", F.lit(""))
    url = F.col("url")
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), F.col("page_id"), url.alias("uri"),
        html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("bytes"))
    order = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))
    shared = (rows.filter(F.col("bytes") >= DEDUP_BYTES).groupBy(F.col("digest").alias("d2"))
              .agg(F.max(order).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    rows = rows.join(shared, F.col("digest") == F.col("d2"), "left")
    again = F.coalesce(order < F.col("lead"), F.lit(False))
    main = _uuid(F.lit("main"), F.col("id"), F.col("digest"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    lead_id = _uuid(F.lit("main"), F.col("lead").cast("string"), F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(RECORD_END))
    host = F.regexp_extract("uri", r"^[a-z]+://([^/?#]*)", 1)
    path = F.coalesce(F.regexp_replace(F.regexp_replace("uri", r"^[a-z]+://[^/?#]*", ""), "#.*$", ""), F.lit(""))
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    uri = ("WARC-Target-URI", F.col("uri"))
    refers = F.when(again, lead_id)
    request = _record(F.lit("request"), _uuid(F.lit("request"), F.col("id"), F.col("digest")),
                      [uri, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "),
                               F.coalesce(host, F.lit("")), F.lit(RECORD_END)))
    response = _record(kind, main,
                       [uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                        ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))), ("WARC-Refers-To", refers),
                        ("Content-Type", F.lit("application/http; msgtype=response"))],
                       F.concat(head, F.when(again, F.lit("")).otherwise(F.col("html"))))
    metadata = _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("id"), F.col("digest")),
                       [uri, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page-id: "), F.col("id"), F.lit(CRLF)))
    return rows.select("bytes", F.explode(F.array(request, response, metadata)).alias("value"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Gzipped WARC files under ``path``, in a folder for each size."""
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    found, low = records(pages), -1
    for high, captures_a_file in SIZES:
        rows = found.filter((F.col("bytes") > low) & (F.col("bytes") <= high)).select("value")
        (rows.write.option("lineSep", RECORD_END).option("compression", "gzip")
         .option("maxRecordsPerFile", 3 * captures_a_file).text(f"{path}/upto-{high}"))
        if largest <= high:
            return
        low = high


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file in pieces."""
    left = data
    while left:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(left, PIECE)
            left = member.unconsumed_tail
            if not piece and not left:
                break
            yield piece
        left = member.unused_data


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive that comes
    in pieces."""
    held, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("the archive ends inside a record's header")
                return
        lines = held[:stop].decode().split(CRLF)
        fields = dict(line.split(": ", 1) for line in lines[1:])
        end = stop + 4 + int(fields["Content-Length"])
        while len(held) < end + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[stop + 4:end])
        del held[:end + 4]


RECORDS = ("type string, id string, main string, uri string, refers_to string, digest string, page_id bigint, "
           "payload_bytes bigint, block string, payload binary")


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The archive's records. ``main``: the id of the capture's main record;
    ``digest`` is taken from the payload as read (a revisit's from its header)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split()[0] for c in RECORDS.split(",")]
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse(inflated(content.as_py())):
                    kind = fields["WARC-Type"]
                    row = dict.fromkeys(names)
                    row |= {"type": kind, "id": fields["WARC-Record-ID"], "uri": fields.get("WARC-Target-URI"),
                            "main": fields.get("WARC-Concurrent-To", fields["WARC-Record-ID"]),
                            "refers_to": fields.get("WARC-Refers-To")}
                    if kind in ("response", "revisit"):
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if kind == "response":
                            row |= {"payload_bytes": len(payload), "digest": hashlib.sha1(payload).hexdigest()}
                            if with_payload:
                                row["payload"] = payload
                        else:
                            row["digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    else:
                        row["block"] = block.decode()
                        if kind == "metadata":
                            number = row["block"].removeprefix("page-id: ").strip()
                            row["page_id"] = int(number) if number else None
                    rows.append(row)
                    size += len(block) if with_payload else 512
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(cut, RECORDS)


_SCHEMA = pa.schema([(c.strip().split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.strip().split()[1]])
                     for c in RECORDS.split(",")])


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: main id, request, response (the main
    record, a revisit or a response) and metadata."""
    main = F.col("type").isin("response", "revisit")
    whole = found.groupBy("main").agg(
        F.count_if(main).alias("copies"),
        F.max(F.when(F.col("type") == "request", F.struct("id", "uri", "block"))).alias("request"),
        F.max(F.when(main, F.struct("type", "id", "uri", "refers_to", "digest", "payload_bytes", "payload"))).alias("response"),
        F.max(F.when(F.col("type") == "metadata", F.struct("id", "page_id", "block"))).alias("metadata"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back and assemble: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archive(pages, path)
    rows = captures(read_records(spark, path))
    rows = rows.select("main", F.col("metadata.page_id").alias("page_id"), F.col("response.uri").alias("url"), "response.*")
    # The few responses that revisits refer to, looked up by their record id.
    wanted = rows.filter("refers_to is not null").select(F.col("refers_to").alias("lead")).distinct()
    leads = (rows.filter("type = 'response'").join(wanted, F.col("id") == F.col("lead")).groupBy("lead")
             .agg(F.max("page_id").alias("lead_page"), F.max("payload_bytes").alias("lead_bytes")))
    both = rows.join(leads, F.col("refers_to") == F.col("lead"), "left")
    return both.select(
        "page_id", F.coalesce("payload_bytes", "lead_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("lead_page")).alias("refers_to"), "url")
