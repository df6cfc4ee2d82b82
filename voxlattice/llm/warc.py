"""WARC archives: write page captures as records, read them back, assemble transactions.

Writing is JVM-side: the text sink with CRLF CRLF as its line separator emits exactly the bytes of WARC/1.1
records (header, blank line, block, two line ends), one gzip stream per part file. Reading streams the files line
by line through a parser that follows Content-Length, so a task holds one record, never a file; payloads may
contain blank lines or text that looks like a header.

A capture is three records: the request, the response (or, where its payload equals that of another capture, a
revisit that refers to it) and the metadata record. Request and metadata name the response or revisit in
WARC-Concurrent-To; ``assemble`` joins them through it into one nested row per capture.

Defined results: null html is the empty payload; a null url is written as ``urn:unknown``; equal payloads are
represented by the row with the largest id, and rows repeated with that id are all written whole; a null id stays null
and is smaller than all others; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlattice.llm.scratch import scratch_path, staged

#: Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex SHA-1: eight groups of five hex digits, each four letters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for group in range(8):
        number = F.conv(F.substring(hex_digest, 1 + 5 * group, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(number, shift).bitwiseAND(F.lit(31)) + F.lit(1)
            letters.append(F.substr(alphabet, at, F.lit(1)))
    return F.concat(*letters)


def _header(fields: list[tuple[str, Column]]) -> Column:
    parts = [F.lit(VERSION + CRLF)]
    for name, value in fields:
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit("")))
    return F.concat(*parts, F.lit(CRLF))


def _uuid_urn(kind: str, key: Column) -> Column:
    """A record id: the same capture and kind always give the same one."""
    h = F.md5(F.concat(F.lit(kind + ":"), key))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the captures of ``pages`` to ``path`` as gzipped WARC part files.

    Among captures with equal payloads of at least ``min_payload`` bytes, the one with the largest id is
    written whole and the others as revisits without payload.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:unknown")), r"[\x00-\x20]", "%20").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(F.encode(payload, "UTF-8")).alias("sha"),
    )
    # Light rows: who is represented by whom. The key is an expression, so AQE may split a hot payload.
    best = rows.where(F.col("bytes") >= min_payload).groupBy("sha").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    light = rows.select("id", "sha")
    refers = (
        light.join(best.select(F.concat("sha", F.lit("")).alias("s"), "top"), F.concat("sha", F.lit("")) == F.col("s"))
        .where("not (id <=> top)")
        .select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "top")
        .distinct()
    )
    rows = rows.join(refers, F.expr("id <=> rid and sha = rsha"), "left")
    page = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    key = F.concat_ws(":", page, "sha")
    main, when_ = _uuid_urn("main", key), F.lit(date)
    digest = F.concat(F.lit("sha1:"), _base32_of_hex(F.col("sha")))
    whole = F.col("top").isNull()
    block = F.when(whole, F.concat(F.lit(_HTTP_HEAD), "payload")).otherwise(F.lit(_HTTP_HEAD))
    request = F.lit("GET / HTTP/1.1\r\n\r\n")
    meta = F.concat(F.lit("page_id: "), page, F.lit("\r\npayload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))

    def record(kind: Column, rid: Column, extra: list[tuple[str, Column]], content_type: str, body: Column) -> Column:
        head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", when_), ("WARC-Target-URI", F.col("url")), *extra]
        return F.concat(_header([*head, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(body).cast("string"))]), body)

    one = F.concat_ws(
        CRLF + CRLF,
        record(F.lit("request"), _uuid_urn("request", key), [("WARC-Concurrent-To", main)], "application/http;msgtype=request", request),
        record(
            F.when(whole, F.lit("response")).otherwise(F.lit("revisit")),
            main,
            [
                ("WARC-Payload-Digest", digest),
                ("WARC-Profile", F.when(~whole, F.lit(REVISIT_PROFILE))),
                ("WARC-Refers-To", F.when(~whole, _uuid_urn("main", F.concat_ws(":", F.col("top").cast("string"), "sha")))),
            ],
            "application/http;msgtype=response",
            block,
        ),
        record(F.lit("metadata"), _uuid_urn("metadata", key), [("WARC-Concurrent-To", main)], "application/warc-fields", meta),
    )
    rows.select(one.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


_RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("declared_digest", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("http_head", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class WarcParser:
    """Fed with lines (without their line feed), gives whole records; follows Content-Length."""

    def __init__(self):
        self.head: list[bytes] | None = None
        self.fields: dict[bytes, bytes] = {}
        self.need = -1
        self.body: list[bytes] = []

    def feed(self, line: bytes):
        """The record that this line ends, or None."""
        if self.need < 0:
            text = line.rstrip(b"\r")
            if self.head is None:
                if text.startswith(b"WARC/"):
                    self.head = []
                return None
            if text:
                self.head.append(text)
                return None
            self.fields = {}
            for x in self.head:
                name, _, value = x.partition(b":")
                self.fields[name.strip().lower()] = value.strip()
            self.head, self.body = None, []
            self.need = int(self.fields.get(b"content-length", b"0"))
            return self._end() if self.need == 0 else None
        line += b"\n"
        self.body.append(line[: self.need])
        self.need -= len(line)
        return self._end() if self.need <= 0 else None

    def _end(self):
        self.need = -1
        return self.fields, b"".join(self.body)


def _parsed(fields: dict[bytes, bytes], block: bytes, keep_payload: bool) -> tuple:
    get = lambda name: (v.decode("utf-8", "replace") if (v := fields.get(name)) is not None else None)
    kind, http = get(b"warc-type"), None
    payload = block
    if (get(b"content-type") or "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    return (
        get(b"warc-record-id"), kind, get(b"warc-target-uri"), get(b"warc-date"), get(b"warc-concurrent-to"), get(b"warc-refers-to"),
        (get(b"warc-payload-digest") or "sha1:").split(":", 1)[1] or None, get(b"content-type"), http,
        len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload if keep_payload or kind == "metadata" else None,
    )


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record. Gzipped files are not split, so a task sees each file's lines in order."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"))
    schema = _arrow(_RECORD)

    def parse(batches):
        parser, file = WarcParser(), None
        out, size = [], 0
        for batch in batches:
            for line, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    parser, file = WarcParser(), name
                done = parser.feed(line.as_py())
                if done:
                    out.append(_parsed(*done, keep_payload))
                    size += len(done[1]) if keep_payload else 0
                    if len(out) >= 4096 or size > 16_000_000:
                        yield _batch(out, schema)
                        out, size = [], 0
        if out:
            yield _batch(out, schema)

    return lines.mapInArrow(parse, _RECORD)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, uri, date, response, request, metadata``.

    The response or revisit is the root; requests and metadata reach it through concurrent-to. A record id names one
    capture, so the join keys carry no skew; captures repeated whole share their request and metadata. A capture
    without request or metadata has null there.
    """
    part = lambda kind, name: records.where(F.col("type") == kind).select(
        F.col("concurrent_to").alias(f"{name}_to"), F.struct("record_id", "http_head", "payload").alias(name)
    ).dropDuplicates([f"{name}_to"])
    root = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        "uri",
        "date",
        F.struct("type", "http_head", "payload_bytes", "payload_digest", "declared_digest", "refers_to", "payload").alias("response"),
    )
    request, metadata = part("request", "request"), part("metadata", "metadata")
    return (
        root.join(request, F.col("capture_id") == F.col("request_to"), "left")
        .join(metadata, F.col("capture_id") == F.col("metadata_to"), "left")
        .select("capture_id", "uri", "date", "response", "request", "metadata")
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, read it back and return one row per capture.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, uri, declared_digest``. A revisit's
    payload is that of the response it refers to, found by a join on the record id; many revisits of one
    response are a skewed side that AQE splits.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    # The archive is parsed once; what the joins need of its records is light.
    records = staged(read_warc(spark, path, keep_payload=False), "records")
    captures = staged(
        assemble(records).select(
            "capture_id",
            "uri",
            F.regexp_extract(F.decode("metadata.payload", "UTF-8"), r"page_id: (-?\d+)", 1).try_cast("long").alias("page_id"),
            "response.*",
        ),
        "captures",
    )
    whole = captures.where("type = 'response'").select(
        F.col("capture_id").alias("source"), F.col("page_id").alias("source_page"), F.col("payload_bytes").alias("source_bytes"), F.col("payload_digest").alias("source_digest")
    ).dropDuplicates(["source"])
    return captures.drop("payload").join(whole, F.concat("refers_to", F.lit("")) == F.concat("source", F.lit("")), "left").select(
        "page_id",
        F.coalesce("source_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("source_digest", "payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("source_page").alias("refers_to"),
        "uri",
        "declared_digest",
    )
