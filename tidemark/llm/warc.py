"""WARC archives: writing captures as request, response (or revisit) and metadata records, reading the files back, and
assembling each transaction from its records.

Archives are written and read through Spark's own sources, so any file system that Spark knows will do. Records keep the
standard's form: a version line, named fields, an empty line, a block of Content-Length bytes and two line ends.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb

END = "\r\n"
HTTP_HEAD = END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])


def plan_captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is the page that a revisit refers to.

    Payloads are the html's UTF-8 bytes (null: empty). Among equal payloads of `least_bytes` or more the smallest
    page_id is the response and the others revisit it; smaller payloads are never revisits. Only digests that occur
    twice meet the pages again, so a payload's copies cost one row each, wherever they are.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    rows = rows.select("*", F.length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    again = (
        rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    out = rows.join(again, "payload_digest", "left")
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to"))


def _record_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<urn:tidemark:{kind}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def _record(kind: Column | str, identifier: Column, fields: list[tuple[str, Column | str]], block: Column, size: Column) -> Column:
    """A record without its closing line ends, which the writer sets."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    parts: list[Column] = [F.lit("WARC/1.1" + END + "WARC-Type: "), as_column(kind), F.lit(END + "WARC-Record-ID: "), identifier]
    for name, value in fields:  # a null value leaves the field out
        parts.append(F.coalesce(F.concat(F.lit(f"{END}{name}: "), as_column(value)), F.lit("")))
    return F.concat(*parts, F.lit(f"{END}Content-Length: "), size.cast("string"), F.lit(END + END), block)


def write_archives(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6000) -> None:
    """Write three records for each capture as gzip-compressed WARC files under path.

    A file holds at most `records_per_file` records. Equal inputs give equal records: identifiers derive from page ids.
    """
    refers = F.col("refers_to")
    revisit = refers.isNotNull()
    page = _record_id("capture", F.col("page_id"))
    target = F.regexp_replace("url", r"[\r\n]+", " ")
    request = F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}{END}"))
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("html")))
    notes = F.concat(F.lit("payload-length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    shared = [("WARC-Date", date), ("WARC-Target-URI", target)]
    octets = lambda c: F.octet_length(c)
    response = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), page,
        [*shared, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
         ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("WARC-Refers-To", F.when(revisit, _record_id("capture", refers))), ("Content-Type", "application/http; msgtype=response")],
        block, F.when(revisit, F.lit(len(HTTP_HEAD)).cast("long")).otherwise(F.col("payload_bytes") + len(HTTP_HEAD)),
    )
    records = captures.select(F.explode(F.array(
        _record("request", _record_id("request", F.col("page_id")), [*shared, ("WARC-Concurrent-To", page), ("Content-Type", "application/http; msgtype=request")], request, octets(request)),
        response,
        _record("metadata", _record_id("metadata", F.col("page_id")), [*shared, ("WARC-Concurrent-To", page), ("Content-Type", "application/warc-fields")], notes, octets(notes)),
    )).alias("value"))
    writer = records.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.text(path)


RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "declared_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


class _Stream:
    """Bytes of a gzip (of one or many members) or plain file, inflated as they are asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.plain, self.at = raw, bytearray(), 0
        self.engine = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None
        self.fed = 0
        if self.engine is None:
            self.plain, self.fed = bytearray(raw), len(raw)

    def _more(self) -> bool:
        if self.engine is None or (self.fed >= len(self.raw) and not self.engine.unused_data):
            return False
        if self.engine.eof:
            rest = self.engine.unused_data
            if not rest and self.fed >= len(self.raw):
                return False
            self.engine = zlib.decompressobj(31)
            self.plain += self.engine.decompress(rest) if rest else b""
        chunk = self.raw[self.fed : self.fed + (1 << 18)]
        self.fed += len(chunk)
        if self.engine.eof:
            self.engine = zlib.decompressobj(31)
        self.plain += self.engine.decompress(chunk)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without mark; None at the end of the file."""
        search = self.at
        while (found := self.plain.find(mark, search)) < 0:
            search = max(self.at, len(self.plain) - len(mark))
            if not self._more():
                return None
        out = bytes(self.plain[self.at : found])
        self.at = found + len(mark)
        return out

    def take(self, size: int) -> bytes:
        while len(self.plain) - self.at < size and self._more():
            pass
        out = bytes(self.plain[self.at : self.at + size])
        if len(out) < size:
            raise ValueError("a WARC record ends before its Content-Length")
        self.at += size
        if self.at > 1 << 22:
            del self.plain[: self.at]
            self.at = 0
        return out


_FIELD = re.compile(r"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a file."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(_FIELD.findall(head.decode("utf-8", "replace").split(END, 1)[1]))
        yield fields, stream.take(int(fields["Content-Length"]))
        stream.take(4)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the archives under path (RECORD_SCHEMA).

    payload is what follows the HTTP head of responses and revisits, and the whole block of other records;
    payload_bytes and payload_digest (hex SHA-256) are computed from it. payloads=False leaves the bytes themselves out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "declared_digest"]
        keys = ["WARC-Record-ID", "WARC-Type", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest"]
        types = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        columns = [*names, "payload_bytes", "payload_digest", "fields", "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(content.as_buffer().to_pybytes()):
                    kind = fields["WARC-Type"]
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit", "request") else block
                    notes = _FIELD.findall(block.decode()) if fields.get("Content-Type") == "application/warc-fields" else []
                    rows.append((*map(fields.get, keys), len(body), hashlib.sha256(body).hexdigest(), notes, body if payloads else None))
                    held += len(body) * payloads
                    if len(rows) >= 2000 or held > 1 << 23:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(tb.lean(records), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit record, with the request and the metadata records that name
    it in WARC-Concurrent-To (null where the archive has none). Of several requests or metadata records of one
    capture, that of the smallest identifier stands in `request` or `metadata`."""
    whole = F.struct("record_id", "record_type", "refers_to", "target_uri", "date", "declared_digest", "payload_bytes", "payload_digest", "fields", "payload")
    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), whole.alias("response"))

    def beside(kind: str) -> DataFrame:
        one = records.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return one.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(whole, F.col("record_id")).alias(kind))

    return captures.join(beside("request"), "capture_id", "left").join(beside("metadata"), "capture_id", "left")


def digest(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives that `write_archives` made. A revisit
    stores no payload; its digest and length are those its records declare."""
    number = lambda c: F.regexp_extract(c, r"^<urn:tidemark:capture:(-?\d+)>$", 1)
    key = lambda c: F.when(number(c) != "", number(c)).cast("long")
    stored = F.col("response.record_type") == "response"
    return captures.select(
        key(F.col("capture_id")).alias("page_id"),
        F.when(stored, F.col("response.payload_bytes")).otherwise(F.col("metadata.fields")["payload-length"].cast("long")).alias("payload_bytes"),
        F.when(stored, F.col("response.payload_digest")).otherwise(F.regexp_replace("response.declared_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        key(F.col("response.refers_to")).alias("refers_to"),
    )
