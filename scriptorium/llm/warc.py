"""WARC archives: write request, response or revisit, and metadata records; read
them back; assemble one nested row per capture through concurrent-to identifiers.

Writing is a text sink whose line separator is the two CRLFs that end every
WARC record, so any store that Spark writes to holds the archives and a lost
task is simply run again. Spark's sink makes one gzip member of a file; files are
cut so that one holds about ``FILE_BYTES`` before compression. Reading takes archives
of one member or of many (one a record, as crawlers write), inflates them piece by
piece and parses records by their Content-Length fields, so a worker holds a file as
it is stored and one record.

A null URL is written as an empty target, a null html as an empty payload; CR
and LF in a URL are percent-encoded in the header. Repeated rows are told apart
by ``row_key``. An empty table writes and reads no record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
END = "\r\n\r\n"
PAGES_PER_FILE, FILE_BYTES = 4000, 64 << 20
#: Bytes that are inflated at once.
PIECE = 1 << 20

RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, page_id long, block binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five bits a character, from its hexadecimal digits (20 bits at a time)."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, key: Column) -> Column:
    m = F.md5(F.concat(F.lit(kind + "|"), key))
    return F.concat(F.lit("<urn:uuid:"), F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-"), F.substring(m, 13, 4), F.lit("-"), F.substring(m, 17, 4), F.lit("-"), F.substring(m, 21, 12), F.lit(">"))


def _record(kind: Column | str, record_id: Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*head, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def with_records(pages: DataFrame, row_key: Column, date: str, min_bytes: int = 0) -> DataFrame:
    """Adds digest, size, the winner of each group of equal payloads, and the capture's records as one string.

    Only digests that occur twice are joined back. Spark sends that side to all executors where it is
    small; else rows with their payloads are shuffled by digest once, and split where one digest is hot.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", "html", row_key.alias("row_key")).withColumn("digest", base32_sha1(payload.cast("binary"))).withColumn("bytes", F.octet_length(payload).cast("long"))
    copies = base.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "row_key")).alias("first"), F.count("*").alias("n"))
    copies = copies.where("n > 1").select("digest", F.col("first.row_key").alias("first_key"))
    b = base.join(copies, "digest", "left")
    revisit = F.col("first_key").isNotNull() & (F.col("first_key") != F.col("row_key")) & (F.col("bytes") >= min_bytes)
    own, uri = _urn("response", F.col("row_key")), F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit(""))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [*common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("first_key")))), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))],
        "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, payload)),
    )
    request = _record("request", _urn("request", F.col("row_key")), [*common, ("WARC-Concurrent-To", own)], "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + END)))
    metadata = _record("metadata", _urn("metadata", F.col("row_key")), [*common, ("WARC-Concurrent-To", own)], "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    return b.withColumn("records", F.concat_ws(END, request, response, metadata))


def write(pages: DataFrame, path: str, row_key: Column, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    rows = max(1, min(PAGES_PER_FILE, int(FILE_BYTES // (mean + 1000))))
    with_records(pages, row_key, date, min_bytes).select("records").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)


def inflated(raw: bytes) -> Iterator[bytes]:
    """The content of a file in pieces: of every gzip member in turn, or as it is."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while at < len(raw):
        if raw[at] == 0:  # padding between members
            at += 1
            continue
        member = zlib.decompressobj(31)
        fed = b""
        while not member.eof:
            if not fed and at < len(raw):
                fed = raw[at : at + PIECE]
                at += len(fed)
            piece = member.decompress(fed, PIECE)
            if not piece and not fed and not member.eof:
                raise ValueError("a gzip member is cut off")
            fed = member.unconsumed_tail
            if piece:
                yield piece
        at -= len(member.unused_data)


def parse(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an archive, given whole or in pieces."""
    pieces = iter([data] if isinstance(data, bytes) else data)
    held, at, gone = bytearray(), 0, 0

    def more() -> bool:
        nonlocal at, gone
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        gone, at = gone + at, 0
        held.extend(piece)
        return True

    while at < len(held) or more():
        end = held.find(END.encode(), at)
        while end < 0:
            if not more():
                raise ValueError(f"no end of the header at byte {gone + at}")
            end = held.find(END.encode(), at)
        lines = held[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {gone + at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        begin = end + 4 - at  # from the record's start, which may move
        while len(held) < at + begin + size + 4:
            if not more():
                raise ValueError(f"record is not closed at byte {gone + at}")
        block = bytes(held[at + begin : at + begin + size])
        at += begin + size + 4
        if held[at - 4 : at] != END.encode():
            raise ValueError(f"record is not closed at byte {gone + at - 4}")
        yield head, block


def _rows(with_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string())) for n, x in zip(names, RECORD.split(", "), strict=True)])
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                out: list[tuple] = []
                for head, block in parse(inflated(raw)):
                    kind, digest, size, page = head["warc-type"], head.get("warc-payload-digest"), None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest is None:
                            digest = f"sha1:{found}"
                        elif digest.startswith("sha1:") and digest != f"sha1:{found}":
                            raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                        size, block = len(payload), payload
                    elif kind == "metadata":
                        text = block.partition(b"page-id:")[2].split(b"\r\n")[0].strip()
                        page = int(text) if text.isdigit() or text[:1] == b"-" and text[1:].isdigit() else None
                    out.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest and digest.removeprefix("sha1:"), size, page, block if with_block and kind in ("response", "metadata") else None))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def read(spark: SparkSession, path: str, with_block: bool = True, names: str = "*.gz") -> DataFrame:
    """One row per record of the archives named ``names``; a response's block is its payload, checked against its SHA-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("content")
    return files.mapInArrow(_rows(with_block), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata, joined by concurrent-to."""
    part = lambda kind, *cols: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct(*cols).alias(kind))
    main = records.where(F.col("type").isin("response", "revisit")).select("record_id", F.struct("type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", F.col("block").alias("payload")).alias("response"))
    request = part("request", F.col("record_id").alias("request_id"), "target_uri", "date")
    metadata = part("metadata", F.col("record_id").alias("metadata_id"), "page_id")
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Flat columns; a revisit takes the size and page of the response it refers to."""
    target = captures.where("response.type = 'response'").select(F.col("record_id").alias("_ref"), F.col("metadata.page_id").alias("_page"), F.col("response.payload_bytes").alias("_bytes"))
    flat = captures.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_ref"))
    return flat.join(target, "_ref", "left").select("page_id", F.coalesce("own_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"))
