"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The writer leaves committing files to Spark. A record is compressed by itself; its last byte (the top
byte of the gzip trailer's length, always 0 here) is written as Spark's line separator, so that the
text writer puts down exactly the members, one after another, and a lost task's files never count.

The reader gives tasks byte ranges. A task scans its range for gzip magic, takes a place for a record
only if the member there decodes to a WARC header, and owns the records that start in its range, of
which it reads the last beyond the range's end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import scratch

#: Payloads shorter than this are never revisits.
LEAST_PAYLOAD = 100
#: Bytes of a reader's range; bytes fetched at a time.
RANGE, CHUNK = 16 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: The largest payload whose member's last byte is 0; longer ones get an empty member at their end.
_SHORT = (1 << 24) - 4096
_DATE = "2000-01-01T00:00:00Z"


def _member(raw: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
            payload = html.encode()
            lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {_DATE}"]
            if url is not None:
                lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
            lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html"]
            body = payload
            if refers is not None:
                lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
                body = b""
            lines += [f"Content-Length: {len(body)}", "", ""]
            raw = "\r\n".join(lines).encode() + body + b"\r\n\r\n"
            packed = _member(raw)
            if len(raw) >= _SHORT:
                packed += _member(b"")
            out.append(packed[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row, deduplicated by payload, as gzip WARC files in the folder ``path``.

    Of rows with equal payloads of at least 100 bytes that with the smallest id is a response and the
    others revisit it; shorter ones are all responses, and so are rows that share the smallest id
    (repeated rows) or have none (null ids come after all others only if every id is null). A null
    html is an empty payload, a null url has no target header. An empty table writes no record.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    told = rows.join(first, "digest", "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first"))
    records = told.select("id", "url", "html", "digest", refers.alias("refers")).mapInArrow(_records, "value binary")
    # Latin-1 maps the separator's character to the byte itself
    records.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


def ranges(spark: SparkSession, path: str, size: int) -> list[tuple[str, int, int, int]]:
    """Byte ranges of the folder's files, listed through Hadoop: uri, start, end, file length."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            n = f.getLen()
            out += [(f.getPath().toString(), a, min(a + size, n), n) for a in range(0, n, size)]
    return out


def _opened(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return open(uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file://") else uri.removeprefix("file:"), "rb")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _header(file, at: int) -> bytes:
    """The first decoded bytes of a member at this place; nothing if none starts here."""
    file.seek(at)
    unpack = zlib.decompressobj(31)
    try:
        return unpack.decompress(file.read(4096), 64)
    except zlib.error:
        return b""


def _whole(file, at: int, chunk: int) -> tuple[bytes, int] | None:
    """A member's decoded bytes and the place after it; None if its data or checksum are bad."""
    file.seek(at)
    unpack, out, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            got = file.read(chunk)
            if not got:
                return None
            end += len(got)
            out.append(unpack.decompress(got))
    except zlib.error:
        return None
    return b"".join(out), end - len(unpack.unused_data)


def members(file, start: int, end: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records whose member starts in [start, end), decoded."""
    at = start
    while at < end:
        file.seek(at)
        window = file.read(min(chunk, end - at) + len(MAGIC) - 1)
        place = window.find(MAGIC)
        if place < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += place
        if at >= end:
            return
        if _header(file, at).startswith(b"WARC/") and (found := _whole(file, at, min(chunk, 1 << 16))):
            yield found[0]
            at = found[1]
        else:
            at += 1


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: _number(headers.get("content-length")) or 0]


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _page(uri: str | None) -> int | None:
    """The page id in a record id that the writer made; others have none."""
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isascii() and text.lstrip("-").isdigit() else None


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without the HTTP header where it is a whole HTTP message."""
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                held = 0
                with _opened(uri) as file:
                    for raw in members(file, start, end):
                        headers, block = parsed(raw)
                        kind = headers.get("warc-type")
                        revisit = kind == "revisit"
                        if revisit:
                            told = headers.get("warc-payload-digest")
                            size, digest = _number(headers.get("warc-payload-length")), told and told.removeprefix("sha256:")
                        else:
                            block = _payload(headers, block)
                            size, digest = len(block), hashlib.sha256(block).hexdigest()
                        out.append((_page(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, digest, kind, _page(headers.get("warc-refers-to")), block if payloads and not revisit else None))
                        held += len(block) if payloads else 0
                        if held > 4 << 20 or len(out) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def read_warc(spark: SparkSession, path: str, size: int = RANGE, payloads: bool = True) -> DataFrame:
    """A row for each record of the gzip WARC files in ``path``: id, url, payload size and digest, type, target of a revisit, payload.

    Size and digest are those of the full payload: computed for responses, from the headers of
    revisits, null where these are missing there. Records of any type and writer are read: a record id
    that is no page's gives a null id, and of a whole HTTP message the payload stands behind its header.
    Bytes that look like a member but do not decode to a record are passed over. A revisit's payload is
    null. A folder without files gives no rows.
    """
    parts = ranges(spark, path, size)
    tasks = spark.createDataFrame([p[:3] for p in parts], "uri string, start bigint, until bigint")
    return tasks.repartition(max(1, min(len(parts), 10_000))).mapInArrow(_read(payloads), RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back, without payloads."""
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, payloads=False).drop("payload")
