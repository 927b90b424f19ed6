"""WARC archives: written from pages, read back with their segments put together.

Writing: each page is an HTTP answer in chunked framing, its payload the html in UTF-8.  Of pages with equal
payloads (length and SHA-1) the one with the smallest page_id becomes a ``response`` record, the others
``revisit`` records that refer to it.  A block longer than ``segment`` bytes is cut: a first record with
segment number 1, then ``continuation`` records with the first one's id as their origin, the last with the
total length.  Spark's own writer stores the records as gzip files in a folder of any file system; no record
is longer than a segment and a file has at most ``FILE_RECORDS``, so files are bounded as well.

Reading: files are parsed one at a time; whole records are decoded where they are read, segments are grouped
by origin, ordered by number, checked for gaps and total length, joined, and then decoded.  ``error`` says
what is wrong with a record (null: nothing); a wrong record doesn't stop the others.

Defined results: null html is an empty payload; a null url leaves the target out; a null page_id is greater
than any other; repeated rows of the response's page are responses too; an empty table gives an empty
archive; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, written

END = b"\r\n\r\n"
FILE_RECORDS = 512
CHUNK = 8192


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing, extensions and trailers left out."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
        if len(out[-1]) != size or body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is cut off")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block


def _target(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def records(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, mark: str, segment: int) -> Iterator[bytes]:
    """The records of one page; ``mark`` tells repeated rows apart."""
    own = f"<urn:x-page:{page}{mark}>"
    fields = [("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _target(url)), ("Content-Type", "application/http;msgtype=response")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{first}>")]
        yield _record("revisit", fields, head)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record("response", fields, block)
        return
    yield _record("response", [*fields, ("WARC-Segment-Number", "1")], block[:segment])
    for k, at in enumerate(range(segment, len(block), segment), 2):
        total = str(len(block)) if at + segment >= len(block) else None
        fields = [("WARC-Record-ID", f"<urn:x-page:{page}{mark};segment={k}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
        fields += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", total)]
        yield _record("continuation", fields, block[at : at + segment])


def write_archives(pages: DataFrame, folder: str, segment: int = 1 << 15, least: int = 0) -> None:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; payloads under ``least`` bytes are all
    stored as responses."""
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload")})
    per_page = base.groupBy("sha", "bytes", "page_id").agg(F.count("*").alias("copies"))
    firsts = per_page.groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.max("copies").alias("copies"))
    sides = base.join(written(firsts, "payloads"), ["sha", "bytes"])
    same = F.col("page_id").eqNullSafe(F.col("first"))
    sides = sides.select("page_id", "url", "payload", "first", (~same & (F.col("bytes") >= least)).alias("revisit"), "copies")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "first", "revisit", "copies")]
            for i in range(batch.num_rows):
                page, url, payload, first, revisit, copies = (c[i].as_py() for c in columns)
                n += 1
                for r in records(page, url, payload, first, revisit, f";copy={part}.{n}" if copies > 1 else "", segment):
                    out.append(r)
                    size += len(r)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = sides.mapInArrow(pack, "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def _decoded(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*chunked", head) else body


def _parsed(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Fields (names in lower case) and block of each record of a gzip file."""
    data = b""
    while content:
        unzip = zlib.decompressobj(31)
        data += unzip.decompress(content) + unzip.flush()
        content = unzip.unused_data
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        size = int(fields["content-length"])
        at = end + len(END) + size + len(END)
        if not lines[0].startswith("WARC/") or data[at - len(END) : at] != END:
            raise ValueError("no record where one should be")
        yield fields, data[end + len(END) : at - len(END)]


ROW = "key string, page_id long, record_type string, refers_to long, declared string, payload_bytes long, payload_digest string, error string, segment int, total long, block binary"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())


def _page(name: str | None) -> int | None:
    found = re.match(r"<urn:x-page:(-?\d+)", name or "")
    return int(found[1]) if found else None


def _judged(block: bytes, declared: str | None) -> tuple[int | None, str | None, str | None]:
    """Length, digest and error of a response's payload."""
    try:
        payload = _decoded(block)
    except ValueError as e:
        return None, None, f"framing: {e}"
    own = digest(payload)
    return len(payload), own, None if declared in (None, own) else "payload digest differs"


def _rows(path: str, content: bytes) -> Iterator[tuple]:
    for k, (f, block) in enumerate(_parsed(content)):
        kind, name = f["warc-type"], f.get("warc-record-id")
        declared = (f.get("warc-payload-digest") or "").rpartition(":")[2] or None
        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
        if kind == "revisit":
            yield f"{path}#{k}", _page(name), kind, _page(f.get("warc-refers-to")), declared, int(f["warc-payload-length"]), declared, None, None, None, None
        elif kind == "response" and number is None:
            yield f"{path}#{k}", _page(name), kind, None, declared, *_judged(block, declared), None, None, None
        elif kind in ("response", "continuation"):
            first = kind == "response"
            yield name if first else f["warc-segment-origin-id"], _page(name), kind if first else None, None, declared, None, None, None, int(number), int(total) if total else None, block


def _batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error for each record of ``folder``."""
    names = [c.strip().split(" ")[0] for c in ROW.split(",")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _batch(list(_rows(batch.column("path")[i].as_py(), batch.column("content")[i].as_py())), names, _KINDS)

    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(folder)
    parts = parts.select("path", "content").mapInArrow(parse, ROW)
    groups = parts.groupBy("key").agg(
        F.max_by("page_id", F.col("record_type").isNotNull().cast("int")).alias("page_id"),
        *(F.max(c).alias(c) for c in ("record_type", "refers_to", "declared", "payload_bytes", "payload_digest", "error", "total")),
        F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block"))).alias("segments"),
    )
    final = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["segments"]:
                    own = sorted(row["segments"], key=lambda s: s["segment"])
                    block = b"".join(s["block"] for s in own)
                    if [s["segment"] for s in own] != list(range(1, len(own) + 1)) or len(block) != row["total"]:
                        row["error"] = "segments are missing"
                    else:
                        row["payload_bytes"], row["payload_digest"], row["error"] = _judged(block, row["declared"])
                out.append(tuple(row[c] for c in final))
            yield _batch(out, final, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))

    return groups.mapInArrow(assemble, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")


def op7_warc(pages: DataFrame) -> DataFrame:
    """Every page written, every record read back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
