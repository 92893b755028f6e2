"""WARC archives: written from pages, read back with segments put together and chunked transfer framing decoded.

Archives are written by the text sink: a record ends with two line breaks, which are the sink's line separator. A block
longer than ``segment`` bytes is cut into continuation records, so a bound on the records of a file bounds its size
and one archive fits into a task. Continuations may lie in any archive: they are grouped by the id of their origin.
An archive is unpacked and read record by record, so a task holds its bytes as stored and one record at a time. What
cannot be read is a row with an error, and reading goes on at the next record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import checkpointed, shared_folder, written

#: Bytes of a block in one record, records in one archive, bytes of one chunk of the transfer framing.
SEGMENT, RECORDS_PER_FILE, CHUNK = 16_384, 4_096, 4_096
#: Payloads from this size on are stored once.
REVISIT_FROM = 1_000
#: Bytes that are unpacked at once, and bytes that a header may have.
_PIECE, _LONGEST_HEAD = 1 << 18, 1 << 20
_END = b"\r\n\r\n"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, origin string, segment int, total long, uri string, page_id long, refers_to string, "
    "digest string, payload binary, payload_bytes long, error string"
)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload in a chunked body; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(piece)
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    head, mark, body = block.partition(_END)
    if not mark:
        raise ValueError("HTTP head without end")
    fields = [x.lower().replace(b" ", b"") for x in head.split(b"\r\n")[1:]]
    return dechunked(body) if any(x.startswith(b"transfer-encoding:") and x.endswith(b"chunked") for x in fields) else body


# Writing ---------------------------------------------------------------------------------------------------------


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def _records(segment: int, chunk: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for row in batch.to_pylist():
                own = f"<urn:uuid:{row['record_id']}>"
                common = [
                    ("WARC-Target-URI", row["uri"]), ("WARC-Date", date), ("Page-Id", row["page_id"]),
                    ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                if row["refers_to"] is not None:
                    block = _HEAD + b"\r\n"
                    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", _PROFILE),
                              ("WARC-Refers-To", f"<urn:uuid:{row['refers_to']}>"), *common]
                    out.append(_header([*fields, ("Content-Length", len(block))]) + block)
                    continue
                block = _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"] or b"", chunk)
                parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                for k, part in enumerate(parts, 1):
                    fields = [
                        ("WARC-Type", "response" if k == 1 else "continuation"),
                        ("WARC-Record-ID", own if k == 1 else f"<urn:uuid:{_uuid(row['record_id'], k)}>"),
                        ("WARC-Segment-Number", k if len(parts) > 1 else None),
                        ("WARC-Segment-Origin-ID", own if k > 1 else None),
                        ("WARC-Segment-Total-Length", len(block) if k == len(parts) > 1 else None),
                    ]
                    out.append(_header([*fields, *common, ("Content-Length", len(part))]) + part)
                    size += len(part)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def _uuid(name: str, k: int) -> str:
    h = hashlib.md5(f"{name}/{k}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def write_pages(
    pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, revisit_from: int = REVISIT_FROM,
    date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """One record per page, into a folder of archives.

    Of equal payloads of at least ``revisit_from`` bytes that of the largest page id is a response, the others are
    revisits of it; all else is a response. A null page has an empty payload. A null URL becomes a URN of the id; line
    breaks in a URL are percent-encoded. Rows with one id and payload are alike: both responses, or both revisits.
    Pages without id are revisits of a page with id, or else responses.
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= revisit_from
    first = rows.where(large).groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")
    ).where("n > 1 and first.page_id is not null")
    first = first.select(
        "digest", F.col("first.page_id").alias("first_id"),
        _record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest")).alias("first_record"),
    )
    rows = rows.join(written(first, "payloads"), "digest", "left").select(
        _record_id(F.col("page_id"), F.col("url"), F.col("digest")).alias("record_id"), "page_id", "digest", "payload",
        F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).alias("uri"),
        F.when(large & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_record")).alias("refers_to"),
    )
    records = rows.mapInArrow(_records(segment, chunk, date), "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", _END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


# Reading ---------------------------------------------------------------------------------------------------------


def _plain(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive piece by piece, of which gzip members are unpacked. Damaged members end it."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + _PIECE] for i in range(0, len(data), _PIECE))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data) or not member.eof:
        if member.eof:
            member = zlib.decompressobj(31)
        piece = data[at : at + _PIECE]
        try:
            out = member.decompress(piece, _PIECE)
        except zlib.error:
            return
        at += len(piece) - len(member.unused_data if member.eof else member.unconsumed_tail)
        if out:
            yield out
        elif not piece:
            return  # the last member is cut off


class _Window:
    """The part of an archive that is being read."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.data += piece or b""
        return piece is not None

    def holds(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def find(self, mark: bytes, start: int = 0, within: int | None = None) -> int:
        """Where the mark is from ``start`` on, at ``within`` at most; -1 if it is not there."""
        while (at := self.data.find(mark, start)) < 0:
            start = max(start, len(self.data) - len(mark) + 1)
            if within is not None and start > within or not self.more():
                return -1
        return at if within is None or at <= within else -1

    def skip_to_record(self, start: int = 0) -> None:
        """Drop what is before the next record that begins after ``start``; nothing that is passed over is held."""
        del self.data[:start]
        mark = _END + b"WARC/"
        while (at := self.data.find(mark)) < 0:
            del self.data[: max(0, len(self.data) - len(mark) + 1)]
            if not self.more():
                self.data.clear()
                return
        del self.data[: at + 4]


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names in lower case), block, and what is wrong, of each record of an archive.

    A record without a usable length, or whose block does not end where its length says, has no block; reading goes on
    at the next line break before a version line. Bytes between records are reported as one record without fields.
    """
    window = _Window(pieces)
    while window.holds(1):
        if not (window.holds(5) and window.data.startswith(b"WARC/")):
            yield {}, b"", "no record"
            window.skip_to_record()
            continue
        end = window.find(_END, within=_LONGEST_HEAD)
        if end < 0:
            yield {}, b"", "header without end"
            window.skip_to_record(5)
            continue
        lines = window.data[:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = _whole(fields.get("content-length"), 1 << 40)
        if size is None or size < 0:
            yield fields, b"", "header: content-length"
            window.skip_to_record(end)
            continue
        start = end + 4
        if not window.holds(start + size + 4) or window.data[start + size : start + size + 4] != _END:
            yield fields, b"", "cut off"
            window.skip_to_record(end)
            continue
        block = bytes(window.data[start : start + size])
        del window.data[: start + size + 4]
        yield fields, block, None


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each whole record of an archive in memory."""
    return ((fields, block) for fields, block, error in read_records(_plain(data)) if error is None)


def _whole(value: str | None, below: int) -> int | None:
    """The whole number in a header field; None where there is none, or one out of bounds."""
    if value is None or not re.fullmatch(r"-?[0-9]{1,19}", value):
        return None
    return int(value) if -below <= int(value) < below else None


def _sha1(value: str | None) -> str | None:
    """A SHA-1 in a header field in lower-case hex, also if it is in base 32; None for other kinds of digest."""
    kind, mark, digest = (value or "").partition(":")
    if kind.lower() != "sha1" or not mark:
        return None
    if re.fullmatch("[A-Za-z2-7]{32}", digest):
        return base64.b32decode(digest.upper()).hex()
    return digest.lower()


def _name(value: str | None) -> str | None:
    return value and value.strip("<>").removeprefix("urn:uuid:")


def _finished(row: dict, block: bytes, payloads: bool) -> dict:
    """The row with its payload decoded and checked."""
    if row["type"] != "response":
        return row | {"payload": block if payloads else None, "payload_bytes": None}
    try:
        payload = http_payload(block)
    except ValueError as e:
        return row | {"payload": None, "error": f"framing: {e}"}
    digest = hashlib.sha1(payload).hexdigest()
    wrong = row["digest"] is not None and row["digest"] != digest
    return row | {
        "payload": payload if payloads else None, "payload_bytes": len(payload), "digest": digest,
        "error": "digest" if wrong else row["error"],
    }


_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()),
     ("total", pa.int64()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()),
     ("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("error", pa.string())]
)


def _row(fields: dict[str, str], error: str | None, place: str) -> dict:
    """A row of a record's header; a number that cannot be read is null, and an error."""
    numbers = {
        name: _whole(fields.get(name), below)
        for name, below in (("warc-segment-number", 1 << 31), ("warc-segment-total-length", 1 << 62), ("page-id", 1 << 63))
    }
    bad = [name for name, value in numbers.items() if value is None and name in fields]
    own = _name(fields.get("warc-record-id"))
    return {
        "record_id": own, "type": fields.get("warc-type"),
        # Records without any id are kept apart, and are spread, by where they are.
        "origin": _name(fields.get("warc-segment-origin-id")) or own or place,
        "segment": numbers["warc-segment-number"], "total": numbers["warc-segment-total-length"],
        "uri": fields.get("warc-target-uri"), "page_id": numbers["page-id"], "refers_to": _name(fields.get("warc-refers-to")),
        "digest": _sha1(fields.get("warc-payload-digest")), "error": error or (f"header: {', '.join(bad)}" if bad else None),
    }


def _scanned(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out: list[dict] = []
                size = 0
                path = batch.column(1)[i].as_py()
                for k, (fields, block, error) in enumerate(read_records(_plain(batch.column(0)[i].as_py()))):
                    row = _row(fields, error, f"{path}#{k}")
                    if error or "warc-segment-number" in fields and row["segment"] is None:
                        out.append(row | {"segment": None, "payload": None, "payload_bytes": None})
                    else:
                        out.append(row | {"payload": block} if row["segment"] is not None else _finished(row, block, payloads))
                    size += len(out[-1].get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return run


def _together(rows: list[dict], payloads: bool) -> list[dict]:
    """The records made of the segments of one origin, in order of their numbers; equal pages give equal segments."""
    copies = max(1, sum(r["segment"] == 1 for r in rows))
    parts: dict[int, bytes] = {}
    for r in rows:
        parts.setdefault(r["segment"], r["payload"])
    head = rows[0] | {"payload": None, "payload_bytes": None, "segment": len(parts)}
    head["error"] = next((r["error"] for r in rows if r["error"]), None)
    total = next((r["total"] for r in reversed(rows) if r["total"] is not None), None)
    block = b"".join(parts.values())
    if list(parts) != list(range(1, len(parts) + 1)) or total is None:
        return [head | {"error": "segment missing"}] * copies
    if total != len(block):
        return [head | {"error": f"{len(block)} of {total} bytes"}] * copies
    return [_finished(head | {"total": total}, block, payloads)] * copies


def _reassembled(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if held and held[0]["origin"] != row["origin"]:
                    out += _together(held, payloads)
                    held = []
                if row["segment"] is None:
                    out.append(row)
                elif not held or row["segment"] != held[-1]["segment"]:
                    held.append(row)
                else:
                    held.append(row | {"payload": None})  # another copy of the segment before
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist(_together(held, payloads), _SCHEMA)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder, segments put together, framing decoded (columns: ``RECORD``).

    ``error`` is null, or says what is wrong with a record: a segment missing, a length or digest that differs, broken
    framing, a bad number in its header, no usable length, a block that is cut off. Bytes that are no record are a row with
    the error ``no record``, so a file that is no archive has one; an empty file has no rows. A gzip member that is damaged
    ends its archive. Digests of other kinds than SHA-1 (hex or base 32) are not compared. Without ``payloads`` only their
    sizes and digests are kept. An archive must fit into a task as it is stored, unpacked it need not.
    """
    files = spark.read.format("binaryFile").load(path).select("content", "path")
    rows = files.mapInArrow(_scanned(payloads), RECORD)
    rows = rows.repartition("origin").sortWithinPartitions("origin", "segment")
    return rows.mapInArrow(_reassembled(payloads), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, uri, error``: revisits with the payload's size
    and the page id of the record they refer to. A revisit of a record that is not there has the error ``reference``."""
    records = checkpointed(records.select("record_id", "type", "uri", "page_id", "refers_to", "digest", "payload_bytes", "error"))
    found = records.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min("page_id").alias("to_page"), F.min("payload_bytes").alias("to_bytes")
    )
    return records.join(found, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"), "uri",
        F.when((F.col("type") == "revisit") & F.col("to_bytes").isNull(), "reference").otherwise(F.col("error")).alias("error"),
    )


def round_trip(pages: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """Write the pages to archives (in the shared folder, unless a path is given), read them back and resolve revisits."""
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid4().hex}"
    write_pages(pages, path, **settings)
    return resolved(read_archives(spark, path, payloads=False))
