"""WARC archives of pages: a writer that stores equal payloads once, and a salvage reader.

Writing.  Pages are grouped by the SHA-256 of their payload; the one with the largest
page_id is written as a response, the others as revisits of it without the payload.
Every record is a gzip member of its own.  Members are gathered into blocks, and Spark's
text writer puts the blocks into files of a bounded size; what it writes between them
is an empty member, so the files are plain ``.warc.gz`` for any reader and any file
system that Spark writes to.

Reading.  A file is walked record by record.  A member must inflate with its length and
CRC; a record must have a version line, its Content-Length, the end mark and digests
that are right.  After a failed check the reader searches for the next member or
version line that passes all checks and goes on there; the bytes between are
quarantined as a gap with the reason.  Plain and compressed records may stand in one file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.lineage import new_folder, written

#: Bytes of members that make a block, and blocks in a file.
BLOCK_BYTES = 1 << 20
FILE_BLOCKS = 16

#: Effort of the compression.
LEVEL = 3

#: An empty gzip member: it inflates to nothing and stands between blocks.
PADDING = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])

#: Fixed values of the format.
MAGIC, VERSIONS, END = b"\x1f\x8b\x08", (b"WARC/1.0", b"WARC/1.1"), b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a file that are inflated at once.
FIRST_PIECE, PIECE = 1 << 12, 1 << 16

#: The first line of a plain record; after damage it need not begin a line.
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

FOUND = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string())]
    + [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)
FOUND_TYPES = "file string, start long, end long, gap string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A WARC/1.1 record; fields that are None are left out."""
    named = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"".join((b"WARC/1.1\r\n", named.encode(), b"WARC-Block-Digest: sha1:", digest(block).encode(), b"\r\nContent-Length: %d\r\n\r\n" % len(block), block, END))


def member(data: bytes) -> bytes:
    """data as a gzip member."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _written(date: str):
    """Task: the members of rows (page_id, url, size, sha, sha1, response, refers_to, payload), in blocks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["block"])
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, length, sha, sha1, response, refers_to, payload = (c[i].as_py() for c in columns)
                number += 1
                # There is one response for each payload, so its digest names it.
                own = uuid.UUID(bytes=sha[:16]) if response else uuid.UUID(bytes=hashlib.md5(f"{part}:{number}".encode()).digest())
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
                fields = {
                    "WARC-Type": "response" if response else "revisit", "WARC-Record-ID": f"<urn:uuid:{own}>", "WARC-Date": date, "WARC-Target-URI": None if url is None else _line(url),
                    "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{b32encode(sha1).decode()}", "Page-ID": page_id,
                }
                if not response:
                    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.UUID(bytes=sha[:16])}>", "Refers-To-Page-ID": refers_to}
                held.append(member(record(fields, http + payload if response else http)))
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return write


def archived(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> str:
    """Write a record for every row of pages (page_id, url, html); the folder with the archives.

    A null html is an empty payload.  Of equal payloads the row with the largest page_id
    (nulls are least), then with the largest url, is the response; of repeated rows only one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    counted = rows.groupBy("sha", "page_id", "url").count()
    classes = counted.groupBy("sha").agg(F.max(F.struct("page_id", "url", "count")).alias("top"), F.sum("count").alias("members"))
    # The planner knows the size of a written table, so it is broadcast only if it is small.
    shared = written(classes.where("members > 1").select("sha", "top"), "shared")
    known = rows.join(shared, "sha", "left")
    chosen = F.col("top").isNull() | (F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")))
    repeated = chosen & (F.coalesce("top.count", F.lit(1)) > 1)
    plain = known.where(~repeated).withColumn("response", chosen)
    copies = known.where(repeated).groupBy("sha", "page_id", "url").agg(F.first("payload").alias("payload"), F.first("top").alias("top"))
    copies = copies.select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("top.count")))).withColumn("response", F.col("pos") == 0)
    every = plain.unionByName(copies.drop("pos", "col"))
    ready = every.select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("size"), "sha", F.unhex(F.sha1("payload")).alias("sha1"), "response",
        F.when(~F.col("response"), F.col("top.page_id")).alias("refers_to"), F.when(F.col("response"), F.col("payload").cast("binary")).alias("payload"),
    )
    path = new_folder(pages.sparkSession, "archives")
    blocks = ready.mapInArrow(_written(date), "block binary").select(F.col("block").cast("string").alias("value"))
    # A single-byte encoding leaves the bytes of the separator as they are.
    blocks.write.option("lineSep", PADDING.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_BLOCKS).text(path)
    return path


class Fault(ValueError):
    """A check that failed."""


def _inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at this place, and where it ends."""
    pack, out, step = zlib.decompressobj(31), [], FIRST_PIECE
    try:
        while not pack.eof:
            if at >= len(data):
                raise Fault("member ends early")
            out.append(pack.decompress(data[at : at + step]))
            at = min(len(data), at + step)
            step = PIECE
    except zlib.error as e:
        raise Fault("member is damaged") from e
    return b"".join(out), at - len(pack.unused_data)


def _parsed(data: memoryview | bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at this place."""
    head, step = -1, PIECE
    while head < 0:
        some = bytes(data[at : at + step])
        if not some.startswith(VERSIONS):
            raise Fault("no version line")
        head = some.find(END)
        if head < 0 and at + step >= len(data):
            raise Fault("header ends early")
        step *= 4
    fields = {}
    for line in some[:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Fault("header is damaged")
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        raise Fault("no content length")
    begin = at + head + len(END)
    end = begin + int(fields["content-length"])
    if bytes(data[end : end + len(END)]) != END:
        raise Fault("record has no end mark")
    block = bytes(data[begin:end])
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != digest(block):
        raise Fault("block digest differs")
    return fields, block, end + len(END)


def _payload(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Size of the full payload, and the payload of a response."""
    head, _, payload = block.partition(END)
    kind = fields.get("warc-type")
    if kind == "response":
        if fields.get("warc-payload-digest", "").startswith("sha1:") and fields["warc-payload-digest"][5:] != digest(payload):
            raise Fault("payload digest differs")
        return len(payload), payload
    size = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})\r?$", head)
    return int(size[1]) if size else 0, None


#: A record that passed its checks: start, end, fields, payload size, payload.  A gap: start, end, reason.
Found = tuple[int, int, dict[str, str], int, bytes | None] | tuple[int, int, str]


def _one(data: memoryview, at: int) -> tuple[list[Found], int]:
    """What the member or record at this place holds, and where it ends; raises Fault."""
    if bytes(data[at : at + 3]) != MAGIC:
        fields, block, end = _parsed(data, at)
        return [(at, end, fields, *_payload(fields, block))], end
    content, end = _inflated(data, at)
    out: list[Found] = []
    if content:
        inner, to = memoryview(content), 0
        while to < len(content):  # one record as a rule
            fields, block, to = _parsed(inner, to)
            out.append((at, end, fields, *_payload(fields, block)))
    return out, end


def _next(data: bytes, at: int) -> Iterator[int]:
    """Places from here on at which a member or a record may begin."""
    member_at, line_at = data.find(MAGIC, at), VERSION_LINE.search(data, at)
    while member_at >= 0 or line_at:
        if line_at and (member_at < 0 or line_at.start() < member_at):
            yield line_at.start()
            line_at = VERSION_LINE.search(data, line_at.end())
        else:
            yield member_at
            member_at = data.find(MAGIC, member_at + 1)


def salvaged(data: bytes) -> Iterator[Found]:
    """Records of an archive in order, and gaps where checks failed."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            found, end = _one(view, at)
        except Fault as fault:
            reason, begin = str(fault), at
            for at in _next(data, begin + 1):
                try:
                    found, end = _one(view, at)
                except Fault:
                    continue
                break
            else:
                yield begin, len(data), reason
                return
            yield begin, at, reason
        yield from found
        at = end


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch("-?[0-9]{1,19}", text) else None


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, size = batch.column(0)[i].as_py(), [], 0
                for found in salvaged(batch.column(1)[i].as_py()):
                    if len(found) == 3:
                        rows.append((file, *found, *[None] * 7))
                    else:
                        start, end, fields, length, payload = found
                        told = fields.get("warc-payload-digest", "")
                        rows.append((
                            file, start, end, None, _number(fields.get("page-id")), fields.get("warc-target-uri"), fields.get("warc-type"), _number(fields.get("refers-to-page-id")), length,
                            told[5:] if told.startswith("sha1:") else told or None, payload if with_payload else None,
                        ))
                        size += len(payload or b"") if with_payload else 0
                    if len(rows) >= 10_000 or size >= BLOCK_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(file, start, end, gap, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record and gap in a folder.

    start and end are the bytes of the file that hold it.  gap is the check that failed
    for quarantined bytes, whose other columns are null; it is null for records.  Empty
    files hold nothing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), FOUND_TYPES)


def gaps(found: DataFrame) -> DataFrame:
    """(file, start, end, gap): the quarantined bytes."""
    return found.where("gap is not null").select("file", "start", "end", "gap")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records read back from the archives of pages.

    Null htmls are empty payloads, null page_ids stay null and are least; repeated rows are
    records of their own, one of them the response if they hold the largest page_id.  Other
    columns are ignored; an empty table gives no rows.
    """
    found = read_archives(pages.sparkSession, archived(pages))
    return found.where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (k // 4)::INTEGER, 5))::BIGINT // [32768, 1024, 32, 1][1 + k % 4]) % 32 + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p
"""
