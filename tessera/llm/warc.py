"""WARC archives: a writer of one gzip member a record, and a reader that splits archives at any byte.

Writing: of pages with equal payloads (by SHA-256) the one with the smallest id is written as a response, the others as
revisits that refer to it and hold no payload. Each task writes files of about FILE_BYTES under names of its own attempt; the table
of the files that were finished is what Spark commits, so the files of a lost or repeated attempt are never read. Each member
carries its own offset in a gzip extra field ("WO", eight bytes).

Reading: files are cut into ranges of bytes. A task scans its range for the gzip magic number and takes a candidate for a
member if its gzip header is sound, its offset field (if there) names the place, and what it inflates to begins with a WARC header that has a type, a
record id and a length. It owns the records that begin inside its range, reads the last one to its end
beyond the range, and goes on behind each. So every record is read once, whatever the ranges. A member whose header is
sound but whose data isn't (lengths, CRC, digest) comes as a row with `error`. In archives of other writers, a
WARC file stored without compression inside a record is told from records only by what follows a member: another one,
zeros or the end of the file.

Tasks open archives through pyarrow's file systems (local and shared folders, HDFS and the object stores that it knows).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dealt, full_uri, materialize, table, work_path

MIN_BYTES = 0  # payloads below are always responses
FILE_BYTES, SPLIT_BYTES = 1 << 28, 1 << 23
READ_BYTES = 1 << 18
HOT_SHARE = 1024  # a payload with one page in so many is hot; there are HOT_SHARE of them at most
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
HEAD_BYTES = 1 << 20  # a record's header is shorter
_OWN = struct.Struct("<2sHQ")


def digest32(payload: bytes) -> str:
    """SHA-1 as 32 letters of base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _clean(value: str) -> str:
    """Spaces and control characters as %XX, so that a field stays one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit of the page refers_to, which has the same payload."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _clean(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Truncated", "length")]
    fields += [("Content-Type", "application/http; msgtype=response")]
    return record(fields, http + (payload if refers_to is None else b""))


def member(data: bytes, offset: int, level: int = LEVEL) -> bytes:
    """A gzip member that names the place in its file at which it will stand."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    extra = _OWN.pack(b"WO", 8, offset)
    head = MAGIC + struct.pack("<BIBBH", 4, 0, 0, 255, len(extra)) + extra
    return head + pack.compress(data) + pack.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


FILES = "path string, bytes long, records long"


def write_pages(pages: DataFrame, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes archives of pages (page_id, url, html, refers_to) to the shared folder; the table of their files."""
    spark = pages.sparkSession
    folder = full_uri(spark, work_path(spark, "warc"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        stream = path = None
        held = records = 0

        def done() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([held]), pa.array([records])], ["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                if stream is None:
                    files.create_dir(root, recursive=True)
                    name = f"part-{context.partitionId():05d}-{context.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
                    stream, path, held, records = files.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 1
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    held += stream.write(member(info, held))
                payload = (html.as_py() or "").encode()
                held += stream.write(member(page_record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), date), held))
                records += 1
                if held >= file_bytes:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.col("refers_to").cast("long").alias("refers_to"))
    return materialize(rows.mapInArrow(written, FILES), "archives")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the smallest page_id of those with the same payload, null for that page itself.

    A null html is an empty payload. Rows without page_id refer to the page with the smallest; if all of a payload have none, all are
    responses, as are repeated rows of the smallest page_id. Payloads of fewer than min_bytes bytes are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    one = F.concat_ws("-", F.lit("alone"), "page_id", F.xxhash64("url"))  # a key that no other page asks for
    pages = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= min_bytes, F.sha2(payload, 256)).otherwise(one).alias("key"))
    counted = pages.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = materialize(counted, "payloads")
    hot = shared.where(F.col("n") >= max(2, pages.count() // HOT_SHARE + 1)).select("key", F.col("first").alias("hot"))
    rest = shared.select("key", F.col("first").alias("cold"))
    found = pages.join(F.broadcast(hot), "key", "left")
    # what is found is spread, so that a payload with many pages is no hot key of the next join
    found = found.withColumn("key", F.when(F.col("hot").isNotNull(), F.concat_ws("-", F.lit("found"), "page_id")).otherwise(F.col("key"))).join(rest, "key", "left")
    first = F.coalesce("hot", "cold")
    return found.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > first), first).alias("refers_to"))


class _File:
    """Bytes of an archive by place, READ_BYTES at a time."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from `at` on."""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(max(0, min(max(n, READ_BYTES), self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]

    def find(self, start: int, end: int) -> int:
        """The first place from start on, before end, where MAGIC stands; -1 if there is none."""
        while start < end:
            part = self.read(start, min(READ_BYTES, end + len(MAGIC) - 1 - start))
            k = part.find(MAGIC)
            if k >= 0:
                return start + k
            if len(part) < len(MAGIC):
                return -1
            start += len(part) - len(MAGIC) + 1
        return -1


def _after_gzip_header(f: _File, at: int) -> int:
    """The place behind a gzip header at `at`; -1 if it isn't sound or names another place."""
    head = f.read(at, 10)
    if len(head) < 10 or head[:3] != MAGIC or head[3] & 0xE0:
        return -1
    flags, k = head[3], at + 10
    if flags & 4:
        size = int.from_bytes(f.read(k, 2), "little")
        extra = f.read(k + 2, size)
        if len(extra) < size:
            return -1
        if size == _OWN.size and extra[:2] == b"WO" and _OWN.unpack(extra)[2] != at:
            return -1
        k += 2 + size
    for bit in (8, 16):  # name and comment, each up to a zero byte
        if flags & bit:
            while (c := f.read(k, 1)) not in (b"\0", b""):
                k += 1
            if not c:
                return -1
            k += 1
    return k + 2 * bool(flags & 2)


def parse_head(head: bytes) -> dict[str, str] | None:
    """Fields of a WARC header by lower-case name; None if it isn't one."""
    first, _, rest = head.partition(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        return None
    fields: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", rest).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            return None
        fields.setdefault(name.decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    if not {"warc-type", "warc-record-id"} <= fields.keys() or not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        return None
    return fields


def read_member(f: _File, at: int) -> tuple[int, dict[str, str], bytes, str | None] | None:
    """(place behind it, fields, block, what is wrong) of the record that begins at `at`; None if none does."""
    k = _after_gzip_header(f, at)
    if k < 0:
        return None
    unpack, out, crc, fields, length, head = zlib.decompressobj(-15), [], 0, None, 0, b""
    while not unpack.eof:
        part = f.read(k, READ_BYTES)
        try:
            data = unpack.decompress(part) if part else b""
        except zlib.error:
            return (k, fields, b"".join(out), "broken data") if fields else None
        k += len(part) - len(unpack.unused_data)
        crc, length = zlib.crc32(data, crc), length + len(data)
        out.append(data)
        if fields is None:
            head = b"".join(out)
            if head[:7] != b"WARC/1."[: len(head)] or (b"\r\n\r\n" not in head and len(head) > HEAD_BYTES):
                return None
            if b"\r\n\r\n" in head:
                head, _, block = head.partition(b"\r\n\r\n")
                if (fields := parse_head(head)) is None:
                    return None
                out = [block]
        if not part:
            break
    if fields is None:
        return None
    block, own = b"".join(out), int(fields["content-length"])
    if not unpack.eof or f.read(k, 8) != struct.pack("<II", crc, length & 0xFFFFFFFF):
        return k, fields, block[:own], "broken data"
    k += 8
    if f.read(k, 1) not in (b"", b"\0") and f.read(k, 3) != MAGIC:
        return None
    return k, fields, block[:own], None if block[own:] == b"\r\n\r\n" else "length"


def _http(block: bytes) -> tuple[bytes, int | None]:
    """(payload, Content-Length) of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
    return payload, int(said[1]) if said else None


RECORDS = "path string, offset long, length long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def _row(path: str, at: int, end: int, fields: dict[str, str], block: bytes, error: str | None, want: bool) -> tuple:
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest")
    said = digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else None
    payload, length = _http(block) if fields.get("content-type", "").startswith("application/http") else (block, None)
    if kind == "revisit":
        payload, own = None, said
    else:
        length, own = len(payload), digest32(payload)
        error = error or ("digest" if said not in (None, own) else None)
    return path, at, end - at, kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"), own, length, payload if want else None, error


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """RECORDS of gzipped archives: files (path, bytes). Each range of split_bytes bytes is read by a task of its own; without
    `payloads` that column is null, digests and lengths are still those of what was read. An empty file has no records."""
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as opened:
                    f, rows, held, at, end = _File(opened), [], 0, start, start + split_bytes
                    while (at := f.find(at, min(end, f.size))) >= 0:
                        found = read_member(f, at)
                        if found is None:
                            at += 1
                            continue
                        rows.append(_row(path, at, *found, payloads))
                        held += len(rows[-1][-2] or b"") + 200
                        at = max(at + 1, found[0]) if found[3] != "broken data" else at + 1
                        if held >= READ_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                    if rows:
                        yield packed(rows)

    return ranges.repartition(int(n)).mapInArrow(read, RECORDS)


def _page(column: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:page:(-?[0-9]*):', 1), '') AS bigint)")


def op13_warc(spark: SparkSession, sf_dir: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes all pages as WARC records and reads the archives back.

    Nulls, empty payloads, ties and repeated rows: see with_revisits(). Payloads of any length are written and read whole, a
    record at a time. Other columns are ignored; an empty table gives no rows. A record that isn't read back sound fails the query.
    """
    pages = dealt(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    found = read_archives(write_pages(with_revisits(pages)), split_bytes, payloads=False)
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "path", "offset", "error")))
    rows = found.withColumn("record_type", sound).where("record_type in ('response', 'revisit')")
    return rows.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), digests AS (
    SELECT page_id, strlen(payload) AS payload_bytes, [CAST('0x' || substr(sha1(payload), 5 * g + 1, 5) AS BIGINT) FOR g IN range(8)] AS fives,
        CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to
    FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + k // 4] >> (15 - 5 * (k % 4))) & 31), 1) FOR k IN range(32)], '') AS payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM digests
"""
