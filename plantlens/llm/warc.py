"""WARC archives: a writer for Spark's text sink, and a reader that salvages damaged archives.

Writing. Every page becomes one record in a gzip member of its own. Of records
with equal payloads of at least ``least`` bytes the one with the smallest
page_id is a response, and the others are revisits of it without payload. The
last byte of a member is the highest byte of its length, 0 below 16 MB (a
longer record is followed by an empty member); so the members are written by
the text sink with 0 as line separator, and with it come the sink's commit
protocol and any file system that Spark knows. A task begins a new archive when
it has written ``archive_bytes``.

Reading. Members (or plain records from their version line on) are read one by
one; a record counts only if its member decompresses with the right check sum,
its length fits and its block digest agrees. After a failed check the reader
looks for the next member or version line with a valid record, goes on there,
and reports the bytes passed over as a gap with the reason. The content of a
sound member that is not just one record is searched in the same way. A member
is inflated in pieces and each search goes on from the last one's answer, so
reading takes time in proportion to the archive. An archive is read by one task
and held whole there (Spark's limit is 2 GB). ``read_records`` also writes the
gaps to a log; the round trip fails if its own archives have any.

Edge cases: a null html is an empty payload; a null url is left out; a null
page_id is written as an empty number and read back as null; repeated rows are
records of their own (all rows with the smallest page_id are responses); line
ends in urls are percent-encoded; headers of more than MOST_HEADERS bytes count
as damaged; other columns of pages are ignored; an empty table gives no archives
and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plantlens.llm.common import saved, shared_dir
from plantlens.operators.skew import joined

MEMBER, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
LINE_END = END[:2]
PIECE, MOST_HEADERS = 1 << 16, 1 << 16
#: Bytes of a version line, and of a member's own header, at most.
VERSION_LINE, MOST_FIELDS = 16, 4096
#: How often the length of an archive is read in vain before a search is confined to what is most likely whole.
WASTE = 4
#: Rows and payload bytes of a batch that the reader hands over.
ROWS, ROWS_BYTES = 500, 16 << 20
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
RECORDS = "archive string, begin long, end long, gap string, record_id string, record_type string, page_id long, refers_to long, uri string, payload binary, payload_bytes long, payload_digest string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed record: WARC headers, HTTP headers and, for a response, the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    number = "" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{number}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes) -> bytes:
    """The record as a gzip member whose last byte is 0."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    packed = z.compress(raw) + z.flush()
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per page to archives of about ``archive_bytes`` below ``path``. Pages are dealt out by id, so a payload that many share is no hot key."""
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    slim = own.where(F.octet_length("html") >= least).where("page_id is not null").select("page_id", "digest").distinct()
    firsts = saved(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1"))
    # a payload that a large part of the pages share is told to them by broadcast
    roles = joined(slim, firsts, ["digest"], "many").where("page_id <> first")
    told = own.join(roles, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "first")

    def work(batches):
        written = 0
        for batch in batches:
            out, archives = [], []
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, html, digest, first = (v.as_py() for v in row)
                archives.append(written // archive_bytes)
                out.append(member(record(page_id, url, html.encode(), digest, first, first is not None))[:-1])
                written += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary()), pa.array(archives, type=pa.int64())], names=["member", "archive"])

    told.mapInArrow(work, "member binary, archive long").select(F.col("member").cast("string").alias("value"), "archive").write.partitionBy("archive").text(path, lineSep="\0")


def has_short_header(data: bytes, at: int) -> bool:
    """Whether the fields of a member's header end within MOST_FIELDS bytes; else what reads it would go on to the end of the archive."""
    flags, place, limit = data[at + 3 : at + 4], at + 10, at + MOST_FIELDS
    if not flags:
        return False
    if flags[0] & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for bit in (8, 16):
        if flags[0] & bit:
            place = data.find(b"\0", place, limit) + 1
            if not place:
                return False
    return place <= limit


def inflated(data: bytes, at: int, told: bool = False) -> tuple[bytes | None, int]:
    """The content of the member at a place and where it ends; if it is damaged, None and how far it was read. ``told``: it has to begin with a version line."""
    if not has_short_header(data, at):
        return None, at
    z, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        if told:
            first = zlib.decompressobj(31)
            if first.decompress(view[at : at + MOST_FIELDS + PIECE], len(VERSION)) != VERSION and not first.eof:
                return None, at
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + PIECE]))
            at += PIECE
    except zlib.error:
        return None, min(at + PIECE, len(data))
    return (b"".join(out), min(at, len(data)) - len(z.unused_data)) if z.eof else (None, len(data))


class Places:
    """The next place of a mark at or behind a place; a search goes on where the last one found something."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.found = data, mark, -1

    def behind(self, at: int) -> int:
        if self.found < at:
            place = self.data.find(self.mark, at)
            self.found = len(self.data) if place < 0 else place
        return self.found


def parsed(raw: bytes, at: int = 0, within: int | None = None, spent: list[int] | None = None) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at a place, or why there is none; ``within``: where a block has to end, ``spent``: gets the bytes hashed in vain."""
    limit = at + MOST_HEADERS
    stop = raw.find(LINE_END, at, at + VERSION_LINE)
    if not raw.startswith(VERSION, at) or stop < 0:
        return "no version line"
    headers = {}
    # line by line, so that a broken header costs no more than its good lines
    while (place := stop + len(LINE_END)) != (stop := raw.find(LINE_END, place, limit)):
        if stop < 0:
            return "no version line"
        name, colon, value = raw[place:stop].partition(b":")
        if not colon:
            return "broken header"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or len(size) > 18:
        return "no length"
    begin = stop + len(LINE_END)
    end = begin + int(size)
    if raw[end : end + len(END)] != END:
        return "length does not fit"
    if within is not None and end > within:
        return "record over other records, in an archive with too many of them"
    block = raw[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        if spent is not None:
            spent.append(len(block))
        return "digest does not agree"
    return headers, block, end + len(END)


def number(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isascii() and tail.lstrip("-").isdigit() else None


def records_in(raw: bytes) -> Iterator[tuple]:
    """(begin, end, gap, headers, block) for the records and gaps of a member's content, as ``salvage`` gives them for an archive."""
    at, lost, why = 0, None, ""
    while at < len(raw):
        one = parsed(raw, at)
        if isinstance(one, str):
            lost, why = (at, one) if lost is None else (lost, why)
            place = raw.find(VERSION, at + 1)
            at = len(raw) if place < 0 else place
            continue
        if lost is not None:
            yield lost, at, why, None, None
            lost = None
        yield at, one[2], None, one[0], one[1]
        at = one[2]
    if lost is not None:
        yield lost, len(raw), why, None, None


def salvage(data: bytes) -> Iterator[tuple]:
    """(begin, end, gap, headers, block) for records (gap is None) and gaps (headers and block are None), in order, without holes.

    Whatever lies in a member with more than one record has the member's begin and end. When WASTE times the length of
    the archive has been read in vain, only members that begin with a version line are tried, and only records that no other
    version line lies in, so that the time stays in proportion to the length.
    """
    at, lost, why = 0, None, ""
    members, versions, wasted = Places(data, MEMBER), Places(data, VERSION), []
    while at < len(data):
        found, reason, inner = None, "no member or version line", []
        hostile = sum(wasted) > WASTE * len(data)
        if data.startswith(MEMBER, at):
            content, end = inflated(data, at, told=hostile)
            if content is None:
                reason = "broken member"
                wasted = [sum(wasted) + end - at]
            elif not content:
                found = (None, None, end)
            elif not isinstance(one := parsed(content), str) and one[2] == len(content):
                found = (one[0], one[1], end)
            else:
                inner = list(records_in(content))
                if any(r[2] is None for r in inner):
                    found = (None, None, end)
                else:
                    reason, inner = inner[0][2], []
                    wasted = [sum(wasted) + end - at]
        elif data.startswith(VERSION, at):
            one = parsed(data, at, versions.behind(at + 1) if hostile else None, wasted)
            found, reason = (None, one) if isinstance(one, str) else (one, "")
        if found is None:
            lost, why = (at, reason) if lost is None else (lost, why)
            at = min(members.behind(at + 1), versions.behind(at + 1))
            continue
        if lost is not None:
            yield lost, at, why, None, None
            lost = None
        if found[0] is not None:
            yield at, found[2], None, found[0], found[1]
        for begin, end, gap, headers, block in inner:
            yield at, found[2], gap and f"{gap} (bytes {begin} to {end} of a member's content)", headers, block
        at = found[2]
    if lost is not None:
        yield lost, len(data), why, None, None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``: gap is null for records, and says why for bytes passed over.

    Archives are read whole, one after the other in a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for begin, end, gap, headers, block in salvage(data):
            if headers is None:
                yield (name, begin, end, gap, *[None] * 8)
                continue
            kind = headers.get("warc-type")
            payload = block.partition(END)[2] if headers.get("content-type", "").startswith("application/http") else block
            digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
            size = headers.get("warc-payload-length", "")
            if kind != "revisit":
                digest, size = hashlib.sha256(payload).hexdigest(), str(len(payload))
            yield (name, begin, end, None, headers.get("warc-record-id"), kind, number(headers.get("warc-record-id")), number(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload if payloads else None, int(size) if size.isdigit() else None, digest)

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    def work(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                out: list[tuple] = []
                size = 0
                for row in rows(name.as_py(), data.as_py()):
                    out.append(row)
                    size += len(row[9] or b"")
                    if len(out) == ROWS or size > ROWS_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    return files.mapInArrow(work, RECORDS)


def read_records(spark: SparkSession, path: str, gap_log: str, payloads: bool = True) -> DataFrame:
    """The valid records of all archives below ``path``; the byte gaps are appended to the Parquet table ``gap_log`` (archive, begin, end, gap)."""
    found = saved(read_archives(spark, path, payloads))
    found.where("gap is not null").select("archive", "begin", "end", "gap").write.mode("append").parquet(gap_log)
    return found.where("gap is null")


def warc_round_trip(pages: DataFrame, least: int = 100, **how) -> DataFrame:
    """Write all pages, read the archives back, and return a row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Raises an error if a byte of the archives could not be read.
    """
    spark, path, log = pages.sparkSession, shared_dir(pages.sparkSession), shared_dir(pages.sparkSession)
    write_archives(pages, path, least, **how)
    read = read_records(spark, path, log, payloads=False)
    if lost := spark.read.schema("archive string, begin long, end long, gap string").parquet(log).limit(5).collect():
        raise ValueError(f"damaged archives, see {log}: {lost}")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))


#: DuckDB twin of ``warc_round_trip(pages)``.
WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
