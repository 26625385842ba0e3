"""Legacy web archives: ARC files of versions 1 and 2, and their conversion to WARC.

Archives are written by Spark's text writer, which commits whole files and survives lost executors: one file per task,
gzip over the file, the separator of the format as line end. They are read line by line with the separator ``\\n``; a
compressed file isn't split, so each task sees a file's lines in order, puts them together to the declared lengths and
holds one record at a time.

A converted record keeps the target, the time and the network document of the ARC record. Its identifier is a name-based
UUID over these and the place in the archive, its digest a SHA-1 over the payload. Of records with equal payloads of at
least ``min_bytes`` bytes the one with the largest page_id is a response, the others are revisits of it without payload.

Defined cases: a null html is an empty payload, a null url the target ``unknown:``. A row with a null page_id is always
a response and nothing revisits it. Rows that repeat the largest page_id are all responses (revisits name the first by
identifier). An empty table gives archives without pages, and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.common import OUT_ROWS, mapped, stage, work_path

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_END = "\r\n\r\n"
SPACE_OF_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
NO_URL, NO_ADDRESS, EPOCH = "unknown:", "0.0.0.0", "19700101000000"

RECORD = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                    ("address", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("head", pa.binary()),
                    ("payload", pa.binary()), ("digest", pa.string()), ("bytes", pa.int64())])
RECORD_DDL = ("file string, offset bigint, page_id bigint, url string, address string, date string, kind string, "
              "head binary, payload binary, digest string, bytes bigint")
BACK = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                  ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("refers_to_id", pa.string())])
BACK_DDL = ("record_id string, record_type string, page_id bigint, url string, payload_bytes bigint, "
            "payload_digest string, refers_to_id string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str | None, empty: str) -> str:
    """A header field holds no white space."""
    return "%20".join((value or "").split()) or empty


# --- writing ARC

def arc_head(version: int, name: str) -> str:
    """The version block that starts an archive."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 archive\n{fields}\n"
    common = f"filedesc://{name} {NO_ADDRESS} {EPOCH} text/plain"
    extra = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{common}{extra} {len(body.encode())}\n{body}"


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None, name: str) -> str:
    """One ARC record; its network document is an HTTP answer whose body is the html in UTF-8."""
    body = html or ""
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
             f"{len(body.encode())}\r\n{mark}\r\n{body}")
    data = block.encode()
    extra = f" 200 {hashlib.md5(data).hexdigest()} - 0 {name}" if version == 2 else ""
    return f"{_field(url, NO_URL)} {NO_ADDRESS} {EPOCH} text/html{extra} {len(data)}\n{block}"


def write_arc(pages: DataFrame, path: str) -> None:
    """One archive per task; the tasks take turns with the two versions."""
    def rows(of):
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:06d}.arc"
        yield (arc_head(version, name),)
        for page_id, url, html in of:
            yield (arc_record(version, page_id, url, html, name),)

    src = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(mapped(src, rows, pa.schema([("value", pa.string())]), "value string", 256), path, "\n")


def _write(df: DataFrame, path: str, end: str) -> None:
    df.write.option("compression", "gzip").option("lineSep", end).text(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file)``: the archives' lines as bytes, a file's lines in order."""
    return (spark.read.schema(T.StructType([T.StructField("value", T.StringType())]))
            .option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")))


# --- reading: lines back to records of declared lengths

class Blocks:
    """Takes lines and gives (header lines, block, offset) records; ``length`` tells a header's block length or None."""

    def __init__(self, is_whole, length):
        self.is_whole, self.length = is_whole, length
        self.header: list[bytes] = []
        self.block: list[bytes] = []
        self.need, self.have, self.at, self.start = -1, 0, 0, 0

    def feed(self, line: bytes) -> Iterator[tuple[list[bytes], bytes, int]]:
        size = len(line) + 1
        if self.need < 0:
            if not self.header and not line.strip(b"\r"):
                self.at += size  # separators between records
                return
            if not self.header:
                self.start = self.at
            self.header.append(line.rstrip(b"\r"))
            self.at += size
            if self.is_whole(self.header):
                self.need, self.have, self.block = self.length(self.header), 0, []
                if self.need < 0:
                    raise ValueError(f"no length in the header at {self.start}: {self.header[0][:200]!r}")
                if self.need == 0:
                    yield from self._done()
            return
        self.at += size
        self.block.append(line)
        self.have += size
        if self.have >= self.need:
            yield from self._done()

    def _done(self):
        whole = b"\n".join([*self.block, b""])
        if whole[self.need:].strip(b"\r\n"):
            raise ValueError(f"the record at {self.start} is longer than declared")
        header, self.header, need, self.need = self.header, [], self.need, -1
        self.block = []
        yield header, whole[:need], self.start

    def end(self) -> None:
        if self.need >= 0 or self.header:
            raise ValueError(f"the record at {self.start} is cut off")


def _arc_length(header: list[bytes]) -> int:
    last = header[0].rsplit(b" ", 1)[-1]
    return int(last) if last.isdigit() else -1


def _warc_length(header: list[bytes]) -> int:
    for line in header:
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value)
    return -1


def arc_blocks() -> Blocks:
    return Blocks(lambda header: True, _arc_length)


def warc_blocks() -> Blocks:
    return Blocks(lambda header: header[-1] == b"", _warc_length)


def records(lines: Iterable[tuple[bytes, str]], blocks) -> Iterator[tuple[str, list[bytes], bytes, int]]:
    """(file, header, block, offset) of all files of a task."""
    now, state = None, None
    for line, file in lines:
        if file != now:
            if state:
                state.end()
            now, state = file, blocks()
        for header, block, at in state.feed(line):
            yield file, header, block, at
    if state:
        state.end()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, mark, body = block.partition(b"\r\n\r\n")
    return (head + mark, body) if mark and head.startswith(b"HTTP/") else (b"", block)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, mark, value = line.partition(b":")
        if mark and key.strip().lower() == name.encode():
            return value.strip().decode("utf-8", "replace")
    return None


def _arc_rows(lines):
    version: dict[str, int] = {}
    for file, header, block, at in records(lines, arc_blocks):
        parts = header[0].decode("utf-8", "replace").split(" ")
        if parts[0].startswith("filedesc://"):
            version[file] = int(block.split(b" ", 1)[0])
            continue
        names = ARC_FIELDS[version[file]].split(" ")
        if len(parts) < len(names):
            raise ValueError(f"{file}: {len(parts)} fields at {at}, {len(names)} declared")
        # a target may hold blanks, so the other fields count from the end
        tail = dict(zip(names[1:], parts[1 - len(names):]))
        url = " ".join(parts[:1 - len(names)])
        head, body = split_http(block)
        page = http_field(head, "x-page-id")
        yield (file, at, int(page) if page else None, url, tail["IP-address"], tail["Archive-date"],
               tail["Content-type"], head, body, sha1_base32(body), len(body))


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The records of ARC archives of either version, without the version blocks; bodies: with head and payload."""
    def rows(lines):
        for r in _arc_rows(lines):
            yield r if bodies else (*r[:7], None, None, *r[9:])

    return mapped(lines_of(spark, path), rows, RECORD, RECORD_DDL, 256 if bodies else OUT_ROWS)


# --- conversion

def warc_time(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: int | None, url: str, date: str, digest: str, place: str = "") -> str:
    """A name-based identifier. A page's does not depend on its place, so revisits can name it."""
    own = f"page {page_id}" if page_id is not None else f"at {place}"
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_NAMES, f'{own} {url} {date} {digest}')}>"


def warc_record(kind: str, rid: str, url: str, address: str, date: str, digest: str, head: bytes, payload: bytes,
                refers: tuple[str, str, str] | None = None) -> bytes:
    block = head + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", warc_time(date)), ("WARC-Target-URI", url),
              ("WARC-IP-Address", address), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if refers:
        fields += [("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]),
                   ("WARC-Refers-To-Date", warc_time(refers[2])),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response" if head else "text/html"),
               ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def responses(found: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(digest, page_id, url, date)`` of the response of each group of equal payloads with more than one page_id."""
    page = F.struct("page_id", "url", "date")
    groups = (found.where(f"page_id is not null and bytes >= {int(min_bytes)}").groupBy("digest")
              .agg(F.max("page_id").alias("most"), F.min("page_id").alias("least"),
                   F.max_by(page, F.struct("page_id", "url", "date")).alias("p")))
    return groups.where("most > least").select("digest", "p.page_id", "p.url", "p.date")


def convert(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Writes the WARC archives of the ARC archives in a folder. Groups of equal payloads are found by digest, before any payload moves.

    The join on the digest is left to Spark: it broadcasts the groups when their measured size is small, and splits a
    hot digest otherwise, as both sides come from a plain exchange.
    """
    groups = stage(responses(read_arc(spark, arc, bodies=False), min_bytes), "groups")
    found = read_arc(spark, arc)
    g = groups.select(F.col("digest").alias("g_digest"), F.col("page_id").alias("g_page"), F.col("url").alias("g_url"),
                      F.col("date").alias("g_date"))
    joined = found.join(g, (F.col("digest") == F.col("g_digest")) & (F.col("bytes") >= min_bytes)
                        & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("g_page")), "left")

    def rows(of):
        yield (b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
               b"Content-Type: application/warc-fields\r\nContent-Length: 16\r\n\r\nformat: WARC 1.1"
               % str(uuid.uuid5(SPACE_OF_NAMES, f"file {TaskContext.get().partitionId()}")).encode(),)
        for file, at, page, url, address, date, head, payload, digest, g_page, g_url, g_date in of:
            rid = record_id(page, url, date, digest, f"{file} {at}")
            if g_page is None:
                yield (warc_record("response", rid, url, address, date, digest, head, payload),)
            else:
                target = record_id(g_page, g_url, g_date, digest), g_url, g_date
                yield (warc_record("revisit", rid, url, address, date, digest, head, payload, target),)

    out = mapped(joined.select("file", "offset", "page_id", "url", "address", "date", "head", "payload", "digest",
                               "g_page", "g_url", "g_date"),
                 rows, pa.schema([("value", pa.binary())]), "value binary", 256)
    _write(out.select(F.col("value").cast("string")), warc, WARC_END)


def _warc_rows(lines):
    for file, header, block, at in records(lines, warc_blocks):
        f = {}
        for line in header[1:]:
            key, mark, value = line.decode("utf-8", "replace").partition(":")
            if mark:
                f[key.lower()] = value.strip()
        if f["warc-type"] not in ("response", "revisit"):
            continue
        head, body = split_http(block)
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        n = len(body)
        if f["warc-type"] == "revisit":
            n = int(http_field(head, "content-length") or 0)
        elif sha1_base32(body) != digest:
            raise ValueError(f"{file}: the payload at {at} doesn't have its digest")
        page = http_field(head, "x-page-id")
        yield (f["warc-record-id"], f["warc-type"], int(page) if page else None, f["warc-target-uri"], n, digest,
               f.get("warc-refers-to"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of WARC archives; payloads are held against their digests."""
    return mapped(lines_of(spark, path), _warc_rows, BACK, BACK_DDL)


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC archives, the converter and WARC archives, and back to a row per page."""
    spark = pages.sparkSession
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, min_bytes)
    back = stage(read_warc(spark, warc), "read-back")
    target = (back.where("record_type = 'response' and page_id is not null")
              .groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to")))
    used = back.where("refers_to_id is not null").select("refers_to_id").distinct()
    return (back.join(stage(target.join(used, "refers_to_id"), "targets"), "refers_to_id", "left")
            .select("page_id", F.when(F.col("url") != NO_URL, F.col("url")).alias("url"), "payload_bytes",
                    "payload_digest", "record_type", "refers_to"))
