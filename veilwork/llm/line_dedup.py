"""Line deduplication: range-partitioned line hashes, streamed in order; keep bitmaps per document.

A line's key is the line without white space (blank, \\t, \\n, \\v, \\f, \\r) at both ends and with A-Z in lower
case. A key of at least ``min_chars`` code points that at least two documents hold loses all its lines but
those in the smallest doc_id that holds it.

Defined cases: a null or empty text is one empty line. A row with a null doc_id is compared with nothing and
keeps all its lines. Rows that share a doc_id are one document to the rule; each keeps or loses its own lines.
Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import SPACE, fresh, mapped, stage

LINES = pa.schema([("h", pa.binary()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32())])
RUNS = pa.schema([("kind", pa.int8()), *LINES])
DROP, OPEN, EDGE = 0, 1, 2


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(h, doc_id, rid, pos)`` for each line whose key is long enough; rid tells rows of one doc_id apart."""
    def rows(of):
        for doc_id, rid, text in of:
            for pos, line in enumerate(text.split(b"\n")):
                if len(line) >= min_chars:
                    key = line.strip(SPACE)
                    if len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars:
                        yield hashlib.blake2b(key.lower(), digest_size=16).digest(), doc_id, rid, pos

    src = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text"), F.col("text").cast("binary"))
    return mapped(src, rows, LINES, "h binary, doc_id bigint, rid bigint, pos int")


def _runs(of):
    """Streams lines sorted by (hash, document, position) and tells which are not first occurrences.

    A hash may go on from the partition before or into the one after, as a common line spreads over many.
    So the first document of the first run stays OPEN, and both outer runs report their first document (EDGE).
    """
    last, first_doc, runs, edge = None, None, 0, None
    for h, doc_id, rid, pos in of:
        if h != last:
            last, first_doc, runs = h, doc_id, runs + 1
            edge = (EDGE, h, doc_id, None, None)
            if runs == 1:
                yield edge
        if doc_id != first_doc:
            yield DROP, None, doc_id, rid, pos
        elif runs == 1:
            yield OPEN, h, doc_id, rid, pos
    if runs > 1:
        yield edge


def repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, rid, pos)`` of the lines to drop."""
    lines = stage(line_hashes(docs, min_chars), "lines")
    order = ["h", "doc_id", "rid", "pos"]
    runs = stage(mapped(lines.repartitionByRange(*order).sortWithinPartitions(*order), _runs, RUNS,
                        "kind tinyint, h binary, doc_id bigint, rid bigint, pos int"), "runs")
    first = runs.where(F.col("kind") == EDGE).groupBy("h").agg(F.min("doc_id").alias("first"))
    late = runs.where(F.col("kind") == OPEN).join(first, "h").where("doc_id > first")
    return runs.where(F.col("kind") == DROP).select("doc_id", "rid", "pos").unionAll(
        late.select("doc_id", "rid", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, rid, bits)`` for documents that lose lines: zlib of a bit per line, set where the line is dropped.

    Lines after the last set bit stay. rid is xxhash64 of the text.
    """
    def rows(of):
        for doc_id, rid, at in of:
            flags = np.zeros(max(at) + 1, np.uint8)
            flags[at] = 1
            yield doc_id, rid, zlib.compress(np.packbits(flags, bitorder="little").tobytes())

    gathered = repeated_lines(docs, min_chars).groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("at"))
    return mapped(gathered, rows, pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("bits", pa.binary())]),
                  "doc_id bigint, rid bigint, bits binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with each document's bitmap (null where it keeps all lines), and that column's name."""
    rid, bits, key = fresh(docs, "rid"), fresh(docs, "bits"), fresh(docs, "key")
    found = bitmaps.select(F.col("doc_id").alias(key), F.col("rid").alias(rid), F.col("bits").alias(bits))
    left = docs.withColumn(f"{rid}_", F.xxhash64("text"))
    joined = left.join(found, (left["doc_id"].cast("bigint") == found[key]) & (left[f"{rid}_"] == found[rid]), "left")
    return joined.drop(key, rid, f"{rid}_"), bits


def kept(text: bytes | None, bits: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, how many lines it had, and how many went."""
    lines = (text or b"").split(b"\n")
    if bits is None:
        return text or b"", len(lines), 0
    drop = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little")
    stay = [x for x, d in zip(lines, drop) if not d] + lines[len(drop):]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_text(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with its columns, ``text`` without the repeated lines (null texts stay null)."""
    joined, bits = with_bitmaps(docs, keep_bitmaps(docs, min_chars))
    new = F.pandas_udf(lambda t, b: t.combine(b, lambda x, y: x if y is None else kept(x.encode(), y)[0].decode()),
                       "string")
    changed = F.when(F.col(bits).isNotNull(), new(F.col("text"), F.col(bits))).otherwise(F.col("text"))
    return joined.withColumn("text", changed).select(*docs.columns)


def dedup_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` per document."""
    def rows(of):
        for doc_id, text, bits in of:
            out, n, gone = kept(text, bits)
            yield doc_id, n, gone, hashlib.sha256(out).hexdigest()

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined, bits = with_bitmaps(docs, keep_bitmaps(docs, min_chars))
    return mapped(joined.select("doc_id", F.col("text").cast("binary"), bits), rows,
                  pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                             ("kept_sha256", pa.string())]),
                  "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
