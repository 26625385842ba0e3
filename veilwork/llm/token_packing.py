"""Packing of token ids to rows of one length: best fit, longest first, with a segment tree over free space.

Each task tokenises its documents, ends each with the end mark, and cuts documents longer than a row into whole rows and
a rest, without loss. The parts of a block of documents go longest first to the open row with the least space that
holds them. A segment tree over the values of free space (0 to the row length) finds that value in one descent. There is no
shuffle; a block bounds what a task holds, and the rows of a block's end are the only ones that later documents can't fill.

A row has its ids (little-endian 16- or 32-bit matrix row, padded), cumulative segment lengths, the places where positions
restart, and for each segment the document and the offset in its ids, so that documents can be put together again.

Defined cases: a null text is no document; an empty one is its end mark alone. A null doc_id stays null. Repeated rows
are packed each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of that vocabulary's word splitter.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, END = 2048, 50256
#: Ids a task gathers before it packs them, and words kept with their ids in a worker.
BLOCK, KNOWN = 4_000_000, 600_000
#: Splitting before white space never parts a token: none holds white space after another character. The class is
#: the pattern's white space, which Python's has four control characters more than.
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")

SCHEMA = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                    ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])
DDL = ("shard int, row bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
       "doc_ids array<bigint>, doc_offsets array<bigint>")


class Tokens:
    """Byte-level BPE with a worker's memory of words."""

    def __init__(self, ranks: bytes):
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        if len(self.known) > KNOWN:
            self.known.clear()
        out: list[int] = []
        get = self.known.get
        for w in CHUNK.findall(text):
            ids = get(w)
            if ids is None:
                ids = self.known[w] = self.enc.encode_ordinary(w)
            out += ids
        return out


_HELD: dict[int, Tokens] = {}


def _tokens(ranks: bytes) -> Tokens:
    mark = hash(ranks)
    if mark not in _HELD:
        _HELD.clear()
        _HELD[mark] = Tokens(ranks)
    return _HELD[mark]


class FreeSpace:
    """Segment tree over 0..length: how many open rows have just that much space."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.sums = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        at = self.size + space
        while at:
            self.sums[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The space and number of a row with the least space of at least ``need``."""
        at = self.size + need
        if not self.sums[at]:
            while at > 1 and (at & 1 or not self.sums[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.sums[2 * at] else 2 * at + 1
        space = at - self.size
        while at:
            self.sums[at] -= 1
            at >>= 1
        return space, self.rows[space].pop()


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of part numbers. Parts of one size keep their order, so the result is fixed by the sizes."""
    rows: list[list[int]] = []
    free = FreeSpace(length)
    for part in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[part])
        found = free.take(size)
        space, row = found or (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(part)
        if space > size:
            free.add(space - size, row)
    return rows


def _block(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int, kind, shard: int, first: int):
    part_doc, part_at, sizes = [], [], []
    for d, (_, ids) in enumerate(docs):
        for at in range(0, len(ids), length):
            part_doc.append(d)
            part_at.append(at)
            sizes.append(min(length, len(ids) - at))
    for k, row in enumerate(best_fit(np.array(sizes, np.int64), length)):
        out = np.full(length, pad, kind)
        ends = [0]
        for p in row:
            at = part_at[p]
            out[ends[-1]:ends[-1] + sizes[p]] = docs[part_doc[p]][1][at:at + sizes[p]]
            ends.append(ends[-1] + sizes[p])
        yield (shard, first + k, ends[-1], out.tobytes(), ends, ends[:-1], [docs[part_doc[p]][0] for p in row],
               [part_at[p] for p in row])


def packed(docs: DataFrame, ranks: str = RANKS, length: int = LENGTH, end: int = END, pad: int = END,
           block: int = BLOCK) -> DataFrame:
    """Packed rows of all documents; see ``DDL``. ``ranks`` is the path of the vocabulary on the driver."""
    if length < 1:
        raise ValueError("a row holds at least one id")
    with open(ranks, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # its size is the vocabulary's
    top = max(end, pad, 50_255 if ranks == RANKS else 1 << 16)
    kind = np.dtype("<u2" if top < 1 << 16 else "<u4")

    def rows(batches):
        encode, shard = _tokens(data.value).encode, TaskContext.get().partitionId()
        held, n, first = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    ids = np.array([*encode(text), end], kind)
                    held.append((doc_id, ids))
                    n += len(ids)
                    if n >= block:
                        done = list(_block(held, length, pad, kind, shard, first))
                        yield from _batches(done)
                        first, held, n = first + len(done), [], 0
        yield from _batches(list(_block(held, length, pad, kind, shard, first)))

    def _batches(done):
        for at in range(0, len(done), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done[at:at + 1000]), SCHEMA.types)],
                                             schema=SCHEMA)

    return docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                                 F.col("text").cast("string").alias("text")).mapInArrow(rows, DDL)


def write_packed(docs: DataFrame, path: str, **settings) -> None:
    """The packed rows as Parquet files."""
    packed(docs, **settings).write.parquet(path)


def unpacked(rows: DataFrame, width: int = 2) -> DataFrame:
    """``(doc_id, ids)``: documents put together again, end marks included; doc_ids must be unique."""
    parts = rows.select("ids", "cu_seqlens", F.explode(F.arrays_zip("doc_ids", "doc_offsets", "position_resets",
                        F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("ends"))).alias("p"))
    cut = parts.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.doc_offsets").alias("at"),
                       F.substring("ids", F.col("p.position_resets") * width + 1,
                                   (F.col("p.ends") - F.col("p.position_resets")) * width).alias("ids"))
    return cut.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("s")).select(
        "doc_id", F.expr("aggregate(s, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
