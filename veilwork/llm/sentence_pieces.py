"""SentencePiece encoding and decoding over a suffix array of the batch.

The words of a batch of documents that aren't known yet are put together to one text, whose suffixes are sorted to the
length of the longest piece (ranks of 4, 8, 16, ... characters by doubling). Every piece of the vocabulary is searched
in it by binary search; its range of suffixes are its occurrences. These edges (position, length, piece) go to a table
by position, and segmentations are relaxed over them: a BPE model's pieces carry the order of merges, so the best edge
that joins two neighbours is taken, leftmost first, until none is left, for all words of the batch at once. A unigram
model's edges are relaxed from left to right for the best sum of scores.

The result is the library's for models without normalisation rules and user-defined pieces. Words are what pieces can't
cross: a piece holds the blank mark in front only, or blank marks only.

Defined cases: a null text has null ids and counts as 0 pieces; an empty one has no ids. A character that is no piece
becomes its UTF-8 bytes' pieces, or the unknown piece where the model has none. Decoding gives the text back, but for a
blank mark (U+2581) in it, which comes back as a blank, and for unknown pieces. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words kept with their ids in a worker; when full it starts anew.
KNOWN = 600_000
#: Documents indexed together, and words relaxed one by one since they are long.
DOCS, LONG = 512, 64
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The model's pieces, read once on the driver and sent to the tasks; its size is the vocabulary's."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.silent = [i for i in range(n) if sp.is_control(i)]
        self.unknown = sp.unk_id()
        self.normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)
                                                  or sp.is_unused(i))]
        self.bpe = sp.encode("ab", out_type=int) is not None and _is_bpe(path)
        if any(BLANK in p.lstrip(BLANK) or "\n" in p and len(p) > 1 for p in (self.pieces[i] for i in self.normal)):
            raise ValueError("pieces cross words; this model isn't supported")


def _is_bpe(path: str) -> bool:
    """The model type of the trainer's settings: field 2 of the model, field 3 in it (1 unigram, 2 BPE)."""
    with open(path, "rb") as f:
        data = f.read()

    def number(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at, end):
        while at < end:
            key, at = number(at)
            if key & 7 == 0:
                value, at = number(at)
                yield key >> 3, value, at
            else:
                size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else number(at)
                yield key >> 3, at, at + size
                at += size

    for name, start, end in fields(0, len(data)):
        if name == 2:
            return any(n == 3 and v == 2 for n, v, _ in fields(start, end))
    return False


WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+")


class Encoder:
    """Encodes words by their edges and remembers them."""

    def __init__(self, v: Vocabulary):
        self.v = v
        normal = [(v.pieces[i], i) for i in v.normal]
        letters = sorted({c for p, _ in normal for c in p})
        if len(letters) > 65_000:
            raise ValueError("the pieces have too many characters")
        self.code = np.zeros(0x110000, np.uint16)  # 0: between words, 1: no piece has it
        self.code[:] = 1
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 2
        self.depth = max(len(p) for p, _ in normal)
        self.levels = 0  # of doubling after 4 characters
        while 4 << self.levels < self.depth:
            self.levels += 1
        self.width = 4 << self.levels
        self.piece_ids = np.array([i for _, i in normal])
        self.piece_len = np.array([len(p) for p, _ in normal])
        self.piece_codes = np.zeros((len(normal), self.width), np.uint64)
        for k, (p, _) in enumerate(normal):
            self.piece_codes[k, :len(p)] = self.code[[ord(c) for c in p]]
        # the order in which pieces are merged; pieces of one score share a place
        places = {s: k for k, s in enumerate(sorted(set(v.scores[v.normal]), reverse=True))}
        self.place = np.full(len(v.pieces) + 1, NONE, np.int32)
        for i in v.normal:
            self.place[i] = places[v.scores[i]]
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.flat, self.size = [], [], [], 0

    # --- the index

    def _levels(self, text: np.ndarray):
        """For 4, 8, 16, ... characters: the sorted keys, the suffix order, and each position's rank."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(self.width, np.uint16)]).astype(np.uint64)
        key = (padded[:n] << np.uint64(48)) | (padded[1:n + 1] << np.uint64(32)) | (padded[2:n + 2] << np.uint64(16)) | padded[3:n + 3]
        out = []
        for level in range(self.levels + 1):
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty(n, bool)
            new[0], new[1:] = True, ordered[1:] != ordered[:-1]
            rank = np.empty(n + self.width, np.uint64)
            rank[n:] = 0
            rank[order] = np.cumsum(new).astype(np.uint64)  # from 1; 0 is past the end
            out.append((ordered, order, ordered[new]))
            if level < self.levels:
                step = 4 << level
                key = (rank[:n] << np.uint64(32)) | rank[step:n + step]
        return out

    def _bounds(self, levels, level: int, codes: np.ndarray, length: np.ndarray):
        """Least and greatest rank at a level of the suffixes that start with the codes (greatest < least: none)."""
        step = 4 << level
        length = np.minimum(length, step)
        if level == 0:
            low = np.zeros(len(codes), np.uint64)
            high = np.zeros(len(codes), np.uint64)
            for k in range(4):
                low = (low << np.uint64(16)) | np.where(k < length, codes[:, k], np.uint64(0))
                high = (high << np.uint64(16)) | np.where(k < length, codes[:, k], np.uint64(0xFFFF))
        else:
            half = step // 2
            a, b = self._bounds(levels, level - 1, codes[:, :half], length)
            c, d = self._bounds(levels, level - 1, codes[:, half:], np.maximum(length - half, 0))
            whole = length > half
            top = np.uint64(0xFFFFFFFF)
            low = (a << np.uint64(32)) | np.where(whole, c, np.uint64(0))
            high = (b << np.uint64(32)) | np.where(whole, d, top)
            gone = (b < a) | whole & ((d < c) | (b != a))
            low, high = np.where(gone, np.uint64(1), low), np.where(gone, np.uint64(0), high)
        distinct = levels[level][2]
        return (np.searchsorted(distinct, low, "left") + 1).astype(np.uint64), np.searchsorted(distinct, high, "right").astype(np.uint64)

    def edges(self, text: np.ndarray) -> np.ndarray:
        """Table by position and length: the piece that is there, or the number of pieces for none."""
        none = len(self.v.pieces)
        table = np.full((len(text), self.depth), none, np.int32)
        if not len(text):
            return table
        levels = self._levels(text)
        for level in range(self.levels + 1):  # pieces are searched at the shallowest level that tells them apart
            least = 0 if level == 0 else 2 << level
            mine = np.flatnonzero((self.piece_len > least) & (self.piece_len <= 4 << level))
            if not len(mine):
                continue
            low, high = self._bounds(levels, level, self.piece_codes[mine], self.piece_len[mine])
            ordered, order, distinct = levels[level]
            found = np.flatnonzero(high >= low)
            first = np.searchsorted(ordered, distinct[(low[found] - np.uint64(1)).astype(np.int64)], "left")
            last = np.searchsorted(ordered, distinct[(high[found] - np.uint64(1)).astype(np.int64)], "right")
            n = last - first
            which = np.repeat(mine[found], n)
            at = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            table[at, self.piece_len[which] - 1] = self.piece_ids[which]
        return table

    # --- relaxing

    def _merge(self, table: np.ndarray, start: np.ndarray, end: np.ndarray, unit: np.ndarray):
        """All words at once: in each round every word takes its best edge between two neighbours."""
        place, done = self.place, []
        while len(start):
            long = end[1:] - start[:-1]
            good = (unit[1:] == unit[:-1]) & (long <= self.depth)
            score = np.full(len(start), NONE, np.int32)
            at = np.flatnonzero(good)
            score[at] = place[table[start[at], long[at] - 1]]
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(score, heads)
            size = np.diff(np.append(heads, len(start)))
            of = np.repeat(best, size)
            live = of < NONE
            if not live.all():
                done.append((start[~live], end[~live], unit[~live]))
                start, end, unit, score, of = start[live], end[live], unit[live], score[live], of[live]
            if not len(start):
                break
            hit = np.flatnonzero(score == of)
            hit = hit[np.concatenate([[True], unit[hit[1:]] != unit[hit[:-1]]])]
            end[hit] = end[hit + 1]
            stay = np.ones(len(start), bool)
            stay[hit + 1] = False
            start, end, unit = start[stay], end[stay], unit[stay]
        return [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, np.int64)] * 3

    def _merge_long(self, table: np.ndarray, a: int, b: int):
        """One long word by a heap of edges."""
        after, before = list(range(a + 1, b + 2)), list(range(a - 1, b))
        alive = [True] * (b - a + 1)

        def edge(i):
            j = after[i - a]
            if j < b and after[j - a] - i <= self.depth:
                p = int(self.place[table[i, after[j - a] - i - 1]])
                if p < NONE:
                    heapq.heappush(heap, (p, i, after[j - a]))

        heap: list = []
        for i in range(a, b):
            edge(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i - a]
            if not alive[i - a] or j >= b or after[j - a] != stop:
                continue
            alive[j - a] = False
            after[i - a] = stop
            if stop < b:
                before[stop - a] = i
            edge(i)
            if before[i - a] >= a:
                edge(before[i - a])
        i, out = a, []
        while i < b:
            out.append((i, after[i - a]))
            i = after[i - a]
        return out

    def _best_sum(self, table: np.ndarray, a: int, b: int):
        """Unigram: edges in order of position, each relaxing its end."""
        worst = self.v.scores.min() - 10
        best, back = [0.0] + [-np.inf] * (b - a), [0] * (b - a + 1)
        for i in range(b - a):
            for n in range(1, min(self.depth, b - a - i) + 1):
                p = table[a + i, n - 1]
                s = self.v.scores[p] if p < len(self.v.pieces) else worst if n == 1 else None
                if s is not None and best[i] + s > best[i + n]:
                    best[i + n], back[i + n] = best[i] + s, i
        out, i = [], b - a
        while i:
            out.append((a + back[i], a + i))
            i = back[i]
        return out[::-1]

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        if not words:
            return
        joined = "\x00".join(words) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        text = self.code[points]
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text[first + size] = 0
        table = self.edges(text)
        short = np.flatnonzero(size <= LONG) if self.v.bpe else np.zeros(0, np.int64)
        n = size[short]
        start = np.repeat(first[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s, e, u = self._merge(table, start, start + 1, np.repeat(short, n))
        rest = [(a, b, k) for k in (np.flatnonzero(size > LONG) if self.v.bpe else range(len(words)))
                for a, b in (self._merge_long if self.v.bpe else self._best_sum)(table, int(first[k]), int(first[k] + size[k]))]
        if rest:
            more = np.array(rest, np.int64)
            s, e, u = np.append(s, more[:, 0]), np.append(e, more[:, 1]), np.append(u, more[:, 2])
        order = np.argsort(s, kind="stable")
        s, e, u = s[order], e[order], u[order]
        ids = table[s, e - s - 1]
        odd = np.flatnonzero(ids == len(self.v.pieces))
        if len(odd):
            spelled = [self._spell(chr(points[s[k]])) for k in odd]
            count = np.ones(len(ids), np.int64)
            count[odd] = [len(x) for x in spelled]
            at = np.cumsum(count) - count
            wide = np.repeat(ids, count)
            for k, x in zip(odd, spelled):
                wide[at[k]:at[k] + len(x)] = x
            ids, u = wide, np.repeat(u, count)
        n = np.bincount(u, minlength=len(words))
        base = self.size
        at = base + np.cumsum(n) - n
        for k, w in enumerate(words):
            self.known[w] = len(self.known)
        self.starts.append(at)
        self.counts.append(n)
        self.flat.append(ids.astype(np.int32))
        self.size += len(ids)

    def _spell(self, c: str) -> list[int]:
        data = c.encode("utf-8", "surrogatepass")
        return [self.v.bytes[b] for b in data] if self.v.bytes else [self.v.unknown]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        split = [WORDS.findall(BLANK + t.replace(" ", BLANK)) if t else () for t in texts]
        if len(self.known) > KNOWN:
            self.reset()
        self.learn(list({w for ws in split for w in ws} - self.known.keys()))
        if len(self.flat) > 1:
            self.starts, self.counts, self.flat = [np.concatenate(self.starts)], [np.concatenate(self.counts)], [np.concatenate(self.flat)]
        if not self.flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        get = self.known.__getitem__
        at = np.fromiter((get(w) for ws in split for w in ws), np.int64)
        n = self.counts[0][at]
        ids = self.flat[0][np.repeat(self.starts[0][at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.cumsum([len(ws) for ws in split])
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(total[np.concatenate([[0], ends])])


class Decoder:
    """Joins the pieces' bytes; blank marks become blanks and the first one goes."""

    def __init__(self, v: Vocabulary):
        spelled = [p.replace(BLANK, " ").encode() for p in v.pieces]
        for b, i in v.bytes.items():
            spelled[i] = bytes([b])
        for i in v.silent:
            spelled[i] = b""
        spelled[v.unknown] = " ⁇ ".encode()
        self.count = np.array([len(x) for x in spelled])
        self.start = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        n = self.count[ids]
        data = self.flat[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
        parts = (data[a:b] for a, b in zip(ends, ends[1:]))
        return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in parts]


_HELD: dict = {}


def _worker(v: Vocabulary) -> tuple[Encoder, Decoder]:
    """One encoder a worker, kept from task to task."""
    mark = hash((tuple(v.pieces), v.bpe, v.scores.tobytes()))
    if mark not in _HELD:
        _HELD.clear()
        _HELD[mark] = Encoder(v), Decoder(v)
    return _HELD[mark]


def pieces_of(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int) and ``n_pieces`` and ``round_trip`` (whether decoding gives the text).

    Columns of these names that ``docs`` has are replaced.
    """
    names = ("piece_ids", "n_pieces", "round_trip")
    docs = docs.drop(*names)
    spark = docs.sparkSession
    v = spark.sparkContext.broadcast(Vocabulary(model))
    at = docs.columns.index("text")

    def run(batches):
        enc, dec = _worker(v.value)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS):
                part = batch.slice(k, DOCS)
                texts = part.column(at).to_pylist()
                ids, n = enc.encode(texts)
                back = dec.decode(ids, n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32(), mask=np.array([t is None for t in texts] + [False]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                     pa.array(n, pa.int64()), pa.array([None if t is None else t == b for t, b in zip(texts, back)], pa.bool_())],
                    names=[*part.schema.names, *names])

    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema, T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def piece_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, n_pieces, round_trip, piece_ids)`` per row."""
    return pieces_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")),
                     model).select("doc_id", "n_pieces", "round_trip", "piece_ids")
