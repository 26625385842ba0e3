"""Language model with gated recurrent units: numpy in the tasks, data-parallel training, whole-document scores.

Tokens are words of the text with A-Z in lower case, and one end per document. Counts of all words come from all training
documents. The output is factored into classes: the ``top`` most frequent words in classes of equal size, each with a
softmax over its words, and ``RARE`` groups of the other words by spelling, which are members of classes of their own; in a
group a word has its share of the counts. So P(word) = P(class | state) P(member | class, state) [P(word | group)], and
every word has a probability, seen or not.

Training is truncated backpropagation over windows: each task trains its own copy on its share of the training text, with
the state carried from window to window and cleared at document ends; the copies are averaged by Spark, for ``rounds``
rounds. It starts from the counts (output biases), so little text can't make it much worse than them. All training
documents are read, and copies grow in number with them; only a caller may ask for a share by hash (``one_in``).

Scoring carries the state over all windows of a document. Each block of documents gets the counts of just its words by a
join, so no task needs the whole vocabulary.

``docs`` must give the same rows in the same partitions each time it is run, as a table scan does; scoring fails if not.

Defined cases: a null text is empty and has its end alone. A null doc_id is scored and counts as training. Repeated rows
count and are scored each. Without training documents all scores are 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import OUT_ROWS, mapped, stage, tuples

END = b" "  # no word is a blank
RARE = 64
#: Texts whose words are split at once.
ROWS = 256
#: Words gathered before their counts leave a task.
FLUSH = 2_000_000
#: Logits are held between these, in which float32 exponentials and their sums are exact enough.
LIMIT = np.float32(60)


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def rare_class(word: bytes) -> int:
    """Class of a word outside the vocabulary: by its end and its first letters."""
    last = word[-1:]
    end = 0 if last.isalpha() or last >= b"\x80" else 1 if last == b"." else 2 if last == b"," else 3
    return 16 * end + zlib.crc32(word[:2]) % 16


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and each text's number of words; as ``tokens`` without the ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty ones
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    n = np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(some).view(pa.binary()), n


@cache
def _beginnings() -> np.ndarray:
    """``rare_class`` of a word by its first two bytes; of one byte alone, as if none followed (at 65536 and on)."""
    return np.array([zlib.crc32(bytes([b >> 8, b & 255])) % 16 for b in range(65536)]
                    + [zlib.crc32(bytes([b])) % 16 for b in range(256)])


@cache
def _endings() -> np.ndarray:
    return np.array([rare_class(bytes([b])) // 16 for b in range(256)])


def units(words: pa.Array, vocab: pa.Array, top: int) -> np.ndarray:
    """Ids of words that aren't empty: their places in the vocabulary, or by spelling."""
    at = pc.index_in(words, value_set=vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    odd = np.flatnonzero(at < 0)
    if len(odd):
        data = np.frombuffer(words.buffers()[2], np.uint8)
        begin, end = offsets[odd], offsets[odd + 1]
        first = data[begin].astype(np.int64)
        second = data[np.minimum(begin + 1, end - 1)]
        spelled = _beginnings()[np.where(end - begin > 1, 256 * first + second, 65536 + first)]
        at[odd] = top + 16 * _endings()[data[end - 1]] + spelled
    return at


# --- the model

class Gru:
    """Weights as one flat vector with named views, so that copies can be averaged.

    Ids below ``top`` are frequent words, the ``RARE`` after them spelling classes; ``per_class`` ids in a row are an output class.
    """

    def __init__(self, words: int, top: int, per_class: int, hidden: int, flat: np.ndarray | None = None):
        self.words, self.top, self.m, self.h = words, top, per_class, hidden
        self.k = (top + RARE) // per_class
        shapes = {"e": (top + RARE, hidden), "wx": (hidden, 3 * hidden), "wh": (hidden, 3 * hidden), "b": (3 * hidden,),
                  "wc": (hidden, self.k), "bc": (self.k,), "wo": (self.k, hidden, per_class), "bo": (self.k, per_class)}
        self.size = sum(math.prod(s) for s in shapes.values())
        self.flat = np.zeros(self.size, np.float32) if flat is None else flat.astype(np.float32)
        self.p, at = {}, 0
        for name, s in shapes.items():
            self.p[name] = self.flat[at:at + math.prod(s)].reshape(s)
            at += math.prod(s)

    def begin(self, mass: np.ndarray, rare: np.ndarray) -> None:
        """Small random weights, and biases that give the shares of the counts."""
        rng = np.random.default_rng(7)
        for name in ("e", "wx", "wh"):
            w = self.p[name]
            w[...] = rng.normal(0, 0.3 if name == "e" else 1 / math.sqrt(self.h), w.shape)
        by_class = np.concatenate([mass, rare]).reshape(self.k, self.m)
        by_class = by_class / max(1.0, np.maximum(by_class, 0).max())  # so that no exponential leaves its range
        self.p["bc"][...] = np.log(np.maximum(by_class, 0).sum(1) + 1e-9)
        self.p["bo"][...] = np.log(np.maximum(by_class, 0) + 1e-9)
        self.p["bo"][by_class < 0] = -30

    def step(self, gx: np.ndarray, h: np.ndarray):
        """The next state, and what the gradient needs. Columns are streams, so that gates lie together; gx is used up."""
        n = self.h
        gh = self.p["wh"].T @ h
        zr = gx[:2 * n]
        zr += gh[:2 * n]
        np.negative(zr, out=zr)
        np.exp(np.minimum(zr, 80, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, gn, c = zr[:n], zr[n:], gh[2 * n:], gx[2 * n:]
        c += r * gn
        np.tanh(c, out=c)
        after = h - c
        after *= z
        after += c
        return after, z, r, c, gn

    def losses(self, hs: np.ndarray, ids: np.ndarray, grad: dict | None = None):
        """Log-probabilities of ids given states (rows); with ``grad``, also the gradient to the states."""
        order = np.argsort(ids.astype(np.uint16), kind="stable")  # so the members of a class are together
        hs, ids = hs[order], ids[order]
        cls, member = np.divmod(ids, self.m)
        logits = hs @ self.p["wc"]
        logits += self.p["bc"]
        np.clip(logits, -LIMIT, LIMIT, out=logits)
        rows = np.arange(len(ids))
        own = logits[rows, cls]
        np.exp(logits, out=logits)
        total = logits @ np.ones(self.k, np.float32)
        own -= np.log(total)
        dh = None
        if grad is not None:
            logits /= total[:, None]
            logits[rows, cls] -= 1
            grad["wc"] += hs.T @ logits
            grad["bc"] += np.ones(len(ids), np.float32) @ logits
            dh = logits @ self.p["wc"].T
        edges = np.searchsorted(cls, np.arange(self.k + 1))
        y = np.empty((len(ids), self.m), np.float32)
        for k in range(self.k):
            i, j = edges[k], edges[k + 1]
            if i < j:
                np.matmul(hs[i:j], self.p["wo"][k], out=y[i:j])
                y[i:j] += self.p["bo"][k]
        np.clip(y, -LIMIT, LIMIT, out=y)
        own += y[rows, member]
        np.exp(y, out=y)
        total = y @ np.ones(self.m, np.float32)
        own -= np.log(total)
        if grad is not None:
            y /= total[:, None]
            y[rows, member] -= 1
            ones = np.ones(len(ids), np.float32)
            for k in range(self.k):
                i, j = edges[k], edges[k + 1]
                if i < j:
                    grad["wo"][k] += hs[i:j].T @ y[i:j]
                    grad["bo"][k] += ones[:j - i] @ y[i:j]
                    dh[i:j] += y[i:j] @ self.p["wo"][k].T
        out = np.empty_like(own)
        out[order] = own
        if grad is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, end: int) -> tuple[np.ndarray, Gru]:
        """The state after a window of inputs x and targets y (time, stream), and the gradient of the summed losses."""
        steps, b, hid = *x.shape, self.h
        out = Gru(self.words, self.top, self.m, hid)
        grad = out.p
        table = self.p["e"] @ self.p["wx"] + self.p["b"]  # few words, so once for each and not for each token
        gx = np.ascontiguousarray(table[x].transpose(0, 2, 1))
        stays = (x != end).astype(np.float32)
        befores, hs, saved = np.empty((steps, hid, b), np.float32), np.empty((steps, hid, b), np.float32), []
        for s in range(steps):
            np.multiply(h, stays[s], out=befores[s])
            h, z, r, c, gn = self.step(gx[s], befores[s])
            hs[s] = h
            saved.append((z, r, c, gn))
        _, dhs = self.losses(hs.transpose(0, 2, 1).reshape(-1, hid), y.reshape(-1), grad)
        dhs = np.ascontiguousarray(dhs.reshape(steps, b, hid).transpose(0, 2, 1))
        dgx, dgh = np.empty((steps, 3 * hid, b), np.float32), np.empty((3 * hid, b), np.float32)
        back = np.zeros((hid, b), np.float32)
        for s in range(steps - 1, -1, -1):
            z, r, c, gn = saved[s]
            d = dhs[s]
            d += back
            dc = dgx[s, 2 * hid:]
            np.multiply(d * (1 - z), 1 - c * c, out=dc)
            np.multiply(d * (befores[s] - c), z * (1 - z), out=dgx[s, :hid])
            np.multiply(dc * gn, r * (1 - r), out=dgx[s, hid:2 * hid])
            dgh[:2 * hid] = dgx[s, :2 * hid]
            np.multiply(dc, r, out=dgh[2 * hid:])
            grad["wh"] += befores[s] @ dgh.T
            back = self.p["wh"] @ dgh
            back += d * z
            back *= stays[s]
        flat = x.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        words, first = np.unique(flat[order], return_index=True)
        own = np.add.reduceat(dgx.transpose(0, 2, 1).reshape(-1, 3 * hid)[order], first, axis=0)  # summed by input word
        grad["b"] += own.sum(0)
        grad["wx"] += self.p["e"][words].T @ own
        grad["e"][words] = own @ self.p["wx"].T
        return h, out

    def train(self, streams: np.ndarray, end: int, window: int = 16, rate: float = 8e-3) -> None:
        """Adam over windows of parallel streams of input ids; a stream's state is cleared after the end token."""
        b, n = streams.shape[0], streams.shape[1] - 1
        first, second, t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        h = np.zeros((self.h, b), np.float32)
        for at in range(0, n, window):
            till = min(n, at + window)
            h, g = self.gradient(streams[:, at:till].T, streams[:, at + 1:till + 1].T, h, end)
            step = g.flat
            step /= (till - at) * b
            norm = float(np.sqrt(step @ step))
            if norm > 1:
                step /= norm
            t += 1
            first *= 0.9
            first += 0.1 * step
            second *= 0.999
            second += 0.001 * (step * step)
            self.flat -= np.float32(rate / (1 - 0.9 ** t)) * first / (np.sqrt(second * np.float32(1 / (1 - 0.999 ** t))) + 1e-8)

    def score(self, docs: list[np.ndarray], end: int, run: int = 4096) -> np.ndarray:
        """Natural log-probability of the classes and members of each document's tokens, over whole documents.

        Documents of like length go together, ``run`` at once, so that the states held are bounded; a state goes on to its
        document's end.
        """
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        table = self.p["e"] @ self.p["wx"] + self.p["b"]
        out = np.zeros(len(docs))
        for at in range(0, len(order), run):
            out[order[at:at + run]] = self._run([docs[i] for i in order[at:at + run]], table, end, run)
        return out

    def _run(self, docs: list[np.ndarray], table: np.ndarray, end: int, run: int) -> np.ndarray:
        size = np.array([len(d) for d in docs])
        begin, flat = np.cumsum(size) - size, np.concatenate(docs)
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # documents longer than each place
        out = np.zeros(len(docs))
        h, last = np.zeros((self.h, len(docs)), np.float32), np.full(len(docs), end)
        states, targets, held = [], [], 0
        for s in range(int(size[0])):
            on = int(live[s])
            if on < len(last):
                h, last = np.ascontiguousarray(h[:, :on]), last[:on]
            h, *_ = self.step(np.ascontiguousarray(table[last].T), h)
            last = flat[begin[:on] + s]
            states.append(h.T)
            targets.append(last)
            held += on
            if held >= run or s + 1 == size[0]:
                logs, _ = self.losses(np.concatenate(states), np.concatenate(targets))
                who = np.concatenate([np.arange(len(t)) for t in targets])
                out += np.bincount(who, logs, minlength=len(docs))
                states, targets, held = [], [], 0
        return out


# --- on Spark

def word_counts(docs: DataFrame) -> DataFrame:
    """``(w, c)`` over all training documents, summed within the tasks first."""
    def run(batches):
        def counted():
            c = pa.chunked_array(held, pa.binary()).value_counts()
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            return [pa.RecordBatch.from_arrays([c.field(0), c.field(1)], schema=schema).slice(k, OUT_ROWS)
                    for k in range(0, len(c), OUT_ROWS)]

        held, n, ends = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                words, of = split(batch.column(0).slice(at, ROWS))
                held, n, ends = [*held, words], n + len(words), ends + len(of)
                if n > FLUSH:
                    yield from counted()
                    held, n = [], 0
        if n:
            yield from counted()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], schema=schema)

    schema = pa.schema([("w", pa.binary()), ("n", pa.int64())])
    train = docs.where(~is_held_out(F.col("doc_id"))).select(F.col("text").cast("binary"))
    return train.mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame, top: int) -> list[tuple[bytes, int]]:
    """The most frequent words, the end first; as many at most as ``top`` says, which bounds what the driver gets."""
    rows = counts.orderBy(F.desc("c"), "w").limit(top).collect()
    found = {bytes(r["w"]): r["c"] for r in rows}
    end = found.pop(END, None)
    if end is None:
        end = counts.where(F.col("w") == END).first()["c"]
    return [(END, end), *list(found.items())[:top - 1]]


def dealt(text: DataFrame, copies: int) -> DataFrame:
    """The documents by a hash of their staged place, so that equal texts are spread over the copies, each time alike."""
    return text.repartition(copies, F.xxhash64("at"))


def trained(docs: DataFrame, vocab: list[tuple[bytes, int]], rare_mass: np.ndarray, top: int, per_class: int, hidden: int,
            one_in: int, rounds: int, share: int, streams: int = 256) -> np.ndarray:
    """The weights after all rounds. share: tokens a copy is trained on, about."""
    model = Gru(len(vocab), top, per_class, hidden)
    model.begin(np.array([c for _, c in vocab] + [-1.0] * (top - len(vocab)), float), rare_mass)

    known = [w for w, _ in vocab]

    def rows(batches):
        place, words_of = TaskContext.get().partitionId() << 40, pa.array(known, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                words, n = split(batch.column(0).slice(at, ROWS))
                ends = np.cumsum(n)
                ids = np.split(np.insert(units(words, words_of, top), ends, 0).astype(np.uint16), ends + np.arange(1, len(n) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(place, place + len(n))), pa.array(n + 1),
                     pa.array([x.tobytes() for x in ids[:len(n)]], pa.binary())], names=["at", "n", "ids"])
                place += len(n)

    chosen = docs.where(~is_held_out(F.col("doc_id")) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0))
    text = stage(chosen.select(F.col("text").cast("binary")).mapInArrow(rows, "at bigint, n bigint, ids binary"), "train")
    total = text.agg(F.sum("n")).first()[0] or 0
    if not total:
        return model.flat
    copies = max(1, round(total / share))
    text = stage(dealt(text, copies), "copies")
    spark = docs.sparkSession
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(model.flat)

        def learn(batches, held=held, turn=turn):
            ids = [np.frombuffer(x, np.uint16).astype(np.int64) for b in batches for x in b.column(0).to_pylist()]
            if not ids:
                return
            rng = np.random.default_rng(turn)
            line = np.concatenate([[0], *(ids[i] for i in rng.permutation(len(ids)))])
            wide = min(streams, max(1, len(line) // 40))
            line = line[:len(line) // wide * wide].reshape(wide, -1)
            own = Gru(len(vocab), top, per_class, hidden, held.value.copy())
            if line.shape[1] > 1:
                own.train(line, 0)
            for at in range(0, own.size, 100_000):
                part = own.flat[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part.astype(np.float64) * line.size),
                                                  pa.array(np.full(len(part), line.size))], names=["i", "v", "n"])

        rows_ = (text.select("ids").mapInArrow(learn, "i bigint, v double, n bigint").groupBy("i")
                 .agg((F.sum("v") / F.sum("n")).alias("v")).collect())  # as many as the model has weights
        for r in rows_:
            model.flat[r["i"]] = r["v"]
    return model.flat


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _blocks(of, size: int):
    """(block, doc_id, out, text) with blocks of about ``size`` bytes of a partition's documents in their order."""
    part, block, held = TaskContext.get().partitionId() << 32, 0, 0
    for doc_id, out, text in of:
        if held and held + len(text or b"") > size:
            block, held = block + 1, 0
        held += len(text or b"") + 16  # empty texts take room as well
        yield part + block, doc_id, out, text


def scores(docs: DataFrame, top: int = 1024, per_class: int = 32, hidden: int = 24, one_in: int = 1, rounds: int = 1,
           share: int = 800_000, block: int = 12_000_000) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stage(word_counts(docs), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    vocab = vocabulary(counts, top) if n else [(END, 0)]
    index = {w: k for k, (w, _) in enumerate(vocab)}

    def by_class(of):
        mass, kinds = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for w, c in of:
            if w not in index:
                mass[rare_class(w)] += c
                kinds[rare_class(w)] += 1
        for k in range(RARE):
            yield k, int(mass[k]), int(kinds[k])

    rare = {r["k"]: (r["n"], r["v"]) for r in mapped(
        counts, by_class, pa.schema([("k", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]), "k int, n bigint, v bigint")
        .groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    mass = np.array([rare.get(k, (0, 0))[0] for k in range(RARE)], float)
    kinds = np.array([rare.get(k, (0, 0))[1] for k in range(RARE)], float)
    flat = trained(docs, vocab, mass, top, per_class, hidden, one_in, rounds, share) if n else None
    weights = docs.sparkSession.sparkContext.broadcast(flat)  # a fixed number of weights

    src = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("out"), F.col("text").cast("binary").alias("text"))

    def words(batches):
        for now, rows in groupby(_blocks(tuples(batches), block), key=lambda x: x[0]):
            some = split(pa.array([text for *_, text in rows], pa.binary()))[0].unique()
            for at in range(0, len(some), OUT_ROWS):
                part = some.slice(at, OUT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now)), part], schema=asked_for)

    asked_for = pa.schema([("block", pa.int64()), ("w", pa.binary())])
    asked = src.mapInArrow(words, "block bigint, w binary")
    known = asked.join(counts, "w").select("block", "w", "c")
    texts = mapped(src, lambda of: _blocks(of, block),
                   pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("out", pa.bool_()), ("text", pa.binary())]),
                   "block bigint, doc_id bigint, out boolean, text binary", 500)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = (left.column(c).to_pylist() for c in ("doc_id", "out"))
        flat, sizes = split(_whole(left.column("text")))
        coded = flat.dictionary_encode()
        every, ends = coded.dictionary, np.cumsum(sizes)
        at = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(every))  # an end has the last number
        begins = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])[:-1]
        docs_ = np.split(at, begins[1:])
        found = pc.index_in(every, value_set=_whole(right.column("w"))).fill_null(-1).to_numpy(zero_copy_only=False)
        c = np.zeros(len(every) + 1)
        c[:-1][found >= 0] = _whole(right.column("c")).to_numpy(zero_copy_only=False)[found[found >= 0]]
        c[-1] = vocab[0][1]
        unit = np.append(units(every, pa.array([w for w, _ in vocab], pa.binary()), top), 0)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        cls = np.maximum(unit - top, 0)
        own = np.where(unit >= top, np.log10((c + 0.5) / (mass[cls] + 0.5 * (kinds[cls] + 1))), 0.0)
        unseen = np.add.reduceat(c[at] == 0, begins, dtype=np.int64)
        if any(not x and k for x, k in zip(out, unseen)):
            raise RuntimeError("a training document has a word without a count: the input isn't the same each time")
        model = Gru(len(vocab), top, per_class, hidden, weights.value) if n else None
        got = model.score([unit[d] for d in docs_], 0) / math.log(10) if n else np.zeros(len(docs_))
        rare_part = np.add.reduceat(own[at], begins) if n else 0.0
        return pa.table([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(sizes + 1, pa.int64()),
                         pa.array(sizes + 1 - unseen, pa.int64()),
                         pa.array([n] * len(docs_), pa.int64()), pa.array(np.add.reduceat(base[at], begins)),
                         pa.array((got + rare_part).tolist(), pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double")
