"""Quality by naive Bayes support vectors: n-gram indicators times class log-count ratios, and a linear hinge-loss model.

A text's n-grams are those of one to four bytes, by hash, and those of one to three words seen by their recurrence: each
word stands for how far back it last occurred. Whether an n-gram occurs is all that counts. Each indicator is multiplied by
its log-count ratio, r = log(p / q) of the smoothed shares of both classes, a row is brought to length one, and dual
coordinate descent fits the hinge loss; the weights are then drawn towards their mean size, as naive Bayes has them. A
logistic curve through the margins of rows that a model was not fitted on turns margins into scores.

The model is fitted on at most ``fit_rows`` labelled documents (by hash of doc_id), a documented bound. A row of the fit is
a bitmap of 2^BITS bins, so what the fitting task holds is bounded by fit_rows times 16 KB, whatever the texts' lengths.
Scoring covers every text in whole.

Defined cases: null and empty texts have no n-grams and are scored by the bias alone. Without rows of both classes all
scores are 0.5. Several labels of a document count by their least; null labels and null doc_ids are no labels. A null
doc_id is scored and not held out. Repeated rows each get a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import mapped, stage

BITS = 17
BYTE_BITS = BITS - 1
ORDERS = 4
#: How far back a word last occurred: never, the word before, up to these distances, further.
BACK = (1, 4, 16, 64)
KINDS = len(BACK) + 2
#: Texts are taken in pieces of so many bytes; n-grams over two pieces are seen in both, as pieces overlap.
PIECE = 1 << 20


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


# --- indicators

def _byte_bins(text: bytes, mark: np.ndarray) -> None:
    for at in range(0, len(text), PIECE):
        b = np.frombuffer(text, np.uint8, min(len(text), at + PIECE + ORDERS - 1) - at, at).astype(np.uint32)
        gram = b
        for k in range(1, ORDERS + 1):
            if k > 1:
                gram = (gram[:-1] << np.uint32(8)) | b[k - 1:]
            mixed = (gram ^ np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mark[(mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - BYTE_BITS)] = True


def _recurrence(text: bytes) -> np.ndarray:
    """Each word's kind: 0 if new, else by the distance to its last place."""
    last: dict[bytes, int] = {}
    get, back = last.get, []
    for at, w in enumerate(text.split()):
        back.append(at - get(w, at))
        last[w] = at
    d = np.array(back, np.int64)
    return np.where(d == 0, 0, 1 + np.searchsorted(BACK, d))


def _word_bins(text: bytes, mark: np.ndarray) -> None:
    at = 0
    while at < len(text):  # pieces end at a blank; recurrence starts anew with each
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        gram = kinds = _recurrence(text[at:end])
        first = 1 << BYTE_BITS
        for k in range(1, 4):
            if k > 1:
                gram = gram[:-1] * KINDS + kinds[k - 1:]
            mark[first + gram] = True
            first += KINDS ** k
        at = end


def indicators(text: bytes | None) -> np.ndarray:
    """The bins of the n-grams that occur in a text, in order."""
    mark = np.zeros(1 << BITS, bool)
    if text:
        _byte_bins(text, mark)
        _word_bins(text, mark)
    return np.flatnonzero(mark)


# --- the model

def log_ratios(rows: list[np.ndarray], good: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed shares of each bin, over the documents that hold it."""
    n = np.full((2, 1 << BITS), alpha)
    for bins, y in zip(rows, good):
        n[int(y), bins] += 1
    share = n / n.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float, epochs: int,
                 seed: int = 0) -> np.ndarray:
    """The hinge loss's weights per bin, and the bias last, by dual coordinate descent over rows in random order.

    A row is its bins' ratios divided by their length, with 1 for the bias. Each dual variable is moved to the optimum that
    it has with the others as they are, between 0 and the cost.
    """
    size = [1 / math.sqrt(max(float((ratio[b] ** 2).sum()), 1e-12)) for b in rows]
    norm = np.array([1 + (len(b) > 0) for b in rows], float)
    w, dual, rng = np.zeros(len(ratio) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    y = np.where(good, 1.0, -1.0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            bins = rows[i]
            x = ratio[bins] * size[i]
            slope = y[i] * (float(w[bins] @ x) + w[-1]) - 1
            to = min(max(dual[i] - slope / norm[i], 0.0), cost)
            step = (to - dual[i]) * y[i]
            if step:
                most = max(most, abs(step))
                dual[i] = to
                w[bins] += step * x
                w[-1] += step
        if most < 1e-3 * cost:
            break
    return w


def drawn(w: np.ndarray, beta: float) -> np.ndarray:
    """Weights between naive Bayes (all of the mean size) and the descent's own."""
    out = w.copy()
    used = w[:-1] != 0
    if used.any():
        out[:-1][used] = (1 - beta) * np.abs(w[:-1][used]).mean() + beta * w[:-1][used]
    return out


def margin(bins: np.ndarray, scaled: np.ndarray, ratio: np.ndarray) -> float:
    """``scaled`` holds the bins' weights times their ratios, and the bias last."""
    if not len(bins):
        return float(scaled[-1])
    return float(scaled[bins].sum() / math.sqrt(max(float((ratio[bins] ** 2).sum()), 1e-12)) + scaled[-1])


def curve(margins: np.ndarray, good: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with smoothed targets."""
    n1, n0 = int(good.sum()), int((~good).sum())
    y = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        bend = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, x.T @ (p - y)), -2, 2)
    return float(w[0]), float(w[1])


class Model:
    def __init__(self, ratio: np.ndarray, scaled: np.ndarray, slope: float, offset: float):
        self.ratio, self.scaled, self.slope, self.offset = ratio, scaled, slope, offset

    def score(self, text: bytes | None) -> float:
        m = self.slope * margin(indicators(text), self.scaled, self.ratio) + self.offset
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, m))))


def train(rows: list[np.ndarray], good: np.ndarray, cost: float = 10.0, beta: float = 0.75, epochs: int = 30,
          folds: int = 3) -> Model | None:
    """None unless both classes are there. Rows are dealt to folds by their order, for margins on rows left out."""
    if good.all() or not good.any():
        return None

    def fitted(pick):
        own, y = [r for r, p in zip(rows, pick) if p], good[pick]
        ratio = log_ratios(own, y)
        w = drawn(dual_descent(own, y, ratio, cost, epochs), beta)
        return ratio, np.append(w[:-1] * ratio, w[-1])

    margins, seen = np.zeros(len(rows)), np.zeros(len(rows), bool)
    fold = np.zeros(len(rows), int)
    for y in (False, True):  # both classes go round the folds
        at = np.flatnonzero(good == y)
        fold[at] = np.arange(len(at)) % folds
    for f in range(folds):
        out = fold == f
        if out.any() and good[~out].any() and not good[~out].all():
            ratio, scaled = fitted(~out)
            for i in np.flatnonzero(out):
                margins[i] = margin(rows[i], scaled, ratio)
            seen |= out
    ratio, scaled = fitted(np.ones(len(rows), bool))
    if not seen.all():
        margins = np.array([margin(r, scaled, ratio) for r in rows])
    return Model(ratio.astype(np.float32), scaled.astype(np.float32), *curve(margins, good))


# --- on Spark

def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000) -> Model | None:
    """The model of at most ``fit_rows`` labelled documents; None if one class is missing."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("good"))
             .where("id is not null and good is not null"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("good").alias("good"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # so its size is bounded
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))

    def bitmaps(of):
        for id_, good, text in of:
            mark = np.zeros(1 << BITS, np.uint8)
            mark[indicators(text)] = 1
            yield id_, good, np.packbits(mark).tobytes()

    schema = pa.schema([("id", pa.int64()), ("good", pa.int32()), ("bits", pa.binary())])
    rows = mapped(texts.join(F.broadcast(some), "id").select("id", "good", "text"), bitmaps, schema,
                  "id bigint, good int, bits binary", 64)
    # rows of one doc_id may be many: one of them stands for it
    rows = stage(rows.groupBy("id").agg(F.min("good").alias("good"), F.min("bits").alias("bits")), "fit")

    def fitting(of):
        held = sorted((i, y, np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))).astype(np.int32)) for i, y, b in of)
        model = train([b for _, _, b in held], np.array([y > 0 for _, y, _ in held], bool)) if held else None
        if model:
            yield model.ratio.tobytes(), model.scaled.tobytes(), model.slope, model.offset

    out = mapped(rows.coalesce(1), fitting, pa.schema([("ratio", pa.binary()), ("scaled", pa.binary()), ("slope", pa.float64()),
                                                       ("offset", pa.float64())]),
                 "ratio binary, scaled binary, slope double, offset double").collect()
    if not out:
        return None
    r = out[0]
    return Model(np.frombuffer(r["ratio"], np.float32), np.frombuffer(r["scaled"], np.float32), r["slope"], r["offset"])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000, limit: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; a map over the texts once the model is fitted."""
    model = fit(docs, labels, fit_rows)

    def rows(of):
        for doc_id, out, text in of:
            p = model.score(text) if model else 0.5
            yield doc_id, out, p, int(p >= limit)

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return mapped(src.select("doc_id", held_out(F.col("doc_id")), "text"), rows,
                  pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                             ("predicted", pa.int32())]),
                  "doc_id bigint, held_out boolean, score double, predicted int")
