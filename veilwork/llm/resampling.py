"""Importance resampling towards a target distribution: bucket gains, perturbed weights, the highest scores drawn.

Features are runs of one to ``most`` words, hashed to buckets. All documents and all target texts are counted by bucket;
a bucket's gain is the log ratio of its smoothed shares. A document's weight is the floored mean of the gains over its
features, taken by array look-ups, and its score adds noise that depends on its doc_id alone, so drawing the highest scores
draws without replacement in proportion to the weights.

The cutoff is found without sorting all scores: a quantile sketch gives a bracket around it, exact counts of what lies
above and within show whether the cutoff is inside, else the bracket is widened, and only the bracket is sorted. The drawn
rows are then numbered by a range partition.

Defined cases: a null or empty text has no features, weight 0, and isn't drawn. A null doc_id gets the noise of '' and
comes after all others in ties. Repeated rows are documents of their own; of equal rows at the cutoff so many are drawn as
fit. Without documents nothing is drawn; without target texts all target counts are 0. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from veilwork.llm.byte_words import letters_table, word_pieces
from veilwork.llm.common import mapped, stage

TABLE = letters_table(digits=True)
#: The sketch's ranks are off by at most a share of 1 / ACCURACY; brackets reach from STEPS[k] below the cutoff to above it.
ACCURACY = 10_000
STEPS = (2 / ACCURACY, 20 / ACCURACY, 200 / ACCURACY)


def buckets_of(text: bytes, most: int, buckets: int):
    """``(words, bucket ids)`` of a text's pieces; a run of words over two pieces counts with the second."""
    crc, tail = zlib.crc32, []
    for words in word_pieces(text, TABLE):
        ids = [crc(w) % buckets for w in words]
        if most > 1:
            joined = tail + words
            for k in range(2, most + 1):
                first = max(0, len(tail) - k + 1)
                ids += [crc(b" ".join(joined[i:i + k])) % buckets for i in range(first, len(joined) - k + 1)]
            tail = joined[1 - most:]
        yield len(words), np.array(ids, np.int64)


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features by bucket over all rows; each task gives a row for each of its buckets."""
    def rows(of):
        n = np.zeros(buckets, np.int64)
        for (text,) in of:
            for _, ids in buckets_of(text, most, buckets):
                n += np.bincount(ids, minlength=buckets)
        at = np.flatnonzero(n)
        yield from zip(at.tolist(), n[at].tolist())

    src = texts.where("text is not null").select(F.col("text").cast("string").cast("binary"))
    found = mapped(src, rows, pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), "bucket int, n bigint").groupBy(
        "bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold log ratio of each bucket's smoothed shares."""
    k = len(raw)
    S, T = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (S + k)) / ((s + 1) * (T + k))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` per row."""
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))

    def rows(of):
        for doc_id, text in of:
            n_words = n = total = 0
            for w, ids in buckets_of(text or b"", most, buckets):
                n_words += w
                n += len(ids)
                total += int(gain[ids].sum())
            weight = total // n if n else 0
            yield doc_id, n_words, n, weight, weight + noise(seed, doc_id)

    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    src = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary"))
    return mapped(src, rows, pa.schema([(c, pa.int64()) for c in names]), ", ".join(f"{c} bigint" for c in names))


# --- the cutoff and the ranks

#: Higher scores first, then smaller doc_ids (null last), then the row.
PLACE = "struct(-score as s, doc_id is null as d, doc_id, row)"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` in order of its place, with ``rank`` from 1: range partitions count themselves, then add those before."""
    ranged = df.withColumn("place", F.expr(PLACE)).repartitionByRange("place").sortWithinPartitions("place")
    inner = stage(ranged.drop("place").withColumn("at", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("at", 33), F.expr(f"at & {(1 << 33) - 1}")
    before, starts = 0, []
    for r in inner.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each range partition
        starts.append((r["part"], before))
        before += r["count"]
    start = df.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    return inner.withColumn("part", part).join(F.broadcast(start), "part").select(
        *df.columns, (F.col("start") + within + 1).alias("rank"))


def bracket(able: DataFrame, n: int, k: int, steps=STEPS) -> tuple[int, int, int]:
    """Scores ``low`` and ``high``, and how many rows lie above: the k-th highest score is exactly known to be within."""
    share = 1 - k / n
    spots = [min(1.0, max(0.0, share + s * way)) for s in steps for way in (-1, 1)]
    row = able.agg(F.percentile_approx("score", spots, ACCURACY).alias("q"), F.min("score").alias("lo"),
                   F.max("score").alias("hi")).first()
    for low, high in [*zip(row["q"][::2], row["q"][1::2]), (row["lo"], row["hi"])]:
        c = able.agg(F.count_if(F.col("score") > high).alias("above"),
                     F.count_if(F.col("score").between(low, high)).alias("within")).first()
        if c["above"] < k <= c["above"] + c["within"]:
            return low, high, c["above"]
    raise AssertionError("the whole range holds every rank")


def cutoff(able: DataFrame, k: int, n: int) -> Row:
    """The row that is k-th in order; only the bracket is sorted."""
    low, high, above = bracket(able, n, k)
    inside = able.where(F.col("score").between(low, high))
    return numbered(inside, "bracket").where(F.col("rank") == k - above).first()


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, **options) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` per row; rank is null where a document isn't drawn.

    Of the N documents with at least ``min_words`` words, the floor(percent N / 100) highest scores are drawn.
    """
    rows = stage(scores(docs, target, **options).withColumn("row", F.monotonically_increasing_id()), "scores")
    out = ["doc_id", "n_features", "weight", "score"]
    able = rows.where(F.col("n_words") >= min_words)
    n = able.count()
    k = percent * n // 100
    if not k:
        return rows.select(*out, F.lit(None).cast("bigint").alias("rank"))
    last = cutoff(able, k, n)
    doc = "null" if last["doc_id"] is None else last["doc_id"]
    end = (f"struct({-last['score']}L as s, {doc} is null as d, cast({doc} as bigint) as doc_id, {last['row']}L as row)")
    drawn = F.expr(f"n_words >= {min_words} and {PLACE} <= {end}")
    ranks = numbered(rows.where(drawn), "drawn")
    return ranks.select(*out, "rank").unionByName(
        rows.where(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")))
