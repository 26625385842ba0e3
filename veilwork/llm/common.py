"""Helpers shared by the operators: batches, staging, fixed-size bitmaps, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words and is trimmed from lines.
SPACE = b" \t\n\x0b\x0c\r"
#: Rows gathered before a batch is handed back to Spark.
OUT_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; only a local session may lack it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def tuples(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches, a few hundred in Python at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns))


def mapped(df: DataFrame, rows, schema: pa.Schema, ddl: str, size: int = OUT_ROWS) -> DataFrame:
    """``rows`` maps an iterator of tuples of a partition to an iterator of tuples."""
    def run(batches):
        return pieces(rows(tuples(batches)), schema, size)
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, ddl)


def bitmap(df: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A bitmap of 2**bits bits, set where a value of the 64-bit ``column`` falls.

    Its size is fixed (8 MB at 26 bits) and doesn't grow with the data. It is put together on the
    executors in stripes, so the driver gets at most 2**(bits - 16) rows of 8 KB.
    """
    stripe = 16
    spots = df.select(F.expr(f"shiftrightunsigned({column}, {64 - bits})").alias("p")).distinct()

    def packed(key, pdf):
        import pandas as pd
        out = np.zeros(1 << (stripe - 3), np.uint8)
        at = pdf["p"].to_numpy() & ((1 << stripe) - 1)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"s": [int(key[0])], "b": [out.tobytes()]})

    rows = (spots.withColumn("s", F.expr(f"shiftright(p, {stripe})"))
            .groupBy("s").applyInPandas(packed, "s long, b binary").collect())
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        whole[r["s"] << (stripe - 3):(r["s"] + 1) << (stripe - 3)] = np.frombuffer(r["b"], np.uint8)
    return whole


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values fall on a set bit; a few that were never put in may, too."""
    at = values.view(np.uint64) >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``(node, root)`` for each node of the edges; root is the least node of its component.

    Alternating large-star and small-star steps: each step is two aggregations by node and the edges
    stay about as many as they were. Every step is written to the shared folder. A node with many
    neighbours only ever passes through aggregations (pre-aggregated before the shuffle) and a join.
    """
    e = stage(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct(), name)
    sums = None
    while True:
        both = e.unionAll(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        # large star: neighbours greater than the node go to the least of its neighbourhood
        big = both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        big = stage(big.distinct(), name)
        # small star: the smaller neighbours and the node itself go to the least
        low = big.groupBy("x").agg(F.min("y").alias("m"))
        small = (big.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
                 .unionAll(low.select("x", F.col("m").alias("y"))))
        after = stage(small.distinct(), name)
        before, sums = sums, _sums(after)
        if before == sums:
            return after.unionAll(after.select(F.col("y").alias("x"), F.col("y"))).distinct().select(
                F.col("x").alias("node"), F.col("y").alias("root"))
        e = after


def _sums(edges: DataFrame):
    """Number and sum of hashes: equal for equal sets of edges."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).first()
