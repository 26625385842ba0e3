"""Finding identifiers in a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import vocab
from ..functions.classify import long_enough
from ..functions.rules import ALL_RULES, Rule


def with_candidates(df: DataFrame, text: str = "text", rules: Sequence[Rule] = ALL_RULES,
                    into: str = "candidates") -> DataFrame:
    """Add every span the rules find, overlaps included. Map-only."""
    return df.withColumn(into, sp.detect(text, rules))


def with_spans(df: DataFrame, text: str = "text", rules: Sequence[Rule] = ALL_RULES,
               into: str = "spans") -> DataFrame:
    """Add the resolved, disjoint spans in text order. Map-only."""
    return with_candidates(df, text, rules, into).withColumn(into, sp.resolve(F.col(into)))


def explode_spans(df: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """One row per span, with its place in the array as ``seq``.

    ``explode_outer`` and a filter above it: with a plain ``explode`` the optimizer would derive a
    filter on the array, push it below, and so run the detection twice.
    """
    rows = df.select(*keys, F.posexplode_outer(spans).alias("seq", "span"))
    return rows.filter(F.col("span").isNotNull()).select(*keys, "seq", "span.*")


def where_computed(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """``df.filter(condition).select(columns)`` for a condition on costly computed columns.

    A plain filter would be pushed below the projection that computes them, together with a copy of
    it; the output of a generator cannot be pushed.
    """
    row = F.when(condition, F.array(F.struct(*columns)))
    return df.select(F.explode_outer(row).alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def detections(df: DataFrame, keys: Sequence[str], text: str = "text",
               rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Long form of single detectors: one row per match, overlaps included."""
    return explode_spans(with_candidates(df, text, rules).select(*keys, "candidates"), keys,
                         "candidates")


def drop_short(spans: Column) -> Column:
    """Apply the minimum lengths for names and record numbers."""
    return F.filter(spans, lambda s: long_enough(s["type"], s["original"]))


def external_spans(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans from another detector, one array per text; medical types are dropped.

    Expects ``(key, type, begin, end, original, score)``. They stand before our own rules on ties.
    """
    kept = entities.filter(~F.col("type").isin(vocab.MEDICAL_ENTITY_TYPES))
    span = F.struct(
        F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "type",
        "original", F.col("score").cast("double").alias("score"), F.lit(0).alias("ord"),
        (F.col("end") - F.col("begin")).cast("int").alias("weight"))
    return kept.groupBy(key).agg(F.collect_list(span).alias("external"))


def with_spans_and_external(df: DataFrame, entities: DataFrame, key: str = "doc_id",
                            text: str = "text", rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Resolve our spans together with those of another detector. One join on the text's key."""
    found = with_candidates(df, text, rules)
    joined = found.join(external_spans(entities, key), key, "left")
    both = F.concat(F.coalesce("external", sp.no_spans()), "candidates")
    return joined.withColumn("spans", sp.resolve(both)).drop("external", "candidates")


def overlap_pairs(df: DataFrame, keys: Sequence[str], candidates: str = "candidates") -> DataFrame:
    """Pairs of overlapping candidates of one text; found within the row, without a self-join."""
    pairs = df.select(*keys, F.explode_outer(sp.overlapping(F.col(candidates))).alias("pair"))
    return pairs.filter(F.col("pair").isNotNull()).select(
        *keys, F.col("pair.left.type").alias("left_type"), F.col("pair.left.begin").alias("left_begin"),
        F.col("pair.left.end").alias("left_end"), F.col("pair.right.type").alias("right_type"),
        F.col("pair.right.begin").alias("right_begin"), F.col("pair.right.end").alias("right_end"))


def entities_by_type(df: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """The values found in each text, grouped by type. Grouped within the row, without a shuffle."""
    of_type = F.transform(
        F.array_distinct(F.transform(spans, lambda s: s["type"])),
        lambda t: F.struct(t.alias("type"), F.transform(
            F.filter(spans, lambda s: s["type"] == t), lambda s: s["original"]).alias("originals")))
    rows = df.select(*keys, F.explode_outer(of_type).alias("g"))
    return rows.filter(F.col("g").isNotNull()).select(*keys, "g.type", "g.originals")
