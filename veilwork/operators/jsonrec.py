"""JSON records: anonymise every string value, keep the structure, restore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as jt
from ..functions import spans as sp
from ..functions.rules import ALL_RULES, Rule
from ..functions.spans import let, running_sum
from ..functions.splice import by_place, splice
from ..session import stage
from . import restore
from .anonymize import apply_overrides, overrides, with_fakes, with_out_offsets, with_uuid
from .detect import where_computed


PLACED = "array<struct<begin:int,end:int,out_begin:int,out_end:int,type:string,original:string,fake:string>>"


def with_leaf_spans(df: DataFrame, record: str, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Add ``leaves`` (pieces of the JSON text), ``spans`` in the order of the leaves, and how many each leaf has (``counts``)."""
    return with_spans_of_leaves(df.withColumn("leaves", jt.leaves(F.col(record))), rules)


def with_spans_of_leaves(out: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    found = F.expr(f"transform(leaves, leaf -> {sp.detect_sql('leaf.value', tuple(rules))})")
    out = out.withColumn("found", found)
    out = out.withColumn("found", F.transform("found", lambda f: sp.resolve(F.coalesce(f, sp.no_spans()))))
    return (out.withColumn("spans", F.flatten("found"))
            .withColumn("counts", F.transform("found", lambda f: F.size(f))).drop("found"))


def anonymize_json(df: DataFrame, secret: str, record: str = "record",
                   rules: Sequence[Rule] = ALL_RULES, registry: DataFrame | None = None,
                   mappings: DataFrame | None = None) -> DataFrame:
    """Anonymise a JSON text column of ``(doc_id, identity, identity_type, record)``.

    Adds ``uuid``, ``entities``, ``anonymized``, ``status`` (500 for text that is not JSON) and
    ``entities_detected`` (distinct type and value pairs). Works for any schema; map-only unless a
    registry or mappings are given.
    """
    out = with_uuid(df, secret, registry).withColumn(
        "status", F.when(jt.is_valid(F.col(record)) & F.col("uuid").isNotNull(), 200).otherwise(500))
    good = F.when(F.col("status") == 200, F.col(record))
    out = with_leaf_spans(out.withColumn("_record", good), "_record", rules)
    out = with_fakes(out, secret)
    if mappings is not None:
        out = apply_overrides(stage(out.withColumn("_row", F.monotonically_increasing_id()), "json-spans"),
                              overrides(mappings, secret), "_row").drop("_row")
    out = with_new_leaves(out)
    return (out.withColumn("anonymized", jt.assemble(F.col("leaves")))
            .withColumn("entities_detected", F.coalesce(F.size(distinct_values("entities")), F.lit(0)))
            .drop("spans", "counts", "_record"))


def distinct_values(entities: str) -> Column:
    """The type and value pairs of a record, each once."""
    return F.array_distinct(F.transform(entities, lambda e: F.struct(
        e["type"].alias("type"), e["original"].alias("original"))))


def with_new_leaves(df: DataFrame) -> DataFrame:
    """``leaves`` with their ``entities`` and new value (``changed``), from ``entities`` and ``counts``."""
    # the entities stand in the order of their leaves, so each leaf's own are those from the end of the one before
    mine = let(F.col("entities"), lambda es: let(running_sum(F.col("counts")), lambda ends: F.transform("leaves", lambda p, i: F.struct(
        p["raw"].alias("raw"), p["value"].alias("value"), F.when(F.get("counts", i) > 0, with_out_offsets(F.transform(
            F.sequence(F.get(ends, i) - F.get("counts", i), F.get(ends, i) - 1), lambda j: F.get(es, j)))).otherwise(
            F.array().cast(PLACED)).alias("entities")))))
    return df.withColumn("leaves", mine).withColumn("leaves", F.transform("leaves", lambda p: F.struct(
        p["raw"].alias("raw"), p["entities"].alias("entities"),
        F.when(F.size(p["entities"]) > 0, splice(p["value"], p["entities"])).alias("changed"))))


def put_back_leaves(leaves: Column) -> Column:
    """Leaves with places (``mine``) as leaves with a new value where something is put back."""
    return F.transform(leaves, lambda p: F.struct(p["raw"].alias("raw"), F.when(p["mine"].isNotNull(), let(
        restore.put_back(p["value"], p["mine"]), lambda new: F.when(new != p["value"], new))).alias("changed")))


def ambiguous_in(hits: str) -> Column:
    return F.coalesce(F.aggregate(hits, F.lit(0), lambda n, h: n + restore.counted(h["places"], True)), F.lit(0))


def ledger_rows(anonymized: DataFrame) -> DataFrame:
    """One row per replaced span with its leaf number and its places in the leaf."""
    leaf = anonymized.select("doc_id", F.xxhash64("anonymized").alias("text_hash"), "uuid",
                             F.posexplode_outer("leaves").alias("leaf", "p"))
    span = leaf.select("doc_id", "text_hash", "leaf", "uuid", F.explode_outer("p.entities").alias("e"))
    return span.filter(F.col("e").isNotNull()).select(
        "doc_id", "text_hash", "leaf", "uuid", F.col("e.type").alias("pii_type"), "e.begin", "e.end",
        "e.out_begin", "e.out_end", "e.original", "e.fake")


def legacy_identities(mappings: DataFrame) -> DataFrame:
    return mappings.filter(F.col("pii_type") == "JSON_STRUCTURE").select("uuid").distinct() \
        .withColumn("legacy", F.lit(True))


def legacy_guard(df: DataFrame, mappings: DataFrame) -> DataFrame:
    """Status 400 for identities whose records were stored in the old, structure-changing form."""
    return df.join(legacy_identities(mappings), "uuid", "left").withColumn(
        "status", F.when(F.col("legacy"), 400).otherwise(200)).drop("legacy")


def with_leaf_hits(df: DataFrame, hits: Column, record: str) -> DataFrame:
    """Add ``leaves``, each piece with the places found in it (``mine``), from rows of a leaf number and places."""
    out = df.withColumn("leaves", jt.leaves(F.col(record))).withColumn("_at", by_place(hits, "leaf"))
    return out.withColumn("leaves", F.transform("leaves", lambda p, i: F.struct(
        p["raw"].alias("raw"), p["value"].alias("value"), F.get("_at", i)["places"].alias("mine")))).drop("_at")


def restore_json(df: DataFrame, mappings: DataFrame, record: str = "anonymized",
                 key: str = "doc_id", whole_values: bool = False) -> DataFrame:
    """Restore the string values of ``(key, uuid, record)``; counts the values that changed.

    Replacements are found inside values; with ``whole_values`` a value must equal one. Text that is not JSON gets
    status 500. Replacements that stand for several originals stay and are counted as ambiguous. Rows may share a key.
    """
    out = legacy_guard(df, mappings).withColumn("status", F.when(
        (F.col("status") == 200) & ~F.coalesce(jt.is_valid(F.col(record)), F.lit(False)), 500).otherwise(F.col("status")))
    out = out.withColumn("_hash", F.xxhash64(record))
    good = F.when(F.col("status") == 200, jt.leaves(F.col(record)))

    def values(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(key, "_hash", "uuid", *more, F.posexplode_outer(good).alias("leaf", "p")).select(
            key, "_hash", "uuid", *more, "leaf", F.col("p.value").alias("value")).filter(F.col("value").isNotNull())

    if whole_values:
        hits = restore.found_in_leaves(values(out), mappings, [key, "_hash"], F.lit(True), shapes=False)
    else:
        hits = restore.found_in_leaves(values(out), mappings, [key, "_hash"], coded=values(
            out.join(restore.codes_of(mappings), "uuid"), "_codes"))
    out = restore.joined_back(out, hits, [key, "_hash", "uuid"])
    out = with_leaf_hits(out, F.col("hits"), record)

    return (out.withColumn("leaves", put_back_leaves(F.col("leaves")))
            .withColumn("restored", F.when(F.col("status") == 200, jt.assemble(F.col("leaves"))))
            .withColumn("entities_restored", F.size(F.filter("leaves", lambda p: p["changed"].isNotNull())))
            .withColumn("ambiguous", ambiguous_in("hits")).drop("leaves", "hits", "_hash"))


def restore_json_by_ledger(df: DataFrame, ledger: DataFrame, record: str = "anonymized",
                           key: str = "doc_id") -> DataFrame:
    """Restore a record exactly, by leaf and place; adds ``restored`` and ``unclear``, as for texts."""
    rows = restore.ledger_places(ledger, key, "leaf", "out_begin", "out_end")
    out = restore.joined_back(df.withColumn("text_hash", F.xxhash64(record)), rows, [key, "text_hash"])
    out = out.withColumn("unclear", F.coalesce("unclear", F.lit(False)))
    out = with_leaf_hits(out, restore.places_by_leaf(F.when(~F.col("unclear"), F.col("places"))), record)
    out = out.withColumn("leaves", F.transform("leaves", lambda p: F.struct(
        p["raw"].alias("raw"), F.when(F.size(p["mine"]) > 0, splice(
            p["value"], p["mine"], "out_begin", "out_end", "original")).alias("changed"))))
    return out.withColumn("restored", jt.assemble(F.col("leaves"))).drop("leaves", "places", "text_hash")


def structure_differences(df: DataFrame, before: str, after: str) -> DataFrame:
    """Records whose keys, order, numbers or nesting changed."""
    return where_computed(df, jt.skeleton(F.col(before)) != jt.skeleton(F.col(after)), df.columns)


def leaf_rows(df: DataFrame, keys: Sequence[str], record: str) -> DataFrame:
    """One row per string value of a record, in order."""
    rows = df.select(*keys, F.posexplode_outer(jt.leaves(F.col(record))).alias("leaf", "p"))
    return rows.select(*keys, "leaf", F.col("p.value").alias("value")).filter(
        F.col("value").isNotNull())
