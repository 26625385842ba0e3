"""Replacing identifiers in texts.

The plain path is one projection over the input: identity uuid, spans, replacements and the new
text are all functions of the row. A stored mapping is only joined where it differs from what the
key would give (mappings taken over from elsewhere).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pseudonyms as ps
from ..functions import vocab
from ..functions.rules import ALL_RULES, Rule
from ..functions.spans import let, running_sum
from ..functions.splice import splice
from ..session import stage
from . import detect

ENTITY_FIELDS = ("begin", "end", "out_begin", "out_end", "type", "original", "fake")


def with_uuid(df: DataFrame, secret: str, registry: DataFrame | None = None) -> DataFrame:
    """Add the identity's uuid; a uuid already registered wins over the derived one."""
    derived = ps.identity_uuid(secret)
    if registry is None:
        return df.withColumn("uuid", derived)
    known = registry.select("identity", "identity_type", F.col("uuid").alias("known_uuid"))
    return (df.join(known, ["identity", "identity_type"], "left")
            .withColumn("uuid", F.coalesce("known_uuid", derived)).drop("known_uuid"))


def consent_status(context: Column) -> Column:
    """403 when consent is required and the purpose is not a valid one, else 200."""
    asks = F.lower(F.coalesce(context["requires_consent"], F.lit("false"))).isin("true", "1", "yes")
    purpose = F.coalesce(context["purpose"], F.lit(vocab.DEFAULT_PURPOSE))
    return F.when(asks & ~purpose.isin(vocab.VALID_PURPOSES), 403).otherwise(200)


def with_fakes(df: DataFrame, secret: str, spans: str = "spans", into: str = "entities") -> DataFrame:
    """Give each span its keyed replacement. The uuid is bound once per row, not per span."""
    fake = ps.fake_sql(ps.secret_sql(secret), "owner", "s.type", "s.original")
    return df.withColumn(into, F.expr(
        f"aggregate(cast(array() as array<int>), uuid, (owner, _) -> owner, owner -> transform({spans}, s -> "
        f"named_struct('begin', s.begin, 'end', s.end, 'type', s.type, 'original', s.original, 'fake', {fake})))"))


def with_out_offsets(entities: Column) -> Column:
    """Add each entity's place in the new text."""
    moved = F.transform(entities, lambda e: F.length(e["fake"]) - e["end"] + e["begin"])

    def placed(es: Column, shifts: Column) -> Column:
        return F.transform(es, lambda e, i: let(e["begin"] + F.coalesce(F.get(shifts, i - 1), F.lit(0)), lambda at: F.struct(
            e["begin"].alias("begin"), e["end"].alias("end"), at.alias("out_begin"),
            (at + F.length(e["fake"])).alias("out_end"), e["type"].alias("type"), e["original"].alias("original"),
            e["fake"].alias("fake"))))

    return let(entities, lambda es: let(running_sum(moved), lambda shifts: placed(es, shifts)))


def overrides(mappings: DataFrame, secret: str) -> DataFrame:
    """Stored mappings whose replacement is not the keyed one; usually none.

    The first stored casing of a value wins. Grouping combines map-side, so one identity with very
    many rows is no hot spot.
    """
    u = mappings.filter(F.col("fake") != ps.fake(secret))
    return u.groupBy("uuid", F.lower("pii_type").alias("type_key"),
                     F.lower("original").alias("value_key")).agg(
        F.min_by("fake", F.struct("created_at", "original")).alias("stored_fake"))


def apply_overrides(df: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Put stored replacements in place of keyed ones.

    Only narrow rows (key, uuid, type, value) are exploded and joined; texts are joined once, on
    their key, with the few arrays that have a stored value.
    """
    values = detect.explode_spans(df.select(key, "uuid", "entities"), [key, "uuid"], "entities")
    hits = (values.select(key, "uuid", "seq", F.lower("type").alias("type_key"),
                          F.lower("original").alias("value_key"))
            .join(changed, ["uuid", "type_key", "value_key"])
            .groupBy(key).agg(F.map_from_entries(
                F.collect_list(F.struct("seq", "stored_fake"))).alias("stored")))
    out = df.join(hits, key, "left")
    merged = F.transform("entities", lambda e, i: e.withField(
        "fake", F.coalesce(F.col("stored")[i], e["fake"])))
    return out.withColumn("entities", F.when(
        F.col("stored").isNotNull(), merged).otherwise(F.col("entities"))).drop("stored")


def anonymize(df: DataFrame, secret: str, text: str = "text", rules: Sequence[Rule] = ALL_RULES,
              registry: DataFrame | None = None, mappings: DataFrame | None = None,
              external: DataFrame | None = None) -> DataFrame:
    """Anonymise ``(doc_id, identity, identity_type, text[, context])``.

    Adds ``uuid``, ``entities`` (with places in both texts), ``anonymized``, ``status`` and
    ``entities_detected``. Rows without consent, or without an identity to key by, keep no result. No shuffle unless a registry,
    mappings or external detections are given; with mappings, the spans are written to the work
    folder first, since the lookup and the texts both build on them.
    """
    out = with_uuid(df, secret, registry)
    status = consent_status(F.col("context")) if "context" in df.columns else F.lit(200)
    out = out.withColumn("status", F.when(F.col("uuid").isNull(), 500).otherwise(status))
    if external is None:
        out = detect.with_spans(out, text, rules)
    else:
        out = detect.with_spans_and_external(out, external, text=text, rules=rules)
    out = with_fakes(out, secret)
    if mappings is not None:
        # a number of the row, as doc_ids may repeat; it is written with the rows, so it stays the same
        out = apply_overrides(stage(out.withColumn("_row", F.monotonically_increasing_id()), "spans"),
                              overrides(mappings, secret), "_row").drop("_row")
    allowed = F.col("status") == 200
    out = out.withColumn("entities", F.when(allowed, with_out_offsets(F.col("entities"))))
    return out.withColumn("anonymized", F.when(allowed, splice(F.col(text), F.col("entities")))) \
        .withColumn("entities_detected", F.coalesce(F.size("entities"), F.lit(0))).drop("spans")


def redact(df: DataFrame, text: str = "text", rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Replace identifiers by ``[REDACTED-<type>]``; nothing to restore from."""
    marked = F.transform("spans", lambda s: F.struct(
        s["begin"].alias("begin"), s["end"].alias("end"),
        F.concat(F.lit("[REDACTED-"), s["type"], F.lit("]")).alias("fake")))
    out = detect.with_spans(df, text, rules).withColumn("marked", marked)
    return out.withColumn("redacted", splice(F.col(text), F.col("marked"))).drop("spans", "marked")


def mapping_rows(anonymized: DataFrame) -> DataFrame:
    """New mapping rows: one per identity, type and value in whatever case, first seen casing."""
    rows = detect.explode_spans(anonymized.select("doc_id", "uuid", "entities"),
                                ["doc_id", "uuid"], "entities")
    first = rows.groupBy("uuid", F.col("type").alias("pii_type"),
                         F.lower("original").alias("value_key")).agg(
        F.min_by(F.struct("original", "fake"), F.struct("doc_id", "begin")).alias("v"))
    return first.select("uuid", "pii_type", F.col("v.original").alias("original"),
                        ps.fake_kind(F.col("pii_type")).alias("fake_type"),
                        F.col("v.fake").alias("fake"))


def ledger_rows(anonymized: DataFrame) -> DataFrame:
    """One row per replaced span, with its place in both texts and a hash of the new one. As sensitive as the mappings."""
    rows = detect.explode_spans(anonymized.select("doc_id", F.xxhash64("anonymized").alias("text_hash"), "uuid", "entities"),
                                ["doc_id", "text_hash", "uuid"], "entities")
    return rows.select("doc_id", "text_hash", F.lit(0).alias("leaf"), "uuid", F.col("type").alias("pii_type"),
                       "begin", "end", "out_begin", "out_end", "original", "fake")


def operation_metadata(entities: Column, context: Column | None = None) -> Column:
    """JSON text about one operation: purpose, legal basis, entity count and sorted types."""
    purpose = context["purpose"] if context is not None else F.lit(None).cast("string")
    basis = F.when(context.isNotNull(), F.lit(vocab.LEGAL_BASIS)) if context is not None \
        else F.lit(None).cast("string")
    return F.to_json(F.struct(
        purpose.alias(vocab.META_PURPOSE), basis.alias(vocab.META_BASIS),
        F.size(entities).alias("entity_count"),
        F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"])))
        .alias("entity_types")), {"ignoreNullFields": "false"})


def record_metadata(processed: Column, context: Column) -> Column:
    """The same about a JSON record: the number of distinct values, and that it is a record."""
    return F.to_json(F.struct(
        context["purpose"].alias(vocab.META_PURPOSE), F.when(context.isNotNull(), F.lit(vocab.LEGAL_BASIS)).alias(vocab.META_BASIS),
        processed.alias("entities_processed"), F.lit(vocab.RECORD_DATA).alias("data_type")), {"ignoreNullFields": "false"})


def restore_metadata(context: Column) -> Column:
    """JSON text about one restore: the access reason and who authorised it."""
    return F.to_json(F.struct(context["access_reason"].alias(vocab.META_REASON),
                              context["authorized_by"].alias(vocab.META_BY)),
                     {"ignoreNullFields": "false"})


def history_rows(anonymized: DataFrame, method: str, at: Column, text: str = "text") -> DataFrame:
    """Operation history; texts without an identifier leave no row."""
    context = F.col("context") if "context" in anonymized.columns else None
    found = detect.where_computed(
        anonymized.withColumn("metadata", operation_metadata(F.col("entities"), context)),
        F.col("entities_detected") > 0, ["uuid", text, "anonymized", "metadata"])
    return found.select("uuid", F.col(text).alias("original"), "anonymized",
                        F.lit(method).alias("method"), "metadata", at.alias("created_at"))
