"""Set-based maintenance of the identity, mapping, history and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pseudonyms as ps
from ..functions import vocab

MAPPING_KEY = ["uuid", "pii_type", "original"]


def register_identities(requests: DataFrame, registry: DataFrame, secret: str, at: Column,
                        insert: bool = True) -> DataFrame:
    """Get or create: the registry rows of the requested identities.

    ``distinct`` combines map-side, so an identity with most of the requests costs no more than
    another. With ``insert=False`` unknown identities are left out.
    """
    wanted = requests.select("identity", "identity_type").distinct()
    known = registry.join(wanted, ["identity", "identity_type"], "left_semi").select(
        "uuid", "identity", "identity_type", "created_at", F.lit(False).alias("is_new"))
    if not insert:
        return known
    return known.unionByName(new_identities(wanted, registry, secret, at).withColumn(
        "is_new", F.lit(True)))


def new_identities(requests: DataFrame, registry: DataFrame, secret: str, at: Column) -> DataFrame:
    """Rows to append to the registry."""
    wanted = requests.select("identity", "identity_type").distinct()
    fresh = wanted.join(registry, ["identity", "identity_type"], "left_anti")
    return fresh.select(
        ps.identity_uuid(secret).alias("uuid"),
        "identity", "identity_type", at.alias("created_at"))


def mappings_of(identities: DataFrame, registry: DataFrame, mappings: DataFrame) -> DataFrame:
    """The stored mappings of the given identities."""
    ids = registry.join(identities.select("identity", "identity_type").distinct(),
                        ["identity", "identity_type"], "left_semi")
    return mappings.join(ids.select("uuid", "identity", "identity_type"), "uuid").select(
        "identity", "identity_type", *MAPPING_KEY, "fake_type", "fake")


def value_key() -> list[Column]:
    """What makes two mappings the same, here and wherever a value is looked up: case doesn't count."""
    return [F.col("uuid"), F.lower("pii_type").alias("type_key"), F.lower("original").alias("value_key")]


def dedup_mappings(rows: DataFrame, order: Column) -> DataFrame:
    """The first row of each (uuid, type, original), whatever the case; an aggregate, so that repeats combine
    map-side instead of being sorted in one window."""
    first = rows.groupBy(*value_key()).agg(F.min_by(F.struct(*rows.columns), order).alias("v"))
    return first.select(*[F.col(f"v.{c}").alias(c) for c in rows.columns])


def mappings_to_insert(rows: DataFrame, stored: DataFrame, order: Column) -> DataFrame:
    """Insert-if-absent: the rows to append to the mapping table."""
    first = dedup_mappings(rows, order).select("*", *value_key()[1:])
    return first.join(stored.select(*value_key()), ["uuid", "type_key", "value_key"], "left_anti").drop(
        "type_key", "value_key")


def resolve_mappings(entities: DataFrame, stored: DataFrame, secret: str) -> DataFrame:
    """Give each ``(uuid, type, original)`` row its stored replacement, or else the keyed one.

    Values compare without case. ``is_new`` marks values that were not stored.
    """
    known = stored.groupBy("uuid", F.lower("pii_type").alias("type_key"),
                           F.lower("original").alias("value_key")).agg(
        F.min_by("fake", F.struct("created_at", "original")).alias("stored_fake"))
    keyed = entities.withColumn("type_key", F.lower("type")).withColumn(
        "value_key", F.lower("original"))
    out = keyed.join(known, ["uuid", "type_key", "value_key"], "left")
    return out.withColumn("fake", F.coalesce("stored_fake", ps.fake(
        secret, type_="type"))).withColumn(
        "is_new", F.col("stored_fake").isNull()).drop("type_key", "value_key", "stored_fake")


def fake_collisions(mappings: DataFrame) -> DataFrame:
    """Replacements that stand for more than one original of an identity.

    Two-stage counting: repeats are removed map-side, then counted, so that a mask shared by many
    originals is not gathered.
    """
    pairs = mappings.groupBy("uuid", "fake", "original").agg(F.max("pii_type").alias("pii_type"))
    return pairs.groupBy("uuid", "fake").agg(
        F.count(F.lit(1)).alias("originals"), F.max("pii_type").alias("pii_type")).filter(
        F.col("originals") > 1)


def separate_collisions(mappings: DataFrame, secret: str) -> DataFrame:
    """Give colliding keyed replacements new values, the first original keeping the old one.

    Masks are meant to collide and are left alone. Only colliding rows meet in the window, a few
    per replacement.
    """
    clashes = fake_collisions(mappings.filter(F.col("fake_type") == ps.KEYED)).select("uuid", "fake")
    hit = mappings.filter(F.col("fake_type") == ps.KEYED).join(clashes, ["uuid", "fake"], "left_semi")
    rest = mappings.join(clashes.withColumn("fake_type", F.lit(ps.KEYED)),
                         ["uuid", "fake", "fake_type"], "left_anti")
    w = Window.partitionBy("uuid", "fake").orderBy("created_at", "pii_type", "original")
    ranked = hit.withColumn("n", F.row_number().over(w))
    salted = ps.fake_sql(f"concat_ws('#', {ps.secret_sql(secret)}, n)", "uuid", "pii_type", "original")
    fixed = ranked.withColumn("fake", F.when(F.col("n") == 1, F.col("fake")).otherwise(
        F.expr(salted))).drop("n")
    return rest.unionByName(fixed.select(rest.columns))


def keep_recent(history: DataFrame, now: Column, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """History within the retention period; on a table laid out by day this prunes directories."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    kept = history.filter(F.col("created_at") >= cutoff)
    return kept.filter(F.col("day") >= F.to_date(cutoff)) if "day" in history.columns else kept


def orphan_mappings(mappings: DataFrame, registry: DataFrame) -> DataFrame:
    """Mappings whose identity is not registered."""
    return mappings.join(registry.select("uuid"), "uuid", "left_anti")


def cleanup_counts(history: DataFrame, mappings: DataFrame, registry: DataFrame, now: Column,
                   days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """How many history and mapping rows a clean-up deletes."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    old = history.agg(F.count_if(F.col("created_at") < cutoff).alias("data_records_deleted"))
    orphans = orphan_mappings(mappings, registry).agg(F.count(F.lit(1)).alias("entity_records_deleted"))
    # Two single rows side by side; unioned and summed, not crossed.
    zero = F.lit(0).cast("bigint")
    both = old.withColumn("entity_records_deleted", zero).unionByName(
        orphans.withColumn("data_records_deleted", zero))
    return both.agg(F.sum("data_records_deleted").alias("data_records_deleted"),
                    F.sum("entity_records_deleted").alias("entity_records_deleted"))


def erase(table: DataFrame, erased: DataFrame) -> DataFrame:
    """A store table without the rows of erased identities (``uuid``)."""
    return table.join(erased.select("uuid"), "uuid", "left_anti")


def erase_identities(stores: dict[str, DataFrame], erased: DataFrame) -> dict[str, DataFrame]:
    """Right to erasure, over every store table."""
    return {name: erase(df, erased) for name, df in stores.items()}
