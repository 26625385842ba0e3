"""Usage statistics over the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def stats_by_type(mappings: DataFrame) -> DataFrame:
    """Mapping counts of the counted identifier types: per identity and type, per identity, and in
    all. One aggregation answers the per-user and the global question (``level`` 0, 1, 2)."""
    return mappings.filter(F.col("pii_type").isin(vocab.HIPAA_TYPES)).groupBy("uuid", "pii_type").agg(
        F.count(F.lit(1)).alias("n")).rollup("uuid", "pii_type").agg(
        F.sum("n").alias("entities"), F.grouping_id().cast("int").alias("grouping")).withColumn(
        "level", F.when(F.col("grouping") == 0, 0).when(F.col("grouping") == 1, 1).otherwise(2)).drop(
        "grouping")


def global_stats_by_type(mappings: DataFrame) -> DataFrame:
    """Mapping counts by identifier type over all identities."""
    return mappings.filter(F.col("pii_type").isin(vocab.HIPAA_TYPES)).groupBy("pii_type").agg(
        F.count(F.lit(1)).alias("entities"))


def stats_by_method(history: DataFrame, by_identity: bool = False) -> DataFrame:
    """Operation counts by method, over all or per identity."""
    keys = ["uuid", "method"] if by_identity else ["method"]
    return history.groupBy(*keys).agg(F.count(F.lit(1)).alias("operations"))


def stats_summary(mappings: DataFrame, history: DataFrame) -> DataFrame:
    """One row: distinct counted types and the totals of each kind of operation."""
    kinds = mappings.filter(F.col("pii_type").isin(vocab.HIPAA_TYPES)).agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_distinct("pii_type").alias("unique_entity_types"))
    method = F.col("method")
    runs = history.agg(
        F.count_if(method.isin(vocab.ANONYMIZE_METHODS)).alias("anonymizations"),
        F.count_if(method.isin(vocab.RESTORE_METHODS)).alias("de_anonymizations"),
        F.count_if(method == "ANONYMIZE_PROFILE").alias("profile_anonymizations"),
        F.count_if(method == "DE_ANONYMIZE_PROFILE").alias("profile_de_anonymizations"))
    wide = kinds.unionByName(runs, allowMissingColumns=True)
    return wide.agg(*[F.sum(c).cast("bigint").alias(c) for c in wide.columns])


def _counts(df: DataFrame, label: str, into: str, activity: bool = False) -> DataFrame:
    """Counts by label as a map per identity, and optionally the first and last time. The counts
    are grouped first; the map then has one entry per label, however many rows there are."""
    times = [F.min("created_at").alias("lo"), F.max("created_at").alias("hi")] if activity else []
    n = df.groupBy("uuid", label).agg(F.count(F.lit(1)).alias("n"), *times)
    spread = [F.min("lo").alias("first_activity"), F.max("hi").alias("last_activity")] if activity \
        else []
    return n.groupBy("uuid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias(into),
        F.sum("n").alias(f"total_{into}"), *spread)


def user_summary(identities: DataFrame, registry: DataFrame, mappings: DataFrame,
                 history: DataFrame) -> DataFrame:
    """Activity of each requested identity; ``error`` is set where it is not registered."""
    wanted = identities.select("identity", "identity_type").distinct()
    ids = wanted.join(registry.select("uuid", "identity", "identity_type"),
                      ["identity", "identity_type"], "left")
    # Both tables are counted before they meet the identities: counting combines map-side, so one
    # identity with a large share of the rows never reaches a join as such.
    entities = _counts(mappings, "pii_type", "entities")
    operations = _counts(history, "method", "operations", activity=True)
    none = F.expr("map()").cast("map<string,bigint>")
    zero = F.lit(0).cast("bigint")
    unknown = F.col("uuid").isNull()
    return (ids.join(entities, "uuid", "left").join(operations, "uuid", "left")
            .select("identity", "identity_type", "uuid",
                    F.when(~unknown, F.coalesce("entities", none)).alias("entities"),
                    F.when(~unknown, F.coalesce("operations", none)).alias("operations"),
                    "first_activity", "last_activity",
                    F.when(~unknown, F.coalesce("total_entities", zero)).alias("total_entities"),
                    F.when(~unknown, F.coalesce("total_operations", zero)).alias("total_operations"),
                    F.when(unknown, F.lit("User not found")).alias("error")))
