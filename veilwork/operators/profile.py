"""Flat key/value profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pseudonyms as ps
from ..functions import spans as sp
from ..functions.rules import ALL_RULES, Rule
from ..functions.spans import let
from ..functions.splice import by_place
from ..session import stage
from . import restore
from .anonymize import apply_overrides, overrides, with_uuid


def field_rule(key: Column) -> Column:
    """How a field is treated: DOB, ZIP, FIRST, LAST, NAME, KEEP (a provider's name) or SCAN."""
    k = F.replace(F.lower(key), F.lit("_"), F.lit(" "))
    named = k.contains("first name") | k.contains("last name") | (k == "name")
    provider = k.rlike("provider|doctor|physician")
    return (F.when(k.contains("dob") | k.contains("date of birth"), "DOB")
            .when(k.contains("zip"), "ZIP")
            .when(named & provider, "KEEP").when(k.contains("first name"), "FIRST")
            .when(k.contains("last name"), "LAST").when(named, "NAME").otherwise("SCAN"))


def with_fields(df: DataFrame, secret: str, profile: str, into: str = "entities",
                rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Add the fields of a profile that are to change: type, original, replacement and key."""
    out = df.withColumn("fields", F.transform(F.map_entries(profile), lambda f: F.struct(
        f["key"].alias("key"), f["value"].alias("value"), field_rule(f["key"]).alias("rule"))))
    # Detection is the costly part, so only fields that their key doesn't decide on are searched.
    out = out.withColumn("fields", F.expr(
        "transform(fields, f -> named_struct('key', f.key, 'value', f.value, 'rule', f.rule, 'found', "
        f"CASE WHEN f.rule = 'SCAN' AND f.value <> '' THEN {sp.detect_sql('f.value', tuple(rules))} END))"))
    out = out.withColumn("fields", F.transform("fields", lambda f: F.struct(
        f["key"].alias("key"), f["value"].alias("value"), f["rule"].alias("rule"),
        F.when(F.size(f["found"]) > 0, F.get(sp.resolve(f["found"]), F.lit(0))).alias("first"))))

    def entity(f: Column) -> Column:
        by_key = f["rule"].isin("DOB", "ZIP", "FIRST", "LAST", "NAME")
        type_ = F.when(f["rule"].isin("FIRST", "LAST"), "NAME").when(by_key, f["rule"]).when(
            f["rule"] == "SCAN", f["first"]["type"])
        found = F.when(by_key, f["value"]).otherwise(f["first"]["original"])
        # a keyed replacement stands for the whole field that it replaces; a mask can't tell fields apart
        masked = F.coalesce(type_.isin(ps.MASKED_TYPES), F.lit(False))
        filled = f["value"].isNotNull() & (f["value"] != "")
        return F.struct(f["key"].alias("key"), F.when(filled, type_).alias("type"), found.alias("found"),
                        F.when(masked, found).otherwise(f["value"]).alias("original"))

    out = out.withColumn("fields", F.transform("fields", entity))
    digest = ps.digest_sql(ps.secret_sql(secret), "owner", "f.type", "f.original")
    # One replacement per value, whatever field it is in, so that it can be stored and undone by value.
    fake = (f"CASE WHEN f.type = 'NAME' AND f.original NOT RLIKE '[ \\\\t]' THEN {ps.LAST_NAME_SQL} "
            f"ELSE {ps.fake_from_digest_sql('f.type', 'f.found')} END")
    return out.withColumn(into, F.expr(
        "transform(array(uuid), owner -> transform(filter(fields, f -> f.type IS NOT NULL), "
        "f -> named_struct('begin', 0, 'end', 0, 'type', f.type, 'original', f.original, 'fake', "
        f"transform(array({digest}), h -> {fake})[0], 'key', f.key)))[0]")).drop("fields")


def new_profile(profile: str, keys: Column, fakes: Column) -> Column:
    """A profile with some of its fields replaced."""
    new = F.map_from_entries(F.transform(F.arrays_zip(keys.alias("key"), fakes.alias("fake")), lambda e: F.struct(
        e["key"].alias("key"), e["fake"].alias("value"))))
    return let(new, lambda m: F.transform_values(profile, lambda k, v: F.coalesce(m[k], v)))


def put_back_fields(profile: str, hits: Column) -> Column:
    """A profile with what was found in its fields (by their number) put back."""
    return F.map_from_entries(F.transform(F.map_entries(profile), lambda f, i: F.struct(f["key"].alias("key"), F.when(
        F.get(hits, i).isNotNull(), restore.put_back(f["value"], F.get(hits, i)["places"])).otherwise(
        f["value"]).alias("value"))))


SINGLE_NAME = "^[A-Z][a-z]+$"  # single first and last names, which only profiles have, fill a field


def anonymize_profile(df: DataFrame, secret: str, profile: str = "profile",
                      rules: Sequence[Rule] = ALL_RULES, registry: DataFrame | None = None,
                      mappings: DataFrame | None = None) -> DataFrame:
    """Anonymise a ``map<string,string>`` of ``(doc_id, identity, identity_type, profile)``.

    Birth dates, ZIP codes and names go by their key; any other field is replaced whole by the
    replacement of the first identifier in it. Empty fields stay. Map-only without stored tables.
    """
    out = with_fields(with_uuid(df, secret, registry), secret, profile, rules=rules)
    if mappings is not None:
        out = apply_overrides(stage(out.withColumn("_row", F.monotonically_increasing_id()), "profile-fields"),
                              overrides(mappings, secret), "_row").drop("_row")
    return out.withColumn("anonymized", new_profile(profile, F.col("entities.key"), F.col("entities.fake")))


def ledger_rows(anonymized: DataFrame, original: str = "profile") -> DataFrame:
    """One row per changed field of anonymised profiles, by its number: the whole field as it was."""
    fields = F.map_entries("anonymized")
    old = F.filter(F.transform(F.map_entries(original), lambda f, i: F.struct(
        i.cast("int").alias("leaf"), f["value"].alias("original"), F.get(fields, i)["value"].alias("fake"))),
        lambda f: f["original"] != f["fake"])
    rows = anonymized.select("doc_id", F.xxhash64(fields).alias("text_hash"), "uuid", F.explode_outer(old).alias("e"))
    return rows.filter(F.col("e").isNotNull()).select("doc_id", "text_hash", "uuid", "e.*")


def restore_profile_by_ledger(df: DataFrame, ledger: DataFrame, profile: str = "anonymized",
                              key: str = "doc_id") -> DataFrame:
    """Restore a profile exactly, whole fields at a time; adds ``restored`` and ``unclear``, as for texts."""
    fields = F.map_entries(profile)
    rows = restore.ledger_places(ledger, key, "leaf")
    out = restore.joined_back(df.withColumn("text_hash", F.xxhash64(fields)), rows, [key, "text_hash"])
    out = out.withColumn("unclear", F.coalesce("unclear", F.lit(False))).withColumn("_at", by_place(F.when(
        ~F.col("unclear"), F.col("places")), "leaf"))
    new = F.map_from_entries(F.transform(fields, lambda f, i: F.struct(
        f["key"].alias("key"), F.coalesce(F.get("_at", i)["original"], f["value"]).alias("value"))))
    return out.withColumn("restored", F.when(F.col("_at").isNotNull(), new).otherwise(F.col(profile))).drop(
        "_at", "places", "text_hash")


def restore_profile(df: DataFrame, mappings: DataFrame, profile: str = "anonymized",
                    key: str = "doc_id") -> DataFrame:
    """Restore every field of ``(key, uuid, profile)``; empty, unmapped and provider fields stay. Rows may share a key."""
    fields = F.map_entries(profile)
    rows = df.withColumn("_hash", F.xxhash64(fields))

    def values(of: DataFrame, *more: str) -> DataFrame:
        return of.select(key, "_hash", "uuid", *more, F.posexplode_outer(fields).alias("leaf", "f")).filter(
            F.col("f.value").isNotNull() & (field_rule(F.col("f.key")) != "KEEP")).select(
            key, "_hash", "uuid", *more, "leaf", F.col("f.value").alias("value"))

    hits = restore.found_in_leaves(values(rows), mappings, [key, "_hash"], F.col("value").rlike(SINGLE_NAME), coded=values(
        rows.join(restore.codes_of(mappings), "uuid"), "_codes"))
    out = restore.joined_back(rows, hits, [key, "_hash", "uuid"]).withColumn("hits", by_place(F.col("hits"), "leaf"))
    return out.withColumn("restored", F.when(F.col("hits").isNotNull(), put_back_fields(profile, F.col("hits"))).otherwise(
        F.col(profile))).drop("hits", "_hash")
