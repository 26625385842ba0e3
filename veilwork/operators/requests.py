"""Mixed batches of requests, served against the stores, and the audit events of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext as jt
from ..functions.rules import ALL_RULES
from ..functions.splice import by_place, splice
from ..session import stage
from ..sources import tables as tb
from . import anonymize as an
from . import detect, jsonrec, profile, restore, stores

RESULT = ["request_id", "uuid", "handler", "status", "result", "entities", "error"]
CONSENT_ERROR = "consent does not cover this purpose"
NOT_JSON = "Error: not a JSON document"
LEGACY_ERROR = "record was stored in an older form: anonymise it again"
NO_PROFILE = "Error: not a profile"
NO_IDENTITY = "Error: no identity"
# Which payload a handler works on, as the audit names it.
DATA_TYPES = {"ANONYMIZE": "conversation", "DE-ANONYMIZE": "conversation", "ANONYMIZE_JSON": "json_data",
              "DE_ANONYMIZE_JSON": "json_data", "ANONYMIZE_PROFILE": "profile", "DE_ANONYMIZE_PROFILE": "profile"}
_TEXT, _JSON, _PROFILE = "ANONYMIZE", "ANONYMIZE_JSON", "ANONYMIZE_PROFILE"
_TEXT_BACK, _JSON_BACK, _PROFILE_BACK = "DE-ANONYMIZE", "DE_ANONYMIZE_JSON", "DE_ANONYMIZE_PROFILE"


def handler() -> Column:
    """Which operation a request asks for: by method, then by the payload that is there."""
    method = F.upper("method")
    json_, text = F.coalesce(F.col("json_data"), F.lit("")) != "", \
        F.coalesce(F.col("conversation"), F.lit("")) != ""
    return (F.when((method == "ANONYMIZE_JSON") | ((method == "ANONYMIZE") & json_), "ANONYMIZE_JSON")
            .when((method == "ANONYMIZE") & text, "ANONYMIZE")
            .when(method == "ANONYMIZE", "ANONYMIZE_PROFILE")
            .when((method == "DE_ANONYMIZE_JSON") | ((method == "DE-ANONYMIZE") & json_),
                  "DE_ANONYMIZE_JSON")
            .when((method == "DE-ANONYMIZE") & text, "DE-ANONYMIZE")
            .when(method == "DE-ANONYMIZE", "DE_ANONYMIZE_PROFILE"))


def _is(*names: str) -> Column:
    return F.coalesce(F.col("handler").isin(*names), F.lit(False))


def accepted(requests: DataFrame, secret: str, registry: DataFrame | None = None) -> DataFrame:
    """Requests with handler, uuid, status and error. Identities and their types are upper-cased."""
    r = requests.withColumn("identity", F.upper("identity")).withColumn(
        "identity_type", F.upper("identity_type")).withColumn("handler", handler())
    r = an.with_uuid(r, secret, registry)
    bad_json = _is(_JSON, _JSON_BACK) & ~F.coalesce(jt.is_valid(F.col("json_data")), F.lit(False))
    error = (F.when(F.col("handler").isNull(), F.concat(F.lit("No handler for method: "), F.coalesce("method", F.lit("null"))))
             .when(F.col("uuid").isNull(), NO_IDENTITY)
             .when(_is(_TEXT) & (an.consent_status(F.col("context")) == 403), CONSENT_ERROR)
             .when(bad_json, NOT_JSON).when(_is(_PROFILE, _PROFILE_BACK) & F.col("profile").isNull(), NO_PROFILE))
    r = r.withColumn("error", error)
    return r.withColumn("status", F.when(F.col("error").isNull(), 200).when(
        F.col("error") == CONSENT_ERROR, 403).otherwise(500))


def _detected(r: DataFrame, secret: str) -> DataFrame:
    """The entities of each request that is to be anonymised, whatever its payload; one projection."""
    def payload(name: str, column: str) -> Column:
        return F.when(_is(name) & (F.col("status") == 200), F.col(column))

    out = r.withColumn("_text", payload(_TEXT, "conversation")).withColumn(
        "_json", payload(_JSON, "json_data")).withColumn("_profile", payload(_PROFILE, "profile"))
    out = an.with_fakes(detect.with_spans(out, "_text", into="_spans"), secret, "_spans", "_found").drop("_spans")
    out = an.with_fakes(jsonrec.with_leaf_spans(out, "_json", ALL_RULES), secret, "spans", "_inner").drop("spans", "leaves")
    out = profile.with_fields(out, secret, "_profile", "_fields")
    plain = F.transform("_fields", lambda e: F.struct(*[e[c].alias(c) for c in ("begin", "end", "type", "original", "fake")]))
    return out.withColumn("entities", F.coalesce("_found", "_inner", plain)).withColumn(
        "keys", F.col("_fields.key")).drop("_text", "_json", "_profile", "_found", "_inner", "_fields")


def _values() -> Column:
    """The values of a request that is to be restored, with their number."""
    def value(leaf: Column, v: Column) -> Column:
        return F.struct(leaf.cast("int").alias("leaf"), v.alias("value"))

    return (F.when(_is(_TEXT_BACK), F.array(value(F.lit(0), F.col("conversation"))))
            .when(_is(_JSON_BACK), F.transform(jt.leaves(F.col("json_data")), lambda p, i: value(i, p["value"])))
            .when(_is(_PROFILE_BACK), F.transform(F.map_entries("profile"), lambda f, i: value(
                i, F.when(profile.field_rule(f["key"]) != "KEEP", f["value"])))))


def _hits(staged: DataFrame, mappings: DataFrame) -> DataFrame:
    """What is to be put back in each request, by the number of the value."""
    rows = staged.select("_row", "uuid", _is(_PROFILE_BACK).alias("field"), F.explode_outer(
        F.when(F.col("status") == 200, _values())).alias("v")).filter(F.col("v.value").isNotNull())
    values = rows.select("_row", "uuid", "field", "v.leaf", "v.value")
    found = restore.found_in_leaves(values, mappings, ["_row"], F.col("field") & F.col("value").rlike(profile.SINGLE_NAME))
    return found.select("_same._row", "hits")


def served(requests: DataFrame, mappings: DataFrame, secret: str, registry: DataFrame | None = None) -> DataFrame:
    """``RESULT`` with what the stores need: the payload, the context, the entities and their places.

    The requests are read once: what was found in them is written to the work folder, one join with the stored
    replacements and one with what they stand for serve all kinds of payloads, and one projection makes the results.
    """
    found = _detected(accepted(requests, secret, registry), secret)
    staged = stage(found.withColumn("_row", F.monotonically_increasing_id()), "requests")
    out = an.apply_overrides(staged, an.overrides(mappings, secret), "_row")
    # by the row's number, as the others, so that whole requests are shuffled once
    legacy = staged.filter(_is(_JSON_BACK)).select("_row", "uuid").join(jsonrec.legacy_identities(mappings), "uuid")
    out = out.join(_hits(staged, mappings), "_row", "left").join(legacy.select("_row", "legacy"), "_row", "left")
    outdated = _is(_JSON_BACK) & F.coalesce("legacy", F.lit(False)) & (F.col("status") == 200)
    out = out.withColumn("error", F.when(outdated, LEGACY_ERROR).otherwise(F.col("error"))).withColumn(
        "status", F.when(outdated, 400).otherwise(F.col("status")))
    good = F.col("status") == 200
    dense = by_place(F.col("hits"), "leaf")
    out = out.withColumn("_at", dense).withColumn("_placed", F.when(_is(_TEXT), an.with_out_offsets(F.col("entities"))))
    json_ = F.when(_is(_JSON, _JSON_BACK) & good, jt.leaves(F.col("json_data")))
    out = out.withColumn("leaves", json_)
    back = jsonrec.put_back_leaves(F.transform("leaves", lambda p, i: F.struct(
        p["raw"].alias("raw"), p["value"].alias("value"), F.get("_at", i)["places"].alias("mine"))))
    out = jsonrec.with_new_leaves(out.withColumn("_back", F.when(_is(_JSON_BACK), back))) \
        .withColumn("leaves", F.when(_is(_JSON), F.col("leaves")))

    def as_text(map_: Column) -> Column:
        return F.to_json(map_, {"ignoreNullFields": "false"})

    result = (F.when(_is(_TEXT), splice(F.col("conversation"), F.col("_placed")))
              .when(_is(_JSON), jt.assemble(F.col("leaves")))
              .when(_is(_PROFILE), as_text(profile.new_profile("profile", F.col("keys"), F.col("entities.fake"))))
              .when(_is(_TEXT_BACK), restore.put_back(F.col("conversation"), F.get("_at", F.lit(0))["places"]))
              .when(_is(_JSON_BACK), jt.assemble(F.col("_back")))
              .when(_is(_PROFILE_BACK), as_text(profile.put_back_fields("profile", F.col("_at")))))
    put_back = F.coalesce(F.aggregate("hits", F.lit(0), lambda n, h: n + restore.counted(h["places"], False)), F.lit(0))
    number = (F.when(_is(_JSON), F.size(jsonrec.distinct_values("entities"))).when(_is(_TEXT, _PROFILE), F.size("entities"))
              .when(_is(_JSON_BACK), F.size(F.filter("_back", lambda p: p["changed"].isNotNull()))).otherwise(put_back))
    in_leaves = F.flatten(F.transform("leaves", lambda p, i: F.transform(p["entities"], lambda e: F.struct(
        i.cast("int").alias("leaf"), *[e[c].alias(c) for c in an.ENTITY_FIELDS]))))
    in_text = F.transform("_placed", lambda e: F.struct(F.lit(0).alias("leaf"), *[e[c].alias(c) for c in an.ENTITY_FIELDS]))
    payload = (F.when(_is(_TEXT, _TEXT_BACK), F.col("conversation")).when(_is(_JSON, _JSON_BACK), F.col("json_data"))
               .when(_is(_PROFILE, _PROFILE_BACK), as_text(F.col("profile"))))
    # the request as it came, where it failed
    whole = F.when(F.col("status") >= 500, F.to_json(F.struct(
        "request_id", "method", "identity", "identity_type", "conversation", "json_data", "profile", "context")))
    return out.select(
        "request_id", "identity", "identity_type", "uuid", "handler", F.col("status").cast("int").alias("status"),
        F.when(good, result).alias("result"), F.when(good, number).cast("int").alias("entities"), "error", "context",
        payload.alias("payload"), whole.alias("request"), F.when(good, F.col("entities")).alias("found"),
        F.when(good, F.coalesce(in_leaves, in_text)).alias("places"))


def route(requests: DataFrame, mappings: DataFrame, secret: str, registry: DataFrame | None = None) -> DataFrame:
    """Serve a batch of ``(request_id, method, identity, identity_type, conversation, json_data,
    profile, context)``; nothing is stored. Unknown methods and unreadable payloads get status 500."""
    return served(requests, mappings, secret, registry).select(*RESULT)


# ---- with the stores ------------------------------------------------------------------------------

def history_of(done: DataFrame, at: Column) -> DataFrame:
    """History rows of served requests; those in which nothing was found leave none. Restores have the restored text as
    the original, as it is the one with identifiers."""
    back = _is(_TEXT_BACK, _JSON_BACK, _PROFILE_BACK)
    metadata = F.when(back, an.restore_metadata(F.col("context"))).when(_is(_JSON), an.record_metadata(
        F.col("entities"), F.col("context"))).otherwise(an.operation_metadata(F.col("found"), F.col("context")))
    rows = done.filter((F.col("status") == 200) & (F.col("entities") > 0))
    return rows.select(
        "uuid", F.when(back, F.col("result")).otherwise(F.col("payload")).alias("original"),
        F.when(back, F.col("payload")).otherwise(F.col("result")).alias("anonymized"), F.col("handler").alias("method"),
        metadata.alias("metadata"), at.alias("created_at"))


def audit_of(done: DataFrame, at: Column) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in DATA_TYPES.items() for x in pair])
    return audit_events(done, F.coalesce("handler", F.lit("UNKNOWN")), kinds[F.col("handler")], at)


def ledger_of(done: DataFrame) -> DataFrame:
    """Ledger rows of texts and records; profiles have no places."""
    rows = done.select(F.col("request_id").alias("doc_id"), F.xxhash64("result").alias("text_hash"), "uuid",
                       F.explode_outer("places").alias("e")).filter(F.col("e").isNotNull())
    return rows.select("doc_id", "text_hash", "uuid", F.col("e.type").alias("pii_type"), "e.*")


def serve(requests: DataFrame, paths: dict[str, str], secret: str, batch: int, at: Column) -> dict[str, int]:
    """Serve a numbered batch against the written stores and give its counters.

    ``paths`` has those of ``results``, ``identities``, ``mappings``, ``history``, ``audit`` and ``ledger``, and may have one
    of ``dead_letters``. Of the looked
    up stores only the folders of the batch's identities are read. The results are made once, in the work folder, and
    every store is written from there. A batch that runs again leaves every store as it was: results, history, audit and
    ledger by its number, identities and mappings as they are inserted if absent.
    """
    spark = requests.sparkSession
    who = requests.select(F.upper("identity").alias("identity"), F.upper("identity_type").alias("identity_type")).distinct()
    registry = tb.read_store(spark, paths["identities"], "identities", who).drop("bucket")
    stored = tb.read_store(spark, paths["mappings"], "mappings", an.with_uuid(who, secret, registry)).drop("bucket")
    done = stage(served(requests, stored, secret, registry), "served")
    anonymised = done.filter(_is(_TEXT, _JSON, _PROFILE) & (F.col("entities") > 0))

    new = stores.new_identities(anonymised, registry, secret, at)
    tb.append_store(new, paths["identities"], "identities")
    maps = an.mapping_rows(anonymised.withColumn("doc_id", F.col("request_id")).withColumn("entities", F.col("found")))
    fresh = maps.withColumn("created_at", at)
    tb.append_store(stores.mappings_to_insert(fresh, stored, F.col("original")), paths["mappings"], "mappings")
    tb.append_store(ledger_of(anonymised), paths["ledger"], "ledger", batch)
    tb.append_store(history_of(done, at), paths["history"], "history", batch)
    tb.append_store(audit_of(done, at), paths["audit"], "audit", batch)
    if "dead_letters" in paths:
        tb.append_store(dead_letters(done, at), paths["dead_letters"], "dead_letters", batch)
    counters = Observation(f"requests-{batch}")
    counted = done.select(*RESULT).observe(
        counters, F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == 200).alias("served"),
        F.count_if(F.col("status").isin(400, 403)).alias("refused"), F.count_if(F.col("status") == 500).alias("failed"),
        F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"))
    counted.write.mode("overwrite").parquet(f"{paths['results']}/batch={batch}")
    return counters.get


REQUEST = ("request_id bigint, method string, identity string, identity_type string, conversation string, "
           "json_data string, profile map<string,string>, context map<string,string>")
BROKEN_LINE = "not a request in JSON"


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Requests from files of JSON lines, and the lines that are none, as dead letters.

    A line that can't be read doesn't stop the others. Dead letters keep the line as it is, its file, and the start of the
    part of the file that it was read in.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_offset"))
    parsed = lines.withColumn("r", F.from_json("value", f"{REQUEST}, _corrupt string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    names = [f.split()[0] for f in REQUEST.split(", ")]
    good = parsed.filter(~bad).select(*[F.col(f"r.{n}").alias(n) for n in names], "source_file", "source_offset")
    dead = parsed.filter(bad & (F.trim("value") != "")).select(
        F.lit(None).cast("bigint").alias("request_id"), F.lit(None).cast("string").alias("handler"),
        F.lit(BROKEN_LINE).alias("reason"), F.col("value").alias("payload"), "source_file", "source_offset",
        F.current_timestamp().alias("created_at"))
    return good, tb.conform(dead, "dead_letters")


def dead_letters(done: DataFrame, at: Column) -> DataFrame:
    """Requests of any kind that failed (not those refused by consent), from which they can be served again."""
    rows = done.filter(F.col("status") >= 500)
    return tb.conform(rows.select("request_id", "handler", F.col("error").alias("reason"), F.col("request").alias("payload"),
                                  at.alias("created_at")), "dead_letters")


def from_dead_letters(dead: DataFrame) -> DataFrame:
    """The requests that dead letters hold, to be served again once the cause is mended; broken lines are left out."""
    r = dead.filter(F.col("reason") != BROKEN_LINE).select(F.from_json("payload", REQUEST).alias("r"))
    return r.select("r.*")


def failed_records(df: DataFrame, record: str) -> DataFrame:
    """Records that cannot be processed get status 500 and a message; others are unaffected."""
    bad = ~F.coalesce(jt.is_valid(F.col(record)), F.lit(False))
    return df.withColumn("status", F.when(bad, 500).otherwise(200)).withColumn(
        "error", F.when(bad, F.lit(NOT_JSON)))


def audit_events(results: DataFrame, action: str | Column, data_type: str | Column, at: Column) -> DataFrame:
    """Audit rows of an operation: one ACCESS per row, then SUCCESS or ERROR by its status."""
    context = F.col("context") if "context" in results.columns else \
        F.lit(None).cast("map<string,string>")
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    good = F.col("status") == 200
    kinds = F.array(F.lit("ACCESS"), F.when(good, "SUCCESS").otherwise("ERROR"))
    action, data_type = (F.lit(x) if isinstance(x, str) else x for x in (action, data_type))
    rows = results.select(
        "uuid", action.alias("action"), data_type.alias("data_type"),
        context.alias("user_context"), good.alias("success"), error.alias("error_message"),
        at.alias("created_at"), F.explode(kinds).alias("event_type"))
    rows = rows.withColumn("success", (F.col("event_type") == "ACCESS") | F.col("success"))
    return tb.conform(rows, "audit")

