"""The queries registered with the driver: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import masks
from ..functions import pseudonyms as ps
from ..functions import spans as sp
from ..functions.rules import ALL_RULES, rules_for
from ..operators import rule_table, spanjoin
from ..operators import anonymize as an
from ..operators import checks, detect, jsonrec, profile, reports, requests, restore, stores, structrec, upkeep
from ..session import stage, work_folder
from ..sources import records as rec
from ..sources import tables as tb
from ..streaming import jobs
from . import derive as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MATCH = ["doc_id", "type", "original", "begin", "end", "score"]
AT = "timestamp'2024-01-01 00:00:00'"
KEPT_TERMS = ["Type 2 Diabetes", "E11.9", "Hypertension", "Metformin 1000mg BID",
              "Glucose: 256 mg/dL", "145/92 mmHg", "MMSE Score: 24/30", "Patricia"]


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f
    return add


def _at():
    return F.expr(AT)


def _naive(column: str):
    """A timestamp without a zone, as the given tables have it."""
    return F.col(column).cast("timestamp_ntz").alias(column)


# ---- detectors ------------------------------------------------------------------------------------

def _detector(name: str, source: Callable, *types: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detect.detections(source(spark, sf), ["doc_id"], rules=rules_for(*types)).select(MATCH)
    QUERIES[name] = run


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return d.spread(d.table(spark, sf, "pages").selectExpr("page_id AS doc_id", "url || chr(10) || html AS text"))


for _name, _src, _types in [
        ("detect_name", d.notes, ("NAME",)), ("detect_name_documents", d.documents, ("NAME",)),
        ("detect_email", d.documents, ("EMAIL",)), ("detect_phone", d.documents, ("PHONE_NUMBER",)),
        ("detect_phone_notes", d.notes, ("PHONE_NUMBER",)), ("detect_ssn", d.notes, ("SSN",)),
        ("detect_date", d.notes, ("DATE",)), ("detect_card", d.documents, ("CREDIT_DEBIT_NUMBER",)),
        ("detect_zip", d.notes, ("ZIP",)), ("detect_address", d.notes, ("ADDRESS",)),
        ("detect_mrn", d.notes, ("MRN",)), ("detect_insurance", d.notes, ("INSURANCE_ID",)),
        ("detect_license", d.notes, ("LICENSE_NUMBER",)),
        ("detect_vehicle", d.notes, ("VEHICLE_ID",)), ("detect_device", d.notes, ("DEVICE_ID",)),
        ("detect_url", _pages, ("URL",)), ("detect_ip", d.documents, ("IP_ADDRESS",)),
        ("detect_biometric", d.notes, ("BIOMETRIC_ID",)),
        ("detect_trial", d.notes, ("CLINICAL_TRIAL_ID",)),
        ("detect_employee", d.notes, ("EMPLOYEE_ID",)), ("detect_age", d.notes, ("AGE",))]:
    _detector(_name, _src, *_types)


@query("text_source")
def text_source(spark, sf):
    return rec.read_text(spark, f"{sf}/documents.parquet", identity="source", identity_type="SOURCE")


@query("provider_exclusion")
def provider_exclusion(spark, sf):
    found = d.notes(spark, sf).withColumn("fences", sp.provider_spans("text"))
    rows = detect.explode_spans(found.select("doc_id", "fences"), ["doc_id"], "fences")
    return rows.select("doc_id", "original", "begin", "end")


@query("medical_exclusion")
def medical_exclusion(spark, sf):
    raw = d.notes(spark, sf).withColumn("raw", sp.raw_matches("text", rules_for("NAME")))
    rows = detect.explode_spans(raw.select("doc_id", "raw"), ["doc_id"], "raw")
    return rows.filter(F.expr(sp.non_name_sql("original"))).select("doc_id", "original", "begin", "end")


@query("detect_all")
def detect_all(spark, sf):
    found = detect.with_spans(d.documents(spark, sf)).select("doc_id", "spans")
    return detect.explode_spans(found, ["doc_id"]).select(MATCH)


@query("resolve_overlaps")
def resolve_overlaps(spark, sf):
    found = detect.with_spans(d.notes(spark, sf)).select("doc_id", "spans")
    return detect.explode_spans(found, ["doc_id"]).select(MATCH)


@query("overlap_pairs")
def overlap_pairs(spark, sf):
    return detect.overlap_pairs(detect.with_candidates(d.notes(spark, sf)), ["doc_id"])


def _external(spark, sf):
    """Stand-in for another detector's output: drug names in the notes, half of them medical."""
    n = d.notes(spark, sf)
    return n.selectExpr(
        "doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'MEDICATION' ELSE 'PRODUCT' END AS type",
        "instr(text, 'Metformin') - 1 AS begin", "instr(text, 'Metformin') + 8 AS end",
        "'Metformin' AS original", "0.97D AS score")


@query("external_entities")
def external_entities(spark, sf):
    found = detect.with_spans_and_external(d.notes(spark, sf), _external(spark, sf))
    return detect.explode_spans(found.select("doc_id", "spans"), ["doc_id"]).select(MATCH)


def _rule_table(spark, sf):
    """A rule table as Parquet: references that the built-in rules don't know."""
    path = work_folder(spark, "rules")
    rows = [("POLICY_REF", 9001, "(policy )(XY[0-9]{8})()", 0.97, True, False, ["policy"]),
            ("PLATE_REF", 9002, "\\bKX-[0-9]{3}\\b", 0.99, False, False, None)]
    spark.createDataFrame(rows, rule_table.SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@query("detect_custom_rules")
def detect_custom_rules(spark, sf):
    """Detections by a rule table that is data."""
    rules = rule_table.rules_from(_rule_table(spark, sf))
    return detect.detections(d.notes(spark, sf), ["doc_id"], rules=rules).select(MATCH)


@query("external_overlap_join")
def external_overlap_join(spark, sf):
    """Our detections and another detector's, both kept as tables, where they overlap."""
    ours = detect.detections(d.notes(spark, sf), ["doc_id"], rules=rules_for("NAME", "DATE", "AGE")).select(
        "doc_id", "type", "begin", "end")
    # both spans of a note from one pass over the notes
    theirs = d.notes(spark, sf).selectExpr("doc_id", (
        "inline(array(named_struct('type', 'LINE', 'begin', instr(text, 'Patient: ') - 1, 'end', instr(text, 'Phone: ') - 1), "
        "named_struct('type', 'TAIL', 'begin', instr(text, 'Age: ') - 1, 'end', length(text))))"))
    return spanjoin.overlaps(stage(ours, "ours"), theirs, "doc_id", bin_width=64)


@query("min_length_rule")
def min_length_rule(spark, sf):
    found = detect.with_spans(d.documents(spark, sf)).select(
        "doc_id", detect.drop_short(F.col("spans")).alias("spans"))
    return detect.explode_spans(found, ["doc_id"]).select("doc_id", "type", "original")


@query("entities_by_type")
def entities_by_type(spark, sf):
    found = detect.with_spans(d.documents(spark, sf))
    return detect.entities_by_type(found, ["doc_id"]).select(
        "doc_id", "type", F.array_join("originals", "|").alias("originals"))


# ---- replacement values and masks ------------------------------------------------------------------

def _values(spark, sf, **columns):
    df = d.orders(spark, sf, doc_id="o_orderkey", identity=d.IDENTITY,
                  identity_type="'CUSTOMER'", **columns)
    return an.with_uuid(df, d.SECRET)


def _fake(type_: str, column: str):
    return ps.fake(d.SECRET, "uuid", f"'{type_}'", column)


def _generator(name: str, type_: str, value: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _values(spark, sf, v=value).select("doc_id", _fake(type_, "v").alias("fake"))
    QUERIES[name] = run


for _name, _type, _value in [
        ("fake_name", "NAME", f"{d.FIRST} || ' ' || {d.LAST}"), ("fake_address", "ADDRESS", d.ADDRESS),
        ("fake_phone", "PHONE_NUMBER", d.PHONE), ("fake_email", "EMAIL", d.EMAIL),
        ("fake_ssn", "SSN", d.SSN), ("fake_card", "CREDIT_DEBIT_NUMBER", d.CARD),
        ("fake_url", "URL", d.URL), ("fake_ip", "IP_ADDRESS", d.IP), ("fake_dob", "DOB", d.DATE),
        ("fake_other", "PASSPORT", d.MRN)]:
    _generator(_name, _type, _value)

ID_TYPES = ["MRN", "INSURANCE_ID", "LICENSE_NUMBER", "VEHICLE_ID", "DEVICE_ID", "BIOMETRIC_ID",
            "CLINICAL_TRIAL_ID", "EMPLOYEE_ID"]


@query("fake_ids")
def fake_ids(spark, sf):
    return _values(spark, sf, v=d.MRN).select(
        "doc_id", *[_fake(t, "v").alias(t.lower()) for t in ID_TYPES])


MIXED_DATES = f"CASE o_orderkey % 9 WHEN 6 THEN {d.DD} || '-' || {d.MM} || '-' || {d.YYYY} " \
              f"WHEN 7 THEN '31/31/' || {d.YYYY} WHEN 8 THEN {d.MM} || '/' || {d.DD} || '/99' " \
              f"ELSE {d.DATE_LINE} END"


@query("mask_date")
def mask_date(spark, sf):
    return d.orders(spark, sf, doc_id="o_orderkey", v=MIXED_DATES).select(
        "doc_id", masks.mask_date("v").alias("masked"))


@query("mask_zip")
def mask_zip(spark, sf):
    return d.orders(spark, sf, doc_id="o_orderkey", v=d.ZIP).select(
        "doc_id", masks.mask_zip("v").alias("masked"))


@query("mask_dob")
def mask_dob(spark, sf):
    return d.orders(spark, sf, doc_id="o_orderkey", v=MIXED_DATES).select(
        "doc_id", masks.mask_dob("v").alias("masked"))


@query("mask_age")
def mask_age(spark, sf):
    return d.orders(spark, sf, doc_id="o_orderkey", v="CAST(80 + o_orderkey % 25 AS INT)").select(
        "doc_id", masks.mask_age("v").alias("masked"))


# ---- anonymise and restore ---------------------------------------------------------------------------

@query("anonymize_documents")
def anonymize_documents(spark, sf):
    return an.anonymize(d.documents(spark, sf), d.SECRET).select(
        "doc_id", "uuid", "anonymized", "status", "entities_detected")


@query("anonymize_notes")
def anonymize_notes(spark, sf):
    return an.anonymize(d.notes(spark, sf), d.SECRET).select(
        "doc_id", "uuid", "anonymized", "entities_detected")


@query("redact_text")
def redact_text(spark, sf):
    return an.redact(d.documents(spark, sf)).select("doc_id", "redacted")


def _registry(spark, sf, all_customers: bool = False):
    """A registry taken over from elsewhere: customers outside one segment, with their own uuids."""
    c = d.table(spark, sf, "customer")
    if not all_customers:
        c = c.filter("c_mktsegment <> 'BUILDING'")
    return c.selectExpr("'known-' || CAST(c_custkey AS STRING) AS uuid",
                        "'cust-' || CAST(c_custkey AS STRING) AS identity",
                        "'CUSTOMER' AS identity_type", f"{AT} AS created_at")


def _legacy_mappings(spark, sf):
    """Mappings taken over from elsewhere: a name per customer of one segment."""
    c = d.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr(
        "c_custkey AS o_custkey", "c_custkey AS o_orderkey").selectExpr(
        f"{d.IDENTITY} AS identity", "'CUSTOMER' AS identity_type",
        f"upper({d.FIRST} || ' ' || {d.LAST}) AS original",
        "'Legacy Person ' || CAST(o_custkey AS STRING) AS fake")
    return an.with_uuid(c, d.SECRET).select(
        "uuid", F.lit("name").alias("pii_type"), "original", F.lit("faker").alias("fake_type"),
        "fake", _at().alias("created_at"))


@query("anonymize_text")
def anonymize_text(spark, sf):
    out = an.anonymize(d.notes(spark, sf), d.SECRET, mappings=_legacy_mappings(spark, sf))
    return out.select("doc_id", "anonymized", "entities_detected")


@query("resolve_mappings")
def resolve_mappings(spark, sf):
    rows = _values(spark, sf, type="'NAME'", original=f"{d.FIRST} || ' ' || {d.LAST}")
    return stores.resolve_mappings(rows, _legacy_mappings(spark, sf), d.SECRET).select(
        "doc_id", "fake", "is_new")


def _anonymized_notes(spark, sf):
    return stage(an.anonymize(d.notes(spark, sf), d.SECRET).select(
        "doc_id", "uuid", "text", "anonymized", "entities", "entities_detected"), "notes")


def _mappings_of(anonymized):
    return an.mapping_rows(anonymized).withColumn("created_at", _at())


@query("deanonymize_text")
def deanonymize_text(spark, sf):
    done = _anonymized_notes(spark, sf)
    return restore.restore_by_value(done.select("doc_id", "uuid", "anonymized"), _mappings_of(done)
                                    ).select("doc_id", "restored", "entities_restored", "ambiguous")


@query("deanonymize_foreign")
def deanonymize_foreign(spark, sf):
    """Replacements of any shape, from a table taken over from elsewhere."""
    rows = _values(spark, sf, text="'seen: Legacy Person ' || CAST(o_custkey AS STRING) || ' today'")
    return restore.restore_by_value(rows, _legacy_mappings(spark, sf), "text").select(
        "doc_id", "restored", "entities_restored")


@query("restore_by_ledger")
def restore_by_ledger(spark, sf):
    done = _anonymized_notes(spark, sf)
    return restore.restore_by_ledger(done.select("doc_id", "anonymized"), an.ledger_rows(done)).select(
        "doc_id", "restored")


@query("ledger_rows")
def ledger_rows(spark, sf):
    done = an.anonymize(d.documents(spark, sf), d.SECRET)
    return an.ledger_rows(done).select("doc_id", "pii_type", "begin", "end", "out_begin", "out_end",
                                       "original", "fake")


# ---- profiles ------------------------------------------------------------------------------------------

@query("profile_scan")
def profile_scan(spark, sf):
    raw = d.orders(spark, sf, doc_id="o_orderkey", raw=f"'{{' || chr(39) || 'name' || chr(39) || ': ' || "
                   f"chr(39) || {d.FIRST} || chr(39) || ', \"age\": ' || {d.AGE} || '}}'")
    rows = rec.parse_profile(raw, "raw").select("doc_id", F.explode_outer("profile"))
    return rows.select("doc_id", "key", "value")


@query("anonymize_profile")
def anonymize_profile(spark, sf):
    out = profile.anonymize_profile(d.profiles(spark, sf), d.SECRET)
    return out.select("doc_id", F.explode_outer("anonymized")).select("doc_id", "key", "value")


@query("deanonymize_profile")
def deanonymize_profile(spark, sf):
    done = stage(profile.anonymize_profile(d.profiles(spark, sf), d.SECRET).select(
        "doc_id", "uuid", "anonymized", "entities"), "profiles")
    back = profile.restore_profile(done.select("doc_id", "uuid", "anonymized"), _mappings_of(done))
    return back.select("doc_id", F.explode_outer("restored")).select("doc_id", "key", "value")


@query("restore_profile_by_ledger")
def restore_profile_by_ledger(spark, sf):
    """Every field as it was, those included that held more than the identifier."""
    done = stage(profile.anonymize_profile(d.profiles(spark, sf), d.SECRET).select(
        "doc_id", "uuid", "profile", "anonymized"), "profiles")
    back = profile.restore_profile_by_ledger(done.select("doc_id", "anonymized"), profile.ledger_rows(done))
    return back.select("doc_id", F.explode_outer("restored")).select("doc_id", "key", "value")


# ---- JSON --------------------------------------------------------------------------------------------

RECORD_SCHEMA = ("patient struct<name:string,dob:string,mrn:string,phone:string>, visit struct<date:string,"
                 "provider:string,note:string>, diagnoses array<string>, medications array<struct<name:string,"
                 "dose:string>>, vitals struct<heart_rate:int,temperature:double,note:string,empty:string>")


@query("json_scan")
def json_scan(spark, sf):
    rows = rec.parse_json(d.records(spark, sf), "record", RECORD_SCHEMA, "r")
    return rows.select("doc_id", F.col("r.patient.name").alias("name"),
                       F.col("r.vitals.heart_rate").alias("heart_rate"),
                       F.size("r.diagnoses").alias("diagnoses"), "record")


@query("json_leaves")
def json_leaves(spark, sf):
    return jsonrec.leaf_rows(d.records(spark, sf), ["doc_id"], "record").select("doc_id", "value")


def _anonymized_records(spark, sf):
    return stage(jsonrec.anonymize_json(d.records(spark, sf), d.SECRET), "records")


@query("anonymize_json")
def anonymize_json(spark, sf):
    return jsonrec.anonymize_json(d.records(spark, sf), d.SECRET).select(
        "doc_id", "anonymized", "status", "entities_detected")


@query("anonymize_json_struct")
def anonymize_json_struct(spark, sf):
    typed = rec.parse_json(d.records(spark, sf), "record", RECORD_SCHEMA, "r").drop("record")
    out = structrec.anonymize_struct(typed, d.SECRET, "r")
    return out.select("doc_id", F.col("r.patient.name").alias("name"),
                      F.col("r.visit.provider").alias("provider"),
                      F.col("r.vitals.heart_rate").alias("heart_rate"))


@query("restore_struct_by_ledger")
def restore_struct_by_ledger(spark, sf):
    """Typed records through the ledger and back."""
    typed = rec.parse_json(d.records(spark, sf), "record", RECORD_SCHEMA, "r").drop("record")
    done = stage(structrec.anonymize_struct(typed, d.SECRET, "r"), "structs")
    back = structrec.restore_struct_by_ledger(done.select("doc_id", "r"), structrec.ledger_rows(done, "r"), "r")
    return back.select("doc_id", F.col("r.patient.name").alias("name"), F.col("r.patient.dob").alias("dob"),
                       F.col("r.diagnoses")[1].alias("diagnosis"), F.col("r.medications")[0]["dose"].alias("dose"),
                       F.col("r.vitals.note").alias("note"), "unclear")


@query("deanonymize_json")
def deanonymize_json(spark, sf):
    done = _anonymized_records(spark, sf)
    return jsonrec.restore_json(done.select("doc_id", "uuid", "anonymized"), _mappings_of(done)).select(
        "doc_id", "restored", "entities_restored", "ambiguous", "status")


@query("restore_json_by_ledger")
def restore_json_by_ledger(spark, sf):
    done = _anonymized_records(spark, sf)
    return jsonrec.restore_json_by_ledger(done.select("doc_id", "anonymized"),
                                          jsonrec.ledger_rows(done)).select("doc_id", "restored")


@query("structure_check")
def structure_check(spark, sf):
    done = jsonrec.anonymize_json(d.records(spark, sf), d.SECRET)
    changed = F.when(jsonrec.jt.skeleton(F.col("record")) != jsonrec.jt.skeleton(F.col("anonymized")), 1)
    return done.agg(F.count(F.lit(1)).alias("records"), F.count(changed).alias("changed"))


@query("legacy_guard")
def legacy_guard(spark, sf):
    old = an.with_uuid(d.table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").selectExpr(
        "'cust-' || CAST(c_custkey AS STRING) AS identity", "'CUSTOMER' AS identity_type"), d.SECRET)
    mappings = old.select("uuid", F.lit("JSON_STRUCTURE").alias("pii_type"))
    return jsonrec.legacy_guard(_values(spark, sf).select("doc_id", "uuid"), mappings).select(
        "doc_id", "status")


@query("bad_records")
def bad_records(spark, sf):
    broken = d.records(spark, sf).withColumn("record", F.expr(
        "CASE WHEN doc_id % 3 = 1 THEN substr(record, 1, length(record) - 4) ELSE record END"))
    out = requests.failed_records(broken, "record")
    return out.select("doc_id", "status", "error")


# ---- requests, consent, audit, history -----------------------------------------------------------------

def _requests(spark, sf):
    """A mixed batch: the method and the payload that is there depend on the order."""
    columns = dict(
        request_id="o_orderkey", identity=d.IDENTITY, identity_type="'customer'", k="o_orderkey % 7", phone=d.PHONE,
        note=f"'Call ' || {d.PHONE} || ' by ' || {d.DATE}",
        record="'{\"phone\": \"' || " + d.PHONE + " || '\", \"n\": 1.50}'", purpose="o_orderstatus",
        reason="'case ' || CAST(o_orderkey AS STRING)", clerk="'dr-' || CAST(o_custkey % 50 AS STRING)")
    df = d.dealt_orders(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()]).withColumn(
        "uuid", ps.identity_uuid(d.SECRET, "upper(identity)", "upper(identity_type)"))
    fake = _fake("PHONE_NUMBER", "phone")
    k = F.col("k")
    return df.select(
        "request_id", "identity", "identity_type", "purpose", "uuid", "phone", "reason", "clerk",
        F.expr("CASE k WHEN 0 THEN 'anonymize' WHEN 1 THEN 'ANONYMIZE_JSON' WHEN 2 THEN 'ANONYMIZE' "
               "WHEN 3 THEN 'DE-ANONYMIZE' WHEN 4 THEN 'DE_ANONYMIZE_JSON' WHEN 5 THEN 'DE-ANONYMIZE' "
               "ELSE 'ERASE' END").alias("method"),
        F.when(k == 0, F.col("note")).when(k == 3, F.concat(F.lit("call "), fake)).alias("conversation"),
        F.when(k == 1, F.col("record")).when(k == 4, F.concat(
            F.lit('{"phone": "'), fake, F.lit('"}'))).alias("json_data"),
        F.when(k == 2, F.create_map(F.lit("phone"), F.col("phone"))).when(
            k == 5, F.create_map(F.lit("phone"), fake)).alias("profile"),
        F.create_map(F.lit("requires_consent"), F.lit("true"), F.lit("purpose"), F.when(
            F.col("purpose") == "F", "marketing").otherwise("emergency_care"), F.lit("access_reason"), F.col("reason"),
            F.lit("authorized_by"), F.col("clerk")).alias("context"))


def _known(reqs):
    """What is stored before the batch: the phones that the restores ask for."""
    return reqs.select("uuid", F.lit("PHONE_NUMBER").alias("pii_type"), F.col("phone").alias("original"),
                       F.lit("keyed").alias("fake_type"), _fake("PHONE_NUMBER", "phone").alias("fake"),
                       _at().alias("created_at")).distinct()


def _served(spark, sf, times=1):
    """A batch served against stores in a work folder, so many times, as after a failure; the stores' paths."""
    base = work_folder(spark, "serve")
    paths = {name: f"{base}/{name}" for name in ("results", "identities", "mappings", "history", "audit", "ledger")}
    reqs = _requests(spark, sf)
    tb.append_store(_known(reqs.filter("k IN (3, 4, 5)")), paths["mappings"], "mappings")
    for _ in range(times):
        requests.serve(reqs.drop("uuid"), paths, d.SECRET, 1, _at())
    return paths


@query("route_requests")
def route_requests(spark, sf):
    reqs = _requests(spark, sf)
    return requests.route(reqs.drop("uuid"), _known(reqs), d.SECRET).select(
        "request_id", "handler", "status", "result", "error")


@query("route_results")
def route_results(spark, sf):
    """Results, mappings and identities of a batch that ran twice."""
    paths = _served(spark, sf, 2)
    results = spark.read.parquet(paths["results"]).selectExpr("'result' AS store", "uuid", "result AS value")
    maps = tb.read_store(spark, paths["mappings"], "mappings").selectExpr("'mapping' AS store", "uuid", "original AS value")
    ids = tb.read_store(spark, paths["identities"], "identities").selectExpr("'identity' AS store", "uuid", "identity AS value")
    return results.unionByName(maps).unionByName(ids)


@query("route_history")
def route_history(spark, sf):
    rows = tb.read_store(spark, _served(spark, sf)["history"], "history")
    return rows.select("uuid", "original", "anonymized", "method", "metadata", _naive("created_at"))


@query("route_audit")
def route_audit(spark, sf):
    rows = tb.read_store(spark, _served(spark, sf)["audit"], "audit")
    return rows.select("uuid", "event_type", "action", "data_type", "success", "error_message",
                       F.col("user_context")["purpose"].alias("purpose"), _naive("created_at"))


@query("route_ledger")
def route_ledger(spark, sf):
    """The results of a served batch put back by its ledger."""
    paths = _served(spark, sf)
    done = spark.read.parquet(paths["results"]).filter("handler = 'ANONYMIZE' AND status = 200").selectExpr(
        "request_id AS doc_id", "result")
    return restore.restore_by_ledger(done, tb.read_store(spark, paths["ledger"], "ledger"), "result").select(
        "doc_id", "restored", "unclear")


@query("restore_metadata")
def restore_metadata(spark, sf):
    reqs = _requests(spark, sf)
    return reqs.select("request_id", an.restore_metadata(F.col("context")).alias("metadata"))


@query("bad_requests")
def bad_requests(spark, sf):
    """Broken request lines and requests that fail, each in the dead-letter table with its reason."""
    base = work_folder(spark, "lines")
    whole = _requests(spark, sf).select(F.to_json(F.struct(
        "request_id", "method", "identity", "identity_type", "conversation", "json_data", "profile", "context")).alias("value"),
        "request_id")
    broken = whole.withColumn("value", F.when(F.col("request_id") % 5 == 1, F.expr(
        "substr(value, 1, length(value) - 3)")).otherwise(F.col("value")))
    broken.select("value").write.text(f"{base}/in")
    good, dead = requests.read_lines(spark, f"{base}/in")
    empty = spark.createDataFrame([], tb.MAPPINGS)
    failed = requests.dead_letters(requests.served(good, empty, d.SECRET), _at())
    tb.append_store(dead.unionByName(failed), f"{base}/dead", "dead_letters", batch=1)
    return tb.read_store(spark, f"{base}/dead", "dead_letters").select(
        "request_id", "handler", "reason", F.col("source_file").isNotNull().alias("from_file"))


@query("consent_gate")
def consent_gate(spark, sf):
    df = d.orders(spark, sf, doc_id="o_orderkey", asks="CASE WHEN o_orderstatus = 'F' THEN 'true' END",
                  purpose="CASE o_orderkey % 4 WHEN 0 THEN 'testing' WHEN 1 THEN 'emergency_care' "
                          "WHEN 2 THEN 'quality_improvement' END")
    ctx = F.create_map(F.lit("requires_consent"), F.col("asks"), F.lit("purpose"), F.col("purpose"))
    return df.select("doc_id", an.consent_status(ctx).alias("status"))


@query("op_metadata")
def op_metadata(spark, sf):
    df = d.documents(spark, sf).withColumn("context", F.create_map(
        F.lit("purpose"), F.lit("quality_improvement")))
    out = an.anonymize(df, d.SECRET)
    return out.select("doc_id", an.operation_metadata(F.col("entities"), F.col("context")).alias(
        "metadata"))


@query("history_append")
def history_append(spark, sf):
    path = work_folder(spark, "history")
    out = an.anonymize(d.documents(spark, sf), d.SECRET)
    tb.append_store(an.history_rows(out, "ANONYMIZE", _at()), path, "history")
    back = tb.read_store(spark, path, "history")
    return back.select("uuid", "original", "anonymized", "method", "metadata", _naive("created_at"))


@query("audit_events")
def audit_events(spark, sf):
    df = d.table(spark, sf, "events").selectExpr(
        "CAST(user_id AS STRING) AS uuid", "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status",
        "CASE WHEN event_type = 'error' THEN props END AS error", "ts")
    out = requests.audit_events(df, "ANONYMIZE", "conversation", F.col("ts"))
    return out.select("uuid", "action", "event_type", "success", "error_message",
                      _naive("created_at"))


# ---- key and term rules ----------------------------------------------------------------------------------

KEYS = ["patient_name", "provider_name", "physician_name", "clinician", "home_phone", "telephone",
        "contact_email", "ip_address", "street_address", "zip_code", "ssn", "social_security", "mrn",
        "medical_record", "visit_date", "birth", "insurance_no", "beneficiary", "license", "device_ref",
        "implant_serial", "website", "staff_id", "vin", "license_plate", "retinal_scan", "trial",
        "diagnosis", "heart_rate", "doctor_phone", "employer", "shipping", "unique_id", "photo"]
KEY_SQL = (f"split_part('{','.join(KEYS)}', ',', CAST(p_partkey % {len(KEYS)} AS INT) + 1) || '_' || "
           "lower(replace(p_brand, '#', ''))")
KEY_VALUE_SQL = "CASE WHEN p_size % 2 = 0 THEN 'NCT0001' ELSE p_type END"


def _keys(spark, sf):
    return d.table(spark, sf, "part").selectExpr("p_partkey", f"{KEY_SQL} AS key",
                                                 f"{KEY_VALUE_SQL} AS value")


@query("key_is_identifier")
def key_is_identifier(spark, sf):
    return _keys(spark, sf).select("p_partkey", "key", cl.is_identifier_key(F.col("key")).alias("yes"))


@query("key_type")
def key_type(spark, sf):
    return _keys(spark, sf).select("p_partkey", "key", cl.key_type(F.col("key")).alias("type"))


@query("key_value_type")
def key_value_type(spark, sf):
    return _keys(spark, sf).select("p_partkey", "key", cl.field_type(
        F.col("key"), F.col("value")).alias("type"))


@query("is_medical")
def is_medical(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", cl.is_medical(F.col("text")).alias("yes"))


@query("is_provider")
def is_provider(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", cl.is_provider(F.col("text")).alias("yes"))


@query("should_preserve")
def should_preserve(spark, sf):
    return d.table(spark, sf, "conversations").select(
        "conv_id", "turn", cl.should_preserve(F.col("text")).alias("yes"))


# ---- stores -----------------------------------------------------------------------------------------------

def _wanted(spark, sf):
    return d.orders(spark, sf, identity=d.IDENTITY, identity_type="'CUSTOMER'")


@query("identity_registry")
def identity_registry(spark, sf):
    return stores.register_identities(_wanted(spark, sf), _registry(spark, sf), d.SECRET, _at()).select(
        "uuid", "identity", "identity_type", "is_new")


def _order_mappings(spark, sf):
    """Mapping rows from orders: several types, some not counted, under the registry's uuids."""
    return d.orders(
        spark, sf, uuid="'known-' || CAST(o_custkey AS STRING)",
        pii_type="CASE o_orderkey % 5 WHEN 0 THEN 'PHONE_NUMBER' WHEN 1 THEN 'ZIP' WHEN 2 THEN 'DATE' "
                 "WHEN 3 THEN 'NAME' ELSE 'JSON_STRUCTURE' END",
        original=f"CASE o_orderkey % 5 WHEN 0 THEN {d.PHONE} WHEN 1 THEN {d.ZIP} WHEN 2 THEN {d.DATE} "
                 f"WHEN 3 THEN {d.LAST} ELSE '{{}}' END",
        fake_type="'keyed'", fake="'F' || CAST(o_orderkey % 3 AS STRING)", created_at="o_orderdate",
        ord="o_orderkey")


@query("identity_mappings")
def identity_mappings(spark, sf):
    return stores.mappings_of(_wanted(spark, sf), _registry(spark, sf), _order_mappings(spark, sf)
                              ).select("identity", "uuid", "pii_type", "original", "fake")


@query("mapping_lookup_pruned")
def mapping_lookup_pruned(spark, sf):
    """Stored mappings of the customers of a few accounts, from the folders of their uuids only."""
    path = work_folder(spark, "mappings")
    tb.append_store(stores.dedup_mappings(_order_mappings(spark, sf), F.col("ord")), path, "mappings")
    who = d.table(spark, sf, "customer").filter("c_acctbal > 9900").selectExpr(
        "'known-' || CAST(c_custkey AS STRING) AS uuid")
    return tb.read_store(spark, path, "mappings", who).join(who, "uuid", "left_semi").select(
        "uuid", "pii_type", "original", "fake")


@query("mapping_upsert")
def mapping_upsert(spark, sf):
    rows = _order_mappings(spark, sf)
    stored = rows.filter("created_at < timestamp'1996-01-01'").select("uuid", "pii_type", "original")
    return stores.mappings_to_insert(rows, stored, F.col("ord")).select(
        "uuid", "pii_type", "original", "fake", "ord")


@query("dedup_mappings")
def dedup_mappings(spark, sf):
    return stores.dedup_mappings(_order_mappings(spark, sf), F.col("ord")).select(
        "uuid", "pii_type", "original", "fake", "ord")


@query("stats_by_type")
def stats_by_type(spark, sf):
    return reports.stats_by_type(_order_mappings(spark, sf)).select(
        "uuid", "pii_type", "entities", "level")


METHOD_SQL = ("CASE event_type WHEN 'click' THEN 'ANONYMIZE' WHEN 'view' THEN 'ANONYMIZE_JSON_SIMPLE' "
              "WHEN 'purchase' THEN 'DE-ANONYMIZE' WHEN 'signup' THEN 'ANONYMIZE_PROFILE' "
              "ELSE 'DE_ANONYMIZE_JSON' END")


def _history(spark, sf):
    return d.table(spark, sf, "events").selectExpr(
        "'known-' || CAST(user_id AS STRING) AS uuid", f"{METHOD_SQL} AS method", "ts AS created_at",
        "event_id")


@query("stats_by_method")
def stats_by_method(spark, sf):
    return reports.stats_by_method(_history(spark, sf), by_identity=True)


@query("stats_by_method_all")
def stats_by_method_all(spark, sf):
    return reports.stats_by_method(_history(spark, sf))


@query("stats_summary")
def stats_summary(spark, sf):
    return reports.stats_summary(_order_mappings(spark, sf), _history(spark, sf))


@query("user_summary")
def user_summary(spark, sf):
    out = reports.user_summary(_wanted(spark, sf), _registry(spark, sf), _order_mappings(spark, sf),
                               _history(spark, sf))
    return out.select("identity", "uuid", F.to_json("entities").alias("entities"),
                      F.to_json("operations").alias("operations"), "first_activity", "last_activity",
                      "total_entities", "total_operations", "error")


NOW = "timestamp'1999-01-01 00:00:00'"


@query("retention_keep")
def retention_keep(spark, sf):
    rows = d.table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate AS created_at")
    return stores.keep_recent(rows, F.expr(NOW), 365)


@query("cleanup_counts")
def cleanup_counts(spark, sf):
    rows = d.table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate AS created_at")
    return stores.cleanup_counts(rows, _order_mappings(spark, sf), _registry(spark, sf), F.expr(NOW), 365)


@query("orphan_mappings")
def orphan_mappings(spark, sf):
    return stores.orphan_mappings(_order_mappings(spark, sf), _registry(spark, sf)).select(
        "uuid", "pii_type", "original", "ord")


@query("erase_identity")
def erase_identity(spark, sf):
    gone = d.table(spark, sf, "customer").filter("c_acctbal < 0").selectExpr(
        "'known-' || CAST(c_custkey AS STRING) AS uuid")
    kept = stores.erase_identities({"mappings": _order_mappings(spark, sf), "history": _history(spark, sf)},
                                   gone)
    return kept["mappings"].selectExpr("'mappings' AS store", "uuid", "ord AS id").unionByName(
        kept["history"].selectExpr("'history' AS store", "uuid", "event_id AS id"))


def _stores(spark, sf):
    """Mappings, identities and history written to a work folder."""
    base = work_folder(spark, "stores")
    tb.append_store(stores.dedup_mappings(_order_mappings(spark, sf), F.col("ord")), f"{base}/mappings", "mappings")
    tb.append_store(_registry(spark, sf), f"{base}/identities", "identities")
    past = _history(spark, sf).withColumn("original", F.col("event_id").cast("string"))
    tb.append_store(past, f"{base}/history", "history")
    return base


@query("erase_stored")
def erase_stored(spark, sf):
    """What the written tables hold after an erasure that writes only touched folders anew."""
    base = _stores(spark, sf)
    gone = d.table(spark, sf, "customer").filter("c_acctbal < 0").selectExpr(
        "'known-' || CAST(c_custkey AS STRING) AS uuid")
    for table in ("mappings", "history"):
        upkeep.erase(spark, f"{base}/{table}", table, gone)
    return tb.read_store(spark, f"{base}/mappings", "mappings").selectExpr(
        "'mappings' AS store", "uuid", "original AS id").unionByName(tb.read_store(
            spark, f"{base}/history", "history").selectExpr("'history' AS store", "uuid", "original AS id"))


@query("cleanup_stored")
def cleanup_stored(spark, sf):
    """Retention and orphans on written tables: what is left of each."""
    base = _stores(spark, sf)
    last = tb.read_store(spark, f"{base}/history", "history").agg(F.max("created_at")).first()[0]
    upkeep.expire(spark, f"{base}/history", "history", last, 7)
    upkeep.drop_orphans(spark, f"{base}/mappings", f"{base}/identities")
    return tb.read_store(spark, f"{base}/mappings", "mappings").selectExpr(
        "'mappings' AS store", "uuid", "original AS id").unionByName(tb.read_store(
            spark, f"{base}/history", "history").selectExpr("'history' AS store", "uuid", "original AS id"))


@query("fake_collisions")
def fake_collisions(spark, sf):
    return stores.fake_collisions(_order_mappings(spark, sf)).select("uuid", "fake", "originals")


@query("separate_collisions")
def separate_collisions(spark, sf):
    """After separating, no keyed replacement stands for two originals. Masks, which are meant to collide, are left out."""
    keyed = _order_mappings(spark, sf).filter(F.col("pii_type").isin("PHONE_NUMBER", "NAME"))
    rows = stores.dedup_mappings(keyed, F.col("ord"))
    fixed = stage(stores.separate_collisions(rows, d.SECRET), "separated")
    zero = F.lit(0).cast("bigint")
    both = fixed.agg(F.count(F.lit(1)).alias("mappings"), zero.alias("collisions")).unionByName(
        stores.fake_collisions(fixed).agg(zero.alias("mappings"), F.count(F.lit(1)).alias("collisions")))
    return both.agg(F.sum("mappings").alias("mappings"), F.sum("collisions").alias("collisions"))


# ---- checks ------------------------------------------------------------------------------------------------

@query("leak_check")
def leak_check(spark, sf):
    return checks.leaks(an.anonymize(d.notes(spark, sf), d.SECRET))


PLANTED = [("NAME", f"{d.FIRST} || ' ' || {d.LAST}"), ("NAME", f"CASE WHEN {d.LAST} <> {d.LAST2} THEN {d.LAST} END"),
           ("EMAIL", d.EMAIL), ("SSN", d.SSN), ("MRN", d.MRN), ("PHONE_NUMBER", d.PHONE), ("ADDRESS", d.ADDRESS)]


@query("leak_planted")
def leak_planted(spark, sf):
    """What is known to have stood in the notes, whether or not a detector took it. Expected to be empty."""
    planted = ", ".join(f"named_struct('type', '{t}', 'original', {v})" for t, v in PLANTED)
    raw = d.dealt_orders(spark, sf).selectExpr("o_orderkey AS doc_id", f"{d.IDENTITY} AS identity",
                                               "'CUSTOMER' AS identity_type", f"{d.NOTE} AS text",
                                               f"array({planted}) AS planted")
    return checks.planted_leaks(an.anonymize(raw, d.SECRET), "planted")


@query("preservation_check")
def preservation_check(spark, sf):
    return checks.kept_terms(an.anonymize(d.notes(spark, sf), d.SECRET), KEPT_TERMS)


@query("roundtrip_check")
def roundtrip_check(spark, sf):
    done = stage(an.anonymize(d.documents(spark, sf), d.SECRET).select(
        "doc_id", "uuid", "text", "anonymized", "entities"), "roundtrip")
    back = restore.restore_by_ledger(done.select("doc_id", "text", "anonymized"), an.ledger_rows(done))
    return back.agg(F.count(F.lit(1)).alias("texts"), F.count_if(
        ~F.col("text").eqNullSafe(F.col("restored"))).alias("failed"))


@query("alarm_errors")
def alarm_errors(spark, sf):
    threshold, seconds = 2, 300
    return checks.alarms(d.table(spark, sf, "events"), "ts", F.col("event_type") == "error", threshold,
                         seconds)


@query("alarm_errors_default")
def alarm_errors_default(spark, sf):
    """With the documented threshold; failed events stand for audit errors."""
    audit = d.table(spark, sf, "events").selectExpr("ts AS created_at", "upper(event_type) AS event_type")
    return checks.error_alarms(audit)


@query("lost_terms")
def lost_terms(spark, sf):
    return checks.lost_terms(an.anonymize(d.notes(spark, sf), d.SECRET), KEPT_TERMS)


@query("roundtrip_records")
def roundtrip_records(spark, sf):
    """Notes and JSON records through the ledger and back."""
    notes = _anonymized_notes(spark, sf)
    back = restore.restore_by_ledger(notes.select("doc_id", "text", "anonymized"), an.ledger_rows(notes))
    js = stage(jsonrec.anonymize_json(d.records(spark, sf), d.SECRET), "records")
    js_back = jsonrec.restore_json_by_ledger(js.select("doc_id", "record", "anonymized"), jsonrec.ledger_rows(js))

    def row(kind, df, original):
        failed = checks.not_restored(df.select(F.col(original).alias("text"), "restored")).agg(
            F.count(F.lit(1)).alias("failed"), F.lit(0).cast("bigint").alias("texts"))
        every = df.agg(F.lit(0).cast("bigint").alias("failed"), F.count(F.lit(1)).alias("texts"))
        return failed.unionByName(every).agg(F.sum("texts").alias("texts"), F.sum("failed").alias("failed")).select(
            F.lit(kind).alias("kind"), "texts", "failed")

    return row("notes", back, "text").unionByName(row("json", js_back, "record"))


@query("alarm_unauthorised")
def alarm_unauthorised(spark, sf):
    """Refused restores; a failed event stands for one."""
    audit = d.table(spark, sf, "events").selectExpr(
        "ts AS created_at", "'DE_ANONYMIZE' AS action", "event_type <> 'error' AS success")
    return checks.unauthorised_alarms(audit)


# ---- streams -------------------------------------------------------------------------------------------------

def _stream(spark, sf, name):
    # A glob, since the table may be one file or a folder of files.
    now = d.table(spark, sf, name)
    stream = spark.readStream.schema(now.schema).parquet(f"{sf}/{name}.parquet*")
    return d.dealt(stream) if name == "orders" else d.spread(stream)


@query("stream_anonymize")
def stream_anonymize(spark, sf):
    base = work_folder(spark, "stream-anonymize")
    texts = _stream(spark, sf, "documents").selectExpr(
        "doc_id", "source AS identity", "'SOURCE' AS identity_type", "text")
    jobs.anonymize_stream(texts, d.SECRET, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "anonymized", "entities_detected")


@query("stream_anonymize_stored")
def stream_anonymize_stored(spark, sf):
    """The notes as a stream, by mappings that are stored."""
    base = work_folder(spark, "stream-stored")
    tb.append_store(_legacy_mappings(spark, sf), f"{base}/mappings", "mappings")
    texts = d.as_notes(_stream(spark, sf, "orders"))
    jobs.anonymize_stream_stored(texts, d.SECRET, f"{base}/mappings", f"{base}/out", f"{base}/state").awaitTermination()
    return jobs.latest_texts(spark, f"{base}/out").select("doc_id", "anonymized", "entities_detected")


@query("stream_mappings")
def stream_mappings(spark, sf):
    base = work_folder(spark, "stream-mappings")
    texts = _stream(spark, sf, "documents").selectExpr(
        "doc_id", "source AS identity", "'SOURCE' AS identity_type", "text")
    jobs.upsert_mappings_stream(texts, d.SECRET, f"{base}/table", f"{base}/state").awaitTermination()
    return tb.read_store(spark, f"{base}/table", "mappings").select("uuid", "pii_type", "original", "fake")


@query("stream_alarms")
def stream_alarms(spark, sf):
    base = work_folder(spark, "stream-alarms")
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.alarm_stream(events, "ts", f"{base}/out", f"{base}/state",
                      alarm=(2, 300)).awaitTermination()
    return jobs.latest_alarms(spark, f"{base}/out").select(
        _naive("window_start"), _naive("window_end"), "n")


__all__ = ["ALL_RULES", "QUERIES"]
