"""Work that is dealt over the tasks, and whole rows that are shuffled no more often than needed."""

import pytest
from pyspark.sql import functions as F

from veilwork.functions import spans as sp
from veilwork.functions.rules import rules_for
from veilwork.operators import profile, requests, restore
from veilwork.plans import derive as d
from veilwork.plans import queries as q
from veilwork.session import stage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("source", [d.notes, d.records, d.profiles])
def test_one_file_is_composed_by_all_cores(spark, source):
    df = source(spark, SF)
    rows = [n for n in df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(rows) >= spark.sparkContext.defaultParallelism and sum(rows) == 1500


def test_planted_leaks_are_searched_by_all_cores(spark):
    plan = q.QUERIES["leak_planted"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_requests_are_made_without_a_join(spark):
    plan = q._requests(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_whole_requests_are_shuffled_by_row_only(spark):
    reqs = q._requests(spark, SF)
    done = requests.served(reqs.drop("uuid"), stage(q._known(reqs), "known"), d.SECRET)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and not [x for x in plan.splitlines() if "Join [uuid#" in x and "LeftOuter" in x]


def test_a_text_is_asked_only_what_its_rules_ask():
    assert "r'jan'" not in sp.detect_sql("text", tuple(rules_for("ZIP"))) and "r'jan'" in sp.detect_sql(
        "text", tuple(rules_for("DATE")))


def test_fields_that_their_key_decides_on_are_not_searched(spark, monkeypatch):
    monkeypatch.setattr(sp, "detect_sql", lambda text, rules: (
        f"if({text} = 'scan me', cast(array() as {sp.SPANS_TYPE}), cast(raise_error({text}) as {sp.SPANS_TYPE}))"))
    p = {"first_name": "Jane", "last_name": "Doe", "dob": "01/15/1960", "zip": "03601", "name": "Jane Doe",
         "provider_first_name": "Sam", "comment": "scan me", "extra": ""}
    df = spark.createDataFrame([(1, "u", "T", p)], "doc_id long, identity string, identity_type string, "
                                                   "profile map<string,string>")
    out = profile.anonymize_profile(df, "k").first().anonymized
    assert {k for k, v in p.items() if out[k] != v} == {"first_name", "last_name", "dob", "zip", "name"}


def test_both_spans_of_a_note_come_from_one_pass(spark):
    plan = q.QUERIES["external_overlap_join"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("RepartitionByExpression") + plan.count("Repartition ") == 1


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_only_units_that_fit_a_replacement_are_looked_up(spark):
    df = spark.createDataFrame([("u", "Bob saw Ann, then Bob O.")], "uuid string, text string")
    maps = spark.createDataFrame([("u", "Bob", "X"), ("u", "Bob O", "Y")], "uuid string, fake string, original string")
    coded = df.join(restore.codes_of(maps), "uuid")
    found = coded.select(restore.runs_of_units(F.col("text"), F.col("_codes")).alias("r")).first().r
    assert sorted((r.begin, r.fake) for r in found) == [(0, "Bob"), (18, "Bob"), (18, "Bob O")]


def test_what_was_found_is_shuffled_once(spark):
    maps = spark.createDataFrame([], "uuid string, pii_type string, fake string, original string")
    text = spark.createDataFrame([], "doc_id long, uuid string, anonymized string")
    ledger = spark.createDataFrame([], "doc_id long, text_hash long, out_begin int, out_end int, original string")
    assert _shuffles(restore.restore_by_ledger(text, ledger)) == 2     # the texts, the ledger
    assert _shuffles(restore.restore_by_value(text, maps)) <= 8
    fields = text.drop("anonymized").withColumn("anonymized", F.create_map(F.lit("k"), F.lit("v")))
    assert _shuffles(profile.restore_profile(fields, maps)) <= 8


def test_rows_with_null_keys_come_back(spark):
    df = spark.createDataFrame([(None, "u", "call Bob"), (1, "u", "call Bob"), (2, None, "call Bob")],
                               "doc_id long, uuid string, anonymized string")
    maps = spark.createDataFrame([("u", "Bob", "X")], "uuid string, fake string, original string")
    back = restore.restore_by_value(df, maps).collect()
    assert {r.doc_id: r.restored for r in back} == {None: "call X", 1: "call X", 2: "call Bob"}


def test_shapes_are_found_in_one_pass(spark):
    from veilwork.functions import pseudonyms as ps
    text = "Anna Botakimu, 1234 Oak St, Dover, MA 021** a[REDACTED-OTHER] xMRN-12345678 MRN-12345678 90 or above"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(restore.candidates(F.col("t")).alias("c"))
    found = [sorted((p.begin, p.fake) for p in r.c) for r in df.collect()]
    assert found == [[(0, "Anna Botakimu"), (15, "1234 Oak St, Dover, MA 021**"), (38, "021**"), (45, "[REDACTED-OTHER]"),
                      (76, "MRN-12345678"), (89, "90 or above")], [], []]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan
    assert set(ps.FAKE_SHAPES) == {n for _, names in restore._BY_FIRST for n in names}
