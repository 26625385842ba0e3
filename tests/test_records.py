"""JSON records, profiles, routing, stores."""

import json

from conftest import KEY
from pyspark.sql import functions as F

from veilwork.functions import jsontext as jt
from veilwork.operators import anonymize as an
from veilwork.operators import jsonrec, profile, requests, restore, stores, structrec

RECORD = {
    "patient": {"name": "Jane Doe", "dob": "01/15/1960", "mrn": "MRN-789456", "phone": "555-987-6543",
                "email": "jane.doe@email.com"},
    "visit_info": {"date": "03/15/2025", "provider": "Dr. Michael Chen, MD", "nurse": "Susan Williams, RN"},
    "diagnoses": ["Type 2 Diabetes Mellitus (E11.9)", "Essential Hypertension (I10)"],
    "medications": [{"name": "Metformin", "dose": "1000mg", "frequency": "BID"}],
    "vitals": {"blood_pressure": "138/88", "heart_rate": 76, "temperature": 98.4},
    "lab_results": {"hba1c": 7.8, "ldl": 145}, "note": 'said "call 555-111-2222"\\ now\nbye é', "none": None,
    "empty": "", "list": ["a@b.example.org", 1.50, True, {"x": []}],
}


def frame(spark, *records):
    rows = [(i, "user1", "USER_ID", r) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "doc_id long, identity string, identity_type string, record string")


def test_json_record(spark):
    raw = json.dumps(RECORD, indent=1).replace("1.5,", "1.50,")
    done = jsonrec.anonymize_json(frame(spark, raw, "{not json", "[]"), KEY).cache()
    first, bad, empty = sorted(done.collect(), key=lambda r: r.doc_id)
    out = json.loads(first.anonymized)
    for k in ("diagnoses", "medications", "vitals", "lab_results", "none", "empty"):
        assert out[k] == RECORD[k]
    assert out["visit_info"]["provider"] == "Dr. Michael Chen, MD"
    assert out["visit_info"]["nurse"] == "Susan Williams, RN"
    for k in ("name", "dob", "mrn", "phone", "email"):
        assert out["patient"][k] != RECORD["patient"][k]
    assert list(out) == list(RECORD) and out["list"][1:] == RECORD["list"][1:]
    assert "1.50" in first.anonymized and "555-111-2222" not in out["note"]
    assert out["note"].startswith('said "call ') and out["note"].endswith('"\\ now\nbye é')
    assert bad.status == 500 and bad.anonymized is None
    assert empty.anonymized == "[]" and empty.status == 200
    assert jsonrec.structure_differences(done, "record", "anonymized").count() == 0
    good = done.filter("status = 200")
    back = jsonrec.restore_json_by_ledger(good.select("doc_id", "anonymized"), jsonrec.ledger_rows(good))
    assert json.loads(back.filter("doc_id = 0").first().restored) == RECORD
    maps = an.mapping_rows(good).withColumn("created_at", F.current_timestamp())
    again = jsonrec.restore_json(good.select("doc_id", "uuid", "anonymized"), maps).filter("doc_id = 0").first()
    assert json.loads(again.restored) == RECORD and again.entities_restored == 8
    whole = jsonrec.restore_json(good.select("doc_id", "uuid", "anonymized"), maps, whole_values=True)
    assert json.loads(whole.filter("doc_id = 0").first().restored)["patient"]["name"] == "Jane Doe"


def test_json_leaves(spark):
    raw = r'{"a":"x\"y","b\\":["\\\\","A"],"c":{"d":"" , "e" : "v:1"}}'
    row = frame(spark, raw).select(jt.leaves(F.col("record")).alias("l")).first()
    assert [p.value for p in row.l if p.value is not None] == ['x"y', "\\\\", "A", "", "v:1"]
    assert "".join(p.raw for p in row.l) == raw


def test_typed_struct_keeps_its_schema(spark):
    df = spark.createDataFrame([(1, "u", "T", ("Sarah Johnson", 3, ["Call 555-123-4567"]))],
                               "doc_id long, identity string, identity_type string, "
                               "r struct<name:string,n:int,l:array<string>>")
    out = structrec.anonymize_struct(df, KEY, "r")
    assert out.schema["r"].dataType == df.schema["r"].dataType
    assert out.first().r.name != "Sarah Johnson" and out.first().r.n == 3


def test_profile(spark):
    p = {"first_name": "Jane", "last_name": "Doe", "dob": "01/15/1960", "zip": "03601", "phone": "555-123-4567",
         "diagnosis": "Alzheimer's Disease", "Provider First Name": "Sam", "x": "", "y": None}
    df = spark.createDataFrame([(1, "u", "T", p)], "doc_id long, identity string, identity_type string, "
                                                   "profile map<string,string>")
    done = profile.anonymize_profile(df, KEY).cache()
    out = done.first().anonymized
    assert out["dob"] == "XX/XX/1960" and out["zip"] == "00000"
    assert out["first_name"] != "Jane" and " " not in out["first_name"] and out["last_name"] != "Doe"
    assert out["phone"].startswith("555-") and out["phone"] != p["phone"]
    for k in ("diagnosis", "Provider First Name", "x", "y"):
        assert out[k] == p[k]
    assert set(out) == set(p)
    maps = an.mapping_rows(done).withColumn("created_at", F.current_timestamp())
    back = profile.restore_profile(done.select("doc_id", "uuid", "anonymized"), maps).first().restored
    assert back == p


def test_stored_mappings_win(spark, texts):
    df = an.with_uuid(texts("Name: John Smith\nPhone: 555-123-4567"), KEY)
    uuid = df.first().uuid
    maps = spark.createDataFrame([(uuid, "NAME", "JOHN SMITH", "faker", "Zed Q. Stored", None)],
                                 "uuid string, pii_type string, original string, fake_type string, fake string, "
                                 "created_at timestamp")
    done = an.anonymize(texts("Name: John Smith\nPhone: 555-123-4567"), KEY, mappings=maps).first()
    assert "Zed Q. Stored" in done.anonymized and "555-123-4567" not in done.anonymized
    rows = [(1, uuid, "(Zed Q. Stored)"), (2, uuid, "xZed Q. Storedx"), (3, "other", "Zed Q. Stored")]
    back = {r.doc_id: r for r in restore.restore_by_value(
        spark.createDataFrame(rows, "doc_id long, uuid string, anonymized string"), maps).collect()}
    assert back[1].restored == "(JOHN SMITH)" and back[1].entities_restored == 1
    assert back[2].restored == rows[1][2] and back[3].restored == rows[2][2]


def test_ambiguous_masks_stay(spark, texts):
    """No invented dates, and a code that looks like a mask is left alone."""
    text = "Seen 01/02/1990 and 05/06/1990. Code 000001. ZIP: 03601"
    done = an.anonymize(texts(text), KEY)
    maps = an.mapping_rows(done).withColumn("created_at", F.current_timestamp())
    back = restore.restore_by_value(done.select("doc_id", "uuid", "anonymized"), maps).first()
    assert back.restored == "Seen XX/XX/1990 and XX/XX/1990. Code 000001. ZIP: 03601"
    assert back.ambiguous == 2 and back.entities_restored == 1


def test_equal_names_in_a_profile(spark):
    p = {"first_name": "James", "last_name": "James", "name": "James", "full name": "James Cook"}
    df = spark.createDataFrame([(1, "u", "t", p)], "doc_id long, identity string, identity_type string, profile map<string,string>")
    done = profile.anonymize_profile(df, KEY)
    maps = an.mapping_rows(done).withColumn("created_at", F.current_timestamp())
    assert "James" not in done.first().anonymized.values()
    assert profile.restore_profile(done.select("doc_id", "uuid", "anonymized"), maps).first().restored == p


def test_equal_doc_ids(spark, texts):
    two = texts("Name: John Smith").unionAll(texts("Name: John Smith, again"))
    uuid = an.with_uuid(two, KEY).first().uuid
    maps = spark.createDataFrame([(uuid, "NAME", "John Smith", "faker", "Zed Stored", None)],
                                 "uuid string, pii_type string, original string, fake_type string, fake string, "
                                 "created_at timestamp")
    assert sorted(r.anonymized for r in an.anonymize(two, KEY, mappings=maps).collect()) == [
        "Name: Zed Stored", "Name: Zed Stored, again"]


def test_json_validity(spark):
    good = ['{"a":1,"a":"x"}', '{"v": NaN, "w": -Infinity}', '{"s": "' + "x" * 25_000_000 + '"}', '"NaN"', "[1, {}]",
            r'{"a": "q\" \\ \u00e9"}']
    bad = ["{bad", '{"a":1}x', '{"a":1},{"b":2}', "", r'{"a": "\x"}', '{"a" 1}', "NaNs"]
    from veilwork.functions.jsontext import is_valid
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "r string, want boolean")
    got = df.select(F.length("r").alias("n"), F.substring("r", 1, 40).alias("r"), "want", is_valid(F.col("r")).alias("is")).collect()
    assert [r for r in got if r["is"] != r["want"]] == []


def test_registry_uuid_wins(spark, texts):
    reg = spark.createDataFrame([("u-1", "user1", "USER_ID")], "uuid string, identity string, identity_type string")
    assert an.anonymize(texts("a@b.example.org"), KEY, registry=reg).first().uuid == "u-1"
    wanted = texts("x").select("identity", "identity_type")
    reg = reg.withColumn("created_at", F.current_timestamp())
    assert stores.register_identities(wanted, reg, KEY, F.current_timestamp()).count() == 1
    other = wanted.withColumn("identity", F.lit("new"))
    assert stores.register_identities(other, reg, KEY, F.current_timestamp()).first().is_new
    assert stores.register_identities(other, reg, KEY, F.current_timestamp(), insert=False).count() == 0


def test_collisions_are_separated(spark):
    rows = [("u", "NAME", f"N{i}", "keyed", "Same Fake", None) for i in range(3)] + [
        ("u", "DATE", f"0{i}/01/1999", "safe_harbor", "XX/XX/1999", None) for i in range(3)]
    maps = spark.createDataFrame(rows, "uuid string, pii_type string, original string, fake_type string, "
                                       "fake string, created_at timestamp")
    assert {(r.fake, r.originals) for r in stores.fake_collisions(maps).collect()} == {
        ("Same Fake", 3), ("XX/XX/1999", 3)}
    fixed = stores.separate_collisions(maps, KEY)
    assert fixed.count() == 6
    assert {r.fake for r in stores.fake_collisions(fixed).collect()} == {"XX/XX/1999"}


def test_routing(spark):
    rows = [(1, "anonymize", "u", "t", "Call 555-123-4567", None, None, None),
            (2, "ANONYMIZE", "u", "t", None, '{"p": "555-123-4567"}', None, None),
            (3, "ANONYMIZE", "u", "t", None, None, {"phone": "555-123-4567"}, None),
            (4, "NOPE", "u", "t", "x", None, None, None),
            (5, "ANONYMIZE", "u", "t", "x", None, None, {"requires_consent": "true", "purpose": "ads"})]
    df = spark.createDataFrame(rows, "request_id long, method string, identity string, identity_type string, "
                                     "conversation string, json_data string, profile map<string,string>, "
                                     "context map<string,string>")
    maps = spark.createDataFrame([], "uuid string, pii_type string, original string, fake_type string, fake string, "
                                     "created_at timestamp")
    out = {r.request_id: r for r in requests.route(df, maps, KEY).collect()}
    assert [out[i].status for i in range(1, 6)] == [200, 200, 200, 500, 403]
    assert out[1].result[5:] == json.loads(out[2].result)["p"] == json.loads(out[3].result)["phone"]
    assert out[4].error.endswith("NOPE") and out[5].result is None


def test_routing_restores(spark):
    """What was given out from the store comes back, in all three forms; bad JSON and null methods say so."""
    shape = ("request_id long, method string, identity string, identity_type string, conversation string, json_data string, "
             "profile map<string,string>, context map<string,string>")
    uuid = an.with_uuid(spark.createDataFrame([("U", "T")], "identity string, identity_type string"), KEY).first().uuid
    maps = spark.createDataFrame([(uuid, "NAME", "John Smith", "faker", "Zed Q. Stored", None)],
                                 "uuid string, pii_type string, original string, fake_type string, fake string, "
                                 "created_at timestamp")
    rows = [(1, "DE-ANONYMIZE", "u", "t", "Name: Zed Q. Stored", None, None, None),
            (2, "DE-ANONYMIZE", "u", "t", None, '{"n": "Zed Q. Stored"}', None, None),
            (3, "DE-ANONYMIZE", "u", "t", None, None, {"name": "Zed Q. Stored"}, None),
            (4, "DE_ANONYMIZE_JSON", "u", "t", None, "{bad", None, None), (5, None, "u", "t", "x", None, None, None)]
    out = {r.request_id: r for r in requests.route(spark.createDataFrame(rows, shape), maps, KEY).collect()}
    assert out[1].result == "Name: John Smith" and json.loads(out[2].result) == {"n": "John Smith"}
    assert json.loads(out[3].result) == {"name": "John Smith"}
    assert out[4].status == 500 and out[4].error and out[5].status == 500 and out[5].error


REQUESTS = ("request_id long, method string, identity string, identity_type string, conversation string, "
            "json_data string, profile map<string,string>, context map<string,string>")


def batch(spark):
    ctx = {"purpose": "emergency_care", "access_reason": "follow-up", "authorized_by": "dr"}
    return spark.createDataFrame([
        (1, "anonymize", "u", "t", "Call 555-123-4567", None, None, ctx),
        (2, "ANONYMIZE", "u", "t", None, '{"p": "555-123-4567", "q": ["555-123-4567", "a@b.example.org"]}', None, ctx),
        (3, "ANONYMIZE", "u", "t", None, None, {"phone": "555-123-4567"}, None),
        (4, "DE-ANONYMIZE", "w", "t", "Name: Zed Q. Stored", None, None, ctx),
        (5, "DE-ANONYMIZE", "w", "t", None, None, {"name": "Zed Q. Stored", "x": ""}, ctx),
        (6, "DE_ANONYMIZE_JSON", "w", "t", None, '{"n": ["a", "Zed Q. Stored"]}', None, ctx),
        (7, "ANONYMIZE", "u", "t", "nothing here", None, None, None),
        (8, "ANONYMIZE_JSON", "u", "t", None, "{bad", None, None),
        (9, "DE_ANONYMIZE_JSON", "w", "t", None, "bad}", None, None),
        (10, "ANONYMIZE", "u", "t", None, None, None, None), (11, "DE-ANONYMIZE", "u", "t", None, None, None, None),
        (12, "NOPE", "u", "t", "x", None, None, None),
        (13, "ANONYMIZE", "u", "t", "x", None, None, {"requires_consent": "true", "purpose": "ads"})], REQUESTS)


def test_served_batch_and_its_stores(spark):
    import datetime

    from veilwork.session import work_folder
    from veilwork.sources import tables as tb
    base = work_folder(spark, "serve")
    paths = {n: f"{base}/{n}" for n in ("results", "identities", "mappings", "history", "audit", "ledger")}
    tb.append_store(spark.createDataFrame([("known-w", "W", "T", None)], tb.IDENTITIES), paths["identities"], "identities")
    tb.append_store(spark.createDataFrame([("known-w", "NAME", "John Smith", "faker", "Zed Q. Stored", None)], tb.MAPPINGS),
                    paths["mappings"], "mappings")
    at = F.lit(datetime.datetime(2024, 1, 2))
    counted = [requests.serve(batch(spark), paths, KEY, 7, at) for _ in range(2)]
    assert counted[0] == counted[1] == {"requests": 13, "served": 7, "refused": 1, "failed": 5, "entities": 7}
    out = {r.request_id: r for r in spark.read.parquet(paths["results"]).collect()}
    assert len(out) == 13 and out[4].uuid == "known-w" and out[4].result == "Name: John Smith"
    assert json.loads(out[5].result) == {"name": "John Smith", "x": ""}
    assert out[6].result == '{"n": ["a", "John Smith"]}' and out[7].result == "nothing here"
    assert [out[i].status for i in (8, 9, 10, 11, 12, 13)] == [500, 500, 500, 500, 500, 403]
    assert all(out[i].error for i in (8, 9, 10, 11, 12, 13)) and not any(out[i].result for i in (8, 10, 12, 13))
    history = tb.read_store(spark, paths["history"], "history").collect()
    assert sorted(r.method for r in history) == ["ANONYMIZE", "ANONYMIZE_JSON", "ANONYMIZE_PROFILE", "DE-ANONYMIZE",
                                                 "DE_ANONYMIZE_JSON", "DE_ANONYMIZE_PROFILE"]
    by = {r.method: r for r in history}
    assert by["DE-ANONYMIZE"].original == "Name: John Smith" and by["DE-ANONYMIZE"].anonymized == "Name: Zed Q. Stored"
    assert json.loads(by["DE-ANONYMIZE"].metadata) == {"gdpr_access_reason": "follow-up", "gdpr_authorized_by": "dr"}
    assert json.loads(by["ANONYMIZE_JSON"].metadata)["entities_processed"] == 2
    audit = tb.read_store(spark, paths["audit"], "audit").collect()
    assert len(audit) == 26 and sum(r.event_type == "ERROR" for r in audit) == 6
    assert {r.data_type for r in audit if r.action == "ANONYMIZE_JSON"} == {"json_data"}
    maps = tb.read_store(spark, paths["mappings"], "mappings").collect()
    assert sorted(r.pii_type for r in maps) == ["EMAIL", "NAME", "PHONE_NUMBER"]
    assert sorted(r.identity for r in tb.read_store(spark, paths["identities"], "identities").collect()) == ["U", "W"]
    ledger = tb.read_store(spark, paths["ledger"], "ledger")
    assert ledger.count() == 4
    done = spark.createDataFrame([(1, out[1].result)], "doc_id long, anonymized string")
    assert restore.restore_by_ledger(done, ledger).first().restored == "Call 555-123-4567"
    record = spark.createDataFrame([(2, out[2].result)], "doc_id long, anonymized string")
    assert json.loads(jsonrec.restore_json_by_ledger(record, ledger).first().restored)["q"] == [
        "555-123-4567", "a@b.example.org"]


def test_requests_are_scanned_once(spark, tmp_path):
    batch(spark).write.parquet(str(tmp_path / "r"))
    maps = spark.createDataFrame([], "uuid string, pii_type string, original string, fake_type string, fake string, "
                                     "created_at timestamp")
    staged = requests.route(spark.read.parquet(str(tmp_path / "r")), maps, KEY)
    assert str(tmp_path / "r") not in staged._jdf.queryExecution().executedPlan().toString()
    found = requests._detected(requests.accepted(spark.read.parquet(str(tmp_path / "r")), KEY), KEY)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_ledger_tells_rows_of_one_doc_id_apart(spark, texts):
    """No row gets what another row with its doc_id held."""
    two = texts("Name: John Smith").unionAll(texts("Name: Jane Doe")).unionAll(texts("Name: Jane Doe"))
    done = an.anonymize(two, KEY)
    back = restore.restore_by_ledger(done.select("doc_id", "anonymized", "text"), an.ledger_rows(done)).collect()
    assert [r.restored for r in back] == [r.text for r in back] and not any(r.unclear for r in back)
    same = texts("Born 01/02/1990").unionAll(texts("Born 05/06/1990"))  # both become the same text
    done = an.anonymize(same, KEY)
    for r in restore.restore_by_ledger(done.select("doc_id", "anonymized"), an.ledger_rows(done)).collect():
        assert r.restored == "Born XX/XX/1990" and r.unclear
    other = done.select("doc_id", F.concat("anonymized", F.lit("!")).alias("anonymized"))
    assert restore.restore_by_ledger(other, an.ledger_rows(done)).first().restored == "Born XX/XX/1990!"


def test_json_ledger_with_a_shared_doc_id(spark):
    two = frame(spark, '{"n": "Name: John Smith"}').unionAll(frame(spark, '{"n": "Name: Jane Doe"}'))
    done = jsonrec.anonymize_json(two, KEY)
    back = jsonrec.restore_json_by_ledger(done.select("doc_id", "anonymized", "record"), jsonrec.ledger_rows(done)).collect()
    assert [r.restored for r in back] == [r.record for r in back]


MAPS = "uuid string, pii_type string, original string, fake_type string, fake string, created_at timestamp"


def test_restored_places(spark):
    """Longest first, whole words, marks and replacements of any shape; what is put back isn't looked at again."""
    stored = [("Zed", "A"), ("Zed Stored", "B"), ("Zed Stored Junior of the Long Name, 5th", "C"), ("***", "D"), ("[x]", "E"),
              ("555-000-1111", "Zed"), ("é-é", "F"), ("10.0.0.1", "G"), ("a", "b"), ("b", "a")]
    maps = spark.createDataFrame([("u", "T", o, "faker", f, None) for f, o in stored], MAPS)
    cases = {"Zed Stored and Zed.": "B and A.", "Zed Stored Junior of the Long Name, 5th!": "C!", "Zed Storeds": "A Storeds",
             "xZed Zedx": "xZed Zedx", "(***)": "(D)", "q[x]q": "qEq", "call 555-000-1111 Zed": "call Zed A",
             "saw 0 there \x01": "saw 0 there \x01", "sé-é, 10.0.0.1; 10.0.0.12": "sF, G; 10.0.0.12",
             "a b ab": "b a ab", "": "", "Zed Zed Stored": "A B"}
    df = spark.createDataFrame([(1, "u", t) for t in cases] + [(1, "u", None), (None, "u", "Zed"), (1, None, "Zed"),
                                                              (2, "v", "Zed")], "doc_id long, uuid string, anonymized string")
    out = restore.restore_by_value(df, maps).collect()
    assert len(out) == len(cases) + 4
    got = {(r.doc_id, r.uuid, r.anonymized): r.restored for r in out}
    for text, want in cases.items():
        assert got[1, "u", text] == want
    assert got[1, "u", None] is None and got[None, "u", "Zed"] == "A" and got[1, None, "Zed"] == got[2, "v", "Zed"] == "Zed"


def test_many_values_in_one_text(spark):
    """Linear: four times the values take less than five times as long."""
    import time

    def run(n):
        rows = spark.range(n).selectExpr(
            "'u' AS uuid", "'PHONE_NUMBER' AS pii_type", "concat('P', id) AS original", "'keyed' AS fake_type",
            "concat('555-', lpad(id div 10000, 3, '0'), '-', lpad(id % 10000, 4, '0')) AS fake",
            "timestamp'2024-01-01' AS created_at")
        text = rows.orderBy("fake").agg(F.array_join(F.collect_list(F.concat("fake", F.lit(" seen on the ward, "))), "").alias(
            "anonymized"), F.lit("u").alias("uuid")).withColumn("doc_id", F.lit(1))
        text, rows = text.cache(), rows.cache()
        text.count(), rows.count()
        start = time.time()
        out = restore.restore_by_value(text, rows).first()
        assert out.entities_restored == n and out.restored.count(" seen") == n and "555-" not in out.restored
        return time.time() - start

    run(1000)
    small, large = min(run(4000) for _ in range(2)), run(16_000)
    assert large < 5 * small + 1, (small, large)


def test_many_spans_are_spliced_in_groups(spark):
    from veilwork.functions.splice import by_place, splice
    text = "".join(chr(97 + i % 26) + "é" for i in range(3000))
    spans = [(i, i + 1 + i % 3, f"<{i}>") for i in range(1, 5990, 7)]
    df = spark.createDataFrame([(text, spans[:n]) for n in (0, 1, 127, 128, 129, 256, len(spans))],
                               "t string, s array<struct<begin:int,end:int,fake:string>>")
    for r in df.withColumn("o", splice(F.col("t"), F.col("s"))).collect():
        want, at = "", 0
        for b, e, f in r.s:
            want, at = want + text[at:b] + f, e
        assert r.o == want + text[at:]
    hits = spark.createDataFrame([([(2, "x"), (3, "y"), (6, "z")],), ([],), (None,)], "h array<struct<leaf:int,v:string>>")
    got = [r[0] and [x and x.v for x in r[0]] for r in hits.select(by_place(F.col("h"), "leaf")).collect()]
    assert got == [[None, None, "x", "y", None, None, "z"], [], None]


NESTED = ("a struct<n:string,d:decimal(10,2),t:date,deep:array<struct<s:string,x:array<string>,k:int>>,"
          "m:map<string,string>,mm:map<string,array<struct<v:string,w:double>>>>, ts timestamp, b binary, "
          "l array<array<string>>, none string, nums array<int>")


def test_structs_of_any_depth(spark):
    """No text form on the way: decimals, dates, binaries, NaN and nulls stay; strings come back."""
    import datetime
    import decimal
    row = ({"n": "Name: John Smith", "d": decimal.Decimal("1.50"), "t": datetime.date(2020, 1, 2),
            "deep": [{"s": "a@b.example.org", "x": ["x", None, "call 555-123-4567 or 555-999-8888"], "k": 1}, None,
                     {"s": None, "x": None, "k": None}, {"s": "plain", "x": [], "k": 2}],
            "m": {"p": "555-123-4567", "q": None}, "mm": {"z": [{"v": "Mr. Smith has it", "w": float("nan")}], "y": None, "e": []}},
           datetime.datetime(2020, 1, 1, 3), bytearray(b"\x00\xff"), [["c@d.example.org"], None, []], None, [1, None])
    empty = (None,) * 6
    shape = f"doc_id long, identity string, identity_type string, r struct<{NESTED.replace(' struct', ':struct').replace(' timestamp', ':timestamp').replace(' binary', ':binary').replace(' array', ':array').replace('none string', 'none:string')}>"
    df = spark.createDataFrame([(1, "u", "T", row), (2, "u", "T", empty), (3, "u", "T", None), (4, None, "T", row)], shape)
    done = structrec.anonymize_struct(df, KEY, "r").cache()
    assert done.schema["r"].dataType == df.schema["r"].dataType
    plan = structrec.anonymize_struct(df, KEY, "r")._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and "from_json" not in plan and "Exchange" not in plan
    out = {r.doc_id: r for r in done.collect()}
    r = out[1].r
    assert "John" not in r.a.n and "555-123" not in r.a.deep[0].x[2] and "555-999" not in r.a.deep[0].x[2]
    assert r.a.d == decimal.Decimal("1.50") and r.a.t == row[0]["t"] and r.b == row[2] and r.nums == [1, None]
    assert r.a.deep[0].x[:2] == ["x", None] and r.a.deep[1] is None and r.a.deep[2].s is None and r.a.deep[3].s == "plain"
    assert r.a.m["q"] is None and r.a.m["p"].startswith("555-") and r.a.m["p"] != "555-123-4567" and r.a.m["p"] in r.a.deep[0].x[2]
    assert "Smith" not in r.a.mm["z"][0].v and r.a.mm["z"][0].w != r.a.mm["z"][0].w and r.a.mm["y"] is None and r.a.mm["e"] == []
    assert r.l[0][0].endswith("@example.com") and r.l[1:] == [None, []] and r.none is None
    assert out[2].r.a is None and out[3].r is None and out[4].r is None and out[4].status == 500
    back = structrec.restore_struct_by_ledger(done.select("doc_id", "r"), structrec.ledger_rows(done, "r"), "r")
    again = {x.doc_id: x.r for x in back.collect()}
    before = {x.doc_id: x.r for x in df.collect()}
    assert str(again[1]) == str(before[1]) and again[2] == before[2] and again[3] is None


def test_rules_as_a_table(spark, texts):
    import pytest

    from veilwork.functions.rules import ALL_RULES
    from veilwork.operators import rule_table

    def table(*rows):
        return spark.createDataFrame(rows, rule_table.SCHEMA)

    good = table(("BADGE", 2002, r"\bB-[0-9]{3}\b", 0.9, False, False, None),
                 ("WARD", 2001, r"(Ward's )([0-9]+)()", 0.9, True, False, ["ward"]))
    rules = rule_table.rules_from(good, ALL_RULES)
    assert [r.type for r in rules[-2:]] == ["WARD", "BADGE"]
    out = an.anonymize(texts("badge B-123 in Ward's 7, a@b.example.org"), KEY, rules=rules).first()
    assert out.anonymized.startswith("badge [REDACTED-BADGE] in Ward's [REDACTED-WARD], user")
    bad = [("", 3001, "x", 0.9, False, False, None), ("A", 3002, "(", 0.9, False, False, None),
           ("B", 3003, "x*", 0.9, False, False, None), ("C", 3004, "(a)(b)", 0.9, True, False, None),
           ("D", 101, "x", 0.9, False, False, None), ("E", 3005, "x", 7.0, False, False, None),
           ("F", 3006, "x", 0.9, False, False, ["X"]), ("G", 3007, "x", 0.9, False, False, None),
           ("H", 3007, "y", 0.9, False, False, None), ("I", 3008, None, 0.9, False, False, None)]
    with pytest.raises(ValueError) as e:
        rule_table.rules_from(table(*bad))
    for part in ("no type", "A 3002: pattern", "B 3003: pattern matches the empty text", "not 2 groups", "D 101: ord",
                 "E 3005: score", "F 3006: guards", "H 3007: ord", "I 3008: pattern matches the empty text"):
        assert part in str(e.value)
    assert rule_table.rules_from(table()) == []


def test_span_join(spark):
    import random

    from veilwork.operators import spanjoin
    rng = random.Random(1)

    def spans(n):
        out = []
        for k in range(n):
            b = rng.randrange(300)
            out.append((rng.choice([1, 2, None]), f"T{k}", b, b + rng.choice([0, 1, 5, 40, 200])))
        return out

    left, right = spans(60), spans(60)
    shape = "doc_id long, type string, begin int, end int"
    want = sorted((a, x[1], y[1]) for x in left for y in right for a in [x[0]] if a is not None and a == y[0]
                  and x[2] < y[3] and y[2] < x[3] and x[3] > x[2] and y[3] > y[2])
    for width in (1, 16, 256):
        got = spanjoin.overlaps(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), bin_width=width)
        assert sorted((r.doc_id, r.left_type, r.right_type) for r in got.collect()) == want


def test_dead_letters(spark, tmp_path):
    """A bad request of each kind is kept with its reason and can be served again; broken lines keep their file."""
    lines = ['{"request_id": 1, "method": "ANONYMIZE_JSON", "identity": "u", "identity_type": "t", "json_data": "{bad"}',
             '{"request_id": 2, "method": "DE_ANONYMIZE_JSON", "identity": "u", "identity_type": "t", "json_data": "bad"}',
             '{"request_id": 3, "method": "ANONYMIZE", "identity": "u", "identity_type": "t"}',
             '{"request_id": 4, "method": "DE-ANONYMIZE", "identity": "u", "identity_type": "t"}',
             '{"request_id": 5, "method": "ANONYMIZE", "identity_type": "t", "conversation": "Call 555-123-4567"}',
             '{"request_id": 6, "method": "DE-ANONYMIZE", "identity_type": "t", "conversation": "x"}',
             '{"request_id": 7, "method": "ANONYMIZE", "identity": "u", "identity_type": "t", "conversation": "fine"}',
             '{"request_id": 8, "meth', "", "[1]", '{"request_id": "nine"}',
             '{"request_id": 10, "method": "ANONYMIZE", "identity": "u", "identity_type": "t", "conversation": "x", '
             '"context": {"requires_consent": "true", "purpose": "ads"}}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    good, dead = requests.read_lines(spark, str(tmp_path))
    dead = dead.collect()
    assert {r.payload for r in dead} == {lines[7], lines[9], lines[10]}
    assert all(r.source_file.endswith("a.json") and r.source_offset == 0 and r.reason for r in dead)
    maps = spark.createDataFrame([], MAPS)
    done = requests.served(good, maps, KEY)
    failed = requests.dead_letters(done, F.current_timestamp())
    by = {r.request_id: r for r in failed.collect()}
    assert set(by) == {1, 2, 3, 4, 5, 6}
    assert {by[i].handler for i in by} == {"ANONYMIZE_JSON", "DE_ANONYMIZE_JSON", "ANONYMIZE_PROFILE", "DE_ANONYMIZE_PROFILE",
                                           "ANONYMIZE", "DE-ANONYMIZE"}
    assert by[5].reason == requests.NO_IDENTITY
    mended = requests.from_dead_letters(failed).withColumn("identity", F.coalesce("identity", F.lit("u")))
    out = {r.request_id: r for r in requests.route(mended, maps, KEY).collect()}
    assert out[5].status == 200 and "555-123-4567" not in out[5].result and out[6].result == "x"
    assert out[1].status == 500


def test_rows_without_identity_keep_no_result(spark):
    shape = "doc_id long, identity string, identity_type string, text string"
    df = spark.createDataFrame([(1, None, "T", "Name: John Smith"), (2, "u", None, "Name: John Smith")], shape)
    assert [(r.status, r.anonymized) for r in an.anonymize(df, KEY).collect()] == [(500, None)] * 2


def test_no_two_identities_share_a_uuid(spark):
    rows = [("B|C", "A"), ("C", "A|B"), ("T", ""), ("", "T"), ("1:A|", "1")]
    got = an.with_uuid(spark.createDataFrame(rows, "identity string, identity_type string"), KEY).collect()
    assert len({r.uuid for r in got}) == len(rows)
    nulls = spark.createDataFrame([(None, "T"), ("T", None)], "identity string, identity_type string")
    assert [r.uuid for r in an.with_uuid(nulls, KEY).collect()] == [None, None]


def test_profile_fields_come_back_whole(spark):
    p = {"comment": "call 555-123-4567 or 555-999-8888", "seen": "on 01/02/1990 by him", "dob": "01/02/1990", "note": "none"}
    df = spark.createDataFrame([(1, "u", "t", p)] * 2, "doc_id long, identity string, identity_type string, profile map<string,string>")
    done = profile.anonymize_profile(df, KEY).cache()
    assert not any("555-999" in r.anonymized["comment"] for r in done.collect())
    back = profile.restore_profile_by_ledger(done.select("doc_id", "anonymized"), profile.ledger_rows(done)).collect()
    assert [r.restored for r in back] == [p, p]
    maps = an.mapping_rows(done).withColumn("created_at", F.current_timestamp())
    value = profile.restore_profile(done.select("doc_id", "uuid", "anonymized"), maps).first().restored
    assert value["comment"] == p["comment"] and value["dob"] == p["dob"]


def test_text_sources(spark, tmp_path):
    from veilwork.sources.records import read_text
    for k in range(3):
        (tmp_path / f"n{k}.txt").write_text(f"Name: John Smith\nnote {k}")
    got = read_text(spark, str(tmp_path), "text").collect()
    assert {r.text for r in got} == {f"Name: John Smith\nnote {k}" for k in range(3)} and len({r.doc_id for r in got}) == 3
    assert all(r.identity == str(r.doc_id) and r.identity_type == "USER_ID" for r in got)
    spark.createDataFrame([(7, "p1", "a text")], "id long, who string, body string").write.json(str(tmp_path / "j"))
    row = read_text(spark, str(tmp_path / "j"), "json", text="body", doc_id="id", identity="who", identity_type="P").first()
    assert tuple(row) == (7, "p1", "P", "a text")
