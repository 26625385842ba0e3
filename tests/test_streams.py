"""Streams: exactly once, late events, mapping upsert across runs."""

import datetime

from conftest import KEY
from pyspark.sql import functions as F

from veilwork.operators import stores
from veilwork.session import work_folder
from veilwork.sources import tables as tb
from veilwork.streaming import jobs

SCHEMA = "doc_id long, identity string, identity_type string, text string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_anonymize_stream_is_exactly_once(spark):
    base = work_folder(spark, "t")
    for n in range(2):
        put(spark, f"{base}/in", [(n, "u", "T", f"mail a{n}@b.example.org")], SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        jobs.anonymize_stream(stream, KEY, f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/out").collect()
    assert sorted(r.doc_id for r in out) == [0, 1]
    assert all("@example.com" in r.anonymized for r in out)


def test_mappings_are_inserted_once(spark):
    base = work_folder(spark, "t")
    for _ in range(2):
        put(spark, f"{base}/in", [(1, "u", "T", "a@b.example.org"), (2, "u", "T", "a@b.example.org 555-123-4567")],
            SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        jobs.upsert_mappings_stream(stream, KEY, f"{base}/table", f"{base}/state").awaitTermination()
    rows = tb.read_store(spark, f"{base}/table", "mappings")
    assert sorted(r.pii_type for r in rows.collect()) == ["EMAIL", "PHONE_NUMBER"]


def test_repeats_within_the_watermark_are_dropped(spark):
    base = work_folder(spark, "t")
    schema = SCHEMA + ", ts timestamp"
    t0 = datetime.datetime(2024, 1, 1)
    put(spark, f"{base}/in", [(i, "u", "T", "a@b.example.org", t0 + datetime.timedelta(minutes=i))
                              for i in range(5)], schema)
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    jobs.upsert_mappings_stream(stream, KEY, f"{base}/table", f"{base}/state", ts="ts").awaitTermination()
    assert tb.read_store(spark, f"{base}/table", "mappings").count() == 1


def test_late_events_are_dropped(spark):
    base = work_folder(spark, "t")
    t0 = datetime.datetime(2024, 1, 1)

    def at(*minutes):
        return [(t0 + datetime.timedelta(minutes=m), "error") for m in minutes]

    for batch in (at(0, 1, 2, 3, 4), at(120), at(1, 2)):
        put(spark, f"{base}/in", batch, "ts timestamp, event_type string")
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{base}/in")
        jobs.alarm_stream(stream, "ts", f"{base}/out", f"{base}/state").awaitTermination()
    out = jobs.latest_alarms(spark, f"{base}/out").collect()
    assert [(r.window_start, r.n) for r in out] == [(t0, 5)]


def test_history_by_day_and_retention(spark):
    path = work_folder(spark, "t")
    rows = spark.createDataFrame([("u", "a", "b", "ANONYMIZE", "{}", datetime.datetime(2024, m, 1)) for m in (1, 6)],
                                 tb.HISTORY)
    tb.append_store(rows, path, "history")
    kept = stores.keep_recent(tb.read_store(spark, path, "history"), F.expr("timestamp'2024-06-10'"), 90)
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def scanned(df):
    """The files that a frame reads."""
    return {f.split("/")[-2] for f in df.inputFiles()}


def test_lookups_read_only_their_folders(spark):
    path = work_folder(spark, "t")
    rows = spark.range(500).selectExpr("concat('u', id) AS uuid", "'NAME' AS pii_type", "'A' AS original", "'B' AS fake")
    tb.append_store(rows, path, "mappings")
    keys = spark.createDataFrame([("u7",), ("u8",)], "uuid string")
    some = tb.read_store(spark, path, "mappings", keys)
    want = {f"bucket={b}" for b in tb.touched_buckets(keys, "mappings")}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.bucket for r in some.select("bucket").distinct().collect()} == {int(w.split("=")[1]) for w in want}
    assert some.count() < 50 and some.join(keys, "uuid").count() == 2
    assert scanned(tb.read_store(spark, path, "mappings")) > want


def test_a_missing_table_is_empty(spark):
    path = work_folder(spark, "t")
    keys = spark.createDataFrame([("u7",)], "uuid string")
    assert tb.read_store(spark, path, "mappings", keys).count() == 0
    assert tb.read_store(spark, path, "history").columns[-2:] == ["day", "batch"]


def test_case_of_a_value_does_not_make_a_mapping(spark):
    base = work_folder(spark, "t")
    for text in ("Name: JOHN SMITH", "Name: John Smith"):
        put(spark, f"{base}/in", [(1, "u", "T", text)], SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        jobs.upsert_mappings_stream(stream, KEY, f"{base}/table", f"{base}/state").awaitTermination()
    assert [r.original for r in tb.read_store(spark, f"{base}/table", "mappings").collect()] == ["JOHN SMITH"]


def test_stream_sees_what_is_stored_between_batches(spark):
    base = work_folder(spark, "t")
    who = spark.createDataFrame([("u", "T")], "identity string, identity_type string")
    registered = who.selectExpr("'known-u' AS uuid", "*", "timestamp'2024-01-01' AS created_at")
    tb.append_store(registered, f"{base}/identities", "identities")

    def run(n):
        put(spark, f"{base}/in", [(n, "u", "T", "Name: John Smith")], SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        jobs.anonymize_stream_stored(stream, KEY, f"{base}/mappings", f"{base}/out", f"{base}/state",
                                     f"{base}/identities").awaitTermination()
        return {r.doc_id: (r.uuid, r.anonymized) for r in jobs.latest_texts(spark, f"{base}/out").collect()}

    first = run(1)
    assert first[1][0] == "known-u" and "John" not in first[1][1]
    row = spark.createDataFrame([("known-u", "NAME", "john smith", "faker", "Zed Stored")],
                                "uuid string, pii_type string, original string, fake_type string, fake string")
    tb.append_store(row, f"{base}/mappings", "mappings")
    assert run(2) == {**first, 2: ("known-u", "Name: Zed Stored")}
    from veilwork.operators import anonymize as an
    batch = an.anonymize(spark.read.schema(SCHEMA).parquet(f"{base}/in").filter("doc_id = 2"), KEY, registry=registered,
                         mappings=tb.read_store(spark, f"{base}/mappings", "mappings"))
    assert batch.first().anonymized == "Name: Zed Stored"


def files(spark, path):
    return sorted(spark.read.parquet(path).inputFiles())


def test_erasure_rewrites_only_folders_that_hold_the_identity(spark):
    from veilwork.operators import upkeep
    path = work_folder(spark, "t")
    maps = spark.range(300).selectExpr("concat('u', id % 100) AS uuid", "'NAME' AS pii_type", "cast(id AS string) AS original")
    tb.append_store(maps, f"{path}/m", "mappings")
    days = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    hist = spark.createDataFrame([(f"u{i}", "a", "b", "ANONYMIZE", "{}", days[i % 3]) for i in range(30)], tb.HISTORY)
    tb.append_store(hist, f"{path}/h", "history")
    gone = spark.createDataFrame([("u7",), ("nobody",)], "uuid string")
    before = {k: files(spark, f"{path}/{k}") for k in "mh"}
    assert upkeep.erase(spark, f"{path}/m", "mappings", gone) == 3
    assert upkeep.erase(spark, f"{path}/h", "history", gone) == 1
    assert tb.read_store(spark, f"{path}/m", "mappings").count() == 297
    assert tb.read_store(spark, f"{path}/h", "history").filter("uuid = 'u7'").count() == 0
    assert tb.read_store(spark, f"{path}/h", "history").count() == 29
    after = {k: files(spark, f"{path}/{k}") for k in "mh"}
    bucket = f"/bucket={tb.touched_buckets(gone.limit(1), 'mappings')[0]}/"
    assert [f for f in before["m"] if bucket not in f] == [f for f in after["m"] if bucket not in f]
    assert [f for f in before["m"] if bucket in f] != [f for f in after["m"] if bucket in f]
    assert [f for f in before["h"] if "day=2024-01-02" not in f] == [f for f in after["h"] if "day=2024-01-02" not in f]
    assert upkeep.erase(spark, f"{path}/m", "mappings", gone) == 0


def test_a_folder_without_rows_goes(spark):
    from veilwork.operators import upkeep
    path = work_folder(spark, "t")
    tb.append_store(spark.createDataFrame([("u1", "NAME", "A"), ("u2", "NAME", "A")],
                                          "uuid string, pii_type string, original string"), path, "mappings")
    assert upkeep.erase(spark, path, "mappings", spark.createDataFrame([("u1",)], "uuid string")) == 1
    assert [r.uuid for r in tb.read_store(spark, path, "mappings").collect()] == ["u2"]


def test_expiry_drops_days_and_trims_the_cutoff_day(spark):
    from veilwork.operators import upkeep
    path = work_folder(spark, "t")
    times = [datetime.datetime(2024, 1, 1, 5), datetime.datetime(2024, 3, 1, 5), datetime.datetime(2024, 3, 1, 20),
             datetime.datetime(2024, 5, 1)]
    rows = spark.createDataFrame([("u", "a", "b", "ANONYMIZE", "{}", t) for t in times], tb.HISTORY)
    tb.append_store(rows, path, "history")
    late = [f for f in files(spark, path) if "2024-05-01" in f]
    assert upkeep.expire(spark, path, "history", datetime.datetime(2024, 5, 30, 12)) == 2
    assert sorted(r.created_at for r in tb.read_store(spark, path, "history").collect()) == times[2:]
    assert [f for f in files(spark, path) if "2024-05-01" in f] == late
    assert not [f for f in files(spark, path) if "2024-01-01" in f]


def test_orphans_and_compaction(spark):
    from veilwork.operators import upkeep
    path = work_folder(spark, "t")
    tb.append_store(spark.createDataFrame([("u1", "a", "T", None)], tb.IDENTITIES), f"{path}/i", "identities")
    shape = "uuid string, pii_type string, original string, fake string, created_at timestamp"
    for k, name in enumerate(("JOHN", "John", "JOHN")):
        at = datetime.datetime(2024, 1, 1 + k)
        tb.append_store(spark.createDataFrame([("u1", "NAME", name, f"F{k}", at), ("u9", "NAME", name, "F", at)], shape),
                        f"{path}/m", "mappings")
    assert upkeep.drop_orphans(spark, f"{path}/m", f"{path}/i") == 3
    upkeep.compact(spark, f"{path}/m", "mappings")
    assert [(r.uuid, r.original, r.fake) for r in tb.read_store(spark, f"{path}/m", "mappings").collect()] == [
        ("u1", "JOHN", "F0")]
    assert len(files(spark, f"{path}/m")) == 1


def test_a_batch_that_runs_again_writes_once(spark):
    path = work_folder(spark, "t")
    rows = spark.createDataFrame([("u", "a", "b", "ANONYMIZE", "{}", datetime.datetime(2024, 1, 1))], tb.HISTORY)
    for batch in (1, 2, 1):
        tb.append_store(rows, path, "history", batch=batch)
    assert tb.read_store(spark, path, "history").groupBy("batch").count().count() == 2
    assert tb.read_store(spark, path, "history").count() == 2
