"""Documented outcomes on invented clinical texts."""

import pytest
from conftest import KEY
from pyspark.sql import functions as F

from veilwork.operators import anonymize as an
from veilwork.operators import restore

NOTE = """
Patient: John Smith, DOB: 03/15/1975, MRN: ABC-123456
Phone: 555-123-4567, Email: jsmith@email.com
SSN: 123-45-6789, Insurance ID: BCB987654321

Chief Complaint: Uncontrolled Type 2 Diabetes
Diagnosis: Type 2 Diabetes Mellitus (E11.9), Hypertension (I10)
Medications:
- Metformin 1000mg BID
- Lisinopril 20mg daily
- Insulin Glargine 24 units at bedtime

Lab Results:
- HbA1c: 9.2% (HIGH)
- Fasting Glucose: 256 mg/dL
- Blood Pressure: 145/92 mmHg

Provider: Dr. Sarah Johnson, MD
Nurse: Patricia Brown, RN
Next appointment: 04/20/2025 at 2:30 PM
"""
GONE = ["John Smith", "03/15/1975", "ABC-123456", "555-123-4567", "jsmith@email.com", "123-45-6789",
        "BCB987654321", "04/20/2025"]
KEPT = ["Type 2 Diabetes", "E11.9", "Hypertension", "I10", "Metformin 1000mg BID", "Lisinopril 20mg daily",
        "Insulin Glargine 24 units", "HbA1c: 9.2%", "Glucose: 256 mg/dL", "145/92 mmHg",
        "Dr. Sarah Johnson", "Patricia Brown, RN", "Patient: ", "MRN: MRN-", "DOB: XX/XX/1975"]
NEURO = """
    - MMSE Score: 24/30
    - MoCA Score: 22/30
    - Anxiety Score: 2, Caregiver Distress: 3
    Brain MRI findings: Mild cerebral atrophy
    - Donepezil 10mg daily
"""


def test_full_note(anonymized):
    out = anonymized(NOTE)[0]
    for term in GONE:
        assert term not in out.anonymized
    for term in KEPT:
        assert term in out.anonymized
    assert out.entities_detected == 8 and out.status == 200


def test_full_note_comes_back(spark, texts):
    done = an.anonymize(texts(NOTE), KEY)
    by_place = restore.restore_by_ledger(done.select("doc_id", "anonymized"), an.ledger_rows(done))
    assert by_place.first().restored == NOTE
    maps = an.mapping_rows(done).withColumn("created_at", F.current_timestamp())
    by_value = restore.restore_by_value(done.select("doc_id", "uuid", "anonymized"), maps)
    assert by_value.first().restored == NOTE
    assert by_value.first().entities_restored == 8


@pytest.mark.parametrize("text", [
    "Patient seen by Dr. John Smith. Referring physician: Dr. Jane Doe, MD.", NEURO,
    "85 yo male", "Glucose 95 mg/dL (normal 70-100)", "Warfarin 5mg Mon/Wed/Fri, 2.5mg other days",
    "Heavy snow, device is fine, licensed nurse", "", None])
def test_unchanged(anonymized, text):
    out = anonymized(text)[0]
    assert out.anonymized == text and out.entities_detected == 0


@pytest.mark.parametrize("text,gone,kept", [
    ("Patient: John Smith was seen today. His mother Mary Smith was present.",
     ["John Smith", "Mary Smith"], ["was present."]),
    ("Address: 123 Main St, City, State 03698", ["03698"], ["00000"]),
    ("Address: 123 Main St, Boston, MA 02101", ["02101"], ["021**"]),
    ("ZIP: 03601", ["03601"], ["00000"]),
    ("Doctor: Hello Mrs. Johnson, how are you feeling today?", ["Johnson"], ["Doctor: Hello"]),
    ("Mrs. Williams, Dr. Brown will see you now", ["Williams"], ["Dr. Brown"]),
    ("Mr. Smith has diabetes", ["Smith"], ["has diabetes"]),
    ("Ms. Davis called about her prescription", ["Davis"], ["called about her"]),
    ("Hello Anderson, your appointment is confirmed", ["Anderson"], [", your appointment is confirmed"]),
    ("92 year old patient", ["92"], ["90 or above year old patient"]),
    ("Age: 95 years", ["95"], ["90 or above"]),
    ("Surgery scheduled for April 15th, 2025", ["April 15th"], ["XX/XX/2025"]),
    ("follow-up on April 20th.", ["April 20th"], ["XX/XX/XXXX"]),
    ("Call (555) 123-4567 or +1 555.123.4567", ["(555)", "123-4567", "123.4567"], ["Call 555-"]),
    ("Medical Record Number: ABC-123-4567", ["ABC-123-4567"], ["Medical Record Number: MRN-"]),
    ("Patient ID: 987654321", ["987654321"], ["Patient ID: "]),
    ("Pacemaker: Serial Number PM-789456123", ["PM-789456123"], ["Serial Number SN-"]),
    ("Continuous Glucose Monitor: SN CGM-123456", ["CGM-123456"], ["SN SN-"]),
    ("Enrolled in clinical trial: NCT12345678", ["NCT12345678"], ["trial: NCT"]),
    ("Name: Jane Doe\nDOB: 01/15/1960", ["Jane Doe", "01/15"], ["\nDOB: XX/XX/1960"]),
    ("mail o'hara.x+y@a-b.example.co", ["@a-b.example.co"], ["@example.com"]),
    ("see https://x.example/a?b=1 ok", ["x.example"], [" ok"]),
    ("99 High Street Salem NH 03079", ["High Street"], [" NH 030**"]),
    ("Mayra Santos, DOB 01/02/1990", ["Mayra"], ["XX/XX/1990"]),
])
def test_short_lines(anonymized, text, gone, kept):
    out = anonymized(text)[0].anonymized
    for g in gone:
        assert g not in out
    for k in kept:
        assert k in out


def test_offsets_count_characters(anonymized):
    text = "Grüße 😀 an a@b.example.de – 555-123-4567"
    out = anonymized(text)[0]
    for e in out.entities:
        assert text[e.begin:e.end] == e.original
        assert out.anonymized[e.out_begin:e.out_end] == e.fake
    assert [e.type for e in out.entities] == ["EMAIL", "PHONE_NUMBER"]


def test_same_value_same_replacement(anonymized):
    a, b = anonymized("Name: John Smith", "Name: JOHN SMITH")
    assert a.entities[0].fake == b.entities[0].fake


def test_marker_characters_in_the_input(anonymized):
    text = "a\x01b\x02 call 555-123-4567\x01"
    out = anonymized(text)[0]
    assert out.anonymized.startswith("a\x01b\x02 call 555-") and out.anonymized.endswith("\x01")


def test_long_runs_do_not_overflow(anonymized):
    names = "Aaa " * 20000
    dotted = "a." * 20000 + "@"
    assert anonymized(names, dotted)[1].anonymized == dotted


def test_batch_and_consent(spark):
    rows = [(1, "p1", "PATIENT_ID", "John Smith, DOB: 01/15/1980", {"purpose": "quality_improvement"}),
            (2, "p2", "PATIENT_ID", "Jane Doe, MRN: 456789", {"requires_consent": "true", "purpose": "testing"}),
            (3, "p3", "PATIENT_ID", "Bob Johnson, age 92", {"requires_consent": "true"})]
    df = spark.createDataFrame(rows, "doc_id long, identity string, identity_type string, text string, "
                                     "context map<string,string>")
    out = {r.doc_id: r for r in an.anonymize(df, KEY).collect()}
    assert [out[i].status for i in (1, 2, 3)] == [200, 403, 200]
    assert out[2].anonymized is None and out[2].entities_detected == 0
    assert "90 or above" in out[3].anonymized


def test_key_matters(texts):
    a = an.anonymize(texts("mail x@y.example.org"), "one").first().anonymized
    b = an.anonymize(texts("mail x@y.example.org"), "two").first().anonymized
    assert a != b


def test_a_new_rule_is_data(texts):
    from veilwork.functions.rules import ALL_RULES, Rule
    rule = Rule("BADGE", 2001, r"\bB-[0-9]{3}\b", 0.9)
    out = an.anonymize(texts("badge B-123"), KEY, rules=[*ALL_RULES, rule]).first()
    assert out.anonymized == "badge [REDACTED-BADGE]"


def test_spark_context_names_the_work_folder(spark):
    from veilwork.session import work_folder
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("text,gone", [
    ("License: dl-889234", "dl-889234"), ("EID: e4455", "e4455"), ("VIN: 1hgcm82633a123456", "1hgcm82633a123456"),
    ("Fingerprint ID: fp1234567", "fp1234567"), ("Serial Number: pm-12345", "pm-12345"),
    ("His mother MARY SMITH was present", "MARY SMITH"), ("Dear JOHN, hello", "JOHN"), ("Staff contacted JANE DOE", "JANE DOE")])
def test_any_case(anonymized, text, gone):
    assert gone not in anonymized(text)[0].anonymized


@pytest.mark.parametrize("text,name", [
    ("Patient: Mary-Ann O'Neil, DOB: 01/02/1990", "Mary-Ann O'Neil"), ("Name: José García\nMRN: AB-123456", "José García"),
    ("Mr. Smith-Jones has diabetes", "Mr. Smith-Jones"), ("Mrs. D’Angelo, please wait", "Mrs. D’Angelo"),
    ("His mother Zoë Müller-Lüdenscheidt was present", "Zoë Müller-Lüdenscheidt"), ("Staff contacted Ronald McDonald today", "Ronald McDonald"),
    ("His father JOSÉ O'NEIL was present", "JOSÉ O'NEIL"), ("Dear MARY-ANN, hello", "MARY-ANN"), ("Łukasz Żak, DOB 01/02/1990", "Łukasz Żak"),
    ("Élodie Brontë", "Élodie Brontë"), ("Ivan Петров, DOB 01/02/1990", "Ivan Петров"), ("Hello Ángel how are you", "Ángel")])
def test_names_are_taken_whole(anonymized, text, name):
    out = anonymized(text)[0]
    assert [e.original for e in out.entities if e.type == "NAME"] == [name]


@pytest.mark.parametrize("text", [
    "Follow-up is scheduled", "X-Ray was normal", "Seen by Dr. José García-López. Nurse: Zoë O'Neil, RN", "It's fine. She's well"])
def test_not_names(anonymized, text):
    assert anonymized(text)[0].anonymized == text


def test_record_numbers_in_any_case(anonymized):
    for text in ("MRN: ab-12345", "Patient ID: p12345", "mrn ab12345-c"):
        out = anonymized(text)[0]
        assert [e.type for e in out.entities] == ["MRN"] and "12345" not in out.anonymized.replace(out.entities[0].fake, "")


def test_planted_originals(spark):
    from veilwork.operators import checks
    rows = [(1, "x José y", [("NAME", "José")]), (2, "Dr. José Smith left", [("NAME", "José")]), (3, "gone", [("NAME", "José"), ("A", None)])]
    df = spark.createDataFrame(rows, "doc_id long, anonymized string, planted array<struct<type:string,original:string>>")
    assert [tuple(r) for r in checks.planted_leaks(df, "planted").collect()] == [(1, "NAME", "José")]
