"""Inputs derived from the given tables.

The given texts hold few kinds of identifiers, so clinical notes, records and profiles are composed
from the columns of ``orders``, one per row, in SQL that Spark and other engines read alike. They
grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import records as rec

SECRET = "demonstration-key"

_FIRST = "split_part('John,Mary-Ann,Robert,José,Susan,Jane,Peter,Zoë', ',', CAST({k} % 8 AS INT) + 1)"
_LAST = ("replace(split_part('Smith,O_Neil,Doe,Davis,Smith-Jones,Williams,McCoy,Nguyen,García,Brown,Clark', "
         "',', CAST({k} % 11 AS INT) + 1), '_', chr(39))")

FIRST, LAST = _FIRST.format(k="o_custkey"), _LAST.format(k="o_custkey")
FIRST2, LAST2 = _FIRST.format(k="(o_orderkey + 3)"), _LAST.format(k="(o_orderkey + 5)")


def _pad(value: str, n: int) -> str:
    return f"lpad(CAST({value} AS STRING), {n}, '0')"


MM, DD = _pad("month(o_orderdate)", 2), _pad("day(o_orderdate)", 2)
YYYY = _pad("year(o_orderdate)", 4)
DATE = f"{MM} || '/' || {DD} || '/' || {YYYY}"
MRN = f"'ABC-' || {_pad('o_orderkey', 6)}"
PHONE = f"'555-' || {_pad('100 + o_custkey % 900', 3)} || '-' || {_pad('o_orderkey % 10000', 4)}"
EMAIL = f"substr(lower({FIRST}), 1, 2) || '.' || CAST(o_custkey AS STRING) || '@mail.example.net'"
SSN = (f"{_pad('100 + o_custkey % 700', 3)} || '-' || {_pad('o_orderkey % 90 + 10', 2)} || '-' || "
       f"{_pad('o_orderkey % 10000', 4)}")
INSURANCE = f"'BCB' || {_pad('o_orderkey', 9)}"
ZIP = _pad("(o_orderkey * 7) % 100000", 5)
ADDRESS = (f"CAST(100 + o_custkey % 900 AS STRING) || ' Main St, Boston, MA ' || "
           f"{_pad('(o_orderkey * 13) % 100000', 5)}")
CARD = (f"'4111 ' || {_pad('o_custkey % 10000', 4)} || ' ' || {_pad('o_orderkey % 10000', 4)} || "
        "' 1881'")
IP = "'172.16.' || CAST(o_custkey % 256 AS STRING) || '.' || CAST(o_orderkey % 256 AS STRING)"
URL = "'https://portal.example.net/p/' || CAST(o_custkey AS STRING)"
AGE = "CAST(80 + o_orderkey % 25 AS STRING)"

NAME_LINE = f"""CASE o_orderkey % 8
  WHEN 0 THEN 'Hello Mrs. ' || {LAST2} || ', how are you feeling today?'
  WHEN 1 THEN 'His mother ' || upper({FIRST2} || ' ' || {LAST2}) || ' was present.'
  WHEN 2 THEN 'Staff contacted ' || {FIRST2} || ' ' || {LAST2} || ' about the refill.'
  WHEN 3 THEN 'Caregiver ' || {FIRST2} || ' ' || {LAST2} || ' lives nearby.'
  WHEN 4 THEN 'Dear ' || upper({FIRST2}) || ', your appointment is confirmed.'
  WHEN 5 THEN 'Seen by Dr. ' || {FIRST2} || ' ' || {LAST2} || '. Nurse: Patricia ' || {LAST2} || ', RN'
  WHEN 6 THEN 'Mr. ' || {LAST2} || ' has diabetes. ' || {FIRST2} || ', his son, agrees.'
  ELSE 'Name: ' || {FIRST2} || ' ' || {LAST2} END"""
DATE_LINE = f"""CASE o_orderkey % 6
  WHEN 0 THEN {DATE} WHEN 1 THEN {YYYY} || '-' || {MM} || '-' || {DD}
  WHEN 2 THEN {DD} || ' Mar ' || {YYYY} WHEN 3 THEN 'April ' || {DD} || 'th, ' || {YYYY}
  WHEN 4 THEN {DD} || '/Nov/' || {YYYY} ELSE 'April 20th' END"""
NL = "chr(10)"

NOTE = f"""'Patient: ' || {FIRST} || ' ' || {LAST} || ', DOB: ' || {DATE} || ', MRN: ' || {MRN} || {NL}
|| 'Phone: ' || {PHONE} || ', Email: ' || {EMAIL} || {NL}
|| 'SSN: ' || {SSN} || ', Insurance ID: ' || {INSURANCE} || ', policy XY' || {_pad('o_orderkey', 8)} || {NL}
|| 'Home: ' || {ADDRESS} || '; ZIP: ' || {ZIP} || '; Patient ID: ' || {_pad('o_custkey', 8)} || {NL}
|| 'Diagnosis: Type 2 Diabetes Mellitus (E11.9), Hypertension (I10)' || {NL}
|| 'Metformin 1000mg BID; Glucose: 256 mg/dL; Blood Pressure: 145/92 mmHg; MMSE Score: 24/30' || {NL}
|| {NAME_LINE} || {NL}
|| 'License # dl-' || {_pad('o_custkey', 6)} || '; Plate: KX-' || {_pad('o_orderkey % 1000', 3)}
|| '; VIN: 1hgcm82633a' || {_pad('o_orderkey % 1000000', 6)} || {NL}
|| 'Pacemaker: Serial Number pm-' || {_pad('o_orderkey', 9)} || '; Device ID INS-' || {_pad('o_custkey', 6)}
|| 'ABC; Fingerprint ID: fp' || {_pad('o_custkey', 7)} || {NL}
|| 'Trial NCT' || {_pad('o_custkey', 8)} || '; Employee ID: e' || {_pad('o_custkey', 5)} || '; call (555) 222-'
|| {_pad('o_orderkey % 10000', 4)} || {NL}
|| 'Portal ' || {URL} || ' from ' || {IP} || ', card ' || {CARD} || {NL}
|| 'Age: ' || {AGE} || ' years; next appointment: ' || {DATE_LINE}"""



def record_sql(name: str = f"{FIRST} || ' ' || {LAST}", date: str = DATE,
               mrn: str = f"'MRN-' || {_pad('o_orderkey', 6)}", phone: str = PHONE,
               email: str = EMAIL) -> str:
    """A JSON patient record as SQL text; every identifier can be given another expression."""
    return f"""'{{"patient": {{"name": "' || {name} || '", "dob": "' || {date}
|| '", "mrn": "' || {mrn} || '", "phone": "' || {phone} || '"}}, "visit": {{"date": "'
|| {date} || '", "provider": "Dr. ' || {FIRST2} || ' ' || {LAST2}
|| ', MD", "note": "line \\"one\\"\\nEmail ' || {email} || '"}}, "diagnoses": ["Type 2 Diabetes (E11.9)", "Call '
|| {phone} || '"], "medications": [{{"name": "Metformin", "dose": "1000mg"}}], "vitals": {{"heart_rate": '
|| CAST(60 + o_orderkey % 40 AS STRING) || ', "temperature": 98.60, "note": null, "empty": ""}}}}'"""


RECORD = record_sql()

PROFILE = [("first_name", FIRST), ("last_name", LAST), ("dob", DATE), ("zip", ZIP),
           ("phone", PHONE), ("email", EMAIL), ("provider_first_name", FIRST2),
           ("diagnosis", "'Type 2 Diabetes'"), ("comment", f"'seen ' || {DATE}"), ("extra", "''")]

IDENTITY = "'cust-' || CAST(o_custkey AS STRING)"


def spread(df: DataFrame) -> DataFrame:
    """Dealt over as many tasks as the session's setting ``veilwork.input.partitions`` says; by default as read."""
    parts = df.sparkSession.conf.get("veilwork.input.partitions", None)
    return rec.spread(df, int(parts) if parts else None)


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows from which texts are composed, dealt over four tasks a core or ``veilwork.input.partitions``.

    A file of a few MB is one task as it is read, and holds the keys of a million texts.
    """
    spark = df.sparkSession
    parts = spark.conf.get("veilwork.input.partitions", None)
    return rec.spread(df, int(parts) if parts else 4 * spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents; their source stands for the identity."""
    return spread(table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source AS identity", "'SOURCE' AS identity_type", "text"))


def orders(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """One row per order with derived columns."""
    exprs = [f"{e} AS {n}" for n, e in columns.items()]
    return table(spark, sf_dir, "orders").selectExpr(*exprs)


def dealt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the orders that notes, records, profiles and requests are made of, dealt over the tasks."""
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clinical note per order; the customer is the identity."""
    return as_notes(dealt_orders(spark, sf_dir))


def as_notes(orders_: DataFrame) -> DataFrame:
    return orders_.selectExpr("o_orderkey AS doc_id", f"{IDENTITY} AS identity",
                              "'CUSTOMER' AS identity_type", f"{NOTE} AS text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON patient record per order."""
    raw = dealt_orders(spark, sf_dir)
    spark_sql = RECORD.replace("\\", "\\\\")    # Spark reads escapes in literals
    return raw.selectExpr("o_orderkey AS doc_id", f"{IDENTITY} AS identity",
                          "'CUSTOMER' AS identity_type", f"{spark_sql} AS record")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile per order."""
    raw = dealt_orders(spark, sf_dir)
    pairs = ", ".join(f"'{k}', {v}" for k, v in PROFILE)
    return raw.selectExpr("o_orderkey AS doc_id", f"{IDENTITY} AS identity",
                          "'CUSTOMER' AS identity_type", f"map({pairs}) AS profile")
