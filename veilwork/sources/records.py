"""Input records: free text, JSON and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """``df`` dealt over ``parts`` tasks, where the caller asks for it; else as it is read.

    For files of one row group, which are one task, and detection is bound by the CPU.
    """
    return df.repartition(parts) if parts else df


def read_text(spark: SparkSession, path: str, fmt: str = "parquet", text: str = "text",
              doc_id: str | None = "doc_id", identity: str | None = None,
              identity_type: str = "USER_ID", **options: str) -> DataFrame:
    """``(doc_id, identity, identity_type, text)`` from any Spark source.

    With the format ``text`` each file is a text, as its folder of notes has it. Where there is no id column (``doc_id``
    None, and always with ``text``), a text is named by a hash of its file and itself. Without ``identity`` each text is
    its own.
    """
    if fmt == "text":
        df = spark.read.text(path, wholetext=True).withColumnRenamed("value", text)
        doc_id = None
    else:
        df = spark.read.format(fmt).options(**options).load(path)
    id_ = F.col(doc_id).cast("bigint") if doc_id else F.xxhash64(F.col("_metadata.file_path"), F.col(text))
    rows = df.select("*", id_.alias("_id"))
    return rows.select(
        F.col("_id").alias("doc_id"), F.col(identity or "_id").cast("string").alias("identity"),
        F.lit(identity_type).alias("identity_type"), F.col(text).alias("text"))


def parse_json(df: DataFrame, column: str, schema: T.StructType | str,
               into: str = "record") -> DataFrame:
    """Parse a JSON column with a given schema; the raw string stays beside it."""
    return df.withColumn(into, F.from_json(F.col(column), schema))


def parse_profile(df: DataFrame, column: str, into: str = "profile") -> DataFrame:
    """Parse a flat JSON object, or a literal dictionary with single quotes, into a map."""
    return df.withColumn(into, F.from_json(
        F.col(column), "map<string,string>", {"allowSingleQuotes": "true"}))
