"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import decontaminate, line_dedup, quality, sentence_pieces, shingle_join
from veilwork.llm.common import stage, table

ORACLE_SQL = None  # no SQL expresses the stages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    out = line_dedup.dedup_text(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8."""
    return shingle_join.first_of_each(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentence_piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return sentence_pieces.pieces_of(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("sentence_pieces", sentence_piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stage(docs, name)
    return docs
