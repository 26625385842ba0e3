"""The thin queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import (archive, decontaminate, html_text, line_dedup, nb_svm, oracle, quality, recurrent_lm,
                          resampling, sentence_pieces, shingle_join, source_audit, token_packing, toxicity)
from veilwork.llm.common import table


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.packed(table(spark, sf_dir, "documents"))


def op3_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked(table(spark, sf_dir, "documents")).drop("rid")


def op5_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_report(table(spark, sf_dir, "pages"))


def op9_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.scores(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_report(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_divergence, op2_token_packing, op3_toxic_lexicon, op4_shingle_join,
                                   op5_benchmark_templates,
                                   op6_html_templates, op7_line_dedup, op8_warc_archive, op9_recurrent_lm,
                                   op10_sentence_pieces, op11_importance_resampling, op12_source_divergence,
                                   op13_nbsvm_quality)}
ORACLE = dict(oracle.ORACLE)
