"""The registered queries of this folder and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chunked_bpe, crf, decontaminate, filter_audit, hilbert, line_frequency, packing, product_codes, simhash, sql, suffix_dedup, template_removal, url_rules, warc
from .common import load


def op1_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_removal.extract(load(spark, sf_dir, "pages"))


def op2_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.score(load(spark, sf_dir, "documents"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = crf.fit(docs, labels, train_rows=~crf.held_out(F.col("doc_id")))
    return crf.score(docs, model)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(load(spark, sf_dir, "documents")))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(load(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.score(load(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(load(spark, sf_dir, "documents"))


def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.encode(load(spark, sf_dir, "embeddings"))


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.round_trip(load(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in [op1_template_removal, op2_seekable_warc, op3_line_frequency, op4_line_crf, op5_decontamination, op6_sum_of_squares_packing, op7_hilbert_sharding, op8_url_rules, op9_suffix_dedup, op10_simhash_components, op11_gnat_codes, op12_chunked_bpe, op13_filter_audit, pipeline]}
ORACLES = {"op2_seekable_warc": sql.WARC, "op3_line_frequency": sql.LINE_FREQUENCY, "op5_decontamination": sql.DECONTAMINATION, "op11_gnat_codes": sql.PRODUCT_CODES, "op13_filter_audit": sql.FILTER_AUDIT}
