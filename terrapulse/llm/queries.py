"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from terrapulse.llm import (filter_audit, hilbert_ann, language_id, license_scan, line_templates, mixing, oracles,
                            packing, pii, probminhash, quality_llr, resampling, span_dedup, trie_tokens)
from terrapulse.llm.common import read


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_llr.trusted_ids(read(spark, sf_dir, "labels"))
    return quality_llr.measure(read(spark, sf_dir, "documents"), trusted)


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return span_dedup.dedup_spans(docs, whole=True).select("doc_id", "text", "span_dedup.*")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(read(spark, sf_dir, "documents")))


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(read(spark, sf_dir, "embeddings"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "source", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_lines(docs).select("doc_id", "text", "line_dedup.*")


def op8_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_tokens.count_tokens(read(spark, sf_dir, "documents"))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, read(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "language.*")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality_llr, op2_span_dedup, op3_license_scan, op4_pii, op5_hilbert_ann, op6_source_mix, op7_line_templates,
    op8_trie_tokens, op9_probminhash, op10_packing, op11_resample, op12_filter_audit, op13_language_id, pipeline)}

ORACLES = {"op3_license_scan": oracles.LICENSE, "op4_pii": oracles.PII, "op6_source_mix": oracles.MIX,
           "op11_resample": oracles.RESAMPLE, "op12_filter_audit": oracles.AUDIT}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
