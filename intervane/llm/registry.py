"""The subpackage's registered queries: thin forms of its operators, with production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.llm import bestfit_packing, compression_quality, exact_fingerprint, hard_negatives, lm_scoring, media_features, secret_scan
from intervane.llm import simhash_dedup, source_divergence, source_mixing, suffix_dedup, token_files, toxicity
from intervane.llm.common import tables


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score(tables(spark, sf_dir, "documents"))
    hits = [F.col("hits")[k].alias(f"n{3 - k}") for k in range(4)]
    return out.select("doc_id", "n_tokens", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"), *hits)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(tables(spark, sf_dir, "documents"))
    n = [secret_scan.count_of(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *n, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mixing.calibrate(tables(spark, sf_dir, "documents"))
    return out.withColumn("probability", F.round("probability", 9))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    model = toxicity.train(docs, toxicity.learnable(labels))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted", "n_sentences", "sentences")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(tables(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.cluster(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(tables(spark, sf_dir, "documents"))


def op8_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features.digests(tables(spark, sf_dir, "documents"))


def op9_exact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_fingerprint.fingerprint(tables(spark, sf_dir, "documents"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    model = compression_quality.train(docs, compression_quality.learnable(labels))
    out = compression_quality.score(docs, model)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted", "good_bytes", "bad_bytes", "difference")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables(spark, sf_dir, "embeddings")
    return hard_negatives.mine(vectors.withColumn("label", hard_negatives.relabelled(F.col("label").cast("long"), F.col("vec_id"))))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(tables(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.compare(tables(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mixing": op3_source_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_bestfit_packing": op7_bestfit_packing,
    "op8_media_features": op8_media_features,
    "op9_exact_fingerprint": op9_exact_fingerprint,
    "op10_compression_quality": op10_compression_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_source_divergence": op13_source_divergence,
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op1_lm_scoring": f"WITH {lm_scoring.sql()} SELECT doc_id, n_tokens, round(log10_score, 4) AS log10_score, CASE WHEN n_tokens > 0 THEN round(log10_score / n_tokens, 6) END AS mean_log10, n3, n2, n1, n0 FROM lm_scores",
    "op3_source_mixing": f"WITH {source_mixing.sql()} SELECT doc_id, c_source AS source_cell, c_lang AS lang_cell, c_topic AS topic_cell, c_tokens AS n_tokens, round(probability, 9) AS probability, kept FROM mixed",
    "op11_hard_negatives": hard_negatives.sql(),
    "op13_source_divergence": source_divergence.sql(),
}
