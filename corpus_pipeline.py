"""A corpus pipeline of five operators: toxicity, near-duplicates, secrets, mixture, packing. Part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intervane.llm import bestfit_packing, near_copies, secret_scan, simhash_dedup, source_mixing, toxicity
from intervane.llm.common import save, tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model, trained on the labelled ones among them, doesn't predict toxic.

    Null and empty texts are judged as empty ones; rows without doc_id are judged but not learned from; repeated rows go together.
    """
    model = toxicity.train(docs, toxicity.learnable(tables(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 64-bit SimHash near-duplicates, within op6's 3 bits. Not a stage: it misses most edited copies."""
    return simhash_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five-word shingle sets of Jaccard similarity 0.8 or more: the smallest doc_id.

    Candidates come from SimHash and exact comparison follows; what the fingerprints miss is found by shared shingles. Texts
    without words, nulls among them, are one group. Rows without doc_id come after all others.
    """
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars set anew. Rows without a finding, nulls among them, stay as they are."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to the source, language and topic targets. Null values are of the cell "other"."""
    return source_mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 4096 tokens and 64 documents: many short ones are spread by the vector rule."""
    return bestfit_packing.pack_documents(docs, limits=bestfit_packing.Limits(documents=64))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("bestfit_packing", pack_sequences),
]

#: Trained models, 64-bit hashes and a tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
