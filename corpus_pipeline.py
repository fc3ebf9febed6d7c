"""The corpus pipeline: STAGES in order, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import bpe, common, decontaminate, jaccard_join, language_id, substring_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a language that the labelled documents teach."""
    labelled = docs.where(~language_id.held_out())
    prototypes = language_id.train(labelled)
    return language_id.keep_known(docs, prototypes, language_id.score_bounds(labelled, prototypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has."""
    return substring_dedup.without_repeats(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every kept text, and a digest of what they decode to."""
    out = bpe.bpe(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("language_id", known_language), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("benchmark_decontamination", benchmark_free), ("bpe", encoded)]

#: Language ID and BPE have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


@common.tidied
def after(stage, spark: SparkSession, docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """What a stage gives, written; the stage's own tables are deleted."""
    return common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")


@common.tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = after(stage, spark, docs, sf_dir, name)
    return STAGES[-1][1](spark, docs, sf_dir)
