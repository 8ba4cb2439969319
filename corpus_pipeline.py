"""A training-data pipeline over the documents table: quality, near duplicates, benchmark leaks, secrets, tokens.

Every stage works on all rows that the one before it kept and keeps the columns of documents, but for the last,
which returns token counts and digests.  Stages are cut by checkpoints in the cluster's shared folder.

Null and empty texts are rejected by the first stage, which asks for 20 words.  Rows with null ids go through like
others; of rows that are equal or nearly so one stays, the one with the smallest id (null last) and then the smallest
digest of its text.  Extra columns are carried up to the last stage, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import decontamination, jaccard_join, piece_tokens, quality_rules, secret_scan
from orbitframe.llm.shared import checkpointed


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id stays."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, whose lengths are counted again where they changed."""
    done = secret_scan.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return piece_tokens.digest_documents(docs, piece_tokens.default_model())


STAGES = [
    ("quality_rules", keep_good_documents),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_texts),
]

#: Encoding and the repetition verdict are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
