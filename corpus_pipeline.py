"""The corpus pipeline: documents pass the stages in turn, each of which works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tramline.llm.common import shared_dir, table
from tramline.llm.exact_dedup import drop_exact_copies
from tramline.llm.language_id import keep_identified
from tramline.llm.mixing import apply_mix
from tramline.llm.near_dedup import drop_near_copies
from tramline.llm.piece_tokens import encode_documents
from tramline.llm.queries import piece_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source towards its target, repeated where the target is above the source's size."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return encode_documents(docs, piece_model())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("tokens", tokens)]

#: No SQL expresses the language field or the signatures; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others return is written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
