"""Cleans documents by a chain of stages; each writes its rows for the next to read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, pieces, secrets, simhash, toxicity
from tidemark.llm.common import remove, shared_dir, table
from tidemark.llm.queries import PIECE_MODEL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go. It learns from labelled rows among docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), grade_col="toxic")
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are masked in the text, and n_chars follows it."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids that decode to their texts."""
    return pieces.encode(docs, pieces.load(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", near_dedup),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("pieces", to_pieces),
]

#: Fingerprints, a trained model and edit distances have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote goes once the next one has written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            remove(spark, done)
        done = path
    return docs
