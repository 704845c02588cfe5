"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to
``documents``, writing each stage's rows as Parquet in the shared checkpoint folder and
reading them again, so a lost executor costs no earlier stage. All stages hold whole texts in
Python workers, so each sees to small Arrow batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontam import decontaminate
from tessera.llm.linededup import dedup_lines
from tessera.llm.packing import pack
from tessera.llm.simhash import drop_near_duplicates
from tessera.llm.text import table
from tessera.llm.toxicity import drop_toxic
from tessera.session import checkpoint_dir, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; n_chars follows the text.

    Documents of which nothing but white space is left go; those that were blank before stay.
    """
    small_batches(spark)
    done = dedup_lines(docs).where("line_removed = 0 or text is null or text rlike '\\\\S'")
    kept = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.select(*[kept.get(n, F.col(n)).alias(n) for n in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike or more.

    SimHash signatures propose first; an exact join finds what fingerprints miss.
    """
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the stages; tests/llm holds their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; returns the last one's rows."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
