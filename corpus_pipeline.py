"""A training corpus from raw documents, in stages that each read what the one before has kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelake.llm import mixing, near_copies, packing, secret_scan, toxicity
from pricelake.llm.common import shared_dir
from pricelake.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents of a batch that goes to a Python worker: with Spark's own 10,000, both sides would hold tens of megabytes of texts.
BATCH = 1000
#: Words whose ids a worker keeps in packing: its JVM has grown by then.
REMEMBERED = 30_000


def _small_batches(spark: SparkSession) -> None:
    """Sets the batch size for what the session runs from now on, unless it has one of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go; learnt from the labels of the training fold."""
    _small_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), limit=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 over shingles of five words) stays, that with the smallest doc_id; SimHash and MinHash name candidates."""
    return near_copies.deduplicated(docs, width=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text becomes a mark; every document stays."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: a row for each time that a document is taken."""
    return mixing.mixed(docs, weights=(3, 1, 2), total=1.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is in the packed sequences."""
    return packing.packed(docs, tokenizer_path(), capacity=2048, with_ids=False, remembered=REMEMBERED)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Packing by search and trained scores can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
