"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Rejects toxic documents, takes out lines that stand in an earlier document, keeps one of each
group of near copies, masks secrets and packs what is left into sequences of tokens. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.common import staged
from tablewright.llm.line_dedup import SHORT_CHARS, deduped
from tablewright.llm.ngram_join import one_of_each
from tablewright.llm.packing import pack
from tablewright.llm.secret_scan import redact
from tablewright.llm.toxicity import fit_severity, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Documents that a Python worker gets at once; whole texts, so some megabytes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Documents are large rows: the stages, which share the executors' workers, take fewer at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not reject."""
    small_batches(spark)
    return without_toxic(docs, fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in an earlier place, up to two edits in long ones."""
    small_batches(spark)
    return deduped(docs, short=SHORT_CHARS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id."""
    small_batches(spark)
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    small_batches(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    small_batches(spark)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return pack(docs, file.read())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_join),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]

# SQL has no trained model, no edit distance join with transitive classes and no packing plan; the
# stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
