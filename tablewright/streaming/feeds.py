"""The query log and landed charts as streams.

A file source keeps what it has read in the query's checkpoint, so a restarted or moved driver
goes on where it stopped. State is bounded by the watermark: later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.statements import first_word
from tablewright.ingest.load import chart_rows, load
from tablewright.operators.embed import Embedder
from tablewright.operators.search import search
from tablewright.sources.query_log import LOG_SCHEMA
from tablewright.sources.store import index_version, loaded_batch, read_index, upsert_index


def query_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The query log as it grows."""
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def log_windows(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs, rows and time per window and leading word of the statement."""
    return (
        log.withWatermark("timestamp", late)
        .groupBy(
            F.window("timestamp", window).alias("w"),
            F.coalesce(first_word(F.col("query")), F.lit("")).alias("first_word"),
        )
        .agg(
            F.count("*").alias("runs"),
            F.sum("rows").alias("rows"),
            F.max("elapsed_ms").alias("max_ms"),
        )
        .select(F.col("w.start").alias("start"), "first_word", "runs", "rows", "max_ms")
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes everything there is now to a parquet folder and stops."""
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )


def load_stream(
    charts: DataFrame, checkpoint: str, load_batch: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hands each batch of landed charts to ``load_batch(charts, batch_id)``. A batch may come again
    after a failure; ``ingest_stream`` is the load that then changes nothing."""
    return (
        charts.writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(
    charts: DataFrame,
    root: str,
    checkpoint: str,
    embedder: Embedder,
    now: datetime | Column,
    name: str = "charts",
    failed_path: str | None = None,
    **rows_options: object,
) -> StreamingQuery:
    """Loads batches of landed charts into the stored index at ``root``, each once.

    The number of a batch is committed to the index together with its rows, under the stream's
    ``name``. A batch that comes again, after a failure or with a lost checkpoint, is passed over
    before any model is asked. Charts that could not be embedded go below ``failed_path``, one
    folder per batch; ``rows_options`` are those of ``chart_rows``.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= loaded_batch(index_version(spark, root), name):
            return
        done = load(chart_rows(batch, **rows_options), read_index(spark, root), embedder, now)
        if failed_path:
            done.failed.write.mode("overwrite").parquet(f"{failed_path}/batch={number}")
        upsert_index(done.rows, root, now, batch=(name, number))

    return load_stream(charts, checkpoint, take)


def search_stream(
    questions: DataFrame,
    dictionary: DataFrame,
    index: DataFrame,
    path: str,
    checkpoint: str,
    **options: object,
) -> StreamingQuery:
    """Searches each batch of new questions in a fixed index; hits go below ``path``, one folder per
    batch, so a batch repeated after a failure replaces its own."""

    def answer(batch: DataFrame, number: int) -> None:
        search(batch, dictionary, index, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return load_stream(questions, checkpoint, answer)
