"""The query log: one JSON line per run."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.statements import first_word

LOG_SCHEMA = "timestamp timestamp, query string, rows bigint, elapsed_ms double"


def append_query_log(
    spark: SparkSession,
    path: str,
    runs: Iterable[tuple[str, int, float]],
    now: datetime | None = None,
) -> None:
    """Appends a session's runs ``(query, rows, elapsed_ms)`` in one small file."""
    at = now or datetime.now(timezone.utc)
    lines = [(at, query.strip(), rows, round(float(ms), 1)) for query, rows, ms in runs]
    spark.createDataFrame(lines, LOG_SCHEMA).coalesce(1).write.mode("append").json(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def query_log_stats(log: DataFrame) -> DataFrame:
    """Runs, rows and time by day and leading word, from partial aggregates; the percentiles are sketches."""
    return (
        log.groupBy(
            F.date_trunc("day", "timestamp").alias("day"),
            F.coalesce(first_word(F.col("query")), F.lit("")).alias("first_word"),
        )
        .agg(
            F.count("*").alias("runs"),
            F.sum("rows").alias("rows"),
            F.avg("elapsed_ms").alias("avg_ms"),
            F.percentile_approx("elapsed_ms", 0.5).alias("p50_ms"),
            F.percentile_approx("elapsed_ms", 0.95).alias("p95_ms"),
            F.max("elapsed_ms").alias("max_ms"),
        )
    )
