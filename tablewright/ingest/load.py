"""Charts and schema documents into the vector index."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.questions import with_question
from tablewright.functions.text import (
    chart_text,
    collapse_newlines,
    pattern_text,
    schema_text,
    stable_id,
)
from tablewright.operators.catalog import union_all
from tablewright.operators.embed import Embedder, Rewriter, embed, simplify_sql
from tablewright.operators.index import last_per_key, upsert
from tablewright.session import work_folder

logger = logging.getLogger(__name__)

# --- Fixed values -------------------------------------------------------------------
CORE_SOURCES = ("databricks", "looker", "warehouse")
OTHER_SOURCES = ("mode", "redash", "sigma", "superset")
NEWLINE_SOURCE = "databricks"
# ------------------------------------------------------------------------------------

ROW_COLUMNS = ("id", "question", "sql", "source", "dashboard", "description", "embed_text")


def select_sources(
    wanted: Iterable[str], readers: Mapping[str, Callable[[], DataFrame]]
) -> dict[str, DataFrame]:
    """Rows to load by source. ``all`` means the core sources; an unknown name is reported and
    left out."""
    names = list(wanted)
    names = sorted(CORE_SOURCES) if "all" in names else list(dict.fromkeys(names))
    for name in names:
        if name not in CORE_SOURCES + OTHER_SOURCES:
            logger.warning("unknown source %s", name)
        elif name not in readers:
            logger.warning("no landed data for source %s", name)
    return {name: readers[name]() for name in names if name in readers}


def chart_questions(charts: DataFrame) -> DataFrame:
    """Charts with their id and question: all that a dry run shows."""
    named = charts.withColumn("id", stable_id(F.col("source"), F.col("dashboard_id"), F.col("element_id")))
    return with_question(named, "element_title", "dashboard_title")


def chart_rows(
    charts: DataFrame,
    rewrite: Rewriter | None = None,
    rewrite_chars: int | None = None,
    embed_chars: int | None = None,
) -> DataFrame:
    """Charts of any sources (``source`` column) as index rows with the text to embed.

    Texts are whole by default. ``rewrite_chars`` leaves longer SQL as it is; ``embed_chars`` cuts
    the SQL in the embedded text, never the stored one. A ``place`` column, where the charts
    have one, is kept and says which of several rows with one id is the last.
    """
    simple = simplify_sql(chart_questions(charts), rewrite, sql_chars=rewrite_chars)
    sql = F.when(F.col("source") == NEWLINE_SOURCE, collapse_newlines(F.col("sql"))).otherwise(F.col("sql"))
    return simple.withColumn("sql", sql).select(
        "id",
        "question",
        "sql",
        "source",
        F.col("dashboard_title").alias("dashboard"),
        F.col("element_title").alias("description"),
        chart_text(F.col("question"), F.col("sql"), embed_chars).alias("embed_text"),
        *(["place"] if "place" in charts.columns else []),
    )


def schema_rows(docs: DataFrame) -> DataFrame:
    """Table documents as index rows of source ``warehouse``."""
    return docs.select(
        "id",
        "question",
        F.lit("").alias("sql"),
        F.lit("warehouse").alias("source"),
        F.lit("").alias("dashboard"),
        "description",
        schema_text(F.col("question"), F.col("description")).alias("embed_text"),
    )


def pattern_rows(patterns: DataFrame) -> DataFrame:
    """Saved patterns as index rows; the id is the pattern's file name."""
    return patterns.select(
        F.col("filename").alias("id"),
        "question",
        "sql",
        "source",
        F.lit("").alias("dashboard"),
        "description",
        pattern_text(F.col("question"), F.col("description"), F.col("sql")).alias("embed_text"),
    )


def counters(outcomes: DataFrame) -> DataFrame:
    """Rows created, updated, skipped and failed, by source and (null source) in all.

    ``outcomes(source, outcome)`` are folded map-side first, so one large source is no hot group.
    """
    folded = outcomes.groupBy("source", "outcome").agg(F.count("*").alias("n"))

    def counted(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("n"))), F.lit(0)).alias(name)

    return folded.rollup("source").agg(*[counted(name) for name in ("created", "updated", "skipped", "errors")])


def without_existing(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows the index does not hold, and those it does."""
    ids = index.select("id")
    return rows.join(ids, "id", "left_anti"), rows.join(ids, "id", "left_semi")


@dataclass(frozen=True)
class Load:
    index: DataFrame
    rows: DataFrame
    counters: DataFrame
    failed: DataFrame


def load(
    rows: DataFrame,
    index: DataFrame,
    embedder: Embedder,
    now: datetime | Column,
    skip_existing: bool = False,
    dry_run: bool = False,
    **embed_options: object,
) -> Load:
    """Embeds rows and upserts them: the new index, the rows to upsert into a stored one, the
    counters, and the rows that failed.

    Rows are spread evenly before the costly model calls, and their vectors are written to the
    shared folder once, so neither a lost executor nor the three results repeat the calls.
    Of several rows with one id that with the largest ``place`` is kept, where rows have one;
    the counters count rows, not ids.
    """
    spark = rows.sparkSession
    nothing = rows.limit(0).withColumn("error", F.lit("")).drop("embed_text")
    if dry_run:
        return Load(index, nothing, counters(rows.select("source", F.lit("skipped").alias("outcome"))), nothing)
    skipped = rows.limit(0)
    if skip_existing:
        rows, skipped = without_existing(rows, index)
    staged = f"{work_folder(spark)}/embedded"
    embed(rows.hint("rebalance"), "embed_text", embedder, **embed_options).write.parquet(staged)
    done = spark.read.parquet(staged).drop("embed_text")
    good, failed = done.where(F.col("error").isNull()), done.where(F.col("error").isNotNull())
    fresh, known = without_existing(good, index)
    outcomes = union_all(
        part.select("source", F.lit(outcome).alias("outcome"))
        for part, outcome in ((fresh, "created"), (known, "updated"), (skipped, "skipped"), (failed, "errors"))
    )
    good = good.drop("error")
    if "place" in good.columns:
        good = last_per_key(good, "id", "place").drop("place")
    return Load(upsert(index, good, now), good, counters(outcomes), failed.drop("embedding", "place"))


def rebuild(
    patterns: DataFrame, index: DataFrame, embedder: Embedder, now: datetime | Column, **embed_options: object
) -> Load:
    """Re-embeds every saved pattern into the index."""
    return load(pattern_rows(patterns), index, embedder, now, **embed_options)
