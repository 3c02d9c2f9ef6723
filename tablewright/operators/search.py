"""Keyword and vector search in one ranked list per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.substring import keyword_hits
from tablewright.operators.topk import BROADCAST_HITS, DEFAULT_THRESHOLD, topk_join
from tablewright.session import work_folder

# --- Fixed values -------------------------------------------------------------------
SEARCH_K = 10
KEYWORD_SIMILARITY = 1.0
KEYWORD_SOURCE = "keyword"
# ------------------------------------------------------------------------------------
HIT_TEXTS = ("question", "sql", "source", "dashboard", "description")


def with_texts(hits: DataFrame, index: DataFrame, at_most: int) -> DataFrame:
    """Hits with the index's text columns. Where the number of hits is known to be small they
    go to the index's tasks and the index is not shuffled."""
    texts = index.select("id", *HIT_TEXTS)
    return texts.join(F.broadcast(hits) if at_most <= BROADCAST_HITS else hits, "id")


def search(
    queries: DataFrame,
    dictionary: DataFrame,
    index: DataFrame | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    k: int = SEARCH_K,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Ranked hits of every query: keywords at similarity 1, then the nearest vectors.

    ``queries(query_id, text)`` and, when there is no ``embed``, optionally ``embedding``. With
    neither vectors nor a way to make them, the keyword hits alone are returned. Keyword hits
    come first at equal similarity, in keyword order, so no more than k of them are ever needed.
    """
    words = keyword_hits(queries, dictionary, first=k).select(
        "query_id",
        F.lit("").alias("question"),
        F.lit("").alias("sql"),
        F.lit(KEYWORD_SOURCE).alias("source"),
        F.lit("").alias("dashboard"),
        F.col("content").alias("description"),
        F.lit(KEYWORD_SIMILARITY).alias("similarity"),
        F.col("keyword").alias("keyword_match"),
        F.lit(0).alias("kind"),
        F.col("position").alias("place"),
    )
    hits = words
    vectors = queries
    if embed:
        # Written once: the model is not asked again for the count, the scan, or a lost executor.
        staged = f"{work_folder(queries.sparkSession)}/queries"
        embed(queries).write.parquet(staged)
        vectors = queries.sparkSession.read.parquet(staged)
    if index is not None and "embedding" in vectors.columns:
        near = topk_join(vectors, index, k, threshold)
        found = with_texts(near, index, vectors.count() * k).select(
            "query_id",
            *HIT_TEXTS,
            "similarity",
            F.lit(None).cast("string").alias("keyword_match"),
            F.lit(1).alias("kind"),
            F.col("rank").alias("place"),
        )
        hits = words.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "kind", "place")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.drop("kind", "place")
