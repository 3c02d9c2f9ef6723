"""The vector index, the dictionaries and the saved patterns, as tables.

Every change is a new DataFrame; ``tablewright.sources.store`` writes it as a new version.
No broadcast is asked for here: Catalyst picks it where a batch's measured size allows, and a
large batch is joined on its keys instead.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.times import moment

INDEX_SCHEMA = (
    "id string, question string, sql string, source string, dashboard string, "
    "description string, embedding array<double>, created_at timestamp, updated_at timestamp"
)
INDEX_DEFAULTS = {
    "question": "",
    "sql": "",
    "source": "manual",
    "dashboard": "",
    "description": "",
}


def no_vector() -> Column:
    return F.array().cast("array<double>")


def last_per_key(df: DataFrame, key: str, order_by: str | None) -> DataFrame:
    """The last row of each key. Folded map-side, so a key with most of the rows is no hot group."""
    if order_by is None:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.col(order_by)).alias("last")
    return df.groupBy(key).agg(last).select(key, *[F.col("last")[c].alias(c) for c in rest])


def _batch(rows: DataFrame, order_by: str | None, keep_vector: bool) -> DataFrame:
    latest = last_per_key(rows, "id", order_by)
    filled = [
        (F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)).alias(c)
        for c, default in INDEX_DEFAULTS.items()
    ]
    if not keep_vector:
        given = F.col("embedding").cast("array<double>") if "embedding" in rows.columns else no_vector()
        filled.append(F.coalesce(given, no_vector()).alias("embedding"))
    return latest.select("id", *filled)


def _changed(index: DataFrame, batch: DataFrame, now: datetime | Column, carried: list[str]) -> DataFrame:
    known = index.join(batch.select("id"), "id", "left_semi").select("id", *carried)
    fresh = batch.join(known, "id", "left")
    stamp = moment(now).cast("timestamp")
    fresh = fresh.withColumns({"created_at": F.coalesce("created_at", stamp), "updated_at": stamp})
    if "embedding" in carried:
        fresh = fresh.withColumn("embedding", F.coalesce("embedding", no_vector()))
    return fresh.select(*index.columns)


def _replace(index: DataFrame, batch: DataFrame, now: datetime | Column, carried: list[str]) -> DataFrame:
    kept = index.join(batch.select("id"), "id", "left_anti")
    return kept.unionByName(_changed(index, batch, now, carried))


def changes(index: DataFrame, rows: DataFrame, now: datetime | Column, order_by: str | None = None) -> DataFrame:
    """Only the rows an ``upsert`` would write, complete, one per id.

    For an index kept in a table format with MERGE: there the rest need not be rewritten.
    """
    return _changed(index, _batch(rows, order_by, keep_vector=False), now, ["created_at"])


def upsert(index: DataFrame, rows: DataFrame, now: datetime | Column, order_by: str | None = None) -> DataFrame:
    """Inserts rows, or replaces all fields but ``created_at`` where the id is known.

    ``order_by`` names the column that says which of several rows with one id is the last.
    The kept rows only pass an anti join on the batch's ids; the index is not re-sorted.
    """
    return _replace(index, _batch(rows, order_by, keep_vector=False), now, ["created_at"])


def edit(index: DataFrame, rows: DataFrame, now: datetime | Column, order_by: str | None = None) -> DataFrame:
    """``upsert`` of the text fields that carries the stored vector over."""
    batch = _batch(rows, order_by, keep_vector=True)
    return _replace(index, batch, now, ["created_at", "embedding"])


def edit_changes(index: DataFrame, rows: DataFrame, now: datetime | Column, order_by: str | None = None) -> DataFrame:
    """Only the rows an ``edit`` would write, complete, one per id."""
    return _changed(index, _batch(rows, order_by, keep_vector=True), now, ["created_at", "embedding"])


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def existing(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that the index holds."""
    return ids.select("id").distinct().join(index.select("id"), "id", "left_semi")


def get(index: DataFrame, id_: str) -> DataFrame:
    return index.where(F.col("id") == id_).drop("embedding")


def list_all(index: DataFrame) -> DataFrame:
    """All rows without vectors, the newest update first."""
    return index.drop("embedding").orderBy(F.desc("updated_at"), "id")


def index_stats(index: DataFrame) -> DataFrame:
    """Vectors and last update per source, and a total row (``is_total``, null source).

    The rows are folded by source first, so only the few sums are rolled up.
    """
    by_source = index.groupBy("source").agg(F.count("*").alias("n"), F.max("updated_at").alias("last"))
    return by_source.rollup("source").agg(
        F.grouping("source").cast("boolean").alias("is_total"),
        F.sum("n").alias("vectors"),
        F.max("last").alias("last_updated"),
    )


def knowledge_stats(
    patterns: DataFrame, keywords: DataFrame, terms: DataFrame, index: DataFrame
) -> DataFrame:
    """Counts of patterns, keywords, terms and vectors (these also by source)."""

    def counted(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(
            F.lit(kind).alias("kind"),
            F.lit(None).cast("string").alias("source"),
            F.count("*").alias("rows"),
            F.lit(None).cast("timestamp").alias("last_updated"),
        )

    vectors = index_stats(index).select(
        F.when(F.col("is_total"), "vectors").otherwise("vectors by source").alias("kind"),
        "source",
        F.col("vectors").alias("rows"),
        "last_updated",
    )
    return (
        counted("patterns", patterns)
        .unionByName(counted("keywords", keywords))
        .unionByName(counted("terms", terms))
        .unionByName(vectors)
    )


def put(dictionary: DataFrame, rows: DataFrame, order_by: str | None = None) -> DataFrame:
    """Adds or replaces entries of a two-column dictionary; the first column is the key."""
    key, value = dictionary.columns
    batch = last_per_key(rows, key, order_by).select(key, value)
    return dictionary.join(batch.select(key), key, "left_anti").unionByName(batch)


def remove(dictionary: DataFrame, keys: DataFrame) -> DataFrame:
    key = dictionary.columns[0]
    return dictionary.join(keys.select(key), key, "left_anti")


def listed(dictionary: DataFrame) -> DataFrame:
    return dictionary.orderBy(dictionary.columns[0])
