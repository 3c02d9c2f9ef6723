"""Named snapshots of tables and their restoration."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = "name string, created timestamp, parts map<string, string>"


def snapshot_name(name: str) -> str:
    return re.sub(r"[^\w\-]", "_", name)


def _meta(spark: SparkSession, root: str) -> DataFrame:
    """The newest entry of each name; a name used again replaces the older snapshot."""
    try:
        entries = spark.read.schema(META_SCHEMA).json(f"{root}/meta")
    except AnalysisException:
        return spark.createDataFrame([], META_SCHEMA)
    return entries.groupBy("name").agg(
        F.max("created").alias("created"), F.max_by("parts", "created").alias("parts")
    )


def checkpoint(
    spark: SparkSession, root: str, name: str, tables: Mapping[str, DataFrame], now: datetime | None = None
) -> str:
    """Copies the tables under ``name``. The entry that makes the snapshot visible is written last,
    so a copy that was cut short is never restored."""
    name = snapshot_name(name)
    folder = f"{root}/{name}-{uuid.uuid4().hex}"
    parts = {}
    for part, df in tables.items():
        parts[part] = f"{folder}/{part}"
        df.write.parquet(parts[part])
    entry = [(name, now or datetime.now(timezone.utc), parts)]
    spark.createDataFrame(entry, META_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/meta")
    return name


def list_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    return _meta(spark, root).select("name", "created").orderBy("name")


def rollback(spark: SparkSession, root: str, name: str = "") -> dict[str, DataFrame]:
    """The tables of a snapshot, of the newest one without a name.

    Only the parts it holds are returned. An unknown name raises ``LookupError`` naming the
    snapshots there are.
    """
    meta = _meta(spark, root)
    if name:
        found = meta.where(F.col("name") == snapshot_name(name))
    else:
        found = meta.orderBy(F.desc("created"), F.desc("name")).limit(1)
    entry = found.first()
    if entry is None:
        names = [r["name"] for r in list_checkpoints(spark, root).collect()]
        known = f"available: {', '.join(names)}" if names else "no snapshots exist"
        raise LookupError(f"snapshot {name!r} not found; {known}" if name else "no snapshots found")
    return {part: spark.read.parquet(path) for part, path in entry["parts"].items()}


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only in one of two snapshots of a table, with ``change`` added or removed."""
    added = after.exceptAll(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))
