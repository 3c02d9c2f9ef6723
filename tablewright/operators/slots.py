"""Named query slots of a data app, as rendered values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import NO_VALUE, format_scalar
from tablewright.operators.catalog import union_all
from tablewright.operators.guard import DEFAULT_LIMIT, safe_sql

SLOT_SCHEMA = "slot string, format string, rendered string, error string"


def scalar_value(df: DataFrame, name: str) -> DataFrame:
    """The first cell for display, or a dash when there are no rows. Always one row."""
    first = df.schema.fields[0]
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    shown = renamed.limit(1).agg(
        F.count("*").alias("n"),
        F.first(format_scalar(F.col("c0"), first.dataType)).alias("text"),
    )
    return shown.select(
        F.lit(name).alias("slot"),
        F.lit("scalar").alias("format"),
        F.when(F.col("n") == 0, NO_VALUE).otherwise(F.col("text")).alias("rendered"),
    )


def chart_points(df: DataFrame) -> DataFrame:
    """The first two columns as x and y; a single column is y."""
    names = [f"c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*names)
    if len(names) == 1:
        return renamed.select(F.col("c0").alias("y"))
    return renamed.select(F.col("c0").alias("x"), F.col("c1").alias("y"))


def chart_value(df: DataFrame, name: str, points: int = DEFAULT_LIMIT) -> DataFrame:
    """A bar trace as JSON, in row order. A query with more rows than a chart slot may hold is an
    error, as the trace is one value; nothing is left out."""
    rows = chart_points(df).limit(points + 1).withColumn("place", F.monotonically_increasing_id())
    ordered = F.array_sort(F.collect_list(F.struct("place", *[c for c in rows.columns if c != "place"])))
    axes = [c for c in ("x", "y") if c in rows.columns]
    trace = F.struct(
        *[F.col("rows")[c].alias(c) for c in axes],
        F.lit("bar").alias("type"),
        F.lit(name).alias("name"),
    )
    too_many = F.raise_error(F.lit(f"chart slot {name} has more than {points} rows; aggregate further"))
    text = F.to_json(trace, {"ignoreNullFields": "false"})
    return rows.agg(ordered.alias("rows")).select(
        F.lit(name).alias("slot"),
        F.lit("chart").alias("format"),
        F.when(F.size("rows") > points, too_many.cast("string")).otherwise(text).alias("rendered"),
    )


def table_value(df: DataFrame, name: str, rows: int = DEFAULT_LIMIT) -> DataFrame:
    """The rows as a JSON list, with the same rule on size as a chart."""
    names = df.columns
    listed = df.limit(rows + 1).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("row"))
    listed = listed.withColumn("place", F.monotonically_increasing_id())
    ordered = F.array_sort(F.collect_list(F.struct("place", "row")))
    too_many = F.raise_error(F.lit(f"table slot {name} has more than {rows} rows; aggregate further"))
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]"))
    return listed.agg(ordered.alias("rows")).select(
        F.lit(name).alias("slot"),
        F.lit("table").alias("format"),
        F.when(F.size("rows") > rows, too_many.cast("string")).otherwise(text).alias("rendered"),
    )


RENDERERS = {"scalar": scalar_value, "chart": chart_value, "table": table_value}


def slot_value(spark: SparkSession, slot: Mapping[str, str]) -> DataFrame:
    """One slot ``{slot, sql, format}`` as a lazy one-row frame, under the read guard.

    The query is not capped here: the renderer asks for one row more than it holds, and so sees
    that there are more.
    """
    render = RENDERERS.get(slot.get("format", "scalar"), scalar_value)
    return render(safe_sql(spark, slot["sql"], limit=None), slot["slot"])


def slot_values(spark: SparkSession, slots: Iterable[Mapping[str, str]]) -> DataFrame:
    """All slots in one job; a failing slot fails the job. See ``evaluate_slots``."""
    return union_all(slot_value(spark, slot) for slot in slots)


def evaluate_slots(spark: SparkSession, slots: Iterable[Mapping[str, str]]) -> DataFrame:
    """All slots, each on its own: a failing one yields its error text and the others go on.

    One short value per slot comes back to the driver. Calling it again refreshes the values.
    """
    rows = []
    for slot in slots:
        kind = slot.get("format", "scalar")
        try:
            rows.append((slot["slot"], kind, slot_value(spark, slot).first()["rendered"], None))
        except Exception as error:  # noqa: BLE001 - reported in the slot
            rows.append((slot["slot"], kind, None, f"Error: {error}"))
    return spark.createDataFrame(rows, SLOT_SCHEMA)
