"""Chart-ready series and aggregates.

The aggregate runs on the cluster; what is left to draw is a few rows per mark. Column totals are
scalar subqueries, so no chart needs a window or a join over all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.quantiles import count_groups, exact_quantiles, join_groups

# --- Fixed values -------------------------------------------------------------------
WHISKER_IQR = 1.5
QUARTILES = [0.25, 0.5, 0.75]
# ------------------------------------------------------------------------------------
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# What one group's row costs in a table sent to the tasks.
BOX_BYTES = 256


def series(df: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """Points of a bar, line or scatter chart in x order."""
    points = df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    ordered = points.orderBy("x", "y")
    return ordered if limit is None else ordered.limit(limit)


def multi_series(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """One trace per y column over the same x: ``x, series, y``."""
    return df.select(F.col(x).alias("x"), *[F.col(y).cast("double").alias(y) for y in ys]).unpivot(
        "x", ys, "series", "y"
    )


def pie(df: DataFrame, names: str, values: str | None = None) -> DataFrame:
    """Sum (or count of rows) per name and its share of the total: ``name, total, share``."""
    total = F.sum(F.col(values).cast("double")) if values else F.count("*").cast("double")
    parts = df.groupBy(F.col(names).alias("name")).agg(total.alias("total"))
    whole = df.agg(total.alias("total")).scalar()
    return parts.withColumn("share", F.col("total") / whole)


def _bin(df: DataFrame, column: str, bins: int) -> tuple[Column, Column, Column]:
    """Bin number from 1, the lower edge and the width; the maximum falls into the last bin."""
    c = _value(df, column)
    low = df.agg(F.min(c).alias("low")).scalar()
    high = df.agg(F.max(c).alias("high")).scalar()
    width = (high - low) / bins
    number = F.when(width == 0, F.lit(1)).otherwise(F.least(F.floor((c - low) / width) + 1, F.lit(bins)))
    return number.cast("bigint"), low, width


def _is_number(df: DataFrame, column: str) -> bool:
    """Whether values are binned: numbers, dates and times."""
    return isinstance(df.schema[column].dataType, (T.NumericType, *TIMES))


def _value(df: DataFrame, column: str) -> Column:
    """A number to bin by; of a date or time, microseconds since 1970."""
    if not isinstance(df.schema[column].dataType, TIMES):
        return F.col(column).cast("double")
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double")


def _edge(df: DataFrame, column: str, value: Column) -> Column:
    """A bin's edge as a value of the column's kind."""
    kind = df.schema[column].dataType
    if not isinstance(kind, TIMES):
        return value
    moment = F.timestamp_micros(F.round(value).cast("bigint"))
    return moment.cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp")


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins, ``bin, low, high, rows``; of a text column, ``bin, rows`` by value."""
    filled = df.where(F.col(x).isNotNull())
    if not _is_number(df, x):
        return filled.groupBy(F.col(x).alias("bin")).agg(F.count("*").alias("rows"))
    number, low, width = _bin(filled, x, bins)
    counted = filled.groupBy(number.alias("bin")).agg(F.count("*").alias("rows"))
    return counted.select(
        "bin",
        _edge(df, x, low + (F.col("bin") - 1) * width).alias("low"),
        _edge(df, x, low + F.col("bin") * width).alias("high"),
        "rows",
    )


def heatmap(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Counts over pairs of bins (of values, for a text column): ``x_bin, y_bin, rows``."""
    filled = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def cell(column: str) -> Column:
        return _bin(filled, column, bins)[0] if _is_number(df, column) else F.col(column)

    return filled.groupBy(cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(F.count("*").alias("rows"))


def box(df: DataFrame, x: str, y: str) -> DataFrame:
    """Quartiles per x, the furthest values within 1.5 IQR, and how many lie beyond."""
    rows = df.where(F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    groups = count_groups(rows, "x")
    quartiles = exact_quantiles(rows, "x", "y", QUARTILES, groups).select(
        "x", "n", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    )
    reach = WHISKER_IQR * (F.col("q3") - F.col("q1"))
    fenced = quartiles.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    inside = F.col("y").between(F.col("low"), F.col("high"))
    return join_groups(rows, fenced, ["x"], groups * BOX_BYTES).groupBy("x", "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("y"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def chart_data(df: DataFrame, x: str, y: str | list[str] | None = None, kind: str = "bar") -> DataFrame:
    """What a chart of the kind draws; ``y`` may be a list or a comma list of columns."""
    ys = [part.strip() for part in y.split(",") if part.strip()] if isinstance(y, str) else list(y or [])
    if kind == "histogram":
        return histogram(df, x)
    if kind == "pie":
        return pie(df, x, ys[0] if ys else None)
    if not ys:
        raise ValueError(f"a {kind} chart needs a y column")
    if kind == "heatmap":
        return heatmap(df, x, ys[0])
    if kind == "box":
        return box(df, x, ys[0])
    if kind in ("bar", "line") and len(ys) > 1:
        return multi_series(df, x, ys)
    return series(df, x, ys[0])
