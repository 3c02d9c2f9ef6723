"""Charts with their SQL out of landed dashboard payloads, one function per platform.

All functions return ``dashboard_id, dashboard_title, element_id, element_title, sql`` and work
row by row on the payload (``from_json`` with a fixed schema); a payload that is not JSON gives
no rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import first_filled, join_lines, or_blank
from tablewright.functions.times import moment
from tablewright.session import spread

# --- Fixed values -------------------------------------------------------------------
MIN_SQL_CHARS = 50
LAKEVIEW_MIN_SQL_CHARS = 21
UNTITLED = "untitled"
FILTER_WIDGET = "filter"
MIN_VIEWS = 10
LOOKBACK_DAYS = 90
DASHBOARD_ID_SHOWN = 8
UNNAMED_DASHBOARD, UNNAMED_REPORT, UNNAMED_WORKBOOK = "Dashboard ", "Report ", "Workbook "
# ------------------------------------------------------------------------------------

CHART_COLUMNS = ("dashboard_id", "dashboard_title", "element_id", "element_title", "sql")

LAKEVIEW_SCHEMA = """
  datasets array<struct<name string, displayName string, queryLines array<string>, query string>>,
  pages array<struct<layout array<struct<widget struct<
    name string, displayName string,
    spec struct<widgetType string, frame struct<title string>>,
    queries array<struct<query struct<datasetName string>>>>>>>>
"""
LOOKER_SCHEMA = """
  id string, title string,
  elements array<struct<id string, title string, query struct<id string, sql string>,
    result_maker struct<query struct<id string, sql string>>>>
"""
REDASH_SCHEMA = """
  slug string, name string,
  widgets array<struct<visualization struct<
    name string, query struct<id string, name string, query string>>>>
"""
MODE_QUERY = "struct<token string, name string, raw_query string>"
SIGMA_ELEMENT = "struct<elementId string, name string>"


def _titled(c: Column) -> Column:
    return (or_blank(c) != "") & (F.lower(c) != UNTITLED)


def _long_enough(sql: Column) -> Column:
    return F.char_length(sql) >= MIN_SQL_CHARS


def first_dashboards(dashboards: DataFrame, limit: int, position: str = "position") -> DataFrame:
    """The first ``limit`` dashboards in listing order; 0 takes all."""
    if limit <= 0:
        return dashboards
    listed = dashboards.select(position).distinct().orderBy(position).limit(limit)
    return dashboards.join(listed, position, "left_semi")


def lakeview_charts(dashboards: DataFrame, place: bool = False) -> DataFrame:
    """``dashboards(dashboard_id, display_name, serialized)``, a definition's JSON in the last.

    With ``place`` the widget's number in its dashboard is a column more: a load keeps the last
    of several charts with one id by it.

    A widget's dataset is its first named reference, or the dashboard's first dataset when that
    is missing or unknown.
    """
    parsed = spread(dashboards).where(or_blank(F.col("dashboard_id")) != "").withColumn(
        "d", F.from_json("serialized", LAKEVIEW_SCHEMA)
    )

    def named_sql(ds: Column) -> Column:
        lines = F.when(F.size(ds["queryLines"]) > 0, join_lines(ds["queryLines"]))
        return F.struct(
            first_filled(ds["name"], ds["displayName"]).alias("name"),
            F.coalesce(lines, ds["query"]).alias("sql"),
        )

    datasets = F.filter(
        F.transform(F.coalesce("d.datasets", F.array()), named_sql),
        lambda ds: ds["name"].isNotNull() & (F.char_length(ds["sql"]) >= LAKEVIEW_MIN_SQL_CHARS),
    )

    def sql_of(name: Column) -> Column:
        return F.try_element_at(F.filter("datasets", lambda ds: ds["name"] == name), F.lit(-1))["sql"]

    layouts = F.flatten(F.transform("d.pages", lambda p: F.coalesce(p["layout"], F.array())))
    # No filter: it would be pushed down, and the payload read once more for it, before its rows are dealt out.
    shown = F.when(F.size("datasets") > 0, layouts)
    widgets = (
        parsed.withColumn("datasets", datasets)
        .select("dashboard_id", "display_name", "datasets", F.posexplode(shown).alias("place", "item"))
        .select("dashboard_id", "display_name", "datasets", "place", F.col("item.widget").alias("w"))
    )
    references = F.filter(
        F.transform(F.coalesce("w.queries", F.array()), lambda q: q["query"]["datasetName"]),
        lambda ref: or_blank(ref) != "",
    )
    title = first_filled(F.col("w.spec.frame.title"), F.col("w.displayName"))
    fallback = F.concat(F.lit(UNNAMED_DASHBOARD), F.substring("dashboard_id", 1, DASHBOARD_ID_SHOWN))
    return (
        widgets.where(~F.startswith(or_blank(F.col("w.spec.widgetType")), F.lit(FILTER_WIDGET)))
        .withColumns({"title": title, "reference": F.get(references, F.lit(0))})
        .where(_titled(F.col("title")))
        .select(
            "dashboard_id",
            F.coalesce("display_name", fallback).alias("dashboard_title"),
            F.coalesce("w.name", "title").alias("element_id"),
            F.col("title").alias("element_title"),
            F.coalesce(sql_of(F.col("reference")), sql_of(F.col("datasets")[0]["name"])).alias("sql"),
            *(["place"] if place else []),
        )
    )


def usage_counts(
    history: DataFrame,
    now: datetime | Column,
    lookback_days: int = LOOKBACK_DAYS,
    min_views: int = MIN_VIEWS,
    top_rows: int | None = None,
) -> DataFrame:
    """Views per dashboard within the look-back, for dashboards with at least ``min_views``.

    ``history(dashboard_id, runs, at)``. ``top_rows`` reproduces a usage report that returns only
    so many rows, the most used first; by default every row counts.
    """
    recent = history.where(
        (F.col("at") >= moment(now) - F.make_dt_interval(F.lit(lookback_days))) & (or_blank(F.col("dashboard_id")) != "")
    )
    if top_rows is not None:
        recent = recent.orderBy(F.desc("runs"), "dashboard_id", "at").limit(top_rows)
    return (
        recent.groupBy("dashboard_id")
        .agg(F.sum(F.coalesce("runs", F.lit(0))).cast("bigint").alias("view_count"))
        .where(F.col("view_count") >= min_views)
    )


def looker_charts(dashboards: DataFrame, usage: DataFrame, limit: int = 0) -> DataFrame:
    """``dashboards(payload)`` that appear in ``usage``, with ``view_count`` added.

    With a ``limit`` the most viewed dashboards are taken.
    """
    wanted = usage.orderBy(F.desc("view_count"), "dashboard_id").limit(limit) if limit > 0 else usage
    parsed = dashboards.select(F.from_json("payload", LOOKER_SCHEMA).alias("d")).select(
        F.col("d.id").alias("dashboard_id"), F.col("d.title").alias("title"), "d.elements"
    )
    used = parsed.join(wanted, "dashboard_id")
    elements = used.select("dashboard_id", "title", "view_count", F.explode("elements").alias("e"))
    own, made = F.col("e.query"), F.col("e.result_maker.query")
    return (
        elements.where(_titled(F.col("e.title")))
        .withColumn("sql", F.when(own.isNotNull(), own["sql"]).otherwise(made["sql"]))
        .where(_long_enough(F.col("sql")))
        .select(
            "dashboard_id",
            F.coalesce(
                F.nullif("title", F.lit("")), F.concat(F.lit(UNNAMED_DASHBOARD), "dashboard_id")
            ).alias("dashboard_title"),
            F.col("e.id").alias("element_id"),
            F.col("e.title").alias("element_title"),
            "sql",
            "view_count",
        )
    )


def redash_charts(dashboards: DataFrame) -> DataFrame:
    """``dashboards(position, payload)``; a query shown on several dashboards counts where it is
    listed first. The first is kept by a partial aggregate, so a query on most dashboards is no
    hot group."""
    widgets = spread(dashboards).select("position", F.from_json("payload", REDASH_SCHEMA).alias("d")).select(
        "position", "d.slug", "d.name", F.posexplode("d.widgets").alias("place", "widget")
    )
    query = F.col("widget.visualization.query")
    title = first_filled(query["name"], F.col("widget.visualization.name"))
    charts = widgets.select(
        F.struct("position", "place").alias("listed"),
        or_blank(F.col("slug")).alias("dashboard_id"),
        F.coalesce("name", F.concat(F.lit(UNNAMED_DASHBOARD), or_blank(F.col("slug")))).alias("dashboard_title"),
        or_blank(query["id"]).alias("element_id"),
        title.alias("element_title"),
        query["query"].alias("sql"),
    ).where(_long_enough(F.col("sql")) & F.col("element_title").isNotNull())
    kept = [c for c in CHART_COLUMNS if c != "element_id"]
    first = F.min_by(F.struct(*kept), F.col("listed")).alias("first")
    return charts.groupBy("element_id").agg(first).select("element_id", "first.*").select(*CHART_COLUMNS)


def superset_charts(charts: DataFrame) -> DataFrame:
    """``charts(dashboard_id, dashboard_title, id, slice_name, params, query_context)``, the last
    two JSON texts; SQL is looked for in that order."""
    sql = first_filled(
        F.get_json_object("params", "$.sql"),
        F.get_json_object("params", "$.query"),
        F.get_json_object("query_context", "$.query"),
    )
    return (
        charts.withColumn("sql", sql)
        .where((or_blank(F.col("slice_name")) != "") & _long_enough(F.col("sql")))
        .select(
            F.col("dashboard_id").cast("string").alias("dashboard_id"),
            F.coalesce("dashboard_title", F.concat(F.lit(UNNAMED_DASHBOARD), "dashboard_id")).alias("dashboard_title"),
            F.col("id").cast("string").alias("element_id"),
            F.col("slice_name").alias("element_title"),
            "sql",
        )
    )


def _bare_or_wrapped(payload: Column, item: str, *path: str) -> Column:
    """The items of a JSON list, given bare or inside an object at ``path``."""
    schema = f"array<{item}>"
    for name in reversed(path):
        schema = f"struct<{name}: {schema}>"
    wrapped = F.from_json(payload, schema)
    for name in path:
        wrapped = wrapped[name]
    bare = F.from_json(payload, f"array<{item}>")
    return F.when(F.startswith(F.ltrim(payload), F.lit("[")), bare).otherwise(wrapped)


def mode_charts(reports: DataFrame) -> DataFrame:
    """``reports(token, name, payload)``, the payload a report's queries."""
    queries = _bare_or_wrapped(F.col("payload"), MODE_QUERY, "_embedded", "queries")
    return (
        spread(reports).select("token", "name", F.explode(queries).alias("q"))
        .where(_long_enough(F.col("q.raw_query")) & (or_blank(F.col("q.name")) != ""))
        .select(
            F.col("token").alias("dashboard_id"),
            F.coalesce("name", F.concat(F.lit(UNNAMED_REPORT), "token")).alias("dashboard_title"),
            or_blank(F.col("q.token")).alias("element_id"),
            F.col("q.name").alias("element_title"),
            F.col("q.raw_query").alias("sql"),
        )
    )


def sigma_charts(workbooks: DataFrame, queries: DataFrame) -> DataFrame:
    """``workbooks(workbook_id, name, payload)``, the payload a workbook's elements, joined to
    ``queries(workbook_id, element_id, sql)``."""
    elements = _bare_or_wrapped(F.col("payload"), SIGMA_ELEMENT, "entries")
    named = (
        spread(workbooks).where(or_blank(F.col("workbook_id")) != "")
        .select("workbook_id", "name", F.explode(elements).alias("e"))
        .where((or_blank(F.col("e.elementId")) != "") & (or_blank(F.col("e.name")) != ""))
        .select("workbook_id", "name", F.col("e.elementId").alias("element_id"), F.col("e.name").alias("title"))
    )
    long = queries.where(_long_enough(F.col("sql")))
    return named.join(long, ["workbook_id", "element_id"]).select(
        F.col("workbook_id").alias("dashboard_id"),
        F.coalesce("name", F.concat(F.lit(UNNAMED_WORKBOOK), "workbook_id")).alias("dashboard_title"),
        "element_id",
        F.col("title").alias("element_title"),
        "sql",
    )
