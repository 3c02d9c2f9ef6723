"""Description and profiles of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.ingest.load import schema_rows
from tablewright.operators.catalog import (
    column_sketches, describe, list_all_tables, list_tables, merged_profile, profile, profile_all, profile_approx, profile_isolated,
    table_docs,
)
from tablewright.plans.registry import TABLES, Tables, register
from tablewright.session import work_folder
from tablewright.sources.connections import register_tables

# The given tables' columns: name, type, whether min and max are reported.
COLUMNS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in COLUMNS[table].split(", ")]


def profile_sql(relation: str, columns: list[tuple[str, str]], lead: str = "") -> str:
    parts = []
    for name, kind in columns:
        ranged = kind not in ("STRING", "ARRAY<FLOAT>")
        low, high = (f"CAST({f}({name}) AS VARCHAR)" if ranged else "CAST(NULL AS VARCHAR)" for f in ("min", "max"))
        nulls = f"(count(*) - count({name}))"
        parts.append(
            f'SELECT {lead}\'{name}\' AS "column", \'{kind}\' AS "type", count(*) AS total_rows, '
            f"{nulls} AS nulls, CASE WHEN count(*) > 0 THEN round({nulls} * 100.0 / count(*), 1) ELSE 0 END "
            f'AS null_pct, count(DISTINCT {name}) AS "distinct", {low} AS "min", {high} AS "max" FROM {relation}'
        )
    return "\nUNION ALL ".join(parts)


def describe_sql(table: str, key: str) -> str:
    parts = [
        f'SELECT \'{name}\' AS "column", \'{kind.lower()}\' AS "type", true AS nullable, '
        f"(SELECT string_agg(CAST({name} AS VARCHAR), ', ' ORDER BY {key}) FROM "
        f"(SELECT * FROM {table} ORDER BY {key} LIMIT 3) t) AS samples"
        for name, kind in columns_of(table)
    ]
    return "\nUNION ALL ".join(parts)


RATED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t"


@register("describe_orders", describe_sql("orders", "o_orderkey"))
def describe_orders(tables: Tables) -> DataFrame:
    return describe(tables.orders, ["o_orderkey"])


@register("profile_lineitem", profile_sql("lineitem", columns_of("lineitem")))
def profile_lineitem(tables: Tables) -> DataFrame:
    return profile(tables.lineitem)


@register("profile_rated_documents", profile_sql(RATED, columns_of("documents") + columns_of("labels")[1:]))
def profile_rated_documents(tables: Tables) -> DataFrame:
    rated = tables.documents.join(tables.labels, "doc_id", "left")
    return profile(rated.select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))


@register(
    "profile_all_tables",
    "\nUNION ALL ".join(profile_sql(t, columns_of(t), f"'{t}' AS \"table\", ") for t in COLUMNS),
)
def profile_all_tables(tables: Tables) -> DataFrame:
    return profile_all(tables.all())


@register(
    "profile_with_failing_columns",
    "SELECT *, CAST(NULL AS VARCHAR) AS error FROM ("
    + profile_sql("documents", columns_of("documents"))
    + ") t UNION ALL SELECT 'as_number', 'INT', NULL, NULL, NULL, NULL, NULL, NULL, 'CAST_INVALID_INPUT'"
    + "\nUNION ALL SELECT 'as_day', 'DATE', NULL, NULL, NULL, NULL, NULL, NULL, 'CAST_INVALID_INPUT'",
)
def profile_with_failing_columns(tables: Tables) -> DataFrame:
    """Two derived columns that cannot be computed beside those that can; whole texts are cast."""
    strict = {c: F.col("text").cast(kind) for c, kind in (("as_number", "int"), ("as_day", "date"))}
    return profile_isolated(tables.documents.withColumns(strict))


def sketch_bound_sql() -> str:
    exact = profile_sql("lineitem", columns_of("lineitem"))
    return (
        'SELECT "column", "type", total_rows, nulls, null_pct, "min", "max", true AS within_bound, true AS merged_alike '
        f"FROM ({exact}) t"
    )


@register("profile_from_sketches", sketch_bound_sql())
def profile_from_sketches(tables: Tables) -> DataFrame:
    """Sketches of parts, stored and merged: within 4 percent of the distinct values, five standard
    errors, and as near to each other whichever parts the table is cut into."""
    lines, folder = tables.lineitem, work_folder(tables.spark)
    merged = []
    for name, part in (("flag", F.col("l_returnflag")), ("month", F.date_format("l_shipdate", "yyyy-MM"))):
        column_sketches(lines, part).write.parquet(f"{folder}/{name}")
        merged.append(merged_profile(tables.spark.read.parquet(f"{folder}/{name}"), lines.schema))
    exact = profile(lines).select(F.col("column").alias("_column"), F.col("distinct").alias("_exact"))
    other = merged[1].select(F.col("column").alias("_other"), F.col("distinct").alias("_again"))
    both = merged[0].join(exact, F.col("column") == F.col("_column")).join(other, F.col("column") == F.col("_other"))
    within = F.abs(F.col("distinct") - F.col("_exact")) <= 0.04 * F.col("_exact")
    return both.select(
        "column", "type", "total_rows", "nulls", "null_pct", "min", "max", within.alias("within_bound"),
        (F.abs(F.col("distinct") - F.col("_again")) <= 0.04 * F.col("_exact")).alias("merged_alike"),
    )


@register("profile_lineitem_approx")
def profile_lineitem_approx(tables: Tables) -> DataFrame:
    """Sketched distinct counts have no equal in SQL; the tests bound their error."""
    return profile_approx(tables.lineitem)


@register("tables_listed", 'SELECT * FROM (VALUES {}) t("table")'.format(", ".join(f"('{t}')" for t in TABLES)))
def tables_listed(tables: Tables) -> DataFrame:
    """The given tables as views of the session, listed."""
    register_tables(tables.all())
    return list_tables(tables.spark).where(F.col("table").isin(TABLES))


def table_docs_sql() -> str:
    rows = []
    for name in COLUMNS:
        lines = "".join(f"\n  - {column} ({kind.lower()}, nullable)" for column, kind in columns_of(name))
        rows.append(
            f"SELECT concat('wh-', substr(sha256('warehouse:schema:{name}'), 1, 16)) AS id, "
            f"'What data is in the {name} table?' AS question, 'Table: {name}\nColumns:{lines}' AS description"
        )
    return "\nUNION ALL ".join(rows)


@register("table_documents", table_docs_sql())
def table_documents(tables: Tables) -> DataFrame:
    """One searchable document per table, as index rows of source ``warehouse``."""
    return schema_rows(table_docs(tables.spark, tables.all())).select("id", "question", "description")


@register(
    "tables_of_all_schemas",
    'SELECT * FROM (VALUES {}) t("table")'.format(", ".join(f"('given_{s}.{t}')" for s in ("first", "second") for t in TABLES)),
)
def tables_of_all_schemas(tables: Tables) -> DataFrame:
    """The given tables in two schemas of the catalog, listed with their schemas' names."""
    spark = tables.spark
    for schema in ("given_first", "given_second"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        for name in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
            spark.sql(f"CREATE TABLE {schema}.{name} USING parquet LOCATION '{tables.folder}/{name}.parquet'")
    listed = list_all_tables(spark).where(F.col("table").startswith("given_"))
    for schema in ("given_first", "given_second"):
        spark.sql(f"DROP DATABASE {schema} CASCADE")
    return listed
