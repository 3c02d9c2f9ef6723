"""Connection settings to readable relations."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIALECT = "postgresql"
FILE_DIALECTS = ("parquet", "orc", "json", "csv")
PATH_DIALECTS = ("sqlite", "duckdb")


def jdbc_url(conn: Mapping[str, str]) -> str:
    """The JDBC address of a connection; an explicit ``url`` wins.

    User and password are given as reader options, so they never stand in an address.
    """
    if conn.get("url"):
        return conn["url"]
    dialect = conn.get("dialect", DEFAULT_DIALECT)
    host, port, database = conn.get("host", ""), conn.get("port", ""), conn.get("database", "")
    if dialect == "snowflake":
        schema = f"&schema={quote_plus(conn['schema'])}" if conn.get("schema") else ""
        return f"jdbc:snowflake://{conn.get('account', '')}.snowflakecomputing.com/?db={quote_plus(database)}{schema}"
    if dialect == "databricks":
        return f"jdbc:databricks://{host}:443;httpPath={conn.get('http_path', '')};ConnCatalog={database};AuthMech=3"
    if dialect in PATH_DIALECTS:
        return f"jdbc:{dialect}:{database}"
    address = f"{host}:{port}" if port else host
    return f"jdbc:{dialect}://{address}/{database}"


def source_options(conn: Mapping[str, str]) -> tuple[str, dict[str, str]]:
    """The reader format and options for a connection's settings."""
    dialect = conn.get("dialect", DEFAULT_DIALECT)
    if dialect in FILE_DIALECTS and not conn.get("url"):
        return dialect, {"path": conn.get("path") or conn.get("database", "")}
    options = {"url": jdbc_url(conn)}
    if dialect == "databricks":
        options |= {"user": "token", "password": conn.get("token", conn.get("password", ""))}
    elif conn.get("user"):
        options |= {"user": conn["user"], "password": conn.get("password", "")}
    if dialect == "snowflake" and conn.get("warehouse"):
        options["warehouse"] = conn["warehouse"]
    if conn.get("driver"):
        options["driver"] = conn["driver"]
    return "jdbc", options


def read_source(
    spark: SparkSession,
    conn: Mapping[str, str],
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table of the connection. A large database table is read in parallel by giving a
    partition column with its bounds; files are split by Spark itself."""
    kind, options = source_options(conn)
    if kind != "jdbc":
        return spark.read.format(kind).load(f"{options['path']}/{table}")
    if partition_column and bounds:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(dbtable=table, **options).load()


def table_paths(folder: str, names: list[str], suffix: str = ".parquet") -> dict[str, str]:
    return {name: f"{folder}/{name}{suffix}" for name in names}


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name."""
    return {name: spark.read.parquet(path) for name, path in table_paths(folder, names).items()}


def register_tables(tables: Mapping[str, DataFrame]) -> None:
    """Makes tables readable by name in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
