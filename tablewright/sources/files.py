"""Landed files: dashboards, dictionaries, JSON rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.index import last_per_key
from tablewright.session import work_folder


def read_dashboards(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Landed payloads as ``file_name, position, payload``.

    One dashboard per file, or one per line when ``whole_files`` is off, which suits many small
    payloads better. ``position`` orders them as the files are listed, by path, and then by line.
    """
    raw = spark.read.text(path, wholetext=whole_files)
    position = F.concat_ws(" ", *_place()) if not whole_files else F.col("_metadata.file_path")
    return raw.select(
        F.col("_metadata.file_name").alias("file_name"), position.alias("position"), F.col("value").alias("payload")
    )


def _place() -> list[Column]:
    """Columns that sort rows as they stand in the files: path, block, and order within the block.

    Spark packs blocks into tasks by size, so the row number alone says nothing across blocks.
    """
    block = F.format_string("%020d", F.col("_metadata.file_block_start"))
    return [F.col("_metadata.file_path"), block, F.format_string("%020d", F.monotonically_increasing_id())]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _yaml_map(texts: pd.Series) -> pd.Series:
    """A YAML map as strings; anything else is an empty map."""
    import yaml

    def entries(text: str) -> dict:
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError:
            return {}
        found = found if isinstance(found, dict) else {}
        return {str(k): None if v is None else str(v) for k, v in found.items()}

    return texts.map(entries)


def read_dictionary(
    spark: SparkSession, path: str, key: str = "keyword", value: str = "content", format: str = "parquet"
) -> DataFrame:
    """A two-column dictionary with unique keys, the last entry of a key winning.

    Entries are ordered by file path, then as they stand in the file. Parquet and the like hold the two columns; ``yaml`` is one map of key to text per file. What
    has another shape reads as empty.
    """
    schema = f"{key} string, {value} string"
    if format == "yaml":
        try:
            files = spark.read.text(path, wholetext=True)
        except AnalysisException:
            return spark.createDataFrame([], schema)
        rows = files.select(F.struct(*_place()).alias("_place"), F.explode(_yaml_map("value")).alias(key, value))
    else:
        try:
            reader = spark.read.option("header", True) if format == "csv" else spark.read
            rows = reader.format(format).load(path).select(key, value, F.struct(*_place()).alias("_place"))
        except AnalysisException:
            return spark.createDataFrame([], schema)
    return last_per_key(rows.where(F.col(key).isNotNull()), key, "_place").select(F.col(key).cast("string"), F.col(value).cast("string"))


def rows_from_json(spark: SparkSession, text: str) -> DataFrame:
    """A JSON list of objects as a table, its schema taken from the text."""
    if not isinstance(json.loads(text), list):
        raise ValueError("expected a JSON list of objects")
    schema = spark.range(1).select(F.schema_of_json(F.lit(text)).alias("s")).first()["s"]
    return spark.createDataFrame([(text,)], "t string").select(F.inline(F.from_json("t", schema)))


def rows_from_json_texts(texts: DataFrame, column: str) -> DataFrame:
    """The objects of all texts that are JSON lists of objects, as one table.

    The texts are written as lines and read by Spark's JSON reader, which finds the schema on the
    executors; none comes to the driver. A text that is no JSON gives no rows.
    """
    spark, folder = texts.sparkSession, work_folder(texts.sparkSession)
    # A raw line end can only stand between tokens: inside a JSON string it is escaped.
    texts.select(F.translate(column, "\n\r", "  ").alias("value")).where(F.col("value").isNotNull()).write.text(folder)
    return spark.read.option("mode", "DROPMALFORMED").json(folder)
