"""Saved SQL patterns: a folder of ``.sql`` files with a header, or a table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import slugify, strip
from tablewright.operators.index import last_per_key
from tablewright.sources.store import read_table, write_table

PATTERN_SCHEMA = (
    "question string, sql string, tables array<string>, description string, "
    "source string, created date, filename string"
)
HEADER = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created", T.StringType()),
    ]
)
FENCE = "---"
WHOLE_SLUG = (1 << 31) - 1


def _yaml():
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading pattern headers needs PyYAML on the executors") from error
    return yaml


def _header_row(text: str | None) -> tuple:
    yaml = _yaml()
    # The parser in C, where there is one: the same safe rules in a tenth of the time.
    fields = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if text else None
    fields = fields if isinstance(fields, dict) else {}

    def words(key: str, default: str = "") -> str:
        value = fields.get(key, default)
        return "" if value is None else value.isoformat() if isinstance(value, (date, datetime)) else str(value)

    listed = fields.get("tables") or []
    listed = listed if isinstance(listed, list) else [listed]
    return (words("question"), [str(t) for t in listed], words("description"), words("source", "manual"), words("created"))


@F.pandas_udf(HEADER)
def _headers(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in series:
        yield pd.DataFrame([_header_row(t) for t in texts], columns=HEADER.names)


def parse_pattern(text: Column) -> Column:
    """``struct(header, sql)``: a text without a header, or with an unclosed one, is all SQL."""
    end = F.locate(FENCE, text, len(FENCE) + 1)
    has_header = F.startswith(text, F.lit(FENCE)) & (end > 0)
    header = F.substring(text, F.lit(len(FENCE) + 1), end - len(FENCE) - 1)
    body = F.substring(text, end + len(FENCE), F.char_length(text))
    return F.struct(
        F.when(has_header, strip(header)).alias("header"),
        F.when(has_header, strip(body)).otherwise(text).alias("sql"),
    )


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.sql`` files of a folder, one row each."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.sql")
    return patterns_of(texts.select(F.col("_metadata.file_name").alias("filename"), "value"))


def patterns_of(texts: DataFrame) -> DataFrame:
    """Pattern files' names and whole texts, ``filename`` and ``value``, as pattern rows."""
    texts = texts.select("filename", parse_pattern(F.col("value")).alias("p"))
    return texts.select("filename", F.col("p.sql").alias("sql"), _headers("p.header").alias("h")).select(
        "h.question",
        "sql",
        "h.tables",
        "h.description",
        "h.source",
        F.col("h.created").try_cast("date").alias("created"),
        "filename",
    )


def pattern_file(question: Column) -> Column:
    """The file name of a question: its slug, with a short hash where the slug is cut.

    Two long questions that begin alike have names of their own.
    """
    whole, cut = slugify(question, max_length=WHOLE_SLUG), slugify(question)
    long_ = F.char_length(whole) > F.char_length(cut)
    return F.concat(F.when(long_, F.concat(cut, F.lit("-"), F.substring(F.sha2(whole, 256), 1, 8))).otherwise(cut), F.lit(".sql"))


def pattern_records(rows: DataFrame, today: date, order_by: str | None = None) -> DataFrame:
    """Patterns ready to save: one per slug of the question, the last one winning."""
    defaults = {"description": F.lit(""), "source": F.lit("manual"), "tables": F.array().cast("array<string>")}
    for name, default in defaults.items():
        rows = rows.withColumn(name, F.coalesce(name, default) if name in rows.columns else default)
    named = rows.withColumn("filename", pattern_file(F.col("question")))
    latest = last_per_key(named, "filename", order_by)
    return latest.withColumn("created", F.lit(today)).select(
        "question", "sql", "tables", "description", "source", "created", "filename"
    )


def write_patterns(rows: DataFrame, root: str, today: date, order_by: str | None = None) -> int:
    """Saves patterns to the table at ``root``; a pattern with a known slug is replaced."""
    saved = read_table(rows.sparkSession, root, PATTERN_SCHEMA)
    batch = pattern_records(rows, today, order_by)
    kept = saved.join(batch.select("filename"), "filename", "left_anti")
    return write_table(kept.unionByName(batch), root)


def find_pattern(patterns: DataFrame, questions: DataFrame) -> DataFrame:
    """Patterns of the given questions, looked up by slug."""
    slugs = questions.select(pattern_file(F.col("question")).alias("filename")).distinct()
    return patterns.join(slugs, "filename", "left_semi")


def rename_patterns(rows: DataFrame, root: str, today: date) -> int:
    """Saves edited patterns, ``filename`` naming the one each replaces: a question with another slug
    gets a file of that name, and the old one goes. The last edit of a file counts."""
    saved = read_table(rows.sparkSession, root, PATTERN_SCHEMA)
    edits = rows.withColumnRenamed("filename", "_old")
    batch = pattern_records(edits, today)
    gone = edits.select(F.col("_old").alias("filename")).unionByName(batch.select("filename")).distinct()
    return write_table(saved.join(gone, "filename", "left_anti").unionByName(batch), root)


def delete_patterns(
    patterns: DataFrame, index: DataFrame, filenames: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Patterns and index without the given files; both are keyed by the file name."""
    names = filenames.select("filename")
    return (
        patterns.join(names, "filename", "left_anti"),
        index.join(names.withColumnRenamed("filename", "id"), "id", "left_anti"),
    )
