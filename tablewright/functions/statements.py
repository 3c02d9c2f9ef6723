"""Read/write and limit rules over columns of SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import SPACE_RANGES, has_word, strip

# --- Fixed values -------------------------------------------------------------------
WRITE_VERBS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "MERGE", "REPLACE",
)
# ------------------------------------------------------------------------------------


def without_comments(sql: Column) -> Column:
    lines = F.regexp_replace(sql, r"--[^\n]*", "")
    return strip(F.regexp_replace(lines, r"(?s)/\*.*?\*/", ""))


def first_word(sql: Column) -> Column:
    return F.upper(F.regexp_substr(without_comments(sql), F.lit(f"^[^{SPACE_RANGES}]+")))


def is_write(sql: Column) -> Column:
    return F.coalesce(first_word(sql).isin(*WRITE_VERBS), F.lit(False))


def has_limit(sql: Column) -> Column:
    return has_word(sql, "limit")


def classify_statements(df: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Adds ``first_word``, ``is_write`` and ``has_limit`` for each statement."""
    sql = F.col(sql_col)
    return df.withColumns(
        {
            "first_word": F.coalesce(first_word(sql), F.lit("")),
            "is_write": is_write(sql),
            "has_limit": has_limit(sql),
        }
    )
