"""Text, id and display expressions.

Everything here is a built-in column expression except the Unicode decomposition inside
``slugify``, for which Spark has no function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values -------------------------------------------------------------------
# Whitespace as Python's str.strip/split and re's \s see it (Spark's trim takes only
# the space, Java's \s only ASCII).
SPACE_RANGES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_RANGES}]"
# A word character as Python's re sees it.
WORD = r"[\p{L}\p{N}_]"

SLUG_LENGTH = 80
REWRITE_SQL_CHARS = 4000
EMBED_SQL_CHARS = 2000

ID_PREFIX = {
    "looker": "lkr",
    "databricks": "dbr",
    "mode": "mode",
    "redash": "rds",
    "superset": "ss",
    "sigma": "sig",
    "warehouse": "wh",
}
ID_HEX_DIGITS = 16

SECRET_WORDS = ("secret", "password", "token", "key", "api_key")
MASKED_SECRET = "****"
NO_VALUE = "—"
MISSING_VALUE = "None"

CHART_TEXT = "Question: %s\nSQL Pattern:\n%s"
SCHEMA_TEXT = "Question: %s\nSchema: %s"
# ------------------------------------------------------------------------------------


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+\\z", "")


def strip(c: Column) -> Column:
    return rstrip(lstrip(c))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first argument that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def clean_title(c: Column) -> Column:
    """Trimmed, with each run of whitespace as one space."""
    return F.trim(F.regexp_replace(or_blank(c), f"{SPACE}+", " "))


def has_word(c: Column, word: str) -> Column:
    """True where ``word`` stands in ``c`` as a whole word, in any case."""
    return c.rlike(f"(?iu)(?<!{WORD}){word}(?!{WORD})")


# Texts and characters that are decomposed together, so that a worker holds few copies of a batch.
NFKD_TEXTS = 64


@F.arrow_udf(T.StringType())
def _nfkd(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        parts = []
        for start in range(0, len(batch), NFKD_TEXTS):
            few = batch.slice(start, NFKD_TEXTS)
            parts.append(pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in few.to_pylist()], few.type))
        yield pa.concat_arrays(parts) if parts else batch


def slugify(c: Column, fallback: str = "file", max_length: int = SLUG_LENGTH) -> Column:
    """A name safe for files: decomposed, lower case, words joined by single hyphens."""
    # Plain letters are decomposed already and do not leave the JVM.
    plain = F.octet_length(c) == F.char_length(c)
    whole = F.when(plain, c).otherwise(_nfkd(F.when(~plain, c)))
    kept = F.regexp_replace(F.lower(whole), f"[^\\p{{L}}\\p{{N}}_{SPACE_RANGES}-]+", "")
    joined = F.regexp_replace(kept, f"[{SPACE_RANGES}-]+", "-")
    edged = F.regexp_replace(joined, r"^-+|-+\z", "")
    return F.coalesce(F.nullif(F.substring(edged, 1, max_length), F.lit("")), F.lit(fallback))


def strip_code_fence(c: Column) -> Column:
    """Text without a surrounding triple-backtick fence."""
    opened = F.regexp_replace(strip(c), r"^```(?:sql)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{2,}", "\n")


def truncate(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def join_lines(lines: Column) -> Column:
    """An array of query lines as one text, each line right-trimmed."""
    return F.array_join(F.transform(lines, rstrip), "\n")


def split_list(c: Column) -> Column:
    """A comma list as an array of its trimmed, non-empty items."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda item: item != "")


def stable_id(source: str | Column, *parts: Column) -> Column:
    """``prefix-`` and the first 16 hex digits of the SHA-256 of ``source:part:part``."""
    if isinstance(source, str):
        prefix, source = F.lit(ID_PREFIX[source]), F.lit(source)
    else:
        table = F.create_map(*[F.lit(v) for pair in ID_PREFIX.items() for v in pair])
        prefix = F.element_at(table, source)
    text = F.concat_ws(":", source, *[or_blank(p.cast("string")) for p in parts])
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(text, 256), 1, ID_HEX_DIGITS))


def double_text(c: Column) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16."""
    raw = c.cast("string")
    size = F.abs(c)
    plain = F.rtrim(raw.cast("decimal(38,20)").cast("string"), F.lit("0"))
    whole = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    digits = F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E(-?)(\d)\z", "E$10$2")
    power = F.regexp_replace(F.regexp_replace(digits, r"E-", "e-"), "E", "e+")
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(raw.contains("E") & (size >= 1e-4) & (size < 1e16), whole)
        .when(raw.contains("E"), power)
        .otherwise(raw)
    )


def value_text(c: Column, data_type: T.DataType) -> Column:
    """A value as text, doubles in plain digits."""
    if isinstance(data_type, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return double_text(c) if isinstance(data_type, T.DoubleType) else c.cast("string")


def format_scalar(c: Column, data_type: T.DataType) -> Column:
    """A value for display: doubles by size (millions, whole, two decimals), others as text."""
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.coalesce(value_text(c, data_type), F.lit(MISSING_VALUE))
    c = c.cast("double")
    millions = F.concat(F.format_number(c / 1e6, 1), F.lit("M"))
    return (
        F.when(c.isNull(), MISSING_VALUE)
        .when(F.isnan(c), "nan")
        .when(c == float("inf"), "$infM")
        .when(c == float("-inf"), "-infM")
        .when(c >= 1e6, F.concat(F.lit("$"), millions))
        .when(c <= -1e6, millions)
        .when(F.abs(c) >= 1e3, F.format_number(c, 0))
        .otherwise(F.format_number(c, 2))
    )


def mask_secrets(settings: Column) -> Column:
    """A settings map with every secret's value replaced by whether one is set."""

    def hide(key: Column, value: Column) -> Column:
        secret = F.lower(key).rlike("|".join(SECRET_WORDS))
        filled = F.coalesce((value != "") & (value != MASKED_SECRET), F.lit(False))
        return F.when(secret, filled.cast("string")).otherwise(value)

    return F.transform_values(settings, hide)


def pattern_text(question: Column, description: Column, sql: Column) -> Column:
    """The text embedded for a saved pattern: its filled parts, one per line."""
    parts = F.array(or_blank(question), or_blank(description), or_blank(sql))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def chart_text(question: Column, sql: Column, sql_chars: int | None = None) -> Column:
    """The text embedded for a dashboard chart, with the whole SQL unless ``sql_chars`` cuts it."""
    return F.format_string(CHART_TEXT, question, sql if sql_chars is None else truncate(sql, sql_chars))


def schema_text(question: Column, description: Column) -> Column:
    """The text embedded for a table's schema."""
    return F.format_string(SCHEMA_TEXT, question, description)
