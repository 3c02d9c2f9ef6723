"""Chart titles as natural-language questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import clean_title, has_word

# --- Fixed values -------------------------------------------------------------------
AGGREGATE_WORDS = (
    "total", "count", "number", "avg", "average", "sum", "min", "max", "mean", "median",
)
VERB_WORDS = (
    "show", "list", "display", "compare", "breakdown", "analyze", "track", "find", "view", "explore",
)
RANK_WORDS = ("top", "bottom")
TIME_WORDS = (
    "daily", "weekly", "monthly", "yearly", "annual", "quarterly", "ytd", "mtd", "wtd",
)
RATE_WORDS = ("rate", "ratio", "percent", "pct", "proportion")
SINGULAR_ENDINGS = ("ss", "us", "is", "ous")
UNTITLED = "Untitled chart"
ONE, MANY, REQUEST, BOARD = "What is the ", "What are the ", "Can you ", " from "
# ------------------------------------------------------------------------------------


def is_plural(word: Column) -> Column:
    low = F.lower(word)
    return low.endswith("ies") | (low.endswith("s") & ~low.rlike(f"(?:{'|'.join(SINGULAR_ENDINGS)})\\z"))


def generate_question(title: Column, dashboard: Column) -> Column:
    """A question for a chart, naming its dashboard.

    A title that is a question stays one, a leading verb makes a request, and all others
    become "What is/are the ...": "are" for rankings, and for a plural last word unless an
    aggregate, time or rate word or a "by" breakdown makes it one figure.
    """
    name = _named(title)
    return _question(name, clean_title(dashboard), F.lower(name))


def with_question(df: DataFrame, title: str, dashboard: str, question: str = "question") -> DataFrame:
    """``generate_question`` as a column, with the cleaned texts worked out once per row: inside one
    expression every rule would clean the title again."""
    cleaned = df.withColumns({"_name": _named(F.col(title)), "_board": clean_title(F.col(dashboard))})
    lowered = cleaned.withColumn("_low", F.lower("_name"))
    asked = _question(F.col("_name"), F.col("_board"), F.col("_low"))
    return lowered.withColumn(question, asked).drop("_name", "_board", "_low")


def _named(title: Column) -> Column:
    return F.coalesce(F.nullif(clean_title(title), F.lit("")), F.lit(UNTITLED))


def _question(name: Column, board: Column, low: Column) -> Column:
    tail = F.when(board != "", F.concat(F.lit(BOARD), board)).otherwise("")
    first = F.rtrim(F.substring_index(low, " ", 1), F.lit("#"))

    def ask(lead: str, text: Column = name) -> Column:
        return F.concat(F.lit(lead), text, tail, F.lit("?"))

    open_question = F.substring(name, F.lit(1), F.char_length(name) - 1)
    request = F.concat(F.left(low, F.lit(1)), F.substring(name, 2, 2**31 - 1))
    single = (
        first.isin(*TIME_WORDS)
        | low.rlike("|".join(RATE_WORDS))
        | name.contains("%")
        | has_word(low, "by")
    )
    return (
        F.when(name.endswith("?") & (board != "") & ~F.contains(low, F.lower(board)), ask("", open_question))
        .when(name.endswith("?"), name)
        .when(name.startswith("#") | first.isin(*AGGREGATE_WORDS), ask(ONE))
        .when(first.isin(*VERB_WORDS), ask(REQUEST, request))
        .when(first.isin(*RANK_WORDS), ask(MANY))
        .when(single, ask(ONE))
        .when(is_plural(F.substring_index(name, " ", -1)), ask(MANY))
        .otherwise(ask(ONE))
    )
