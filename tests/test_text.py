import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import text as tx
from tablewright.functions.questions import generate_question, is_plural, with_question
from tablewright.functions.statements import classify_statements


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def plain_slug(text, fallback="file", size=80):
    low = unicodedata.normalize("NFKD", text).lower()
    kept = "".join(ch for ch in low if ch.isalnum() or ch in "_-" or ch.isspace())
    words = [w for w in re.split(r"[\s-]+", kept) if w]
    return "-".join(words)[:size] or fallback


SLUGS = [
    "What is our monthly churn rate?", "Revenue by Region 2024", "  many   spaces -- here ", "Café Ñandú",
    "x" * 200, "!!!", "", "tab\tnew\nline", "a_b c-d", "ﬁne ² ½ Ⅷ", "naïve space", "日本 語", "é̂ combined",
    "-edge-", "İstanbul ẞ", "word " * 40, "\x1cfs\x1f",
]


def test_slugify(spark):
    assert column(spark, SLUGS, tx.slugify) == [plain_slug(s) for s in SLUGS]
    assert column(spark, ["?"], lambda c: tx.slugify(c, "chart")) == ["chart"]


def test_clean_title(spark):
    values = ["  a \n b\t\tc ", " x y　", "", None, "\x1cq\x1f"]
    assert column(spark, values, tx.clean_title) == ["a b c", "x y", "", "", "q"]


def test_plural(spark):
    words = ["Orders", "Class", "Status", "Analysis", "Countries", "famous", "data", "series", "Users"]
    assert column(spark, words, is_plural) == [True, False, False, False, True, False, False, True, True]


QUESTIONS = [
    ("Who buys most?", "Sales", "Who buys most from Sales?"),
    ("Who is in sales today?", "Sales", "Who is in sales today?"),
    ("Ready?", "", "Ready?"),
    ("# Orders", "Ops", "What is the # Orders from Ops?"),
    ("Total Users", "", "What is the Total Users?"),
    ("count# of things", "B", "What is the count# of things from B?"),
    ("Show Orders by day", "D", "Can you show Orders by day from D?"),
    ("Compare", "", "Can you compare?"),
    ("Top 10 Customers", "D", "What are the Top 10 Customers from D?"),
    ("Bottom regions by sales", "", "What are the Bottom regions by sales?"),
    ("Monthly Orders", "D", "What is the Monthly Orders from D?"),
    ("Conversion Rates", "D", "What is the Conversion Rates from D?"),
    ("Share % of Users", "", "What is the Share % of Users?"),
    ("Orders by Countries", "D", "What is the Orders by Countries from D?"),
    ("Nearby Stores", "D", "What are the Nearby Stores from D?"),
    ("Active   Users", " My  Board ", "What are the Active Users from My Board?"),
    ("Order Status", "D", "What is the Order Status from D?"),
    ("Revenue", "D", "What is the Revenue from D?"),
    ("   ", "D", "What is the Untitled chart from D?"),
    (None, None, "What is the Untitled chart?"),
]


def test_generate_question(spark):
    rows = [(i, t, d) for i, (t, d, _) in enumerate(QUESTIONS)]
    df = spark.createDataFrame(rows, "i int, t string, d string").orderBy("i")
    got = [r[0] for r in df.select(generate_question(F.col("t"), F.col("d"))).collect()]
    assert got == [q for _, _, q in QUESTIONS]
    staged = with_question(df, "t", "d").orderBy("i")
    assert staged.columns == ["i", "t", "d", "question"]
    assert [r["question"] for r in staged.collect()] == got


def test_code_fence(spark):
    values = ["```sql\nSELECT 1\n```", "```\nSELECT 2```  ", " SELECT 3 ", "```", "```sql```", ""]
    assert column(spark, values, tx.strip_code_fence) == ["SELECT 1", "SELECT 2", "SELECT 3", "", "", ""]


def test_small_rules(spark):
    assert column(spark, ["a\n\n\nb\nc"], tx.collapse_newlines) == ["a\nb\nc"]
    assert column(spark, ["a, b ,,c,"], tx.split_list) == [["a", "b", "c"]]
    lines = column(spark, [["SELECT 1  ", " FROM t\t\n"]], tx.join_lines, "array<string>")
    assert lines == ["SELECT 1\n FROM t"]


def test_stable_id(spark):
    import hashlib

    want = "lkr-" + hashlib.sha256(b"looker:12:ab").hexdigest()[:16]
    rows = spark.createDataFrame([("looker", 12, "ab")], "s string, a int, b string")
    got = rows.select(
        tx.stable_id("looker", F.col("a"), F.col("b")), tx.stable_id(F.col("s"), F.col("a"), F.col("b"))
    ).first()
    assert list(got) == [want, want]


def plain_format(v):
    if isinstance(v, float):
        if abs(v) >= 1e6:
            return f"${v / 1e6:,.1f}M" if v > 0 else f"{v / 1e6:,.1f}M"
        return f"{v:,.0f}" if abs(v) >= 1e3 else f"{v:,.2f}"
    return str(v)


def test_format_scalar(spark):
    values = [0.0, 0.125, 2.675, 999.999, 1000.0, 2500.5, 999999.9, 1e6, -1e6, -1500.0, 1.25e9, -0.5,
              float("nan"), float("inf"), float("-inf"), 3500.5, None]
    got = column(spark, values, lambda c: tx.format_scalar(c, T.DoubleType()), "double")
    assert got == [plain_format(v) for v in values]
    assert column(spark, [7, None], lambda c: tx.format_scalar(c, T.LongType()), "bigint") == ["7", "None"]
    assert column(spark, [True], lambda c: tx.format_scalar(c, T.BooleanType()), "boolean") == ["True"]


def test_double_text(spark):
    values = [0.0, 1.5, 1e7, 123456789.125, 1e16, 1.5e20, 0.0005, 0.00001, 1.25e-7, -2e8, 900.1, float("inf"),
              float("nan"), 9999999999999998.0]
    assert column(spark, values, tx.double_text, "double") == [str(v) for v in values]


def test_mask_secrets(spark):
    got = column(
        spark,
        [{"api_key": "x", "Client_Secret": "", "password": "****", "host": "h", "access_token": None}],
        tx.mask_secrets, "map<string,string>",
    )[0]
    assert got == {"api_key": "true", "Client_Secret": "false", "password": "false", "host": "h", "access_token": "false"}


STATEMENTS = [
    ("SELECT 1", "SELECT", False, False),
    ("-- note\ninsert into t values (1)", "INSERT", True, False),
    ("/* a\nb */ Drop table t", "DROP", True, False),
    ("WITH a AS (SELECT 1) DELETE FROM t", "WITH", False, False),
    ("select * from t limit 5", "SELECT", False, True),
    ("select limits from t", "SELECT", False, False),
    ("\n\t merge into t", "MERGE", True, False),
    ("", "", False, False),
    ("-- only", "", False, False),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STATEMENTS)], "i int, sql string")
    got = classify_statements(df).orderBy("i").select("sql", "first_word", "is_write", "has_limit").collect()
    assert [tuple(r) for r in got] == STATEMENTS


@pytest.mark.parametrize("size", [3, 2000])
def test_chart_text(spark, size):
    df = spark.createDataFrame([("q?", "S" * 3000)], "q string, s string")
    got = df.select(tx.chart_text(F.col("q"), F.col("s"), size)).first()[0]
    assert got == "Question: q?\nSQL Pattern:\n" + "S" * size


def test_slugs_of_large_batches_are_made_in_small_parts(spark, monkeypatch):
    """Plain texts stay in the JVM; others are decomposed a few at a time, nulls and order kept."""
    from tablewright.functions import text as module

    monkeypatch.setattr(module, "NFKD_TEXTS", 3)
    texts = [None, "", "plain Text", "é à ﬁn", *[f"Ünï {n}" for n in range(20)], "plain again", "ﬃ"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").coalesce(1)
    got = [r[0] for r in df.select("n", module.slugify(F.col("t")).alias("s")).orderBy("n").select("s").collect()]
    assert got == ["file", "file", "plain-text", "e-a-fin", *[f"uni-{n}" for n in range(20)], "plain-again", "ffi"]
