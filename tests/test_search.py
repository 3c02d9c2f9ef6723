import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators.embed import HashedTokens, embed, simplify_sql
from tablewright.operators.search import search
from tablewright.operators.substring import candidate_pairs, glossary_hits, keyword_hits, rare_gram_index, substring_pairs

WORDS = [("revenue", "R"), ("churn", "C"), ("ARR", "A"), ("arr", "a"), ("monthly revenue by region and segment", "long"),
         ("é😀", "u"), ("?a", "mark"), ("🏽", "half"), ("x", "one"), ("", "empty")]
QUERIES = [(1, "Monthly REVENUE and churn"), (2, "nothing"), (3, "monthlychurnrate"), (4, ""), (5, None),
           (6, "the Monthly revenue by region and segment, arr"), (7, "caféÉ😀x"), (9, "😀a 👍🏽"), (10, "?a"), (8, "Monthly revenue by region and segmen")]


def plain_hits(queries, words, first=None):
    out = []
    for qid, text in queries:
        if text is None:
            continue
        found = sorted((k, c) for k, c in words if k.lower() in text.lower())[:first]
        out += [(qid, k, c, n) for n, (k, c) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 20, 0])
@pytest.mark.parametrize("first", [None, 2])
def test_keyword_hits(spark, size, first):
    q = spark.createDataFrame(QUERIES, "query_id int, text string").repartition(3)
    d = spark.createDataFrame(WORDS, "keyword string, content string")
    got = keyword_hits(q, d, first, size)
    rows = sorted(tuple(r) for r in got.select("query_id", "keyword", "content", "position").collect())
    assert rows == plain_hits(QUERIES, WORDS, first)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keyword_hits_random(spark, seed):
    rng = random.Random(seed)

    def text(low, high):
        return "".join(rng.choice("abé😀? ") for _ in range(rng.randint(low, high)))

    words = list({w: (w, str(n)) for n, w in enumerate(text(1, 14) for _ in range(120))}.values())
    words += [(t, "whole") for t in (text(60, 140) for _ in range(10))]
    queries = [(n, text(0, 60)) for n in range(60)] + [(100 + n, text(0, 30) + w + text(0, 9)) for n, (w, _) in enumerate(words)]
    queries += [(1000 + n, "copy " + words[0][0]) for n in range(100)]
    q = spark.createDataFrame(queries, "query_id int, text string")
    d = spark.createDataFrame(words, "keyword string, content string")
    want = plain_hits(queries, words)
    for sizes in ((1 << 20, 0), (0, 1 << 20), (0, 0)):
        got = keyword_hits(q, d, None, *sizes).select("query_id", "keyword", "content", "position")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_null_entries(spark):
    q = spark.createDataFrame([(1, "churn")], "query_id int, text string")
    d = spark.createDataFrame([(None, "x"), ("churn", None)], "keyword string, content string")
    for sizes in ((1 << 20, 0), (0, 1 << 20), (0, 0)):
        assert [tuple(r) for r in keyword_hits(q, d, None, *sizes).select("keyword", "content").collect()] == [("churn", None)]


def test_empty_dictionary(spark):
    q = spark.createDataFrame(QUERIES, "query_id int, text string")
    d = spark.createDataFrame([], "keyword string, content string")
    assert keyword_hits(q, d).count() == 0
    assert keyword_hits(q, d, None, -1).count() == 0
    assert keyword_hits(q, d, None, -1, -1).count() == 0


def test_patterns_with_one_beginning_are_told_apart(spark):
    """Candidates grow with the hits, not with patterns times texts that hold the beginning."""
    start = "select sum of revenue from the table of orders where region is "
    words = [(f"{start}{n:04d}z", str(n)) for n in range(400)] + [(f"{start}{n:04d}", str(n)) for n in range(400, 800)]
    queries = [(n, f"{start}{n:04d} and more") for n in range(300, 700)] + [(1000 + n, start) for n in range(300)]
    texts = spark.createDataFrame(queries, "text_id int, text string").selectExpr("text_id", "array(text) AS parts")
    patterns = spark.createDataFrame(words, "pattern string, content string")
    for sizes in ((1 << 20, 1 << 20), (0, 0)):
        index = rare_gram_index(patterns, texts, *sizes)
        assert index.where("gram = 'selec'").count() == 0
        met = candidate_pairs(index, texts, "patterns", sizes[1]).count()
        hits = substring_pairs(patterns, texts, "patterns", *sizes)
        want = [(p, t) for t, text in queries for p, _ in words if p in text]
        assert sorted(tuple(r) for r in hits.collect()) == sorted(want) and met <= 3 * len(want)


def test_patterns_with_a_gram_nowhere_are_not_looked_up(spark):
    texts = spark.createDataFrame([(1, ["abcdefghijklmnop"])], "text_id int, parts array<string>")
    patterns = spark.createDataFrame([("abcdefghijkl",), ("abcdefghijkX",), (None,), ("q",)], "pattern string")
    assert sorted(r.pattern for r in rare_gram_index(patterns, texts).collect()) == ["abcdefghijkl", "q"]


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_glossary_hits(spark, size):
    terms = [("Annual Recurring", "ARR is revenue"), ("Churn", None), ("LTV", "lifetime of churned users")]
    queries = [(1, "churn"), (2, "CHURN"), (3, "arr"), (4, "zzz"), (5, ""), (6, "recurring"), (7, None), (8, "lifetime of churned usersX")]
    got = glossary_hits(
        spark.createDataFrame(queries, "query_id int, text string"),
        spark.createDataFrame(terms, "term string, definition string"),
        size,
    )
    want = [
        (q, t, d)
        for q, text in queries if text is not None
        for t, d in terms if text.lower() in t.lower() or text.lower() in (d or "").lower()
    ]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


INDEX = [(f"e{n}", f"question {n}", "SELECT 1", "manual", "", "", [1.0, n / 10.0], None, None) for n in range(12)]


def index_of(spark, rows=INDEX):
    from tablewright.operators.index import INDEX_SCHEMA

    return spark.createDataFrame(rows, INDEX_SCHEMA)


def test_search_merges(spark):
    q = spark.createDataFrame([(1, "total revenue", [1.0, 0.0]), (2, "zzz", [-1.0, 0.0])],
                              "query_id int, text string, embedding array<double>")
    d = spark.createDataFrame([("revenue", "R"), ("total", "T")], "keyword string, content string")
    got = search(q, d, index_of(spark), k=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["keyword_match"], r["question"], r["similarity"]) for r in got] == [
        (1, "revenue", "", 1.0), (1, "total", "", 1.0), (1, None, "question 0", 1.0), (1, None, "question 1", 0.995)
    ]
    assert got[0]["description"] == "R" and got[0]["source"] == "keyword"


def test_search_cap_and_degrade(spark):
    q = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "query_id int, text string")
    d = spark.createDataFrame([(c, c) for c in "abcdefghijklm"], "keyword string, content string")
    for index in (None, index_of(spark)):
        got = search(q, d, index).orderBy("rank").collect()
        assert [r["keyword_match"] for r in got] == list("abcdefghij")


def test_search_with_embedder(spark):
    q = spark.createDataFrame([(1, "monthly churn"), (2, "daily orders")], "query_id int, text string")
    rows = spark.createDataFrame([("x", "monthly churn rate"), ("y", "daily orders")], "id string, question string")
    model = HashedTokens(64)
    stored = embed(rows, "question", model).selectExpr(
        "id", "question", "'' AS sql", "'m' AS source", "'' AS dashboard", "'' AS description", "embedding"
    )
    none = spark.createDataFrame([], "keyword string, content string")
    got = search(q, none, stored, lambda df: embed(df, "text", model), k=1).orderBy("query_id").collect()
    assert [(r["question"], r["similarity"]) for r in got] == [("monthly churn rate", 0.8165), ("daily orders", 1.0)]


def test_embed_isolates_failures(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(n, t) for n, t in enumerate(["a", "bad", "ccc", None])], "n int, t string").coalesce(1)
    got = embed(df, "t", model, wait=(0, 0)).orderBy("n").collect()
    assert [r["embedding"] for r in got] == [[1.0], None, [3.0], [0.0]]
    assert [r["error"] for r in got] == [None, "ValueError: refused", None, None]
    assert embed(df.limit(0), "t", model).count() == 0


def test_failing_texts_are_found_by_halving(spark, tmp_path):
    """Few calls for few bad texts, every other vector there; a model that is down is not asked for ever."""
    calls = tmp_path / "calls"
    calls.write_text("")

    def model(texts):
        with open(calls, "a") as f:
            f.write("x")
        if any(t.startswith("bad") for t in texts):
            raise ValueError("refused")
        return np.array([[len(t), 1.0] for t in texts])

    rows = [(n, f"bad{n}" if n in (17, 400, 401) else "t" * (n % 9 + 1)) for n in range(512)]
    df = spark.createDataFrame(rows, "n int, t string").coalesce(1)
    got = sorted(embed(df, "t", model, batch=512, wait=(0, 0)).collect())
    assert [r.n for r in got if r.error] == [17, 400, 401] and all(r.embedding is None for r in got if r.error)
    assert all(r.embedding == [float(len(r.t)), 1.0] for r in got if not r.error)
    assert len(calls.read_text()) <= 3 * 2 * 9 + 3 * 3 + 3
    calls.write_text("")
    down = embed(df.withColumn("t", F.lit("bad")), "t", model, batch=512, wait=(0, 0)).collect()
    assert all(r.error for r in down) and len(calls.read_text()) <= 20 * 3 + 40
    assert sum(r.error.startswith("not tried") for r in down) == 492


def test_embed_tries_three_times(spark, tmp_path):
    marks = str(tmp_path / "tries")

    def model(texts):
        with open(marks, "a") as f:
            f.write("x")
        if len(open(marks).read()) < 3:
            raise RuntimeError("busy")
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([("a",)], "t string").coalesce(1)
    assert embed(df, "t", model, wait=(0, 0)).first()["embedding"] == [1.0]


def test_simplify(spark):
    rows = [(0, "SELECT 1", "fine"), (1, "SELECT 2", "empty"), (2, "SELECT 3", "fails"), (3, "  ", "fine"), (4, None, "fine")]
    df = spark.createDataFrame(rows, "n int, sql string, element_title string")

    def rewrite(sql, title):
        if title == "fails":
            raise RuntimeError
        return "```sql\n```" if title == "empty" else f"```sql\n{sql} -- {len(sql)}\n```"

    got = [r["sql"] for r in simplify_sql(df, rewrite).orderBy("n").collect()]
    assert got == ["SELECT 1 -- 8", "SELECT 2", "SELECT 3", "  ", None]
    assert simplify_sql(df, None) is df
    long = spark.createDataFrame([("S" * 5000, "fine")], "sql string, element_title string")
    assert simplify_sql(long, rewrite).first()["sql"] == "S" * 5000 + " -- 5000"
    assert simplify_sql(long, rewrite, sql_chars=4000).first()["sql"] == "S" * 5000
    assert simplify_sql(long, lambda s, t: "").select(F.length("sql")).first()[0] == 5000


def test_models_are_asked_once_per_row(spark, tmp_path):
    marks = tmp_path / "asked"
    marks.write_text("")

    def rewrite(sql, title):
        with open(marks, "a") as f:
            f.write("r")
        return sql + "!"

    def model(texts):
        with open(marks, "a") as f:
            f.write("e" * len(texts))
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([(f"SELECT {n}", "t") for n in range(7)], "sql string, element_title string").coalesce(1)
    rows = embed(simplify_sql(df, rewrite), "sql", model).collect()
    assert [r["sql"] for r in rows] == [f"SELECT {n}!" for n in range(7)] and rows[0]["embedding"] == [1.0]
    assert sorted(marks.read_text()) == ["e"] * 7 + ["r"] * 7

    marks.write_text("")
    stored = spark.createDataFrame([("x", "q", "", "m", "", "", [1.0])], "id string, question string, sql string, "
                                   "source string, dashboard string, description string, embedding array<double>")
    none = spark.createDataFrame([], "keyword string, content string")
    asked = df.selectExpr("sql AS query_id", "sql AS text")
    assert search(asked, none, stored, lambda q: embed(q, "text", model)).count() == 7
    assert marks.read_text() == "e" * 7


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_a_gram_that_a_text_repeats_is_looked_up_once(spark, size):
    texts = spark.createDataFrame([(1, ["abc " * 1000]), (2, ["é😀abcé" * 500, "abc"])], "text_id int, parts array<string>")
    patterns = spark.createDataFrame([("abc",), ("é😀",)], "pattern string")
    index = rare_gram_index(patterns, texts, size, size)
    assert sorted((r.pattern, r.text_id) for r in candidate_pairs(index, texts, "patterns", size).collect()) == [("abc", 1), ("abc", 2), ("é😀", 2)]
