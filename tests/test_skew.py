"""One key with a third of the rows, against plain Python."""

import json
import random
from datetime import datetime, timedelta

import pytest

from tablewright.ingest import charts as ch
from tablewright.ingest.load import counters
from tablewright.operators import index as ix
from tablewright.operators.catalog import profile
from tablewright.operators.ledger import job_states
from tablewright.operators.substring import glossary_hits, keyword_hits

NOW = datetime(2024, 2, 1)
ROWS = 12_000


@pytest.fixture(scope="module")
def keys():
    rng = random.Random(5)
    return ["hot" if rng.random() < 1 / 3 else f"k{rng.randint(0, 2000)}" for _ in range(ROWS)]


def test_upsert(spark, keys):
    stored = spark.createDataFrame([(k, "old") for k in sorted(set(keys))[:700]], "id string, question string")
    index = ix.upsert(spark.createDataFrame([], ix.INDEX_SCHEMA), stored, datetime(2024, 1, 1))
    batch = spark.createDataFrame([(k, f"q{n}", n) for n, k in enumerate(keys)], "id string, question string, n int")
    got = {r["id"]: (r["question"], r["created_at"]) for r in ix.upsert(index, batch.repartition(8), NOW, "n").collect()}
    known = set(sorted(set(keys))[:700])
    last = {k: f"q{n}" for n, k in enumerate(keys)}
    assert got == {k: (q, datetime(2024, 1, 1) if k in known else NOW) for k, q in last.items()}


def test_first_chart_of_a_query(spark, keys):
    sql = "SELECT something FROM some_table WHERE it_is_long_enough = true"
    rows = []
    for n, key in enumerate(keys):
        widget = {"visualization": {"name": "v", "query": {"id": key, "name": f"n{n}", "query": sql}}}
        rows.append((n, json.dumps({"slug": f"s{n}", "name": "b", "widgets": [widget]})))
    df = spark.createDataFrame(rows, "position int, payload string").repartition(8)
    got = {r["element_id"]: r["element_title"] for r in ch.redash_charts(df).collect()}
    want = {}
    for n, key in enumerate(keys):
        want.setdefault(key, f"n{n}")
    assert got == want


def test_usage_and_counters(spark, keys):
    rows = [(k, n % 7, NOW) for n, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "dashboard_id string, runs bigint, at timestamp").repartition(8)
    want = {}
    for k, runs, _ in rows:
        want[k] = want.get(k, 0) + runs
    got = {r["dashboard_id"]: r["view_count"] for r in ch.usage_counts(df, NOW, min_views=20).collect()}
    assert got == {k: v for k, v in want.items() if v >= 20}
    outcomes = df.selectExpr("dashboard_id AS source", "IF(runs > 3, 'created', 'errors') AS outcome")
    total = {r["source"]: (r["created"], r["errors"]) for r in counters(outcomes).collect()}
    assert total[None] == (sum(r[1] > 3 for r in rows), sum(r[1] <= 3 for r in rows))
    assert total["hot"] == (sum(r[1] > 3 for r in rows if r[0] == "hot"), sum(r[1] <= 3 for r in rows if r[0] == "hot"))


def test_profile(spark, keys):
    long = "x" * 300
    rows = [(None if n % 5 == 0 else k, long + k if k == "hot" else k) for n, k in enumerate(keys)]
    got = {r["column"]: r for r in profile(spark.createDataFrame(rows, "a string, b string").repartition(8)).collect()}
    assert got["a"]["nulls"] == sum(a is None for a, _ in rows)
    assert got["a"]["distinct"] == len({a for a, _ in rows} - {None})
    assert got["b"]["distinct"] == len({b for _, b in rows})


def test_job_with_most_events(spark, keys):
    rows = [(k, "looker", "running", NOW + timedelta(seconds=n), f"{n}/x") for n, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id string, source string, status string, at timestamp, progress string").repartition(8)
    last, first = {}, {}
    for k, _, _, at, progress in rows:
        first.setdefault(k, at)
        last[k] = progress
    got = {r["id"]: (r["started_at"], r["progress"]) for r in job_states(df, keep=None).collect()}
    assert got == {k: (first[k], last[k]) for k in last}


@pytest.mark.parametrize("sizes", [(1 << 20, 0), (0, 1 << 20), (0, 0)])
def test_copies_of_a_text(spark, keys, sizes):
    words = [("hot", "h"), ("k1", "a"), ("k20", "b"), ("zz", "c"), ("text of k19", "d")]
    texts = [(n, f"text of {k}") for n, k in enumerate(keys)]
    queries = spark.createDataFrame(texts, "query_id int, text string").repartition(8)
    dictionary = spark.createDataFrame(words, "keyword string, content string")
    got = keyword_hits(queries, dictionary, None, *sizes).select("query_id", "keyword").collect()
    assert sorted(map(tuple, got)) == sorted((n, w) for n, t in texts for w, _ in words if w in t)


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_copies_of_a_question(spark, keys, size):
    terms = [("hotel", "a place"), ("k1", None), ("other", "k19 and k20"), ("none", "nothing")]
    asked = spark.createDataFrame(list(enumerate(keys)), "query_id int, text string").repartition(8)
    got = glossary_hits(asked, spark.createDataFrame(terms, "term string, definition string"), size)
    want = [(n, t) for n, k in enumerate(keys) for t, d in terms if k in t or k in (d or "")]
    assert sorted(map(tuple, got.select("query_id", "term").collect())) == sorted(want)
