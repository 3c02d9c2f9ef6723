import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.ingest import charts as ch
from tablewright.ingest.load import chart_rows, load, rebuild, schema_rows, select_sources
from tablewright.operators.catalog import table_docs
from tablewright.operators.index import INDEX_SCHEMA, upsert
from tablewright.plans import ingest_checks
from tablewright.plans.registry import Tables
from tablewright.sources.files import read_dashboards

NOW = datetime(2024, 2, 1)
LONG = "SELECT a, b, c FROM some_table WHERE a > 10 AND b < 20 -- long"


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def lakeview(datasets, *widgets):
    return json.dumps({"datasets": datasets, "pages": [{"layout": [{"widget": w} for w in widgets]}, {}]})


SALES = {"name": "sales", "queryLines": ["SELECT sum(amount)  \n", "FROM sales_table\t"]}
USERS = {"displayName": "users", "query": "SELECT count(*) FROM users"}


def test_lakeview(spark):
    def widget(title, ref=None, name=None, kind="bar", **more):
        return {"spec": {"widgetType": kind, "frame": {"title": title}}, "queries": [{"query": {"datasetName": ref}}],
                **({"name": name} if name is not None else {}), **more}

    whole = lakeview(
        [SALES, USERS, {"name": "tiny", "query": "SELECT 1"}, {"query": "SELECT nothing FROM unnamed"}],
        widget("Total", "sales", "w1"), widget("Users", "users", "w2"), widget("", "users", "w3", displayName="Shown"),
        widget("Other", "tiny", "w4"), widget("None", None, "w5"), widget("Pick", "sales", "w6", "filter-multi"),
        widget("UNTITLED", "sales", "w7"), widget("", "sales", "w8"), widget("No name", "sales"),
        {"displayName": "Bare", "name": "w9"},
    )
    twice = lakeview([{"name": "a", "query": "SELECT first_version FROM t"}, {"name": "a", "query": "SELECT second_version FROM t"}],
                     widget("T", "missing", "w"))
    rows = [("d1", "Board", whole), ("d2", None, twice), ("d3", "x", "{broken"), ("d4", "x", lakeview([], widget("T", "a", "w"))),
            ("", "blank", whole), ("longer-identifier", None, lakeview([USERS], widget("T", "a", "w"))), ("d5", "x", None),
            ("d6", "x", "[1, 2]"), ("d7", "x", "{}")]
    got = tuples(ch.lakeview_charts(spark.createDataFrame(rows, "dashboard_id string, display_name string, serialized string")))
    sales, users = "SELECT sum(amount)\nFROM sales_table", "SELECT count(*) FROM users"
    assert got == sorted([
        ("d1", "Board", "w1", "Total", sales), ("d1", "Board", "w2", "Users", users), ("d1", "Board", "w3", "Shown", users),
        ("d1", "Board", "w4", "Other", sales), ("d1", "Board", "w5", "None", sales),
        ("d1", "Board", "No name", "No name", sales), ("d1", "Board", "w9", "Bare", sales),
        ("d2", "Dashboard d2", "w", "T", "SELECT second_version FROM t"),
        ("longer-identifier", "Dashboard longer-i", "w", "T", users),
    ])


def test_usage(spark):
    rows = [("a", 6, datetime(2024, 1, 20)), ("a", 4, datetime(2024, 1, 30)), ("b", 9, datetime(2024, 1, 30)),
            ("c", 50, datetime(2023, 1, 1)), ("", 99, datetime(2024, 1, 30)), (None, 99, datetime(2024, 1, 30)),
            ("d", None, datetime(2024, 1, 30)), ("d", 10, datetime(2024, 1, 30))]
    df = spark.createDataFrame(rows, "dashboard_id string, runs bigint, at timestamp")
    assert tuples(ch.usage_counts(df, NOW)) == [("a", 10), ("d", 10)]
    assert tuples(ch.usage_counts(df, NOW, min_views=1, top_rows=2)) == [("b", 9), ("d", 10)]
    assert tuples(ch.usage_counts(df, NOW, lookback_days=5, min_views=0)) == [("a", 4), ("b", 9), ("d", 10)]


def test_looker(spark):
    elements = [
        {"id": 1, "title": "Own", "query": {"id": 5, "sql": LONG}},
        {"id": 2, "title": "Made", "result_maker": {"query": {"id": 6, "sql": LONG}}},
        {"id": 3, "title": "untitled", "query": {"sql": LONG}}, {"id": 4, "title": "Short", "query": {"sql": "SELECT 1"}},
        {"id": 5, "title": "Nothing"}, {"id": 6, "query": {"sql": LONG}},
    ]
    rows = [(json.dumps({"id": i, "title": t, "elements": elements}),) for i, t in (("7", "Seven"), ("8", ""), ("9", "Unused"))]
    boards = spark.createDataFrame(rows + [("nope",)], "payload string")
    usage = spark.createDataFrame([("7", 20), ("8", 30), ("10", 99)], "dashboard_id string, view_count bigint")
    got = tuples(ch.looker_charts(boards, usage))
    assert got == [("7", "Seven", "1", "Own", LONG, 20), ("7", "Seven", "2", "Made", LONG, 20),
                   ("8", "Dashboard 8", "1", "Own", LONG, 30), ("8", "Dashboard 8", "2", "Made", LONG, 30)]
    assert ch.looker_charts(boards, usage.where("view_count < 50"), 1).select("dashboard_id").distinct().collect()[0][0] == "8"


def test_redash(spark):
    def widget(id_, name, sql, vis="Chart"):
        return {"visualization": {"name": vis, "query": {"id": id_, "name": name, "query": sql}}}

    first = {"slug": "s1", "name": "One", "widgets": [
        {"text": "note"}, {"visualization": None}, widget(2, "short", "SELECT 1"), widget(1, "Q1", LONG), widget(3, "", LONG, "Vis3")]}
    second = {"slug": "s2", "widgets": [widget(1, "Q1 again", LONG), widget(2, "Q2", LONG), widget(4, "", LONG, "")]}
    df = spark.createDataFrame([("b", json.dumps(second)), ("a", json.dumps(first)), ("c", "{")], "position string, payload string")
    assert tuples(ch.redash_charts(df)) == [
        ("s1", "One", "1", "Q1", LONG), ("s1", "One", "3", "Vis3", LONG), ("s2", "Dashboard s2", "2", "Q2", LONG)]


def test_superset(spark):
    rows = [
        (1, "Board", 10, "A", json.dumps({"sql": LONG}), None), (1, None, 11, "B", json.dumps({"sql": "", "query": LONG}), "{}"),
        (2, "x", 12, "C", "{bad", json.dumps({"query": LONG})), (2, "x", 13, "D", None, "{bad"),
        (2, "x", 14, "", json.dumps({"sql": LONG}), None), (2, "x", 15, "E", json.dumps({"sql": "SELECT 1"}), json.dumps({"query": LONG})),
    ]
    df = spark.createDataFrame(
        rows, "dashboard_id int, dashboard_title string, id int, slice_name string, params string, query_context string")
    assert tuples(ch.superset_charts(df)) == [
        ("1", "Board", "10", "A", LONG), ("1", "Dashboard 1", "11", "B", LONG), ("2", "x", "12", "C", LONG)]


def test_mode(spark):
    queries = [{"token": "q1", "name": "N", "raw_query": LONG}, {"token": "q2", "raw_query": LONG}, {"token": "q3", "name": "S", "raw_query": "x"}]
    rows = [("r1", "One", json.dumps(queries)), ("r2", None, " " + json.dumps({"_embedded": {"queries": queries}})), ("r3", "x", "{"), ("r4", "x", "{}")]
    df = spark.createDataFrame(rows, "token string, name string, payload string")
    assert tuples(ch.mode_charts(df)) == [("r1", "One", "q1", "N", LONG), ("r2", "Report r2", "q1", "N", LONG)]


def test_sigma(spark):
    elements = [{"elementId": "e1", "name": "N"}, {"elementId": "e2", "name": ""}, {"elementId": "", "name": "x"}, {"elementId": "e4", "name": "S"}]
    books = spark.createDataFrame(
        [("w1", "One", json.dumps(elements)), ("w2", None, json.dumps({"entries": elements})), ("", "x", json.dumps(elements))],
        "workbook_id string, name string, payload string")
    sql = spark.createDataFrame(
        [(w, e, LONG if e != "e4" else "SELECT 1") for w in ("w1", "w2") for e in ("e1", "e2", "e4")],
        "workbook_id string, element_id string, sql string")
    assert tuples(ch.sigma_charts(books, sql)) == [("w1", "One", "e1", "N", LONG), ("w2", "Workbook w2", "e1", "N", LONG)]


def test_first_dashboards(spark):
    df = spark.createDataFrame([(n // 2, n) for n in range(10)], "position int, n int")
    assert tuples(ch.first_dashboards(df, 2), "n") == [(0,), (1,), (2,), (3,)]
    assert ch.first_dashboards(df, 0).count() == 10


def test_read_dashboards(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":\n 1}')
    (tmp_path / "b.json").write_text('{"x": 2}')
    got = tuples(read_dashboards(spark, str(tmp_path)), "file_name", "payload")
    assert got == [("a.json", '{"x":\n 1}'), ("b.json", '{"x": 2}')]
    assert read_dashboards(spark, str(tmp_path), whole_files=False).count() == 3


def test_select_sources(spark, caplog):
    readers = {name: (lambda n=name: spark.createDataFrame([(n,)], "source string")) for name in ("looker", "databricks", "redash")}
    assert list(select_sources(["all"], readers)) == ["databricks", "looker"]
    assert list(select_sources(["redash", "nope", "redash"], readers)) == ["redash"]
    assert "unknown source nope" in caplog.text


@pytest.fixture
def charts(spark):
    rows = [("looker", "d1", "Sales", "1", "Total Revenue", LONG), ("databricks", "d2", "Ops", "2", "bad chart", LONG + "\n\n\nx"),
            ("databricks", "d2", "Ops", "3", "Orders", LONG + "\n\n\nx")]
    return spark.createDataFrame(
        rows, "source string, dashboard_id string, dashboard_title string, element_id string, element_title string, sql string")


def local_model():
    """A nested function travels to the workers by value; they need not find this file."""

    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    return model


model = local_model()


def counts(done):
    return {r["source"]: tuple(r)[1:] for r in done.counters.collect()}


def test_load(spark, charts):
    empty = spark.createDataFrame([], INDEX_SCHEMA)
    done = load(chart_rows(charts), empty, model, NOW, wait=(0, 0))
    assert counts(done) == {"looker": (1, 0, 0, 0), "databricks": (1, 0, 0, 1), None: (2, 0, 0, 1)}
    rows = {r["description"]: r for r in done.index.collect()}
    assert set(rows) == {"Total Revenue", "Orders"}
    assert rows["Orders"]["sql"] == LONG + "\nx" and rows["Orders"]["question"] == "What are the Orders from Ops?"
    assert rows["Total Revenue"]["id"].startswith("lkr-") and rows["Total Revenue"]["dashboard"] == "Sales"
    text = f"Question: What is the Total Revenue from Sales?\nSQL Pattern:\n{LONG}"
    assert rows["Total Revenue"]["embedding"] == [float(len(text)), 1.0]
    failed = done.failed.collect()
    assert [(r["description"], r["error"]) for r in failed] == [("bad chart", "ValueError: refused")]

    stored = spark.createDataFrame(done.index.collect(), done.index.schema)
    again = load(chart_rows(charts), stored, model, datetime(2024, 3, 1), wait=(0, 0))
    assert counts(again)[None] == (0, 2, 0, 1)
    assert {r["created_at"] for r in again.index.collect()} == {NOW}
    skipping = load(chart_rows(charts), stored, model, NOW, skip_existing=True, wait=(0, 0))
    assert counts(skipping)[None] == (0, 0, 2, 1)
    dry = load(chart_rows(charts), empty, model, NOW, dry_run=True)
    assert counts(dry) == {"looker": (0, 0, 1, 0), "databricks": (0, 0, 2, 0), None: (0, 0, 3, 0)}
    assert dry.index.count() == 0 and dry.failed.count() == 0


def test_schema_documents(spark):
    docs = table_docs(spark, {"orders": spark.createDataFrame([], "a int")})
    done = load(schema_rows(docs), spark.createDataFrame([], INDEX_SCHEMA), model, NOW)
    row = done.index.first()
    assert (row["source"], row["sql"], row["question"]) == ("warehouse", "", "What data is in the orders table?")
    assert row["embedding"][0] == len(f"Question: {row['question']}\nSchema: {row['description']}")


def test_rebuild(spark):
    patterns = spark.createDataFrame(
        [("q", "SELECT 1", ["t"], "", "manual", None, "q.sql"), ("bad", "SELECT 2", [], "d", "manual", None, "bad.sql")],
        "question string, sql string, tables array<string>, description string, source string, created date, filename string")
    done = rebuild(patterns, spark.createDataFrame([], INDEX_SCHEMA), model, NOW, wait=(0, 0))
    assert counts(done)[None] == (1, 0, 0, 1)
    assert [(r["id"], r["embedding"][0]) for r in done.index.collect()] == [("q.sql", len("q\nSELECT 1"))]


def test_load_is_repeatable(spark, charts):
    empty = spark.createDataFrame([], INDEX_SCHEMA)
    once = load(chart_rows(charts), empty, model, NOW, wait=(0, 0)).index
    twice = upsert(once, once.drop("created_at", "updated_at"), NOW)
    assert tuples(once.withColumn("e", F.size("embedding")), "id", "e") == tuples(twice.withColumn("e", F.size("embedding")), "id", "e")


def test_payloads_are_made_and_read_by_all_cores(spark, data):
    """A small table is one split; what is below the dealing of its rows neither makes nor reads JSON."""
    tables = Tables(spark, data)
    for extract in (ingest_checks.lakeview, ingest_checks.mode, ingest_checks.redash):
        plan = extract(tables)._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("RoundRobinPartitioning")
        assert "json" in above and "json" not in below
