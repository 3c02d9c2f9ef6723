import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.operators import snapshots
from tablewright.operators.ledger import job_states, sweep_stale
from tablewright.operators.slots import evaluate_slots, slot_values
from tablewright.sources.query_log import LOG_SCHEMA, append_query_log
from tablewright.streaming.feeds import ingest_stream, load_stream, log_windows, query_log_stream, run_available, search_stream

SLOTS = [
    {"slot": "n", "sql": "SELECT count(*) FROM slot_rows", "format": "scalar"},
    {"slot": "big", "sql": "SELECT CAST(2500000 AS DOUBLE)"},
    {"slot": "none", "sql": "SELECT y FROM slot_rows WHERE y > 99"},
    {"slot": "null", "sql": "SELECT CAST(NULL AS DOUBLE)"},
    {"slot": "bars", "sql": "SELECT x, y, x FROM slot_rows ORDER BY y DESC", "format": "chart"},
    {"slot": "one", "sql": "SELECT y FROM slot_rows ORDER BY y", "format": "chart"},
    {"slot": "rows", "sql": "SELECT x AS a, y FROM slot_rows ORDER BY y", "format": "table"},
]
BAD = [
    {"slot": "write", "sql": "DROP VIEW slot_rows"},
    {"slot": "missing", "sql": "SELECT * FROM no_such_table"},
    {"slot": "runtime", "sql": "SELECT 1 / CAST(y - y AS INT) FROM slot_rows"},
    {"slot": "long", "sql": "SELECT id FROM range(6000) LIMIT 6000", "format": "chart"},
]


@pytest.fixture(autouse=True)
def rows(spark):
    spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "x string, y int").createOrReplaceTempView("slot_rows")


def test_slots(spark):
    got = {r["slot"]: r for r in evaluate_slots(spark, SLOTS + BAD).collect()}
    assert [got[s]["rendered"] for s in ("n", "big", "none", "null")] == ["3", "$2.5M", "—", "None"]
    assert json.loads(got["bars"]["rendered"]) == {"x": ["b", "a", "c"], "y": [2, 1, None], "type": "bar", "name": "bars"}
    assert json.loads(got["one"]["rendered"])["y"] == [None, 1, 2] and "x" not in json.loads(got["one"]["rendered"])
    assert json.loads(got["rows"]["rendered"])[1] == {"a": "a", "y": 1}
    for slot in BAD:
        assert got[slot["slot"]]["rendered"] is None and got[slot["slot"]]["error"].startswith("Error: ")
    assert spark.catalog.tableExists("slot_rows")
    assert slot_values(spark, SLOTS).count() == len(SLOTS)


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snaps")
    with pytest.raises(LookupError, match="no snapshots"):
        snapshots.rollback(spark, root)
    with pytest.raises(LookupError, match="no snapshots exist"):
        snapshots.rollback(spark, root, "x")
    a, b = spark.range(3), spark.range(5)
    assert snapshots.checkpoint(spark, root, "before pivot!", {"t": a}, datetime(2024, 1, 1)) == "before_pivot_"
    snapshots.checkpoint(spark, root, "later", {"t": b, "u": a}, datetime(2024, 1, 2))
    assert {k: v.count() for k, v in snapshots.rollback(spark, root).items()} == {"t": 5, "u": 3}
    assert {k: v.count() for k, v in snapshots.rollback(spark, root, "before pivot!").items()} == {"t": 3}
    snapshots.checkpoint(spark, root, "before pivot!", {"u": b}, datetime(2024, 1, 3))
    assert {k: v.count() for k, v in snapshots.rollback(spark, root, "before pivot!").items()} == {"u": 5}
    assert [r["name"] for r in snapshots.list_checkpoints(spark, root).collect()] == ["before_pivot_", "later"]
    with pytest.raises(LookupError, match="available: before_pivot_, later"):
        snapshots.rollback(spark, root, "nope")
    changed = sorted((r["id"], r["change"]) for r in snapshots.diff(b, a).collect())
    assert changed == [(3, "removed"), (4, "removed")]


def test_ledger(spark):
    t = datetime(2024, 1, 1)
    events = [("done", "looker", "pending", t, None), ("done", "looker", "running", t + timedelta(1), "5/10"),
              ("done", "looker", "completed", t + timedelta(2), None), ("stuck", "mode", "running", t + timedelta(5), "1/2"),
              ("bad", "mode", "failed", t + timedelta(3), None)]
    events += [(f"old{n}", "mode", "completed", t - timedelta(n + 1), None) for n in range(60)]
    df = spark.createDataFrame(events, "id string, source string, status string, at timestamp, progress string").repartition(4)
    got = job_states(df).collect()
    assert len(got) == 50 and [r["id"] for r in got[:4]] == ["stuck", "bad", "done", "old0"]
    jobs = {r["id"]: r for r in job_states(df, keep=None).collect()}
    assert len(jobs) == 63
    assert (jobs["done"]["status"], jobs["done"]["started_at"], jobs["done"]["finished_at"]) == ("completed", t, t + timedelta(2))
    assert (jobs["stuck"]["progress"], jobs["stuck"]["finished_at"]) == ("1/2", None)
    now = datetime(2024, 2, 1)
    swept = {r["id"]: r for r in sweep_stale(job_states(df), now).collect()}
    assert (swept["stuck"]["status"], swept["stuck"]["finished_at"], swept["stuck"]["progress"]) == ("failed", now, None)
    assert swept["stuck"]["error"] and swept["done"]["error"] is None and swept["done"]["status"] == "completed"


def test_log_stream(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    at = datetime(2024, 1, 1, 10)
    append_query_log(spark, log, [("SELECT 1", 5, 2.0), ("select 2", 7, 4.0)], at)
    append_query_log(spark, log, [("SHOW TABLES", 1, 1.0)], at + timedelta(minutes=70))
    windows = log_windows(query_log_stream(spark, log))
    run_available(windows, out, state).awaitTermination()
    append_query_log(spark, log, [("SELECT 3", 1, 1.0)], at + timedelta(hours=9))
    run_available(windows, out, state).awaitTermination()
    append_query_log(spark, log, [("SELECT late", 1, 1.0)], at)
    append_query_log(spark, log, [("SELECT 4", 1, 1.0)], at + timedelta(hours=19))
    run_available(windows, out, state).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [(at, "SELECT", 2, 12, 4.0), (at + timedelta(hours=1), "SHOW", 1, 1, 1.0), (at + timedelta(hours=9), "SELECT", 1, 1, 1.0)]


def test_load_stream(spark, tmp_path):
    from tablewright.operators.index import INDEX_SCHEMA
    from tablewright.sources.store import read_index, upsert_index

    landed, root = str(tmp_path / "landed"), str(tmp_path / "index")

    def land(*rows):
        spark.createDataFrame(rows, "id string, question string").write.mode("append").json(landed)

    def batch(df, _):
        upsert_index(df, root, datetime(2024, 1, 1))

    land(("a", "one"), ("b", "two"))
    stream = spark.readStream.schema("id string, question string").json(landed)
    load_stream(stream, str(tmp_path / "state"), batch).awaitTermination()
    land(("a", "changed"))
    load_stream(stream, str(tmp_path / "state"), batch).awaitTermination()
    assert sorted((r["id"], r["question"]) for r in read_index(spark, root).collect()) == [("a", "changed"), ("b", "two")]
    assert spark.createDataFrame([], INDEX_SCHEMA).columns == read_index(spark, root).columns


def test_search_stream(spark, tmp_path):
    from tablewright.operators.search import search

    asked, out = str(tmp_path / "asked"), str(tmp_path / "out")
    schema = "query_id int, text string, embedding array<double>"
    index = spark.createDataFrame(
        [(f"i{n}", f"q{n}", "", "m", "", "", [1.0, float(n)]) for n in range(5)],
        "id string, question string, sql string, source string, dashboard string, description string, embedding array<double>")
    words = spark.createDataFrame([("churn", "C")], "keyword string, content string")
    rows = [(1, "churn now", [1.0, 0.0]), (2, "orders", [0.0, 1.0]), (3, "churned", [1.0, 1.0])]
    for row in rows:
        spark.createDataFrame([row], schema).write.mode("append").json(asked)
        stream = spark.readStream.schema(schema).json(asked)
        search_stream(stream, words, index, out, str(tmp_path / "state"), k=3).awaitTermination()
    want = search(spark.createDataFrame(rows, schema), words, index, k=3)
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_log_schema(spark):
    assert spark.createDataFrame([], LOG_SCHEMA).select(F.col("timestamp")).dtypes == [("timestamp", "timestamp")]


def test_ingest_stream_passes_over_batches_it_holds(spark, tmp_path):
    """Three files, a batch each; with its checkpoint lost the stream sends them again."""
    from tablewright.sources.store import index_version, loaded_batch, read_index

    landed, root = str(tmp_path / "landed"), str(tmp_path / "index")
    schema = "dashboard_id string, dashboard_title string, element_id string, element_title string, sql string, source string"
    for n in range(3):
        rows = [("d", "Board", f"e{k}", f"Chart {k} of file {n}", f"SELECT {k}", "looker") for k in range(n, n + 3)] + [("d", "Board", f"bad{n}", "bad", "SELECT 0", "looker")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(landed)
    asked = tmp_path / "asked"
    asked.write_text("")

    def model(texts):
        with open(asked, "a") as f:
            f.write("x" * len(texts))
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    def run(checkpoint, now):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(landed)
        ingest_stream(stream, root, str(tmp_path / checkpoint), model, now, failed_path=str(tmp_path / "failed")).awaitTermination()
        return {r.id: (r.description, r.updated_at) for r in read_index(spark, root).collect()}

    first = run("state", datetime(2024, 1, 1))
    assert len(first) == 5 and loaded_batch(index_version(spark, root), "charts") == 2
    assert spark.read.parquet(str(tmp_path / "failed")).groupBy("batch").count().count() == 3
    calls = asked.read_text()
    assert run("lost", datetime(2024, 2, 2)) == first and asked.read_text() == calls
    spark.createDataFrame([("d", "Board", "e9", "New", "SELECT 9", "looker")], schema).coalesce(1).write.mode("append").json(landed)
    assert len(run("state", datetime(2024, 3, 3))) == 6
