import pytest

from tablewright.operators.embed import HashedTokens
from tablewright.workbench import Workbench

LONG = "SELECT sum(amount) FROM sales WHERE region = 'north' AND year = 2024"


@pytest.fixture
def bench(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", None)], "x string, y int").createOrReplaceTempView("bench_rows")
    return Workbench(spark, str(tmp_path / "bench"), HashedTokens(64))


def test_sql_and_catalog(bench):
    assert bench.sql("SELECT * FROM bench_rows", 1).truncated
    with pytest.raises(ValueError):
        bench.sql("DROP VIEW bench_rows")
    assert bench.log().count() == 1
    assert "bench_rows" in [r["table"] for r in bench.tables().collect()]
    assert [r["column"] for r in bench.describe("bench_rows").collect()] == ["x", "y"]
    assert {r["column"]: r["nulls"] for r in bench.profile("bench_rows").collect()} == {"x": 0, "y": 1}
    assert bench.slots([{"slot": "n", "sql": "SELECT count(*) FROM bench_rows"}]).first()["rendered"] == "2"


def test_dictionaries(bench):
    bench.add_keyword("revenue", "R")
    bench.add_keyword("churn", "C")
    bench.add_keyword("revenue", "R2")
    assert [tuple(r) for r in bench.keywords().collect()] == [("churn", "C"), ("revenue", "R2")]
    assert bench.remove_keyword("churn") and not bench.remove_keyword("churn")
    bench.define("ARR", "Annual recurring revenue")
    assert [r["term"] for r in bench.search_terms("recurring").collect()] == ["ARR"]
    assert bench.undefine("ARR") and not bench.undefine("ARR")


def test_patterns_and_search(bench):
    saved = bench.save_pattern("What is monthly churn?", "SELECT 1", ["subs"], "churn by month").first()
    assert saved["filename"] == "what-is-monthly-churn.sql"
    bench.save_pattern("Revenue by region", "SELECT 2")
    bench.add_keyword("churn", "Use canceled_at")
    hits = bench.search("monthly churn by month", k=2).collect()
    assert [(r["keyword_match"], r["question"]) for r in hits] == [("churn", ""), (None, "What is monthly churn?")]
    many = bench.search(["revenue by region", "zzz"], k=1, threshold=0.5).collect()
    assert [(r["query_id"], r["question"]) for r in many] == [(0, "Revenue by region")]
    bench.edit_vector("revenue-by-region.sql", "Renamed", source="edited")
    row = bench.index().where("id = 'revenue-by-region.sql'").first()
    assert (row["question"], row["source"], len(row["embedding"])) == ("Renamed", "edited", 64)
    counts = {(r["kind"], r["source"]): r["rows"] for r in bench.stats().collect()}
    assert counts[("patterns", None)] == 2 and counts[("vectors", None)] == 2 and counts[("keywords", None)] == 1
    total = {r["source"]: r["updated"] for r in bench.rebuild().counters.collect()}
    assert total[None] == 2
    assert bench.delete_pattern("revenue-by-region.sql") and not bench.delete_pattern("revenue-by-region.sql")
    assert [r["id"] for r in bench.index().collect()] == ["what-is-monthly-churn.sql"]
    assert bench.delete_vector("what-is-monthly-churn.sql") and not bench.delete_vector("what-is-monthly-churn.sql")


def test_without_embedder(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "plain"))
    bench.save_pattern("Q", "SELECT 1")
    bench.add_keyword("q", "K")
    assert [r["keyword_match"] for r in bench.search("a q").collect()] == ["q"]
    assert bench.index().count() == 0
    with pytest.raises(ValueError):
        bench.rebuild()


def test_ingest(spark, bench):
    charts = spark.createDataFrame(
        [("d", "Sales", "1", "Total Revenue", LONG), ("d", "Sales", "2", "Orders by day", LONG)],
        "dashboard_id string, dashboard_title string, element_id string, element_title string, sql string")
    tables = {"bench_rows": spark.table("bench_rows")}
    dry = bench.ingest({"looker": charts}, dry_run=True)
    assert {r["source"]: r["skipped"] for r in dry.counters.collect()} == {"looker": 2, None: 2}
    assert bench.index().count() == 0
    done = bench.ingest({"looker": charts, "redash": charts}, tables=tables)
    assert {r["source"]: r["created"] for r in done.counters.collect()} == {"looker": 2, "warehouse": 1, None: 3}
    again = bench.ingest({"looker": charts}, ["looker"], skip_existing=True)
    assert {r["source"]: r["skipped"] for r in again.counters.collect()} == {"looker": 2, None: 2}
    assert bench.search("total revenue sales", k=1).first()["dashboard"] == "Sales"
    with pytest.raises(ValueError):
        bench.ingest({"looker": charts}, ["nope"])


def test_snapshots(spark, bench):
    bench.checkpoint("before pivot", {"t": spark.range(3)})
    assert [r["name"] for r in bench.checkpoints().collect()] == ["before_pivot"]
    assert bench.rollback()["t"].count() == 3
