"""Nothing is cut, dropped or reordered: slots over the cap, long SQL, many files, repeated ids."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tablewright.ingest.charts import lakeview_charts
from tablewright.ingest.load import chart_rows, load
from tablewright.operators.catalog import profile
from tablewright.operators.embed import simplify_sql
from tablewright.operators.index import INDEX_SCHEMA
from tablewright.operators.slots import evaluate_slots
from tablewright.sources.files import read_dashboards, read_dictionary

NOW = datetime(2024, 1, 1)


def test_slots_over_the_cap_are_errors(spark):
    spark.range(7000).createOrReplaceTempView("seven")
    slots = [{"slot": f, "sql": "SELECT id, id FROM seven", "format": f} for f in ("chart", "table", "scalar")]
    rows = {r.slot: r for r in evaluate_slots(spark, slots).collect()}
    assert "more than 5000" in rows["chart"].error and "more than 5000" in rows["table"].error
    assert rows["scalar"].error is None and rows["scalar"].rendered == "0"


def test_long_sql_is_rewritten_and_embedded_whole(spark):
    sql = "SELECT " + ", ".join(f"column_{i}" for i in range(900)) + " FROM t"
    charts = spark.createDataFrame([("d", "Title", "e", "Chart", sql, "looker")], "dashboard_id string, dashboard_title string, element_id string, element_title string, sql string, source string")
    row = chart_rows(charts, lambda s, _: s.replace("SELECT", "select")).first()
    assert row.sql == sql.replace("SELECT", "select") and row.sql in row.embed_text
    kept = chart_rows(charts, lambda s, _: s[:10], rewrite_chars=4000, embed_chars=2000).first()
    assert kept.sql == sql and len(kept.embed_text) < 2300
    assert simplify_sql(charts, lambda s, _: "short", sql_chars=4000).first().sql == sql


def test_files_are_read_in_listing_order(spark, tmp_path):
    for name, lines in (("p1.json", 1), ("p2.json", 501), ("p3.json", 20)):
        (tmp_path / name).write_text("\n".join(f"{name}-{i:04d}" for i in range(lines)))
    rows = read_dashboards(spark, str(tmp_path), whole_files=False).orderBy("position").collect()
    assert [r.payload for r in rows] == sorted(r.payload for r in rows) and rows[0].file_name == "p1.json"
    folder = tmp_path / "dictionary"
    for part, n in enumerate((3, 4000, 1, 900)):
        frame = spark.range(1, numPartitions=1).select(F.lit("x").alias("keyword"), F.lit(f"part {part}").alias("content"))
        frame.union(spark.range(n, numPartitions=1).select(F.concat(F.lit(f"k{part}-"), "id"), F.lit("c"))).coalesce(1).write.parquet(f"{folder}/{part}")
    found = {r.keyword: r.content for r in read_dictionary(spark, f"{folder}/*").collect()}
    assert found["x"] == "part 3" and len(found) == 4905


def test_last_widget_of_an_id_stays(spark):
    def widget(title, dataset):
        return {"widget": {"spec": {"widgetType": "bar", "frame": {"title": title}}, "queries": [{"query": {"datasetName": dataset}}]}}

    sets = [{"name": f"d{i}", "query": f"SELECT {i} AS value FROM some_table"} for i in range(4)]
    pages = [{"layout": [widget("Total", "d0"), widget("Other", "d1")]}, {"layout": [widget("Total", "d2"), widget("Total", "d3")]}]
    boards = spark.createDataFrame([("b", "Board", json.dumps({"datasets": sets, "pages": pages}))], "dashboard_id string, display_name string, serialized string")
    charts = lakeview_charts(boards, place=True).withColumn("source", F.lit("databricks")).repartition(5)
    done = load(chart_rows(charts), spark.createDataFrame([], INDEX_SCHEMA), lambda ts: [[1.0] for _ in ts], NOW)
    rows = {r.description: r.sql for r in done.index.collect()}
    assert rows == {"Total": "SELECT 3 AS value FROM some_table", "Other": "SELECT 1 AS value FROM some_table"}
    assert done.rows.columns == [c for c in done.rows.columns if c != "place"]


def test_profile_of_nested_maps_and_variants(spark):
    frame = spark.sql("SELECT id, struct(parse_json('1') AS v, id AS n) AS s, array(map('a', id)) AS m FROM range(5)")
    rows = {r.column: r for r in profile(frame).collect()}
    assert rows["s"].total_rows == rows["m"].total_rows == 5 and rows["s"].nulls == 0 and rows["s"].distinct is None
    assert rows["id"].distinct == 5


def test_two_writers_lose_nothing(spark, tmp_path):
    import pytest

    from tablewright.operators.index import upsert
    from tablewright.sources.store import LostRace, change_index, read_index, upsert_index

    root = str(tmp_path / "index")

    def rows(*ids):
        return spark.createDataFrame([(i, f"question {i}") for i in ids], "id string, question string")

    upsert_index(rows("a"), root, NOW, parts=2)

    def slow(old):
        upsert_index(rows("b"), root, NOW)  # another writer is faster
        return upsert(old, rows("c"), NOW)

    with pytest.raises(LostRace):
        change_index(spark, root, rows("c"), slow)
    assert {r.id for r in read_index(spark, root).collect()} == {"a", "b"}
    upsert_index(rows("c"), root, NOW)
    assert {r.id for r in read_index(spark, root).collect()} == {"a", "b", "c"}


def test_long_questions_keep_their_own_files(spark):
    from datetime import date

    from tablewright.sources.patterns import find_pattern, pattern_records

    start = "how many orders did we ship to customers in the regions of the north " * 2
    questions = spark.createDataFrame([(start + "in May", "1"), (start + "in June", "2"), ("short one", "3")], "question string, sql string")
    saved = pattern_records(questions, date(2024, 1, 1))
    names = [r.filename for r in saved.orderBy("sql").collect()]
    assert len(set(names)) == 3 and names[2] == "short-one.sql" and names[0][:80] == names[1][:80]
    assert [r.sql for r in find_pattern(saved, questions.where("sql = '2'")).collect()] == ["2"]
