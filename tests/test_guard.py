import json
import os

import pytest
from pyspark.errors import AnalysisException, ParseException

from tablewright.operators.guard import assert_read_only, run_sql, safe_sql
from tablewright.sources.query_log import query_log_stats, read_query_log


@pytest.fixture(autouse=True)
def numbers(spark):
    spark.range(20).createOrReplaceTempView("numbers")


REFUSED = [
    "INSERT INTO numbers VALUES (1)", "update numbers set id = 1", "DELETE FROM numbers", "DROP VIEW numbers",
    "ALTER VIEW numbers RENAME TO x", "TRUNCATE TABLE numbers", "CREATE TABLE made USING parquet AS SELECT 1 AS a",
    "MERGE INTO numbers USING numbers s ON true WHEN MATCHED THEN DELETE", "REPLACE TABLE x AS SELECT 1",
    "-- note\nDROP VIEW numbers", "/* a\nb */ DROP VIEW numbers",
    "WITH a AS (SELECT 1 AS id) INSERT INTO numbers SELECT * FROM a", "SET spark.x=1", "USE default", "CLEAR CACHE",
    "CACHE TABLE numbers", "FROM numbers INSERT INTO numbers SELECT id", "REFRESH TABLE numbers", "ADD JAR x", "",
]


@pytest.mark.parametrize("query", REFUSED)
def test_refused(spark, query):
    with pytest.raises((ValueError, ParseException)):
        safe_sql(spark, query)
    assert spark.catalog.tableExists("numbers")


@pytest.mark.parametrize("query", [q for q in REFUSED if q.strip()])
def test_refused_as_value_error(spark, query):
    with pytest.raises(ValueError):
        assert_read_only(spark, query)


def test_two_statements(spark):
    with pytest.raises(ParseException):
        safe_sql(spark, "SELECT 1; DROP VIEW numbers")
    with pytest.raises(ParseException):
        safe_sql(spark, "SELECT 1) t; DROP VIEW numbers --")
    with pytest.raises((ValueError, ParseException)):
        safe_sql(spark, "BEGIN DROP VIEW numbers; END")
    with pytest.raises(ParseException):
        safe_sql(spark, "SELECT 1), other AS (SELECT 2")
    assert spark.catalog.tableExists("numbers")


HOSTILE = [
    "SELECT 1 AS x) INSERT INTO target WITH g AS (SELECT 1",
    "SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{folder}' USING parquet WITH g AS (SELECT 1",
    "-- \\\nSHOW\nINSERT INTO target VALUES (1)",
    "-- a\rSHOW TABLES\rINSERT INTO target VALUES (1)",
    "/* a /* b */ SHOW TABLES */ INSERT INTO target VALUES (1)",
    "EXECUTE IMMEDIATE 'INSERT INTO target VALUES (1)'",
    "WITH a AS (SELECT 1) FROM a INSERT INTO target SELECT * INSERT OVERWRITE target SELECT *",
    "INSERT OVERWRITE DIRECTORY '{folder}' USING parquet SELECT 1 AS x",
    "CALL system.some_procedure()",
]


@pytest.mark.parametrize("query", HOSTILE)
def test_crafted_writes_change_nothing(spark, tmp_path, query):
    target, folder = str(tmp_path / "target"), tmp_path / "folder"
    spark.createDataFrame([(7,)], "x int").write.parquet(target)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW target (x INT) USING parquet OPTIONS (path '%s')" % target)
    for read in (safe_sql, run_sql, assert_read_only):
        with pytest.raises((ValueError, ParseException)):
            read(spark, query.format(folder=folder))
    assert [r.x for r in spark.read.parquet(target).collect()] == [7] and not folder.exists()


def test_bad_text_and_missing_table(spark):
    with pytest.raises(ParseException):
        safe_sql(spark, "SELEC 1")
    with pytest.raises(AnalysisException):
        safe_sql(spark, "SELECT * FROM no_such_table")


@pytest.mark.parametrize(
    "query,rows",
    [
        ("SELECT * FROM numbers", 5), ("SELECT * FROM numbers;", 5), ("SELECT * FROM numbers LIMIT 9", 9),
        ("SELECT * FROM numbers LIMIT 9 OFFSET 15", 5), ("SELECT * FROM numbers OFFSET 2", 5),
        ("SELECT * FROM (SELECT * FROM numbers LIMIT 12)", 5), ("SELECT *, 'limit' AS a FROM numbers -- LIMIT 3", 5),
        ("WITH a AS (SELECT * FROM numbers) SELECT * FROM a LIMIT 11", 11),
        ("WITH a AS (SELECT * FROM numbers LIMIT 11) SELECT * FROM a", 5),
        ("SELECT id FROM numbers UNION ALL SELECT id FROM numbers LIMIT 30", 30), ("VALUES (1), (2)", 2),
        ("FROM numbers SELECT id", 5), ("TABLE numbers", 5),
    ],
)
def test_cap(spark, query, rows):
    assert safe_sql(spark, query, 5).count() == rows


def test_read_commands(spark):
    assert safe_sql(spark, "SHOW TABLES").count() >= 1
    assert safe_sql(spark, "DESCRIBE numbers").first()["col_name"] == "id"
    assert "plan" in safe_sql(spark, "EXPLAIN DROP VIEW numbers").columns
    assert spark.catalog.tableExists("numbers")


def test_order_is_kept(spark):
    got = safe_sql(spark, "SELECT id FROM numbers ORDER BY id DESC", 3)
    assert [r["id"] for r in got.collect()] == [19, 18, 17]


def test_run_and_log(spark, tmp_path):
    log = str(tmp_path / "log")
    run = run_sql(spark, " SELECT id FROM numbers ORDER BY id DESC ", 20, log)
    assert (run.rows, run.truncated) == (20, False)
    run = run_sql(spark, "SELECT id FROM numbers ORDER BY id DESC", 19, log)
    assert (run.rows, run.truncated, run.frame.count(), run.frame.first()["id"]) == (19, True, 19, 19)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty() and os.path.isdir(run.folder)
    run.release()
    assert not os.path.exists(run.folder)
    run = run_sql(spark, "SELECT id FROM numbers LIMIT 20", 5, log)
    assert (run.rows, run.truncated) == (20, False)
    with pytest.raises(ValueError):
        run_sql(spark, "DROP VIEW numbers", 5, log)
    rows = read_query_log(spark, log).collect()
    assert sorted(r["rows"] for r in rows) == [19, 20, 20]
    assert all(r["query"] == r["query"].strip() and r["elapsed_ms"] == round(r["elapsed_ms"], 1) for r in rows)
    names = [n for n in os.listdir(log) if n.endswith(".json")]
    line = json.loads(open(os.path.join(log, names[0])).readline())
    assert set(line) == {"timestamp", "query", "rows", "elapsed_ms"}
    stats = query_log_stats(read_query_log(spark, log)).first()
    assert (stats["first_word"], stats["runs"], stats["rows"]) == ("SELECT", 3, 59)


def test_log_failure_never_fails_the_query(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("x")
    assert run_sql(spark, "SELECT 1 AS a", 5, str(blocked / "log")).rows == 1


def test_a_whole_result_is_written_and_not_held(spark):
    run = run_sql(spark, "SELECT id, id AS id, NULL AS nothing, array() AS none, make_interval(1, 2) AS span FROM numbers ORDER BY id DESC", None)
    assert (run.rows, run.truncated) == (20, False) and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert run.frame.columns == ["id", "id", "nothing", "none", "span"]
    rows = run.frame.selectExpr("*").drop("span").collect()
    assert [r[0] for r in rows] == list(range(19, -1, -1)) and {r[2] for r in rows} == {None}
    assert run_sql(spark, "SELECT id FROM numbers WHERE id < 0", None).rows == 0
    wide = run_sql(spark, "SELECT id FROM range(0, 5000, 1, 7) ORDER BY id DESC", None)
    assert [r[0] for r in wide.frame.collect()] == list(range(4999, -1, -1))
