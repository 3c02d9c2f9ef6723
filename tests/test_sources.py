from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tablewright.sources.connections import jdbc_url, read_source, source_options
from tablewright.sources.files import read_dictionary, rows_from_json
from tablewright.sources.patterns import (
    PATTERN_SCHEMA, delete_patterns, find_pattern, pattern_records, read_patterns, write_patterns,
)
from tablewright.sources.store import read_table


def test_urls():
    assert jdbc_url({"user": "u", "host": "h", "port": "5432", "database": "d"}) == "jdbc:postgresql://h:5432/d"
    assert jdbc_url({"dialect": "mysql", "host": "h", "database": "d"}) == "jdbc:mysql://h/d"
    assert jdbc_url({"dialect": "sqlite", "database": "/tmp/x.db"}) == "jdbc:sqlite:/tmp/x.db"
    snow = jdbc_url({"dialect": "snowflake", "account": "ab1", "database": "D B", "schema": "S"})
    assert snow == "jdbc:snowflake://ab1.snowflakecomputing.com/?db=D+B&schema=S"
    bricks = jdbc_url({"dialect": "databricks", "host": "h", "http_path": "/sql/1", "database": "cat"})
    assert bricks == "jdbc:databricks://h:443;httpPath=/sql/1;ConnCatalog=cat;AuthMech=3"
    assert jdbc_url({"url": "jdbc:x:y", "dialect": "mysql"}) == "jdbc:x:y"


def test_source_options():
    kind, options = source_options({"user": "u", "password": "p@ss/word", "host": "h", "database": "d", "driver": "org.x"})
    assert (kind, options["user"], options["password"], options["driver"]) == ("jdbc", "u", "p@ss/word", "org.x")
    assert "p@ss" not in options["url"]
    assert "user" not in source_options({"dialect": "sqlite", "database": "x"})[1]
    assert source_options({"dialect": "databricks", "host": "h", "token": "t"})[1]["password"] == "t"
    assert source_options({"dialect": "parquet", "path": "/data"}) == ("parquet", {"path": "/data"})


def test_read_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "numbers"))
    assert read_source(spark, {"dialect": "parquet", "path": str(tmp_path)}, "numbers").count() == 3


def test_dictionary(spark, tmp_path):
    csv = tmp_path / "d.csv"
    csv.write_text("keyword,content\nmrr,one\narr,two\nmrr,three\n")
    got = read_dictionary(spark, str(csv), format="csv").orderBy("keyword")
    assert [tuple(r) for r in got.collect()] == [("arr", "two"), ("mrr", "three")]
    assert read_dictionary(spark, str(csv), "term", "definition", "csv").count() == 0
    assert read_dictionary(spark, str(tmp_path / "none")).columns == ["keyword", "content"]


def test_yaml_dictionary(spark, tmp_path):
    (tmp_path / "words.yaml").write_text("revenue: \"R: sum\"\nchurn: C\n1: null\n")
    got = read_dictionary(spark, str(tmp_path / "words.yaml"), format="yaml").orderBy("keyword")
    assert [tuple(r) for r in got.collect()] == [("1", None), ("churn", "C"), ("revenue", "R: sum")]
    for text in ("- a\n- b\n", "a: [", ""):
        (tmp_path / "bad.yaml").write_text(text)
        assert read_dictionary(spark, str(tmp_path / "bad.yaml"), "term", "definition", "yaml").count() == 0
    assert read_dictionary(spark, str(tmp_path / "none.yaml"), format="yaml").count() == 0


def test_rows_from_json(spark):
    got = rows_from_json(spark, '[{"month": "Jan", "n": 1}, {"month": "Feb", "n": 2, "extra": null}]')
    assert [(r["month"], r["n"]) for r in got.collect()] == [("Jan", 1), ("Feb", 2)]
    with pytest.raises(ValueError):
        rows_from_json(spark, '{"a": 1}')


FILES = {
    "b-full.sql": '---\nquestion: "What is churn?"\ntables: ["subs", "users"]\ndescription: Counts --\nsource: looker\n'
    "created: 2024-01-15\n---\nSELECT 1\nFROM t\n",
    "a-bare.sql": "SELECT 2 -- no header\n",
    "c-open.sql": "---\nquestion: never closed\nSELECT 3",
    "d-block.sql": "---\nquestion: Q\ntables:\n- one\n- two\n---\n\n  SELECT 4  ",
    "e-empty.sql": "---\n---\nSELECT 5",
    "other.txt": "SELECT 6",
}


def test_read_patterns(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    got = {r["filename"]: r for r in read_patterns(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a-bare.sql", "b-full.sql", "c-open.sql", "d-block.sql", "e-empty.sql"]
    full = got["b-full.sql"]
    # The header ends at the first fence after the opening one, also inside a line.
    assert (full["question"], full["tables"], full["source"]) == ("What is churn?", ["subs", "users"], "looker")
    assert (full["description"], full["created"]) == ("Counts --", date(2024, 1, 15))
    assert full["sql"] == "SELECT 1\nFROM t"
    assert got["a-bare.sql"]["sql"] == "SELECT 2 -- no header\n" and got["a-bare.sql"]["source"] == "manual"
    assert got["c-open.sql"]["sql"].startswith("---") and got["c-open.sql"]["question"] == ""
    assert (got["d-block.sql"]["tables"], got["d-block.sql"]["sql"]) == (["one", "two"], "SELECT 4")
    assert (got["e-empty.sql"]["question"], got["e-empty.sql"]["sql"], got["e-empty.sql"]["tables"]) == ("", "SELECT 5", [])


def test_write_patterns(spark, tmp_path):
    root = str(tmp_path / "patterns")
    first = spark.createDataFrame([("What is churn?", "SELECT 1", 1), ("what is CHURN", "SELECT 2", 2)], "question string, sql string, n int")
    assert write_patterns(first, root, date(2024, 1, 1), "n") == 1
    more = spark.createDataFrame([("What is churn!", "SELECT 3", ["t"]), ("Other", "SELECT 4", None)], "question string, sql string, tables array<string>")
    write_patterns(more, root, date(2024, 1, 2))
    saved = read_table(spark, root, PATTERN_SCHEMA)
    got = {r["filename"]: r for r in saved.collect()}
    assert {k: v["sql"] for k, v in got.items()} == {"what-is-churn.sql": "SELECT 3", "other.sql": "SELECT 4"}
    assert got["other.sql"]["tables"] == [] and got["other.sql"]["created"] == date(2024, 1, 2)
    asked = spark.createDataFrame([("WHAT is churn",), ("none",)], "question string")
    assert [r["sql"] for r in find_pattern(saved, asked).collect()] == ["SELECT 3"]
    index = saved.select(F.col("filename").alias("id"), "question")
    kept, kept_index = delete_patterns(saved, index, spark.createDataFrame([("other.sql",)], "filename string"))
    assert [r["filename"] for r in kept.collect()] == ["what-is-churn.sql"]
    assert [r["id"] for r in kept_index.collect()] == ["what-is-churn.sql"]


def test_pattern_defaults(spark):
    rows = spark.createDataFrame([("!!!", "SELECT 1")], "question string, sql string")
    got = pattern_records(rows, datetime(2024, 1, 1).date()).first()
    assert (got["filename"], got["description"], got["source"], got["tables"]) == ("file.sql", "", "manual", [])


def test_headers_are_read_by_the_parser_in_c(monkeypatch):
    """Where there is one; the same fields either way."""
    import yaml

    from tablewright.sources import patterns as module

    text = "question: 'What of x?'\ntables: [a, 'b']\ncreated: 2024-01-05\nsource:\n"
    want = ("What of x?", ["a", "b"], "", "", "2024-01-05")
    assert module._header_row(text) == want
    if yaml.__with_libyaml__:
        with monkeypatch.context() as m:
            m.setattr(yaml, "SafeLoader", None)
            assert module._header_row(text) == want
    monkeypatch.delattr(yaml, "CSafeLoader", raising=False)
    assert module._header_row(text) == want and module._header_row(None) == ("", [], "", "manual", "")
