from datetime import date, datetime
from decimal import Decimal

import tablewright.operators.catalog as catalog
from pyspark.sql import functions as F

from tablewright.operators.catalog import (
    column_sketches, describe, list_all_tables, list_tables, merged_profile, profile, profile_all, profile_approx,
    profile_isolated, table_docs,
)

SCHEMA = (
    "`odd name` int, txt string, d date, ts timestamp, num decimal(10,2), f double, arr array<int>, "
    "m map<string,int>, b boolean, bin binary"
)
ROWS = [
    (1, "a", date(2024, 1, 1), datetime(2024, 1, 1, 1), Decimal("1.50"), 0.5, [1], {"k": 1}, True, b"x"),
    (None, "a" * 100, date(2024, 1, 2), None, Decimal("2.50"), 1e7, [1], None, False, b"x"),
    (1, "a" * 100 + "b", None, None, None, None, [2, 3], {"k": 2}, None, None),
    (7, None, None, None, None, None, None, None, None, None),
]


def expected():
    return {
        "odd name": ("INT", 4, 1, 25.0, 2, "1", "7"),
        "txt": ("STRING", 4, 1, 25.0, 3, None, None),
        "d": ("DATE", 4, 2, 50.0, 2, "2024-01-01", "2024-01-02"),
        "ts": ("TIMESTAMP", 4, 3, 75.0, 1, "2024-01-01 01:00:00", "2024-01-01 01:00:00"),
        "num": ("DECIMAL(10,2)", 4, 2, 50.0, 2, "1.50", "2.50"),
        "f": ("DOUBLE", 4, 2, 50.0, 2, "0.5", "10000000.0"),
        "arr": ("ARRAY<INT>", 4, 1, 25.0, 2, None, None),
        "m": ("MAP<STRING,INT>", 4, 2, 50.0, None, None, None),
        "b": ("BOOLEAN", 4, 2, 50.0, 2, None, None),
        "bin": ("BINARY", 4, 2, 50.0, 1, None, None),
    }


def test_profile(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {r[0]: tuple(r[1:]) for r in profile(df).collect()} == expected()
    assert {r[0]: tuple(r[1:]) for r in profile_approx(df).collect()} == expected()


def test_profile_empty(spark):
    df = spark.createDataFrame([], "a int, m map<string,int>")
    want = {("a", "INT", 0, 0, 0.0, 0, None, None), ("m", "MAP<STRING,INT>", 0, 0, 0.0, None, None, None)}
    assert {tuple(r) for r in profile(df).collect()} == want
    assert {tuple(r) for r in profile_approx(df).collect()} == want


def test_describe(spark):
    df = spark.createDataFrame(
        [(3, "c", True, 1.0), (1, None, None, 1e8), (2, "b", False, 0.5), (0, "z", True, None)],
        "k int not null, v string, b boolean, f double",
    )
    got = [tuple(r) for r in describe(df, ["k"]).collect()]
    assert got == [
        ("k", "int", False, "0, 1, 2"), ("v", "string", True, "z, b"), ("b", "boolean", True, "True, False"),
        ("f", "double", True, "100000000.0, 0.5"),
    ]
    empty = [tuple(r) for r in describe(df.limit(0)).collect()]
    assert [r[0] for r in empty] == ["k", "v", "b", "f"] and {r[3] for r in empty} == {""}


def test_listing(spark):
    spark.range(1).createOrReplaceTempView("zz_listed")
    spark.sql("CREATE DATABASE IF NOT EXISTS listed_db")
    assert "zz_listed" in [r["table"] for r in list_tables(spark).collect()]
    assert list_tables(spark, "listed_db").where("table <> 'zz_listed'").count() >= 0
    names = [r["table"] for r in list_all_tables(spark).collect()]
    assert names == sorted(names) and not any(n.startswith("information_schema") for n in names)
    spark.sql("DROP DATABASE listed_db")


def test_table_docs(spark):
    import hashlib

    df = spark.createDataFrame([], "b int not null, a string")
    got = table_docs(spark, {"orders": df}).first()
    digest = hashlib.sha256(b"warehouse:schema:orders").hexdigest()[:16]
    assert got["id"] == f"wh-{digest}"
    assert got["question"] == "What data is in the orders table?"
    assert got["description"] == "Table: orders\nColumns:\n  - b (int, not null)\n  - a (string, nullable)"


EDGES = [
    (0.0, float("nan"), datetime(1, 1, 1), date(9999, 12, 31), Decimal("-0.5"), -5, {"a": None, "b": datetime(2020, 1, 1, 0, 0, 0, 1)}, datetime(2024, 3, 31, 2, 30), 1.5),
    (-0.0, 1.0, datetime(2024, 1, 1, 0, 0, 0, 7), date(1, 1, 1), Decimal("10.0"), 10, {"a": None, "b": datetime(2020, 1, 1, 0, 0, 0, 2)}, None, 0.1),
    (None, None, None, None, None, 9, None, datetime(1900, 1, 1), None),
]
EDGE_SCHEMA = "z double, n double, t timestamp, d date, c decimal(20,1), i smallint, s struct<a:int,b:timestamp>, w timestamp_ntz, f float"


def test_profile_of_odd_values(spark):
    """Equal zeros, not-a-number, microseconds, negative numbers as numbers, nested values, small floats."""
    df = spark.createDataFrame(EDGES, EDGE_SCHEMA)
    rows = {r.column: (r.nulls, r.distinct, r.min, r.max) for r in profile(df).collect()}
    assert rows == {
        "z": (1, 1, "0.0", "0.0"), "n": (1, 2, "1.0", "nan"), "d": (1, 2, "0001-01-01", "9999-12-31"),
        "t": (1, 2, "0001-01-01 00:00:00", "2024-01-01 00:00:00.000007"), "c": (1, 2, "-0.5", "10.0"), "i": (0, 3, "-5", "10"),
        "s": (1, 2, None, None), "w": (1, 2, "1900-01-01 00:00:00", "2024-03-31 02:30:00"), "f": (1, 2, "0.1", "1.5"),
    }
    sketched = merged_profile(column_sketches(df, F.col("i")), df.schema)
    assert [tuple(r) for r in sketched.collect()] == [tuple(r) for r in profile(df).collect()]


def test_a_derived_input_runs_once_and_wide_frames_by_groups(spark, tmp_path):
    marks = tmp_path / "seen"
    marks.write_text("")

    @F.udf("int")
    def seen(x):
        with open(marks, "a") as f:
            f.write("x")
        return x

    once = spark.range(40, numPartitions=2).select(seen("id").alias("a"), F.col("id").alias("b"))
    assert [(r.column, r.distinct) for r in profile(once).collect()] == [("a", 40), ("b", 40)]
    assert len(marks.read_text()) == 40
    wide = once.select("*", *[(F.col("b") % (i + 1)).alias(f"m{i}") for i in range(10)])
    marks.write_text("")
    got = profile(wide, group=5).collect()
    assert [(r.column, r.distinct) for r in got] == [("a", 40), ("b", 40)] + [(f"m{i}", i + 1) for i in range(10)]
    assert len(marks.read_text()) == 40


def test_many_columns_and_tables_have_plans_of_bounded_size(spark, monkeypatch):
    seen = []
    real = catalog._written

    def written(df):
        seen.append(len(df._jdf.queryExecution().analyzed().toString()))
        return real(df)

    monkeypatch.setattr(catalog, "_written", written)
    df = spark.range(5).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(300)])
    assert [r.distinct for r in profile(df, group=100).collect()] == [5] * 300
    small = spark.range(3)
    seen.clear()
    assert profile_all({f"t{i}": small for i in range(7)}, plans=3).count() == 7 and len(seen) == 3


def test_failing_columns_are_told_and_others_profiled(spark):
    texts = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    df = texts.select("t", *[F.col("t").cast("int").alias(f"bad{i}") if i in (3, 11) else F.lit(i).alias(f"c{i}") for i in range(16)])
    rows = profile_isolated(df, group=6).collect()
    assert [r.column for r in rows] == df.columns
    bad = {r.column: (r.error, r.total_rows, r.distinct, r.type) for r in rows if r.error}
    assert bad == {f"bad{i}": ("CAST_INVALID_INPUT", None, None, "INT") for i in (3, 11)}
    assert all((r.total_rows, r.null_pct) == (3, 33.3 if r.column == "t" else 0.0) for r in rows if not r.error)
    assert profile_isolated(df.select("t")).drop("error").collect() == profile(df.select("t")).collect()


def test_sketches_merge_within_their_error(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 997).cast("string").alias("s"), F.expr("map(id, 1)").alias("m"))
    exact = {r.column: r.distinct for r in profile(df).collect()}
    stored = column_sketches(df.where("id < 25000"), F.col("id") % 7).unionByName(column_sketches(df.where("id >= 20000"), F.lit(9).cast("bigint")))
    got = {r.column: r for r in merged_profile(stored, df.schema).collect()}
    assert all(abs(got[c].distinct - exact[c]) <= 0.04 * exact[c] for c in ("id", "s")) and got["m"].distinct is None
    assert got["id"].total_rows == 45_000 and (got["id"].min, got["id"].max) == ("0", "39999")
    assert merged_profile(stored.limit(0), df.schema).count() == 0
