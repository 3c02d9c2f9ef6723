import random

import numpy as np
import pytest

from tablewright.operators import charts, quantiles
from tablewright.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("seed,bound", [(1, 32 << 20), (2, 0)])
def test_exact_quantiles(spark, seed, bound, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_BYTES", bound)
    rng = random.Random(seed)
    groups = {
        "hot": [rng.gauss(0, 100) for _ in range(20000)],
        "one value": [5.0] * 3000 + [6.0],
        "few": [1.0, 2.0, 10.0],
        "single": [7.5],
        "copies": [float(rng.randint(0, 3)) for _ in range(4000)],
        None: [float(n) for n in range(1000)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("nothing", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: (r["n"], r["quantiles"]) for r in exact_quantiles(df, "g", "v", points).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == len(values)
        assert got[g][1] == pytest.approx(list(np.quantile(values, points)))


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_box(spark, bound, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_BYTES", bound)
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 1.0)], "x string, y double")
    got = {r["x"]: r for r in charts.box(df, "x", "y").collect()}
    a = got["a"]
    assert (a["q1"], a["median"], a["q3"], a["whisker_low"], a["whisker_high"], a["outliers"]) == (2, 3, 4, 1, 4, 1)
    assert got["b"]["outliers"] == 0 and got["b"]["median"] == 1.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 9.99, 10, 10]] + [(None,)], "x double")
    got = {r["bin"]: r["rows"] for r in charts.histogram(df, "x", 10).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 3}
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r["bin"], r["rows"]) for r in charts.histogram(same, "x", 5).collect()] == [(1, 2)]


def test_heatmap_mixed(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 10.0), ("b", None)], "x string, y double")
    got = sorted(tuple(r) for r in charts.heatmap(df, "x", "y", 2).collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("b", 2, 1)]


def test_multi_series_and_series(spark):
    df = spark.createDataFrame([("Jan", 1, 10), ("Feb", 2, 20)], "month string, revenue int, costs int")
    got = sorted(tuple(r) for r in charts.multi_series(df, "month", ["revenue", "costs"]).collect())
    assert got == [("Feb", "costs", 20.0), ("Feb", "revenue", 2.0), ("Jan", "costs", 10.0), ("Jan", "revenue", 1.0)]
    assert [r["x"] for r in charts.series(df, "month", "revenue").collect()] == ["Feb", "Jan"]
    shares = {r["name"]: r["share"] for r in charts.pie(df, "month", "costs").collect()}
    assert shares == pytest.approx({"Jan": 1 / 3, "Feb": 2 / 3})


def test_chart_data(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("b", 3, 30)], "m string, r int, c int")
    columns = {
        ("bar", "r"): ["x", "y"], ("line", "r, c"): ["x", "series", "y"], ("bar", ("r", "c")): ["x", "series", "y"],
        ("scatter", "r,c"): ["x", "y"], ("pie", "r"): ["name", "total", "share"], ("pie", None): ["name", "total", "share"],
        ("heatmap", "r"): ["x_bin", "y_bin", "rows"], ("histogram", None): ["bin", "rows"],
        ("box", "c"): ["x", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers"],
    }
    for (kind, y), want in columns.items():
        got = charts.chart_data(df, "m", list(y) if isinstance(y, tuple) else y, kind)
        assert got.columns == want and got.count() > 0
    counted = {r["name"]: r["share"] for r in charts.chart_data(df, "m", kind="pie").collect()}
    assert counted == pytest.approx({"a": 1 / 3, "b": 2 / 3})
    with pytest.raises(ValueError):
        charts.chart_data(df, "m")
