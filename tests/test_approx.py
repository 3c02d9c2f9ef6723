import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tablewright.operators.approx as approx
from tablewright.operators.approx import Plan, build_tables, probe_codes, read_plan, topk_approx
from tablewright.operators.topk import topk_join
from tests.test_topk import fixture, plain_topk


def clustered(seed, n, size=24, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, size))
    return centres[rng.integers(0, groups, n)] + 0.35 * rng.standard_normal((n, size))


def frame(spark, rows, key):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} long, embedding array<double>")


def hits(df):
    return {(r["query_id"], r["id"]): r["similarity"] for r in df.collect()}


def test_probes_come_from_the_likeliest_on():
    rng = np.random.default_rng(1)
    margins = rng.standard_normal((20, 2, 5))
    codes = probe_codes(margins, 32)
    assert all(sorted(c) == list(range(32)) for c in codes.reshape(-1, 32).tolist())
    assert (codes[:, :, 0] == (margins > 0) @ (1 << np.arange(5))).all()
    for row, table in np.ndindex(20, 2):
        own, cost = codes[row, table, 0], margins[row, table] ** 2
        spent = [sum(c for k, c in enumerate(cost) if (own ^ code) >> k & 1) for code in codes[row, table]]
        assert spent == sorted(spent)


def test_recall_against_the_exact_join_and_share_of_vectors_read(spark, tmp_path):
    rows = clustered(3, 6000)
    index, queries = frame(spark, rows, "id"), frame(spark, clustered(3, 200) + 0.01, "query_id")
    plan = build_tables(index, str(tmp_path / "t"), k=10, threshold=0.3, bucket_rows=100)
    assert plan.vectors == 6000 and plan.bits == 6 and plan == read_plan(spark, str(tmp_path / "t"))
    true, got = hits(topk_join(queries, index, 10, 0.3)), hits(topk_approx(queries, str(tmp_path / "t"), 10, 0.3))
    assert len(set(true) & set(got)) >= 0.9 * len(true) and plan.recall >= 0.95
    assert all(got[pair] == true[pair] for pair in set(true) & set(got))
    assert plan.probes < 1 << plan.bits


def test_all_rows_stand_in_every_table(spark, tmp_path):
    rows = clustered(5, 500)
    plan = build_tables(frame(spark, rows, "id"), str(tmp_path / "t"), bucket_rows=10, tables=3)
    held = spark.read.parquet(str(tmp_path / "t/vectors"))
    assert held.groupBy("key").count().where("count = 3").count() == 500 and plan.tables == 3


@pytest.mark.parametrize("slice_bytes", [32 << 20, 64])
def test_all_buckets_give_the_exact_hits(spark, tmp_path, monkeypatch, slice_bytes):
    """Copies, ties, zero, empty and shorter vectors; a hot bucket in many slices."""
    monkeypatch.setattr(approx, "SLICE_BYTES", slice_bytes)
    queries, index = fixture(4)
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    held = spark.createDataFrame(index, "id string, embedding array<double>")
    build_tables(held, str(tmp_path / "t"), k=4, threshold=0.1, bucket_rows=8)
    got = topk_approx(asked, str(tmp_path / "t"), probes=1 << 10)
    want = plain_topk(queries, index, 4, 0.1)
    assert sorted(tuple(r) for r in got.collect()) == want
    gone = held.select("id").limit(30)
    names = {r.id for r in gone.collect()}
    got = topk_approx(asked, str(tmp_path / "t"), probes=1 << 10, without=gone)
    assert sorted(tuple(r) for r in got.collect()) == plain_topk(queries, [r for r in index if r[0] not in names], 4, 0.1)
    with pytest.raises(ValueError):
        topk_approx(asked, str(tmp_path / "t"), threshold=0.0)


def test_odd_rows_and_nothing(spark, tmp_path):
    schema = "id string, embedding array<double>"
    odd = spark.createDataFrame([("a", None), ("b", []), ("c", [0.0, 0.0]), (None, [1.0, 0.0]), ("d", [None, 1.0]), ("e", [1.0])], schema)
    plan = build_tables(odd, str(tmp_path / "odd"))
    asked = spark.createDataFrame([(1, [0.0, 2.0]), (2, [3.0]), (3, None), (4, [])], "query_id int, embedding array<double>")
    assert plan.vectors == 2
    assert sorted(tuple(r) for r in topk_approx(asked, str(tmp_path / "odd")).collect()) == [(1, "d", 1.0, 1), (2, "e", 1.0, 1)]
    build_tables(odd.limit(0), str(tmp_path / "none"))
    assert topk_approx(asked, str(tmp_path / "none")).count() == 0
    assert topk_approx(asked.limit(0), str(tmp_path / "odd")).count() == 0


def test_a_plan_below_its_aim_says_so(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(approx, "UNSURE_BITS", 1)
    rng = np.random.default_rng(1)
    plan = build_tables(frame(spark, rng.standard_normal((2000, 16)), "id"), str(tmp_path / "t"), bucket_rows=10, tables=1)
    assert plan.recall < 0.95 and plan.probes == 2 and isinstance(plan, Plan)


def test_vectors_are_not_multiplied_by_queries(spark, tmp_path):
    index = frame(spark, clustered(7, 1000), "id")
    build_tables(index, str(tmp_path / "t"), bucket_rows=50)
    assert spark.read.parquet(str(tmp_path / "t/vectors")).count() == 2000
    cells = spark.read.parquet(str(tmp_path / "t/cells"))
    assert cells.agg(F.sum("rows")).first()[0] == 2000


def test_all_buckets_are_more_than_the_unsure_signs_reach(spark, tmp_path, monkeypatch):
    """With more signs than are turned, all buckets still hold every hit."""
    monkeypatch.setattr(approx, "UNSURE_BITS", 1)
    rows = clustered(7, 800)
    index, queries = frame(spark, rows, "id"), frame(spark, rows[:50], "query_id")
    plan = build_tables(index, str(tmp_path / "t"), bucket_rows=20)
    assert plan.bits > 1
    exact, got = topk_join(queries, index), topk_approx(queries, str(tmp_path / "t"), probes=1 << 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))


def test_copies_of_queries_are_made_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(approx, "COPY_BYTES", 4000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([[float(n), 1.0] for n in range(20)])], names=["key", "vector"])
    codes = np.arange(20 * 2 * 3).reshape(20, 2, 3)
    parts = list(approx._copies(batch, np.arange(20), codes, 2))
    assert len(parts) > 1 and all(p.num_rows * 80 <= 4000 for p in parts)
    found = pa.Table.from_batches(parts).to_pylist()
    assert [(r["key"], r["tab"], r["place"], r["code"]) for r in found] == [(n, t, p, codes[n, t, p]) for n in range(20) for t in range(2) for p in range(3)]
