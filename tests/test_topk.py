import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tablewright.operators.topk as topk_module
from tablewright.functions.vectors import cosine
from tablewright.operators.topk import topk, topk_join

PAIRS = [
    ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1.0),
    ([1.0, 0.0], [0.0, 1.0], 0.0),
    ([1.0, 0.0], [-1.0, 0.0], -1.0),
    ([1.0, 2.0], [1.0, 2.0, 3.0], 0.0),
    ([0.0, 0.0], [1.0, 2.0], 0.0),
    ([3.0, 4.0], [4.0, 3.0], 24 / 25),
]


def plain_cosine(a, b):
    if len(a) != len(b):
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def plain_topk(queries, index, k, threshold):
    out = []
    for qid, q in queries:
        found = [(round(plain_cosine(q, v), 4), i) for i, v in index if v and plain_cosine(q, v) >= threshold]
        found.sort(key=lambda r: (-r[0], r[1]))
        out += [(qid, i, s, n) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_cosine(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i int, a array<double>, b array<double>")
    got = [r[0] for r in df.orderBy("i").select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([p[2] for p in PAIRS])


def fixture(seed):
    """Copies, ties, zero, empty, missing and shorter vectors, a third of them one hot copy."""
    rng = random.Random(seed)

    def vector():
        kind = rng.random()
        if kind < 0.33:
            return [1.0, 2.0, 3.0, 4.0]
        if kind < 0.4:
            return [0.0] * 4
        if kind < 0.45:
            return []
        if kind < 0.55:
            return [rng.random() for _ in range(3)]
        return [float(rng.randint(-3, 3)) for _ in range(4)]

    index = [(f"i{n:03d}", vector()) for n in range(300)]
    queries = [(n, vector() or [1.0]) for n in range(40)]
    return queries, index


@pytest.mark.parametrize("seed,k,threshold", [(1, 5, 0.3), (2, 3, -1.0), (3, 50, 0.0), (4, 1, 0.999)])
@pytest.mark.parametrize("form", ["queries", "index", "blocks"])
def test_topk_join_against_brute_force(spark, seed, k, threshold, form, monkeypatch):
    queries, index = fixture(seed)
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>").repartition(3)
    i = spark.createDataFrame(index + [("none", None)], "id string, embedding array<double>").repartition(5)
    bound = {"queries": 1 << 20, "index": 1 << 20, "blocks": 1500}[form]
    if form == "index":
        real = topk_module._bytes
        monkeypatch.setattr(topk_module, "_bytes", lambda df, b: b + 1 if df.schema["key"].dataType.simpleString() == "int" else real(df, b))
    got = topk_join(q, i, k, threshold, broadcast_bytes=bound)
    rows = sorted(tuple(r) for r in got.select("query_id", "id", "similarity", "rank").collect())
    assert rows == plain_topk(queries, index, k, threshold)


def test_small_tiles(monkeypatch):
    """Batches and tiles cut to a few cells, as large ones are."""
    monkeypatch.setattr(topk_module, "TILE_CELLS", 7)
    queries, index = fixture(9)

    def batch(rows):
        vectors = pa.array([r[1] for r in rows], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), vectors], names=["key", "vector"])

    held = [batch(index[n : n + 40]) for n in range(0, len(index), 40)]
    stream = map(topk_module._held, topk_module._tables(iter(held)))
    asked = topk_module._asked(pa.Table.from_batches([batch(queries)]))
    found = list(topk_module.scan_best(asked, stream, 4, 0.1))
    rows = sorted(tuple(r.values()) for b in found for r in b.to_pylist())
    exact = [[(i, [float(np.float32(x)) for x in v]) for i, v in side] for side in (queries, index)]
    assert rows == plain_topk(*exact, 4, 0.1)


def test_topk(spark):
    index = [(f"v{n}", [1.0, n * 0.01], f"q{n}") for n in range(10)] + [("empty", [], "q")]
    df = spark.createDataFrame(index, "id string, embedding array<double>, question string")
    got = topk(df, [1.0, 0.0], k=3, threshold=0.0)
    assert got.columns == ["id", "question", "similarity"]
    assert [(r["id"], r["similarity"]) for r in got.collect()] == [("v0", 1.0), ("v1", 1.0), ("v2", 0.9998)]
    assert topk(df, [-1.0, 0.0]).count() == 0
    assert topk(df.limit(0), [1.0, 0.0]).count() == 0


def test_rows_without_vectors_are_not_gathered(spark):
    """Most of the index waits for its vectors; ids and rows count, and the result is the same."""
    from tablewright.operators import topk as module

    index = spark.range(3000).selectExpr("concat('id-', id) AS id", "IF(id % 100 = 0, array(1.0D, id / 3000.0D), CAST(array() AS ARRAY<DOUBLE>)) AS embedding")
    queries = spark.createDataFrame([(1, [1.0, 0.5])], "query_id int, embedding array<double>")
    right = index.selectExpr("id AS key", "embedding AS vector")
    assert module._bytes(right, 1 << 30) > 3000 * module.ROW_BYTES
    found = [[tuple(r) for r in module.topk_join(queries, index, 5, broadcast_bytes=size).orderBy("rank").collect()] for size in (1 << 30, 90, 900)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 5


def test_blocks_that_cannot_hold_a_hit_are_not_asked(spark, monkeypatch):
    """Groups of directions far apart: each query travels to few blocks, and the hits are exact."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    index = [(f"i{n:04d}", (centres[n % 12] + 0.05 * rng.standard_normal(16)).tolist()) for n in range(1200)]
    queries = [(n, (centres[n % 12] + 0.05 * rng.standard_normal(16)).tolist()) for n in range(60)]
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    i = spark.createDataFrame(index, "id string, embedding array<double>")
    seen, real = {}, topk_module._asking

    def asking(rows, cones, threshold):
        out = real(rows, cones, threshold)
        seen["asked"], seen["blocks"] = out.count(), cones.num_rows
        return out

    monkeypatch.setattr(topk_module, "_asking", asking)
    got = topk_join(q, i, 5, 0.9, broadcast_bytes=8000)
    rows = sorted(tuple(r) for r in got.select("query_id", "id", "similarity", "rank").collect())
    assert rows == plain_topk(queries, index, 5, 0.9)
    assert seen["blocks"] >= 12 and seen["asked"] <= 60 * seen["blocks"] / 2


def test_vectors_that_are_no_numbers_hide_nothing():
    """More of them than hits are asked for, in a batch with others."""
    index = [(f"i{n}", [math.nan, 1.0]) for n in range(9)] + [("good", [1.0, 1.0]), ("huge", [math.inf, 1.0])]
    rows = pa.table({"key": [r[0] for r in index], "vector": pa.array([r[1] for r in index], pa.list_(pa.float64()))})
    asked = topk_module._asked(pa.table({"key": [1], "vector": pa.array([[1.0, 0.9]], pa.list_(pa.float64()))}))
    found = [r for b in topk_module.scan_best(asked, iter([topk_module._held(rows)]), 3, 0.3) for r in b.to_pylist()]
    assert [(r["id"], r["rank"]) for r in found] == [("good", 1)]


def test_few_blocks_are_dealt_to_many_tasks(spark, monkeypatch):
    """The queries of a block go to as many tasks as their pairs ask for, and the hits are the same."""
    queries, index = fixture(6)
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    i = spark.createDataFrame(index, "id string, embedding array<double>")
    seen, real = [], topk_module.meet_in_cells

    def meet(held, asked, k, threshold, cells=None):
        seen.append((cells, held.select("cell").distinct().count()))
        return real(held, asked, k, threshold, cells)

    monkeypatch.setattr(topk_module, "meet_in_cells", meet)
    monkeypatch.setattr(topk_module, "LEAST_PAIRS", 1000)
    got = topk_join(q, i, 5, 0.3, broadcast_bytes=2000)
    assert sorted(tuple(r) for r in got.select("query_id", "id", "similarity", "rank").collect()) == plain_topk(queries, index, 5, 0.3)
    assert seen[0][0] >= 12 and seen[0][1] >= 12


def test_leaves_bound_their_vectors_and_most_are_passed_over(monkeypatch):
    """Of 64 far groups a query looks into its own, and finds what brute force finds."""
    monkeypatch.setattr(topk_module, "LEAF_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((64, 12))
    held = centres[rng.integers(64, size=2000)] + 0.05 * rng.standard_normal((2000, 12))
    held[::50], held[1::50], held[2::50] = 0.0, 1e-160, centres[5]
    asked = np.concatenate([centres[:40], 1e-160 * np.ones((1, 12)), np.zeros((1, 12))])

    def table(rows, name):
        return pa.table({"key": [f"{name}{i:04}" for i in range(len(rows))], "vector": pa.array(list(rows), pa.list_(pa.float64()))})

    queries, index = topk_module.Vectors(table(asked, "q")), topk_module.Vectors(table(held, "i"))
    leaves = index.leaves()[12]
    reach = leaves.reach(queries.unit(12, np.arange(len(asked))))
    cosines = queries.similarity(0, len(asked), index)[:, leaves.at]
    for leaf, (begin, end) in enumerate(zip(leaves.begin, leaves.end)):
        assert end - begin <= 16 and (cosines[:41, begin:end].max(axis=1) <= reach[:41, leaf]).all()
    assert (reach[:40] >= 0.9).mean() < 0.2
    got = pa.concat_tables(list(topk_module._near(queries, index, 5, 0.3, np.full(len(asked), 0.3)))).to_pylist()
    want = plain_topk(list(enumerate(asked.tolist())), [(f"i{i:04}", v) for i, v in enumerate(held.tolist())], 5, 0.3)
    assert [(r["query"], r["id"], r["similarity"]) for r in got if r["query"] < 40] == [w[:3] for w in sorted(want, key=lambda w: (w[0], w[3])) if w[0] < 40]
