import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm.lm_scoring import LEAVES, Features, Model, lm_scores, log_softmax
from tablewright.llm.vector_search import neighbours, shards

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_scores(rows):
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter()
    for (_, own), out in zip(words, held):
        counts.update([] if out else own)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, out, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        for (i, own), out in zip(words, held)
    ]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5]))


def test_base_scores(spark, data, docs):
    same(entry.queries()["op3_lm_scoring"](spark, data).collect(), base_scores([(r.doc_id, r.text) for r in docs.collect()]))


def test_counts_that_are_joined(docs):
    same(lm_scores(docs, known=300).collect(), base_scores([(r.doc_id, r.text) for r in docs.collect()]))


def test_scores_of_odd_rows(odd, clashing):
    same(lm_scores(clashing).collect(), base_scores([(r.doc_id, r.text) for r in odd.collect()]))
    assert lm_scores(odd.limit(0)).count() == 0
    untrained = lm_scores(odd.where("doc_id = 5"), known=10).collect()
    assert all(math.isfinite(r.score) for r in untrained)


def test_model_beats_counts_on_held_out_texts(spark):
    rows = lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_model_learns_an_order(frame):
    rng = random.Random(1)
    texts = [" ".join(["red", "green", "blue"] * rng.randrange(5, 20)) for _ in range(300)]
    for r in lm_scores(frame(texts)).where("held_out").collect():
        assert r.score > 0.5 * r.base_score  # the next word is nearly certain


def test_chances_sum_to_one():
    rng = np.random.default_rng(0)
    model = Model.of(rng.standard_normal(Model.of(np.zeros(4096 * 16 + 1024 * 256, np.float32)).flat().size).astype(np.float32))
    rows = Features(4096).of(rng.integers(0, LEAVES, 50), np.array([0, 20, 20, 50]))
    assert rows.shape == (50, 5) and np.allclose(np.exp(log_softmax(model.by_class, rows)).sum(1), 1, atol=1e-5)


def exact(ids, vectors, k, every):
    out = {}
    for i in sorted({i for i in ids if i % every == 0}):
        q = vectors[ids.index(i)]
        found = sorted((-float(np.dot(q, v)), j) for j, v in zip(ids, vectors) if j != i)
        out[i] = found[:k]
    return out


def test_neighbours_and_recall(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in table], [np.array(r.embedding, float) for r in table]
    want = exact(ids, vectors, 20, 20)
    rows = entry.queries()["op4_nearest_neighbours"](spark, data).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    by_id = dict(zip(ids, vectors))
    hits = 0
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[0], p[1])) and len(found) == 20
        assert all(abs(s - float(by_id[q] @ by_id[v])) < 1e-12 for s, v in found)
        hits += len({v for _, v in found} & {v for _, v in want[q]})
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)


def test_recall_over_lists(spark, monkeypatch):
    from tablewright.llm import vector_search

    monkeypatch.setattr(vector_search, "LIST_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16)) * 2
    vectors = [centres[i % 30] * (1 + i % 3) + rng.standard_normal(16) for i in range(1500)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = exact(list(range(1500)), vectors, 10, 20)
    found = neighbours(frame, k=10).collect()
    hits = sum(r.vec_id in {v for _, v in want[r.query_id]} for r in found)
    assert len(found) == 750 and hits >= 0.9 * 750


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [1.0, None]), (None, [1.0, 1.0]),
            (140, [1.0, 2.0, 3.0]), (7, [1.0, 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (160, [])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, list string, id string")
    got = [tuple(r) for r in neighbours(frame, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 5, 1.0), (0, 3, 7, 1.0), (20, 1, 5, 2.0), (20, 2, 5, 2.0), (20, 3, 7, 2.0)]
    assert neighbours(frame.limit(0)).count() == 0 and neighbours(frame.where("vec_id = 0")).count() == 0


def test_one_vector_in_many_rows(spark, monkeypatch):
    from tablewright.llm import vector_search

    monkeypatch.setattr(vector_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 7)
    frame = spark.range(400).selectExpr("id AS vec_id", "IF(id % 3 = 0, array(1.0D, 0.0D), array(1.0D, id / 400.0D)) AS embedding")
    found = neighbours(frame, k=5).where("query_id = 60").orderBy("rank").collect()
    assert len(found) == 5 and {r.score for r in found} == {1.0} and [r.vec_id for r in found] == [0, 1, 2, 3, 4]


def test_copies_follow_the_visits_of_a_list(spark, monkeypatch):
    """Copies of a vector do not grow with the number of queries, only with those of its own shard."""
    from tablewright.llm import vector_search

    monkeypatch.setattr(vector_search, "QUERY_ROWS", 10)
    for shards_ in (4, 40):
        placed = spark.range(shards_ * 30).selectExpr("id", f"id % {shards_} AS shard")
        wanted = spark.range(shards_ * 25).selectExpr("id", f"id % {shards_} AS shard").where("shard <> 3")
        left, right = vector_search.met_in_parts(placed, wanted)
        assert left.count() == 3 * (shards_ - 1) * 30 and right.count() == 25 * (shards_ - 1)
        met = left.alias("l").join(right.alias("r"), ["shard", "part"]).selectExpr("l.id AS v", "r.id AS q")
        assert met.count() == met.distinct().count() == (shards_ - 1) * 30 * 25
    none = spark.range(0).selectExpr("id", "id AS shard")
    assert [d.count() for d in vector_search.met_in_parts(placed, none)] == [0, 0]


def test_lists_grow_with_the_rows():
    from tablewright.llm.vector_search import Layout, lists_for

    assert [lists_for(n) for n in (0, 999, 5_000, 1_024_000, 10_000_000, 10**8)] == [1, 1, 5, 1024, 3162, 10_000]
    rng = np.random.default_rng(1)
    layout = Layout.fit(rng.standard_normal((300, 7)), 60.0, 20)
    points = layout.turned(rng.standard_normal((50, 7)) * 0.1)
    whole = layout.order(points)
    assert (layout.order(points, 1)[:, 0] == whole[:, 0]).all() and (layout.order(points, 3) == whole[:, :3]).all()


def test_workers_need_no_package(tmp_path, data):
    """From a foreign folder, where workers cannot import the package."""
    script = f"""
import sys
sys.path[:0] = [{os.path.dirname(entry.__file__)!r}]
from tablewright.session import local_session
from tablewright.llm.lm_scoring import lm_scores
from tablewright.llm.vector_search import neighbours
spark = local_session("foreign", 2, "2g")
print(neighbours(spark.read.parquet({data!r} + "/embeddings.parquet")).count(), lm_scores(spark.read.parquet({data!r} + "/documents.parquet").limit(20)).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[-1] == "20"


def test_shards_bound_rows():
    assert shards({0: 10, 1: 5, 2: 100, 3: 4, 4: 9}, 16) == [(0, 0, 1), (1, 0, 1), (2, 1, 7), (3, 8, 1), (4, 8, 1)]
    assert shards({}, 16) == []


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, data))
        out.append((name, before, docs))
    return out


def test_pipeline_stages(stages):
    assert [name for name, *_ in stages] == ["toxicity", "line_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    for name, before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString(), name
    ids = [{r.doc_id for r in after.select("doc_id").collect()} for *_, after in stages]
    assert ids[1] == ids[0] >= ids[2] == ids[3] == ids[4]
    lengths = [after.selectExpr("sum(length(text))").first()[0] for *_, after in stages[:-1]]
    assert lengths[0] > lengths[1] >= lengths[2] and all(r.n_chars == len(r.text) for r in stages[3][2].collect())


def test_pipeline_run(spark, data, stages):
    last = stages[-1][2]
    assert sorted(map(repr, entry.queries()["pipeline"](spark, data).drop("sequence_id", "offset").collect())) == sorted(
        map(repr, last.drop("sequence_id", "offset").collect())
    )


def test_pipeline_takes_odd_rows(spark, data, clashing):
    for docs in (clashing, clashing.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, data))
        assert docs.count() >= 0
