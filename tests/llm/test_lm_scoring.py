"""The whole choice among all words is made in context, whatever their number."""

import random
import zlib

import numpy as np

from tablewright.llm import lm_scoring
from tablewright.llm.lm_scoring import lm_scores


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_rare_words_are_scored_in_their_context(frame):
    """Of two held-out texts of the same 5,000 + 5,000 rare words, the one in learned pairs is far likelier."""
    rng = random.Random(5)
    pairs = [(f"a{i:04}", f"b{i:04}") for i in range(5000)]
    ids = iter(range(10**6))
    rows, kinds = [], {}
    for _ in range(6):
        rng.shuffle(pairs)
        for at in range(0, len(pairs), 50):
            rows.append((next(i for i in ids if not held(i)), " ".join(w for p in pairs[at : at + 50] for w in p)))
    for at in range(0, len(pairs), 50):
        some = pairs[at : at + 50]
        for kind, seconds in (("learned", some), ("strange", some[1:] + some[:1])):
            rows.append((next(i for i in ids if held(i)), " ".join(f"{a} {b}" for (a, _), (_, b) in zip(some, seconds, strict=True))))
            kinds[rows[-1][0]] = kind
    sums = {"learned": [0.0, 0.0], "strange": [0.0, 0.0]}
    for r in lm_scores(frame(rows)).where("held_out").collect():
        sums[kinds[r.doc_id]][0] += r.score
        sums[kinds[r.doc_id]][1] += r.base_score
    assert abs(sums["learned"][1] - sums["strange"][1]) < 1e-6
    # More than the root of ten for each pair.
    assert sums["learned"][0] - sums["strange"][0] > 2500


def test_words_that_tasks_do_not_know_get_the_same_scores(docs):
    few, all_ = (sorted(map(tuple, lm_scores(docs, known=k).collect())) for k in (6000, 1 << 20))
    assert [r[:5] for r in few] == [r[:5] for r in all_]
    assert np.allclose([r[5:] for r in few], [r[5:] for r in all_], rtol=1e-6)


def test_ids_of_text_and_scores_of_stored_and_other_rows(spark, docs, tmp_path):
    """Ids of any type keep their rows; what is read from files and what was dealt anew is scored alike."""
    some = docs.selectExpr("IF(doc_id % 10 = 0, NULL, concat('d', doc_id)) AS doc_id", "text").orderBy("text").limit(60)
    some.coalesce(1).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    other = stored.orderBy("text").coalesce(1)
    one, two = (sorted(map(tuple, lm_scores(d).collect()), key=repr) for d in (stored, other))
    assert sorted(repr(r[0]) for r in one) == sorted(repr(r.doc_id) for r in stored.collect())
    assert [r[:5] for r in one] == [r[:5] for r in two] and np.allclose([r[5:] for r in one], [r[5:] for r in two], rtol=1e-9)


def test_chances_in_a_leaf_sum_to_one():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 16, 17, 900):
        tokens = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        counts = rng.zipf(1.5, n)
        tree = lm_scoring.Tree(tokens, counts)
        ends = np.append(tree.find(tokens), n)
        assert sorted(ends) == list(range(n + 1)) and tree.find(np.array([0], np.uint64)) == [n]
        for learned in (0.0, 1.0):
            weights = np.concatenate([tree.shares, learned * rng.standard_normal((256, 16)).astype(np.float32)])
            contexts = np.repeat(rng.integers(1, 1 << 63, (4, 1), dtype=np.uint64), n + 1, 1)
            token, rows, outcome = tree.choices(contexts, ends, len(weights))
            chance = np.bincount(token, lm_scoring.chances(weights, rows, outcome), n + 1) if n else np.zeros(1)
            assert np.isclose((10**chance).sum(), 1, atol=1e-4)
            if not learned:  # counts plus one, with one place for what was never seen
                assert np.allclose(10**chance, np.append(counts + 1, 1) / (counts.sum() + n + 1), rtol=1e-4)


def test_gradients_of_runs():
    rng = np.random.default_rng(4)
    values, size = rng.standard_normal((50, 16)).astype(np.float32), np.array([300, 40, 9, 8, 8, 3, 1, 1])
    first = np.cumsum(size) - size
    source = rng.integers(0, 50, size.sum())
    want = np.add.reduceat(values[source], first, axis=0)
    assert np.allclose(lm_scoring.run_sums(values, source, first, size), want, atol=1e-4)
