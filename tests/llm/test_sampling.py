import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import tablewright.llm.hard_negatives as negatives_module
import tablewright.llm.mixing as mixing_module
from tablewright.llm.common import numbered, staged
from tablewright.llm.hard_negatives import hard_negatives
from tablewright.llm.mixing import mixed, mixture
from tablewright.llm.resampling import gram_spans, importance_ranks, line_of, resampled
from tests.llm.conftest import SCHEMA

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def digest(seed, doc_id, n):
    return int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:n], 16)


# --- Global numbers -----------------------------------------------------------------------
def test_numbers_follow_the_order_and_split_equal_rows(spark):
    rows = staged(spark.range(5000).select((F.col("id") % 7).alias("a"), F.lit(1).alias("b")))
    got, n = numbered(rows, F.desc("a"), F.col("b"))
    found = got.orderBy("number").collect()
    assert n == 5000 and [r.number for r in found] == list(range(1, 5001))
    assert [r.a for r in found] == sorted((r.a for r in found), reverse=True)
    none, n = numbered(rows.limit(0), F.col("a"))
    assert n == 0 and none.count() == 0


# --- Importance resampling ----------------------------------------------------------------
def plain_grams(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for i in range(len(words)) for n in range(1, longest + 1) if i + n <= len(words)], len(words)


def plain_ranks(docs, target, share=(25, 100), least=20, longest=2, buckets=10000, seed=7):
    def count(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in plain_grams(t, longest)[0])

    s, t = count(x for _, x in docs), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        grams, words = plain_grams(text, longest)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams) // len(grams) if grams else 0
        noise = math.floor(-1000 * math.log(-math.log((digest(seed, doc_id, 8) + 0.5) / 4294967296)))
        rows.append([doc_id, len(grams), weight, weight + noise, None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(able[: share[0] * len(able) // share[1]], 1):
        row[4] = place
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def shown(rows):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in rows.collect())


def test_spans_of_overlapping_ngrams():
    line = line_of("  It's A\x00b--ÉÀ x_9\n日本! ")
    assert line.decode() == "it s a b ÉÀ x 9 日本"
    for longest in (1, 2, 3):
        assert sorted(line[a:b].decode() for a, b in gram_spans(line, longest)) == sorted(plain_grams(line.decode(), longest)[0])
    assert list(gram_spans(b"")) == []


def test_ranks_by_hand(spark, data, docs):
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = plain_ranks([(r.doc_id, r.text) for r in docs.collect()], target)
    assert shown(entry.queries()["op11_importance_resampling"](spark, data)) == want


@pytest.mark.parametrize("longest,share", [(1, (1, 2)), (3, (1, 1))])
def test_ranks_on_odd_rows_and_other_settings(odd, clashing, spark, longest, share):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    aim = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    options = {"longest": longest, "share": share, "least_words": 4, "buckets": 50, "seed": 3}
    want = plain_ranks(rows, ["one two three", None, ""], share, 4, longest, 50, 3)
    assert shown(importance_ranks(clashing, aim, **options)) == want
    assert shown(importance_ranks(clashing.repartition(7), aim, **options)) == want
    assert importance_ranks(odd.limit(0), aim).count() == 0
    assert all(r.weight is not None for r in importance_ranks(odd, aim.limit(0)).collect())


def test_ties_go_to_the_smaller_id_and_a_hot_id_is_dealt_out(spark, frame):
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    docs = frame([(5, text)] * 300 + [(i, text) for i in range(300)])
    aim = spark.createDataFrame([("a b",)], "text string")
    got = importance_ranks(docs, aim)
    assert shown(got) == plain_ranks([(r.doc_id, r.text) for r in docs.collect()], ["a b"])
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 151))


def test_drawn_documents_look_like_the_target(spark, frame):
    rng = random.Random(2)
    near = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(40)) for _ in range(60)]
    far = [" ".join(rng.choice("red green blue white".split()) for _ in range(40)) for _ in range(240)]
    docs = frame([*near, *far])
    drawn = resampled(docs, spark.createDataFrame([(t,) for t in near[:5]], "text string"))
    ids = [r.doc_id for r in drawn.collect()]
    assert drawn.columns == docs.columns and len(ids) == 75 and sum(i < 60 for i in ids) >= 55


# --- Mixing -------------------------------------------------------------------------------
def plain_targets(sizes, weights, most):
    """Targets by source, the excess shared again until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        shares = sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * left / shares > most * sizes[s]}
        if not above:
            return target | {s: weight[s] * left / shares for s in free}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= above
    return target


def plain_mixture(rows, weights=(1, 2, 3), most=3, seed=13):
    words = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    sizes = Counter()
    for _, s, n in words:
        sizes[s] += n
    targets, out = plain_targets(sizes, weights, most), []
    for source, size in sizes.items():
        own = defaultdict(list)
        for i, s, n in words:
            if s == source:
                own[digest(seed, i, 12)].append((i, n))
        whole = min(most, int(targets[source] // size)) if size else 0
        rest, taken = targets[source] - whole * size, 0
        for h in sorted(own):
            group = sum(n for _, n in own[h])
            more = rest > 0 and (taken + group <= rest or (taken <= rest and taken + group - rest < rest - taken))
            taken += group
            out += [(i, n, size, targets[source], n * (whole + more)) for i, n in own[h]]
    return sorted(map(repr, out))


def mixture_rows(found):
    return sorted(repr((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in found.collect())


def fixture_rows(seed, n=600, sources=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "", "Z", "é", "😀", *[f"s{k}" for k in range(sources)]])
        text = rng.choice([None, "", " \t\n", " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(0.7)) % 3000))])
        rows.append((rng.choice([i, i, i, 7, None]), source, text))
    return rows


@pytest.mark.parametrize("seed,sent", [(1, True), (2, False)])
def test_mixture_by_hand(spark, monkeypatch, seed, sent):
    if not sent:
        monkeypatch.setattr(mixing_module, "BROADCAST_ROWS", -1)
    rows = fixture_rows(seed)
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in rows], SCHEMA).withColumn("target", F.lit("x")).withColumn("number", F.lit(1))
    assert mixture_rows(mixture(docs)) == plain_mixture(rows)
    assert mixture_rows(mixture(docs.repartition(5), (5, 1), 2, 4)) == plain_mixture(rows, (5, 1), 2, 4)


def test_targets_are_met_and_bounds_hold(spark, data, docs):
    found = entry.queries()["op13_source_mixing"](spark, data).collect()
    rows = {r.doc_id: r for r in docs.collect()}
    taken, largest = Counter(), Counter()
    for r in found:
        source = rows[r.doc_id].source
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
        largest[source] = max(largest[source], r["size"])
        assert r.target <= 3 * r.source_size
    for r in found:
        source = rows[r.doc_id].source
        assert abs(taken[source] - r.target) <= largest[source] / 2
    assert sum({rows[r.doc_id].source: r.target for r in found}.values()) == pytest.approx(sum(r["size"] for r in found))


def test_the_mix_repeats_documents(spark, data, docs):
    copies = {r.doc_id: r.copies for r in mixture(docs).collect()}
    mix = mixed(docs)
    assert mix.columns == [*docs.columns, "epoch"]
    got = Counter((r.doc_id, r.text) for r in mix.collect())
    assert got == Counter({(r.doc_id, r.text): copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]})


def test_mixtures_of_nothing(spark, frame):
    assert mixture(frame([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in mixture(frame([(1, ""), (2, None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_mixing_runs_no_python(spark, data, capsys):
    entry.queries()["op13_source_mixing"](spark, data).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan) and "Window" not in plan


# --- Hard negatives -----------------------------------------------------------------------
def plain_negatives(rows, every):
    held = [(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows
            if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({i for i, _, _ in held if i % every == 0}):
        label, own = min((c, v) for i, c, v in held if i == anchor)
        scored = [(-sum(a * b for a, b in zip(own, v)), i, c) for i, c, v in held if i != anchor and len(v) == len(own)]
        for s, i, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted((t, j) for t, j, c in scored if c != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(anchor, i, n, j, -s, -t) for n, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def vectors_of(seed, n=400, size=10):
    rng = random.Random(seed)
    hot = [rng.gauss(0, 1) for _ in range(size)]
    rows = []
    for i in range(n):
        kind = rng.random()
        v = hot if kind < 0.3 else [rng.gauss(0, 0.3) + h * (kind < 0.6) for h in hot]
        if kind > 0.97:
            v = rng.choice([None, [], [None] * size, [math.nan] * size, [math.inf] + [1.0] * (size - 1), [0.0] * size, [0.5] * 3, [1.0]])
        rows.append((rng.choice([i] * 20 + [None, 10]), rng.choice([0, 0, 0, 1, 2, None]), v))
    return rows


@pytest.mark.parametrize("seed,cells,bounds", [(1, 1 << 22, 1 << 25), (2, 200, 1 << 25), (3, 200, 0)])
def test_negatives_by_hand(spark, monkeypatch, seed, cells, bounds):
    monkeypatch.setattr(negatives_module, "BLOCK_CELLS", cells)
    monkeypatch.setattr(negatives_module, "TILE_CELLS", max(cells // 2, 64))
    monkeypatch.setattr(negatives_module, "BOUNDS_BYTES", bounds)
    rows = vectors_of(seed)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(0))
    got = sorted(map(tuple, hard_negatives(table, every=10).collect()))
    assert got == plain_negatives(rows, 10)


def test_repeats_of_an_anchor_are_no_negatives(spark):
    rows = [(10, 0, [1.0, 1.0]), (11, 0, [1.0, 1.0]), (10, 1, [1.0, 1.0]), (12, 1, [0.9, 0.9])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives(table, every=10).select("anchor_id", "positive_id", "rank", "negative_id")
    assert [tuple(r) for r in got.collect()] == [(10, 11, 1, 12)]


def test_negatives_of_real_vectors_and_of_none(spark, data):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    moved = [(i, (c + 1) % 10 if i % 7 == 0 else c, v) for i, c, v in rows]
    got = entry.queries()["op12_hard_negatives"](spark, data)
    assert sorted(map(tuple, got.collect())) == plain_negatives(moved, 100)
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert hard_negatives(empty).count() == 0


def test_summaries_leave_blocks_and_pairs_out(spark, monkeypatch):
    """Of two far groups only the near one's blocks are asked, and bounds hold every score."""
    rng = random.Random(5)
    rows = [(i, i % 2, [(10.0 if i % 4 < 2 else -10.0) + rng.gauss(0, 0.1) for _ in range(16)]) for i in range(800)]
    monkeypatch.setattr(negatives_module, "BLOCK_CELLS", 16 * 50)
    asked = {}
    real = negatives_module.asked_blocks

    def counted(anchors, bounds, own_label):
        out = staged(real(anchors, bounds, own_label))
        asked[own_label] = (out.count(), anchors.count(), bounds.count())
        return out

    monkeypatch.setattr(negatives_module, "asked_blocks", counted)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives(table, every=10).collect())) == plain_negatives(rows, 10)
    for found, anchors, blocks in asked.values():
        assert found <= anchors * blocks * 0.4
