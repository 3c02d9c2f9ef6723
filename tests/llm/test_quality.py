import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from tablewright.llm.quality_classifier import LabelModel, fit_labels, quality_scores, sampled
from tablewright.llm.quality_rules import quality_rules, trusted_documents
from tablewright.llm.toxicity import fit_ordinal, fit_severity, labelled_words, severity, without_toxic


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_rules_by_hand(spark, data, docs):
    got = {r.doc_id: tuple(r)[1:7] for r in entry.queries()["op6_quality_rules"](spark, data).collect()}
    assert got == {r.doc_id: rules(r.text) for r in docs.collect()}


def test_rules_on_odd_rows(odd, clashing, frame, spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab|") for _ in range(rng.randrange(0, 60))).replace("| |", "\n") for _ in range(200)]
    all_ = frame(texts)
    assert {r.doc_id: tuple(r)[1:7] for r in quality_rules(all_, all_).collect()} == {i: rules(t) for i, t in enumerate(texts)}
    rows = quality_rules(clashing, clashing.limit(0)).collect()
    assert len(rows) == 11 and all(r.ratio == 0.0 and r.kept == (not r.base_failed) for r in rows)
    assert sorted(tuple(r)[1:7] for r in rows) == sorted(rules(r.text) for r in odd.collect())
    assert quality_rules(odd.limit(0), odd.limit(0)).count() == 0


def test_rules_tell_junk_apart(spark, data):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op6_quality_rules"](spark, data).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id].quality == 1)


def test_rules_run_no_python(spark, data, capsys):
    entry.queries()["op6_quality_rules"](spark, data).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas", plan)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7])
    says = np.where(rng.random((20000, 5)) < right, good[:, None], ~good[:, None])
    patterns = Counter("".join("-" if rng.random() < 0.1 else "bg"[int(x)] for x in row) for row in says)
    model = fit_labels(list(patterns), list(patterns.values()), strength=1e-6)
    assert abs(model.prior - 0.8) < 0.02
    assert np.allclose(model.answers[1, :, 1] / model.answers[1, :, :2].sum(1), right, atol=0.03)
    assert fit_labels([], []).posterior([]).tolist() == []
    assert isinstance(model, LabelModel) and model.posterior(["ggggg"])[0] > 0.99 > 0.01 > model.posterior(["bbbbb"])[0]


def test_classifier_keeps_good_and_drops_junk(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op1_quality_classifier"](spark, folder).collect() if r.doc_id in labels]
    good, bad = ([r for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.5
    assert np.mean([r.posterior > 0.5 for r in good]) > 0.99 and np.mean([r.posterior > 0.5 for r in bad]) < 0.1


def test_verdicts_do_not_depend_on_how_rows_are_dealt(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    found = []
    try:
        for parts, most in ((1, "128m"), (40, "64k")):
            for k in before:
                spark.conf.set(k, most)
            rows = quality_scores(docs.repartition(parts)).collect()
            found.append({r.doc_id: r for r in rows})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    one, many = found
    assert {i: r.kept for i, r in one.items()} == {i: r.kept for i, r in many.items()}
    assert all(abs(one[i].score - many[i].score) < 1e-3 for i in one)
    for rows in found:
        assert np.mean([rows[i].kept for i, q in labels.items() if q == 0]) < 0.1


def test_classifier_on_odd_rows(odd, clashing):
    rows = quality_scores(clashing).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert quality_scores(odd.limit(0)).count() == 0


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(1)
    x = [rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(4000)]
    weights = np.array([2.0, 1.0, 0.5, 0.0, -1.0, -2.0])
    score = np.array([weights[v].sum() for v in x]) + rng.logistic(size=4000)
    grade = np.digitize(score, [0.0, 1.0, 2.5])
    found, cuts = fit_ordinal(x, grade, 6, 4)
    assert np.allclose(found, weights, atol=0.35) and np.allclose(cuts, [0, 1, 2.5], atol=0.35) and (np.diff(cuts) > 0).all()


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_toxicity(labelled):
    docs, labels = labelled
    model = fit_severity(docs, labels.where("doc_id % 3 <> 0"))
    held = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    rows = [r for r in severity(docs, model).collect() if r.doc_id in held]
    wrong = [r for r in rows if not held[r.doc_id] and r.toxic]
    caught = [r.toxic for r in rows if held[r.doc_id]]
    assert len(wrong) <= 0.01 * len(rows) and np.mean(caught) > 0.8
    assert all(0 <= r.severity <= 3 for r in rows)
    assert np.mean([r.severity for r in rows if held[r.doc_id]]) > 5 * np.mean([r.severity for r in rows if not held[r.doc_id]])


def test_toxicity_on_odd_rows(spark, odd, clashing, frame):
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(40)] + [(None, 1, 1), (99, 0, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame([(i, f"text number {i} about " + ("gruntles" if i < 20 else "flowers")) for i in range(40)])
    model = fit_severity(docs, labels)
    assert {r.doc_id for r in severity(docs, model).where("toxic").collect()} == set(range(20))
    assert {r.doc_id for r in without_toxic(docs, model).collect()} == set(range(20, 40))
    assert severity(clashing, model).count() == 11 and without_toxic(clashing, model).columns == clashing.columns
    none = fit_severity(odd.limit(0), labels)
    assert none is None and {r.severity for r in severity(odd, none).collect()} == {0.0}
    assert severity(odd.limit(0), model).count() == 0


def test_repeated_rows_stay_within_the_samples(spark, frame):
    rows = [(i, f"text {i}") for i in range(30)]
    docs = frame(rows + [(5, f"text {i}") for i in range(300)] + [(6, "text 6")] * 300)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] * 2, "doc_id long, quality int, toxic int")
    words = labelled_words(docs, labels, 10)
    assert {r.toxic: r["count"] for r in words.groupBy("toxic").count().collect()} == {0: 10, 1: 10}
    assert labelled_words(docs, labels, 1000).count() == 30
    whole = docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS _key")
    marked = whole.groupBy("_key").count()
    found = [r._key for r in sampled(whole, marked, 50).collect()]
    assert sorted(found) == sorted(r._key for r in marked.collect())[:50]
    assert quality_scores(docs, rows=20).count() == 630


def test_very_long_texts(spark, frame):
    long_ = " ".join(f"gruntles {i} of the day." for i in range(200_000))
    docs = frame([(i, f"text number {i} about " + ("gruntles" if i < 20 else "flowers")) for i in range(40)] + [(50, long_), (51, long_ + " more")])
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(40)] + [(50, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in severity(docs, fit_severity(docs, labels)).collect()}
    assert len(got) == 42 and got[50].toxic and got[51].toxic
    rules_ = {r.doc_id: r.n_words for r in quality_rules(docs, trusted_documents(docs, labels)).where("doc_id >= 50").collect()}
    assert rules_ == {50: 1_000_000, 51: 1_000_001}
    assert quality_scores(docs).where("doc_id >= 50").count() == 2
