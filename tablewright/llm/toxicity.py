"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity has the grades 0 (clean) to ``GRADES - 1``. One weight vector is shared by all
thresholds: P(grade <= k) = sigmoid(t_k - w.x) with t_0 < t_1 < ...; the severity of a text is its
expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import HashIndex, WordHasher, hashed_words, list_array, matching, staged, texts

# Labelled rows of each class that the model is fitted on, at most: those with the smallest hashes.
TRAINING_ROWS = 10_000
FEATURES = 2048
GRADES = 4
# Signed root of the likelihood ratio by which a word must tell the classes apart to be a feature.
LEAST_Z = 4.2
# Words and their first so many bytes are the features, so that inflected forms share evidence.
PREFIXES = (4, 5, 6)
REJECT_AT = 0.5


@dataclass(frozen=True)
class SeverityModel:
    keys: np.ndarray  # sorted hashes of the feature words
    weights: np.ndarray
    cuts: np.ndarray  # thresholds, ascending

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each score, one column a threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))


def labelled_words(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(toxic, words): distinct word hashes of up to ``rows`` labelled documents of each class.

    Contradicting labels of one id count as toxic; ids without a document drop out. An id counts
    once, with the text of the smallest hash, however many rows repeat it.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(c).orderBy(*order).limit(rows) for c in (F.col("toxic") == 1, F.col("toxic") == 0)]
    sample = picked[0].union(picked[1])
    hasher = WordHasher("plain", PREFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, bounds in hashed_words(batch.column("text"), hasher):
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic")[low:high], list_array(flat, ends, pa.int64())], ["toxic", "words"]
                )

    sample = F.broadcast(staged(sample.select("doc_id", F.col("toxic").cast("int"))))
    whole = texts(docs, "doc_id").withColumn("_text", F.xxhash64("text")).join(sample, "doc_id")
    one = F.broadcast(whole.groupBy("doc_id").agg(F.min("_text").alias("_text")))
    joined = whole.join(one, ["doc_id", "_text"]).dropDuplicates(["doc_id"]).select("toxic", "text")
    return joined.mapInArrow(run, "toxic int, words array<long>")


def marked(words: DataFrame, most: int, least_z: float) -> list[tuple[int, float]]:
    """(word, signed root of its likelihood ratio), the most telling first."""
    n1, n0 = (words.where(F.col("toxic") == k).count() for k in (1, 0))
    each = words.select("toxic", F.explode("words").alias("word")).groupBy("word")
    counts = each.agg(F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = F.lit(n1 / (n1 + n0))
    a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (part(a, both * share) + part(b, both * (1 - share)))
    z = F.sqrt(F.greatest(ratio, F.lit(0.0))) * F.signum(a - both * share)
    telling = counts.where(both >= 5).select("word", z.alias("z"))
    best = telling.where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(most)
    return [(r["word"], r["z"]) for r in best.collect()]


def fit_ordinal(
    x: list[np.ndarray], grade: np.ndarray, features: int, levels: int, steps: int = 1500, rate: float = 0.1, ridge: float = 2e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full gradients (Adam). ``x`` lists each row's features, each of value 1.

    Thresholds are t_0 and positive gaps, so they stay ascending.
    """
    sizes = np.array([len(v) for v in x], np.int64)
    row, col = np.repeat(np.arange(len(x)), sizes), np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
    params = np.zeros(features + levels - 1)
    params[features] = 1.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = max(len(x), 1)
    for step in range(1, steps + 1):
        w, gaps = params[:features], np.exp(params[features + 1 :])
        cuts = params[features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[col], len(x)) if len(col) else np.zeros(len(x))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -500, 500)))  # P(grade <= k)
        padded = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        at = np.arange(len(x))
        chance = np.maximum(padded[at, grade + 1] - padded[at, grade], 1e-12)
        slope = padded * (1 - padded)
        up, down = slope[at, grade + 1] / chance, slope[at, grade] / chance
        by_score = up - down  # of the loss
        by_cut = np.zeros(levels + 1)
        np.add.at(by_cut, grade + 1, -up)
        np.add.at(by_cut, grade, down)
        by_cut = by_cut[1:levels]
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(col, by_score[row], features) / n + ridge * w if len(col) else ridge * w, [tail[0] / n], tail[1:] * gaps / n]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    cuts = params[features] + np.concatenate([[0.0], np.cumsum(np.exp(params[features + 1 :]))])
    return params[:features], cuts


def fit_severity(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = TRAINING_ROWS,
    features: int = FEATURES,
    grades: int = GRADES,
    least_z: float = LEAST_Z,
) -> SeverityModel | None:
    """The model from at most ``rows`` labelled documents of each class; None without both classes.

    Labels are binary, so the severity of a toxic document is graded by how many of the words
    that mark toxic documents it holds, cut at equal shares: grades 1 to ``grades - 1``. What
    comes to the driver is bounded: ``features`` words and the sample's rows of those.
    """
    words = staged(labelled_words(docs, labels, rows))
    if {r[0] for r in words.select("toxic").distinct().collect()} != {0, 1}:
        return None
    best = marked(words, features, least_z)
    keys = np.array([w for w, _ in best], np.int64).view(np.uint64)
    toxic_word = np.array([z > 0 for _, z in best], bool)
    wanted = F.array_intersect("words", F.lit([w for w, _ in best]).cast("array<long>")) if best else F.array().cast("array<long>")
    rows_ = words.select("toxic", wanted.alias("found")).collect()
    index = HashIndex(keys)
    x = [np.sort(index.find(np.array(r["found"], np.int64).view(np.uint64))) for r in sorted(rows_, key=lambda r: (r[0], sorted(r[1])))]
    toxic = np.array(sorted(r["toxic"] for r in rows_))
    evidence = np.array([toxic_word[v].sum() for v in x])
    cuts = np.quantile(evidence[toxic == 1], [k / (grades - 1) for k in range(1, grades - 1)], method="lower")
    grade = np.where(toxic == 1, 1 + (evidence[:, None] > cuts[None, :]).sum(1), 0)
    weights, thresholds = fit_ordinal(x, grade, len(keys), grades)
    return SeverityModel(keys, weights, thresholds)


def severity(docs: DataFrame, model: SeverityModel | None, reject_at: float = REJECT_AT) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``p_toxic`` = P(grade >= 1), ``grade``, ``toxic``.

    One row per row of ``docs``, whatever its id; a null or empty text has no features and
    takes the model's base chance. ``toxic`` is ``p_toxic >= reject_at``. Without a model every
    severity is 0. A word counts once per text, so length alone moves nothing.
    """
    hasher = WordHasher("plain", PREFIXES)
    keys = model.keys if model else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(keys)
        for batch in batches:
            for low, high, hashes, bounds in hashed_words(batch.column("text"), hasher):
                n = high - low
                if model:
                    at = index.find(hashes)
                    hit = np.flatnonzero(at >= 0)
                    owner = np.searchsorted(bounds, hit, side="right") - 1
                    pairs = np.unique(owner * len(keys) + at[hit])
                    score = np.bincount(pairs // len(keys), model.weights[pairs % len(keys)], n)
                    above = model.grades(score)
                else:
                    above = np.zeros((n, 1))
                each = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[low:high],
                        pa.array(above.sum(1)),
                        pa.array(above[:, 0]),
                        pa.array((each[:, :-1] - each[:, 1:]).argmax(1).astype(np.int32)),
                        pa.array(above[:, 0] >= reject_at),
                    ],
                    ["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, p_toxic double, grade int, toxic boolean"
    return texts(docs, "doc_id").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: SeverityModel | None, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, columns unchanged.

    A row is judged by its own text; rows that share an id with a rejected one go with it.
    Rows without an id are kept.
    """
    bad = severity(docs, model, reject_at).where("toxic AND doc_id IS NOT NULL").select("doc_id")
    return matching(docs, staged(bad), "doc_id", "left_anti")
