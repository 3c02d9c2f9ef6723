"""Quality classifier: a weak-label model of overlapping heuristics, and a scorer trained on its posteriors.

Each heuristic calls a text good or bad, or abstains. Expectation-maximisation over the counts of
all vote patterns estimates how often each heuristic gives each answer on good and on bad texts,
without any labelled text. The posteriors of a sample then train a linear scorer over hashed
features of the words, which judges every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WordHasher, list_array, matching, staged, text_blocks, texts
from tablewright.llm.quality_rules import SPACE, bound_to, word_hashes, words

FEATURES = 1 << 16
# A word of letters with one mark of punctuation at most, and the end of a word with an odd sign there.
PLAIN_WORD = r"(?<![^\t-\r ])\p{L}++[.,;:!?]?+(?![^\t-\r ])"
TAILED_WORD = r"[#*$%&|<>~^+=](?![^\t-\r ])"
# Documents that the scorer is fitted on, at most: those with the smallest hashes of their ids.
TRAINING_ROWS = 20_000
# Tasks that a round of the fit has at most; the weights do not depend on it.
TRAINING_TASKS = 8
# Passes over the sample at most; the fit mostly settles after some 20.
ROUNDS = 100
KEEP_AT = 0.5


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def called(value: Column, good: Column, bad: Column) -> Column:
    """``g``, ``b``, or ``-`` where the heuristic abstains, also on a null value."""
    return F.when(value.isNull(), "-").when(good, "g").when(bad, "b").otherwise("-")


def votes(text: Column) -> Column:
    """The heuristics' votes, one letter each, in the order in which they stand here."""

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def measured(h: Column) -> Column:
        n = F.size(h)
        pairs = F.array_distinct(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        values = (
            n,
            share(F.char_length(text) - n + 1, n),
            share(count(r"[#*$%&|<>{}^~=+\\!]"), n),
            share(count("[A-Z]{2}"), n),
            F.when(n >= 50, share(F.size(F.array_distinct(h)), n)),
            F.when(n >= 50, share(F.size(pairs), n)),
            share(count(PLAIN_WORD), n),
            share(count(TAILED_WORD), n),
            F.when(n >= 20, share(count("[.!?]"), n)),
            bound_to(lines, lambda x: F.when(F.size(x) >= 3, share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))),
        )
        return F.array(*[v.cast("double") for v in values])

    def told(v: Column) -> Column:
        n, length, symbols, upper, different, paired, plain, tailed, stops, repeated = (v[i] for i in range(10))
        return F.concat(
            called(n, n >= 30, n < 4),
            called(length, length.between(3, 10), (length < 2) | (length > 14)),
            called(symbols, symbols < 0.05, symbols > 0.3),
            called(upper, upper < 0.1, upper > 0.8),
            called(different, different > 0.45, different < 0.3),
            called(paired, paired > 0.85, paired < 0.6),
            called(plain, plain > 0.8, plain < 0.5),
            called(tailed, tailed < 0.02, tailed > 0.2),
            called(stops, stops.between(0.02, 0.4), (stops < 0.005) | (stops > 0.8)),
            called(repeated, repeated == 0, repeated > 0.3),
        )

    return bound_to(bound_to(word_hashes(words(text)), measured), told)


@dataclass(frozen=True)
class LabelModel:
    prior: float  # share of good texts
    answers: np.ndarray  # class (bad, good) x heuristic x answer (b, g, -)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """P(good) of each vote pattern."""
        if not patterns:
            return np.zeros(0)
        at = np.array([["bg-".index(c) for c in p] for p in patterns])
        logs = np.log(self.answers)[:, np.arange(at.shape[1]), at].sum(2) + np.log([1 - self.prior, self.prior])[:, None]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_labels(patterns: list[str], counts: list[int], rounds: int = 200, strength: float = 0.1) -> LabelModel:
    """Expectation-maximisation from the majority of votes; no patterns give even chances.

    Abstaining says nothing about the class, so its rate is one for both classes. The answers have
    a prior that weighs as much as the share ``strength`` of all texts: a heuristic calls a good
    text bad in 2 of 100 cases and a bad one in every second, as each knows one kind of bad text.
    """
    heuristics = len(patterns[0]) if patterns else 1
    answers = np.full((2, heuristics, 3), 1 / 3)
    if not patterns:
        return LabelModel(0.5, answers)
    at = np.array([["bg-".index(c) for c in p] for p in patterns])
    n = np.array(counts, float)
    given = np.stack([(at == a) for a in range(3)], 2)
    lead = (at == 1).sum(1) - 2.0 * (at == 0).sum(1)
    good = 1 / (1 + np.exp(-lead))
    silent = (n[:, None] * given[:, :, 2]).sum(0) / n.sum()
    for _ in range(rounds):
        prior = float(np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3))
        for y, weight in ((0, n * (1 - good)), (1, n * good)):
            prior_said = strength * n.sum() * np.array([[0.5, 0.5], [0.02, 0.98]][y])
            said = (weight[:, None, None] * given[:, :, :2]).sum(0) + prior_said
            answers[y, :, :2] = said / said.sum(1, keepdims=True) * (1 - silent)[:, None] + 1e-9
            answers[y, :, 2] = silent + 1e-9
        before, good = good, LabelModel(prior, answers).posterior(patterns)
        if np.abs(good - before).max() < 1e-9:
            break
    return LabelModel(prior, answers)


class TextFeatures:
    """Hashed features of each word: itself, its last three bytes, its last byte, its first byte's case."""

    def __init__(self, size: int) -> None:
        self.hasher, self.size = WordHasher(fold=False), size

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers, from 1, and where each text's begin."""
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        word = ~self.hasher.between[data]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        whole = self.hasher.spans(data, start, [end])[0]
        tail = self.hasher.spans(data, np.maximum(start, end - 3), [end])[0] ^ np.uint64(0x5851F42D4C957F2D)
        final = data[end - 1].astype(np.uint64) + np.uint64(1 << 20)
        case = ((data[start] >= 65) & (data[start] <= 90)).astype(np.uint64) + np.uint64(1 << 21)
        rows = np.stack([whole, tail, final * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7), case * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(9)], 1)
        return (rows % np.uint64(self.size - 1)).astype(np.int32).ravel() + np.int32(1), 4 * np.searchsorted(start, bounds)


def scores(weights: np.ndarray, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """P(good) of each text: the bias and the mean weight of its features; without words the bias."""
    sums = np.concatenate([[0.0], np.cumsum(weights[features])])
    n = np.diff(bounds)
    mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(np.clip(-(weights[0] + mean), -700, 700)))


def different(features: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different features, where each text's begin, and their shares in the text."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    pairs, count = np.unique(row * size + features, return_counts=True)
    row = pairs // size
    return (pairs % size).astype(np.int32), np.searchsorted(row, np.arange(len(n) + 1)), count / n[row]


def sums(sample: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``part``, of ``size`` numbers; how rows are dealt changes its rounding only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "value"])

    found = sample.coalesce(TRAINING_TASKS).mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value")).toArrow()
    out = np.zeros(size)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def train(sample: DataFrame, size: int, rounds: int, ridge: float = 1e-3, settled: float = 1e-3) -> np.ndarray:
    """Weights of a ridge logistic regression on (good, features, shares), the bias at 0.

    Each round sums the gradient over the whole sample and the driver takes a quasi-Newton step
    (L-BFGS), until the gradient has fallen to the share ``settled`` of the first one, or after
    ``rounds`` passes. The loss is convex and its sums do not depend on how the sample is dealt
    out, and so neither do the weights. Features are scaled by their root mean square.
    """
    spark = sample.sparkSession

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(batch)), batch.column("features").value_lengths().to_numpy())
        return (batch.column("good").to_numpy(), row, *(batch.column(c).flatten().to_numpy() for c in ("features", "shares")))

    def measured(batch: pa.RecordBatch) -> np.ndarray:
        _, _, features, shares = read(batch)
        return np.append(np.bincount(features, shares**2, size), len(batch))

    squares = sums(sample, size + 1, measured)
    n = squares[size]
    if not n:
        return np.zeros(size)
    scale = 1 / np.sqrt(squares[:size] / n + 1e-6)
    scale[0] = 1

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(at * scale)

        def part(batch: pa.RecordBatch) -> np.ndarray:
            good, row, features, shares = read(batch)
            odds = shared.value[0] + np.bincount(row, shared.value[features] * shares, len(good))
            error = 1 / (1 + np.exp(np.clip(-odds, -700, 700))) - good
            gradient = np.bincount(features, error[row] * shares, size)
            gradient[0] = error.sum()
            return np.append(gradient, (np.logaddexp(0, odds) - good * odds).sum())

        found = sums(sample, size + 1, part) / n
        shared.unpersist()
        own = ridge * np.append(0.0, at[1:])
        return found[size] + own @ at / 2, found[:size] * scale + own

    at = np.zeros(size)
    value, slope = loss(at)
    first, passes = np.linalg.norm(slope), 1
    moves: list[tuple[np.ndarray, np.ndarray]] = []  # the last changes of place and slope
    while np.linalg.norm(slope) > settled * first and passes < rounds:
        step, shares = slope.copy(), []
        for moved, turned in reversed(moves):
            shares.append(moved @ step / (moved @ turned))
            step -= shares[-1] * turned
        step *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / first
        for (moved, turned), share_ in zip(moves, reversed(shares), strict=True):
            step += (share_ - turned @ step / (moved @ turned)) * moved
        length = 1.0
        while passes < rounds:
            passes += 1
            to, new, turned = at - length * step, *loss(at - length * step)
            if new <= value - 1e-4 * length * (slope @ step) or length < 1e-6:
                break
            length /= 2
        if new >= value:  # nothing is left to gain but rounding
            break
        if (to - at) @ (turned - slope) > 1e-12:
            moves = [*moves[-9:], (to - at, turned - slope)]
        at, value, slope = to, new, turned
    return at * scale


def sampled(whole: DataFrame, marked: DataFrame, rows: int) -> DataFrame:
    """(_key, text): at most ``rows`` documents, those with the smallest keys; equal rows are one."""
    keys = marked.select("_key").orderBy("_key").limit(rows)
    return matching(whole, keys, "_key", "left_semi").dropDuplicates(["_key"]).select("_key", "text")


def quality_scores(
    docs: DataFrame, rows: int = TRAINING_ROWS, size: int = FEATURES, rounds: int = ROUNDS, keep_at: float = KEEP_AT
) -> DataFrame:
    """One row per document: ``doc_id``, ``votes``, ``posterior``, ``score``, ``kept``.

    ``votes`` has a letter for each heuristic (good, bad, abstains), ``posterior`` is the weak-label
    model's P(good), ``score`` the linear scorer's; ``kept`` is ``score >= keep_at``. The counts
    behind the weak-label model are of all documents and have at most 3 to the number of heuristics
    rows; the scorer is fitted on at most ``rows`` documents, those with the smallest hashes, equal
    rows taken as one. Null and repeated ids keep their rows; a null or empty text has no words and
    the scorer's base chance. Other columns are ignored; no documents, no rows.
    """
    spark = docs.sparkSession
    whole = texts(docs, "doc_id").withColumn("_key", F.xxhash64("doc_id", "text"))
    # The votes are taken once; equal ids and texts have equal votes.
    marked = staged(whole.select("_key", votes(F.col("text")).alias("votes")).groupBy("_key").agg(F.first("votes").alias("votes"), F.count("*").alias("n")))
    counted = [(r[0], r[1]) for r in marked.groupBy("votes").agg(F.sum("n")).collect()]
    model = fit_labels([p for p, _ in counted], [n for _, n in counted])
    patterns = [p for p, _ in counted]
    chances = dict(zip(patterns, model.posterior(patterns).tolist(), strict=True))

    picked = staged(sampled(whole, marked, rows)).join(marked, "_key")
    shared = spark.sparkContext.broadcast(chances)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = TextFeatures(size)
        for batch in batches:
            good = np.array([shared.value[v] for v in batch.column("votes").to_pylist()])
            for low, high, data, bounds in text_blocks(batch.column("text")):
                found, cuts, parts = different(*maker.of(data, bounds), size)
                lists = [list_array(found, cuts, pa.int32()), list_array(parts, cuts, pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(good[low:high]), *lists], ["good", "features", "shares"])

    sample = staged(picked.select("votes", "text").mapInArrow(features, "good double, features array<int>, shares array<double>"))
    weights = spark.sparkContext.broadcast(train(sample, size, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = TextFeatures(size)
        for batch in batches:
            for low, high, data, bounds in text_blocks(batch.column("text")):
                score = scores(weights.value, *maker.of(data, bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high], batch.column("_key")[low:high], pa.array(score)], ["doc_id", "_key", "score"]
                )

    judged = whole.select("doc_id", "_key", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _key long, score double"
    )
    told = spark.createDataFrame([(p, c) for p, c in chances.items()], "votes string, posterior double")
    marked = marked.select("_key", "votes").join(F.broadcast(told), "votes")
    return judged.join(marked, "_key").select("doc_id", "votes", "posterior", "score", (F.col("score") >= keep_at).alias("kept"))
