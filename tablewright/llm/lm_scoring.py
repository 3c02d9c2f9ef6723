"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Every token falls into one of 4096 leaves: the most frequent training tokens have a leaf each, all
others share the last leaves by hash. The leaves are the ends of a tree of choices among 16; so are,
below each shared leaf, its tokens and one place for what was never seen. So

    P(token | context) = P(leaf | context) * P(token | leaf, context)

is a product of softmaxes over 16, and all tokens together have probability 1. Each softmax starts
from the shares of its branches in the training tokens, below the leaves by counts plus one, and adds
hashed features of its node and the context's words: the last, the last two, and, skipping, the one
before the last and the last with the third.

The weights above the leaves are learned over all tasks and sent to them. Those below never leave
their leaf: what a shared leaf holds of all texts is dealt to one task, which builds the tree,
learns, and scores, so that tree and weights grow with the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.llm.common import HashIndex, WordHasher, hashed_words, heaviest, mixed, staged, texts
from tablewright.session import is_scan

CLASSES = 16
LEAVES = CLASSES**3
SHARED_LEAVES = LEAVES // 8
# Rows of the weights of the first choice, and of those after it that lead to the leaves.
CLASS_FEATURES = 1 << 14
LEAF_FEATURES = 1 << 16
# Most frequent tokens whose counts every task has; all others are counted in their leaf's task.
KNOWN_TOKENS = 1 << 20
ROUNDS = 2
BATCH = 8192
RATE = 0.2
END = np.uint64(0xA24BAED4963EE407)
BEFORE = np.uint64(0x2545F4914F6CDD1D)
ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
# Rows of weights that travel together.
SLAB = 128
# Texts that one record of dealt tokens is about, at most; named by 16 bits in it.
SPOTS = 1 << 15
UNKNOWN = np.uint32(1 << 31)


def shared_leaf(token: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(token, 33), F.lit(SHARED_LEAVES)) + (LEAVES - SHARED_LEAVES)


def with_ends(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens, each text closed by the end token, and where each text begins."""
    n = len(bounds) - 1
    out = np.full(len(hashes) + n, END, np.uint64)
    text = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(hashes)) + text] = hashes
    return out, bounds + np.arange(n + 1)


@dataclass(frozen=True)
class Counts:
    """What the training texts hold: ``total`` tokens, ``kinds`` of them distinct."""

    total: int
    kinds: int
    tokens: np.ndarray  # the most frequent, the first ones with a leaf each
    counts: np.ndarray
    leaf_total: np.ndarray


def count_tokens(training: DataFrame) -> DataFrame:
    """(token, n): every distinct token of the training texts; batches are counted before the shuffle."""
    hasher = WordHasher()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [with_ends(h, b)[0] for _, _, h, b in hashed_words(batch.column(0), hasher)]
            found, n = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    seen = training.select("text").mapInArrow(run, "token long, n long")
    return seen.groupBy("token").agg(F.sum("n").alias("n"))


def summary(vocabulary: DataFrame, known: int) -> Counts:
    """Totals, the most frequent tokens and the leaves' sums of a staged vocabulary."""
    total, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, counts = heaviest(vocabulary, "token", "n", known)
    order = np.lexsort((tokens, -counts))
    tokens, counts = tokens[order].view(np.uint64), counts[order]
    own = LEAVES - SHARED_LEAVES
    leaf_total = np.zeros(LEAVES, np.int64)
    leaf_total[: len(tokens[:own])] = counts[:own]
    for leaf, n in vocabulary.groupBy(shared_leaf(F.col("token")).alias("leaf")).agg(F.sum("n")).collect():
        leaf_total[leaf] = n
    np.subtract.at(leaf_total, shared(tokens[:own]), counts[:own])
    return Counts(total, kinds, tokens, counts, leaf_total)


def shared(tokens: np.ndarray) -> np.ndarray:
    """The leaves of tokens that have none of their own."""
    return ((tokens >> np.uint64(33)) % np.uint64(SHARED_LEAVES)).astype(np.int64) + (LEAVES - SHARED_LEAVES)


def back(words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The last word before each, the one before that, and the third."""
    out = []
    for k in (1, 2, 3):
        own = np.full(len(words), BEFORE)
        own[k:] = words[:-k] if len(words) > k else own[k:]
        for step in range(k):
            at = starts[:-1] + step
            own[at[at < starts[1:]]] = BEFORE
        out.append(own)
    return out


def combined(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """A hash for each feature of contexts: the last word, the last two, the one before, the last and third."""
    last = one * ODD[0]
    return np.stack([last, mixed(last ^ (two * ODD[1])), two * ODD[2], mixed(last + three * ODD[3])])


def weight_rows(contexts: np.ndarray, node: np.ndarray | int, first: int, size: int) -> np.ndarray:
    """Rows of the weights of nodes in their contexts: the node's own, then one for each feature."""
    out = np.empty((len(contexts) + 1, contexts.shape[1]), np.int64)
    out[0] = node
    own = np.asarray(node).astype(np.uint64) * ODD[4]
    for k, hashes in enumerate(contexts):
        spread = ((hashes ^ own) * ODD[0]) >> np.uint64(32)
        out[k + 1] = (spread * np.uint64(size - first) >> np.uint64(32)).astype(np.int64) + first
    return out.T


class Features:
    """Rows of a table of ``size`` weights for the choice that every token begins with."""

    def __init__(self, size: int) -> None:
        self.size = size

    def of(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Feature numbers of each token's context, the first being always 0."""
        return weight_rows(combined(*back(words.astype(np.uint64), starts)), 0, 1, self.size)


class Branches:
    """The tree of choices among 16 with the fewest of them on average that leads to ends of given weights, the heaviest first.

    The 16 lightest ends or nodes are joined to a node, again and again; node 0 is the root.
    """

    def __init__(self, weight: np.ndarray) -> None:
        n, light = len(weight), weight[::-1].tolist()
        sums: list[float] = []
        end_up, node_up = [], []  # the node above and the place in it, lightest first
        i = j = 0
        size = 2 + (n - 2) % (CLASSES - 1)  # so that all nodes after the first are full
        while n - i + len(sums) - j > 1:
            total = 0.0
            for place in range(size):
                if j == len(sums) or (i < n and light[i] <= sums[j]):
                    total += light[i]
                    end_up.append((len(sums), place))
                    i += 1
                else:
                    total += sums[j]
                    node_up.append((len(sums), place))
                    j += 1
            sums.append(total)
            size = CLASSES
        count = len(sums)
        above, places = np.array([(count, 0), *node_up[::-1]], np.int64).T  # nothing is above the root
        above = count - 1 - above
        node, outcome = np.array(end_up[::-1], np.int64).reshape(-1, 2).T
        node, chain = count - 1 - node, []
        while (node >= 0).any():
            chain.append((node, outcome))
            node, outcome = np.where(node >= 0, above[node], -1), places[node]
        depth = sum(((node >= 0).astype(np.int64) for node, _ in chain), np.zeros(n, np.int64))
        nodes, outcomes = np.full((len(chain), n), -1, np.int32), np.zeros((len(chain), n), np.uint8)
        for step, (node, outcome) in enumerate(chain):
            at = np.flatnonzero(node >= 0)
            nodes[depth[at] - 1 - step, at], outcomes[depth[at] - 1 - step, at] = node[at], outcome[at]
        self.nodes, self.outcomes = list(nodes), list(outcomes)  # per level the node of each end, or -1
        share = np.zeros(count * CLASSES)
        for node, outcome in zip(nodes, outcomes, strict=True):
            share += np.bincount((node * CLASSES + outcome)[node >= 0], weight[node >= 0], count * CLASSES)
        share = share.reshape(-1, CLASSES)
        self.shares = np.log(np.maximum(share / share.sum(1, keepdims=True), 1e-30)).astype(np.float32)

    def choices(self, contexts: np.ndarray, ends: np.ndarray, size: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all levels from one on: the token whose choice it is, the rows of the weights, the outcome."""
        each = [(np.flatnonzero(node[ends] >= 0), node, outcome) for node, outcome in zip(self.nodes[level:], self.outcomes[level:], strict=True)]
        none = np.zeros(0, np.int64)
        token = np.concatenate([none, *[t for t, _, _ in each]])
        node = np.concatenate([none, *[n[ends[t]] for t, n, _ in each]])
        outcome = np.concatenate([none, *[o[ends[t]] for t, _, o in each]])
        return token, weight_rows(contexts[:, token], node, len(self.shares), size), outcome


def leaf_tree(leaf_total: np.ndarray) -> tuple[Branches, np.ndarray]:
    """The choices that lead to the leaves that hold tokens or may, and the end that each leaf is."""
    weight = leaf_total.astype(np.float64)
    weight[LEAVES - SHARED_LEAVES :] += 0.5
    order = np.argsort(-weight, kind="stable")[: np.count_nonzero(weight)]
    end = np.full(LEAVES, -1)
    end[order] = np.arange(len(order))
    return Branches(weight[order]), end


def weights_of(first: np.ndarray, more: int = 0) -> np.ndarray:
    """The given rows of weights and ``more`` of zeros, none of which lies in two lines of the processor's cache."""
    size = 4 * CLASSES * (len(first) + more)
    raw = np.zeros(size + 64, np.uint8)
    out = raw[-raw.ctypes.data % 64 :][:size].view(np.float32).reshape(-1, CLASSES)
    out[: len(first)] = first
    return out


@dataclass
class Model:
    by_class: np.ndarray  # a row for the shares of the first choice, hashed features after it
    by_leaf: np.ndarray  # a row for the shares of each node, hashed features after them

    @classmethod
    def start(cls, counts: Counts) -> Model:
        """The leaves' shares in the training tokens, whatever the context."""
        model = cls(np.zeros((CLASS_FEATURES, CLASSES), np.float32), np.zeros((LEAF_FEATURES, CLASSES), np.float32))
        shares = leaf_tree(counts.leaf_total)[0].shares
        model.by_class[0] = shares[0]
        model.by_leaf[: len(shares)] = shares
        return model

    def flat(self) -> np.ndarray:
        return np.concatenate([self.by_class.ravel(), self.by_leaf.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        """The model of its numbers, a fifth of them by class."""
        n = len(flat) // 5
        return cls(weights_of(flat[:n].reshape(-1, CLASSES)), weights_of(flat[n:].reshape(-1, CLASSES)))


def exponentials(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the sums of its features' weights, their exponentials, and the sum of these."""
    score = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        score += weights.take(rows[:, k], axis=0)
    ones = np.ones(score.shape[1], score.dtype)
    with np.errstate(over="ignore"):
        each = np.exp(score)
        total = each @ ones
    if len(total) and not (total.min() > 1e-30 and total.max() < 1e30):
        score -= score.max(1, keepdims=True)
        each = np.exp(score)
        total = each @ ones
    return score, each, total


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log chances of each row's outcomes: the sum of its features' weights, normalised."""
    score, _, total = exponentials(weights, rows)
    return score - np.log(total)[:, None]


def chances(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log chances, to base 10, of each row's target."""
    score, _, total = exponentials(weights, rows)
    return (score.ravel().take(np.arange(len(score)) * CLASSES + target) - np.log(total)) / np.log(10.0)


def run_sums(values: np.ndarray, source: np.ndarray, first: np.ndarray, size: np.ndarray, short: int = 8) -> np.ndarray:
    """The sums of ``values`` over runs of ``source``, the longest first.

    Most runs are short: they are added up place by place, and of long ones what is beyond as a whole.
    """
    sums = values.take(source[first], axis=0)
    for k in range(1, short):
        n = int(np.searchsorted(-size, -k))
        if not n:
            break
        sums[:n] += values.take(source[first[:n] + k], axis=0)
    n = int(np.searchsorted(-size, -short))
    if n:
        more = size[:n] - short
        begin = np.cumsum(more) - more
        at = np.arange(more.sum()) + np.repeat(first[:n] + short - begin, more)
        sums[:n] += np.add.reduceat(values.take(source[at], axis=0), begin, axis=0)
    return sums


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step along the gradient of the batch's likelihood, each feature with its own rate.

    The shares, a row's first weights, stay; the features learn what differs from them.
    """
    n = len(target)
    if not n:
        return
    ones = np.ones(CLASSES, np.float32)
    _, error, total = exponentials(weights, rows)
    error *= (-1.0 / total)[:, None]
    error.ravel()[np.arange(n) * CLASSES + target] += 1.0
    flat = rows[:, 1:].T.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable") if len(weights) <= 1 << 16 else np.argsort(flat.astype(np.int32))
    flat = flat[order]
    first = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1])
    size = np.diff(np.append(first, len(flat)))
    longest = np.argsort((255 - np.minimum(size, 255)).astype(np.uint8), kind="stable")
    first, size = first[longest], size[longest]
    touched = flat[first]
    source = np.tile(np.arange(n), rows.shape[1] - 1)[order]
    gradient = run_sums(error, source, first, size)
    some = int(np.searchsorted(-size, -1))  # runs of more than one row; the others' squares are those of their row
    own = np.square(error) @ ones
    square = squares[touched] + np.concatenate([np.square(gradient[:some]) @ ones, own[source[first[some:]]]])
    squares[touched] = square
    gradient *= (np.float32(rate) / np.sqrt(square + np.float32(1e-8)))[:, None]
    gradient += weights.take(touched, axis=0)
    whole = f"V{weights.itemsize * CLASSES}"  # a row at once, which is faster
    weights.view(whole)[touched, 0] = gradient.view(whole)[:, 0]


class Reader:
    """Places of hashed tokens among the known ones, their leaves, and the rows of the weights that tell the leaves."""

    def __init__(self, tokens: np.ndarray, leaf_total: np.ndarray) -> None:
        self.index, self.own = HashIndex(tokens), LEAVES - SHARED_LEAVES
        self.tree, self.end = leaf_tree(leaf_total)

    def leaf(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where((at >= 0) & (at < self.own), at, shared(tokens))

    def choices(self, model: Model, contexts: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the choices that lead to the leaves: the table, the tokens, the rows of the weights, the outcomes."""
        ends = self.end[leaf]
        yield "by_class", np.arange(len(ends)), weight_rows(contexts, 0, 1, len(model.by_class)), self.tree.outcomes[0][ends]
        yield "by_leaf", *self.tree.choices(contexts, ends, len(model.by_leaf), 1)


def train(training: DataFrame, counts: Counts, rounds: int, rate: float = RATE) -> Model:
    """The model after ``rounds`` of distributed gradient updates, one pass over all training texts.

    In each round every task starts from the common weights, updates its own copy batch by batch
    over its share of the round's texts, and gives the change of each row that it touched; the
    changes are averaged by the number of tokens behind them. What comes to the driver is the
    model's size, whatever the number of tasks.
    """
    spark = training.sparkSession
    model = Model.start(counts)
    hasher = WordHasher()
    for turn in range(rounds):
        common = spark.sparkContext.broadcast((model.flat(), counts.tokens[: LEAVES - SHARED_LEAVES], counts.leaf_total))

        def run(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            flat, tokens, leaf_total = common.value
            mine, reader = Model.of(flat), Reader(tokens, leaf_total)
            squares = {"by_class": np.zeros(len(mine.by_class), np.float32), "by_leaf": np.zeros(len(mine.by_leaf), np.float32)}
            n = 0
            for batch in batches:
                for _, _, hashes, bounds in hashed_words(batch.column(0), hasher):
                    words, starts = with_ends(hashes, bounds)
                    leaf = reader.leaf(words, reader.index.find(words))
                    before = back(words, starts)
                    for a in range(0, len(words), BATCH):
                        part = slice(a, a + BATCH)
                        for table, _, rows, target in reader.choices(mine, combined(*[b[part] for b in before]), leaf[part]):
                            descend(getattr(mine, table), squares[table], rows, target, rate)
                    n += len(words)
            change = (mine.flat() - flat).reshape(-1, CLASSES) * np.float32(n)
            behind = (np.concatenate(list(squares.values())) > 0) * np.float32(n)
            slabs = np.concatenate([change, behind[:, None].astype(np.float32)], 1).reshape(-1, SLAB * (CLASSES + 1))
            at = np.flatnonzero(slabs.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), packed(slabs[at], np.arange(len(at) + 1) * slabs.shape[1])], ["slab", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, slab in enumerate(batch.column(0).to_pylist()):
                    sums[slab] = sums.get(slab, 0.0) + unpacked(batch.column(1), i, i + 1, np.float32).astype(np.float64)
            for slab, each in sums.items():
                each = each.reshape(SLAB, CLASSES + 1)
                mean = (each[:, :-1] / np.maximum(each[:, -1:], 1.0)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), packed(mean, np.array([0, mean.size]))], ["slab", "sums"])

        part = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).select("text")
        changes = part.mapInArrow(run, "slab int, sums binary").repartition("slab").mapInArrow(add, "slab int, sums binary").toArrow()
        flat = model.flat().reshape(-1, SLAB * CLASSES)
        for slab, mean in zip(changes.column(0).to_pylist(), changes.column(1).to_pylist(), strict=True):
            flat[slab] += np.frombuffer(mean, np.float32)
        model = Model.of(flat.ravel())
        common.unpersist()
    return model


# --- What the shared leaves hold, dealt to a task each ------------------------------------
# Records of three kinds go one way: of the texts of a block, of a leaf's vocabulary, and of a block's tokens
# in a leaf. Their numbers lie packed in binary columns, so that a record costs little beside them.
PACKED = 6


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of the numbers between the cuts."""
    values = np.ascontiguousarray(values)
    at = pa.py_buffer((np.asarray(cuts) * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, at, pa.py_buffer(values)])


def cuts_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def unpacked(column: pa.Array, low: int, high: int, kind: type) -> np.ndarray:
    """The numbers of some rows of packed values, one after the other."""
    at, data = cuts_of(column), column.buffers()[2]
    if data is None or at[high] == at[low]:
        return np.zeros(0, kind)
    return np.frombuffer(data, np.uint8)[at[low] : at[high]].copy().view(kind)


def record_type(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"target long, kind int, block long, n int, ids array<{kind}>, " + ", ".join(f"b{k} binary" for k in range(PACKED))


def records(target, kind: int, block, n, ids: pa.Array, *columns: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows with one list of ``ids`` in the first, others none."""
    size = len(target)
    lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * size, pa.int32()), ids)
    full = [packed(*c) for c in columns] + [packed(np.zeros(0, np.uint8), np.zeros(size + 1, np.int64))] * (PACKED - len(columns))
    plain = [pa.array(np.broadcast_to(np.asarray(v), size).astype(t)) for v, t in ((target, np.int64), (kind, np.int32), (block, np.int64), (n, np.int32))]
    return pa.RecordBatch.from_arrays([*plain, lists, *full], ["target", "kind", "block", "n", "ids", *[f"b{k}" for k in range(PACKED)]])


def dealt(docs: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """Per block of texts what the model gives for the leaves, and for each shared leaf the tokens that fell into it.

    A token goes with its text and its context: the last words hashed to 32, 16 and 16 bits.
    """
    hasher = WordHasher()
    common = docs.sparkSession.sparkContext.broadcast((counts.tokens, counts.counts, counts.leaf_total, model.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen_before, leaf_total, flat = common.value
        own, reader = Model.of(flat), Reader(tokens, leaf_total)
        log_count = np.append(np.log10(seen_before + 1.0), 0.0)  # the last for tokens not known
        for batch in batches:
            for a in range(0, len(batch), SPOTS):
                piece = batch.slice(a, SPOTS)
                for low, high, hashes, bounds in hashed_words(piece.column("text"), hasher):
                    words, starts = with_ends(hashes, bounds)
                    at = reader.index.find(words)
                    leaf = reader.leaf(words, at)
                    before = back(words, starts)
                    chance = np.zeros(len(words))
                    for b in range(0, len(words), BATCH):
                        part = slice(b, b + BATCH)
                        for table, token, rows, target in reader.choices(own, combined(*[x[part] for x in before]), leaf[part]):
                            chance[part] += np.bincount(token, chances(getattr(own, table), rows, target), len(chance[part]))
                    first, one = starts[:-1], np.arange(2) * (high - low)
                    held = piece.column("held_out")[low:high].to_numpy(zero_copy_only=False)
                    block = piece.column("_row")[low].as_py()
                    yield records(
                        [-1 - block], 0, block, 0, piece.column("doc_id")[low:high],
                        (np.diff(starts), one), (np.add.reduceat((at >= 0).astype(np.int64), first), one),
                        (np.add.reduceat(log_count[at], first), one), (np.add.reduceat(chance, first), one), (held.astype(np.uint8), one),
                    )
                    spot = np.repeat(np.arange(high - low), np.diff(starts))
                    picked = np.flatnonzero(leaf >= reader.own)
                    key = ((leaf[picked] - reader.own) * 2 + held[spot[picked]]).astype(np.uint16)
                    order = np.argsort(key, kind="stable")
                    picked, key = picked[order], key[order]
                    cuts = np.append(np.flatnonzero(np.diff(key >> 1, prepend=-1)), len(key))
                    if len(cuts) == 1:
                        continue
                    strange = np.flatnonzero(at[picked] < 0)
                    other = np.searchsorted(strange, cuts)
                    names = at[picked].astype(np.uint32)
                    names[strange] = UNKNOWN + (np.arange(len(strange)) - other[np.searchsorted(cuts, strange, side="right") - 1]).astype(np.uint32)
                    trained = np.add.reduceat((key & 1) == 0, cuts[:-1], dtype=np.int32)
                    yield records(
                        leaf[picked[cuts[:-1]]], 2, block, trained, piece.column("doc_id")[:0],
                        (names, cuts), (words[picked[strange]], other), ((before[0][picked] >> np.uint64(32)).astype(np.uint32), cuts),
                        *[((x[picked] >> np.uint64(48)).astype(np.uint16), cuts) for x in before[1:]], (spot[picked].astype(np.uint16), cuts),
                    )

    return docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("_row")).mapInArrow(run, record_type(docs))


def vocabulary_records(vocabulary: DataFrame, docs: DataFrame, counts: Counts, most: int = 1 << 19) -> DataFrame:
    """The tokens of each shared leaf with their counts."""
    own = docs.sparkSession.sparkContext.broadcast(counts.tokens[: LEAVES - SHARED_LEAVES])
    kind = docs.select("doc_id")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            if sum(len(t) for t, _ in held) >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    empty = pa.array([], arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(own.value)
        for tokens, n in gathered(batches):
            rest = index.find(tokens) < 0
            tokens, n = tokens[rest], n[rest]
            leaf = shared(tokens)
            order = np.argsort(leaf.astype(np.uint16), kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(leaf[order], prepend=-1)), len(order))
            if len(cuts) > 1:
                yield records(leaf[order][cuts[:-1]], 1, -1, 0, empty, (tokens[order], cuts), (n[order], cuts))

    return vocabulary.select("token", "n").mapInArrow(run, record_type(docs))


class Tree(Branches):
    """Choices that lead to each of a leaf's tokens, and to what was never seen, the last end."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((tokens, -counts))
        self.index, self.counts = HashIndex(tokens[order]), counts[order]
        super().__init__(np.append(self.counts, 0) + 1.0)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        at = self.index.find(tokens)
        return np.where(at < 0, len(self.counts), at)


class Leaf:
    """A shared leaf: its vocabulary, and its tokens of all texts with their contexts."""

    def __init__(self) -> None:
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.tree: Tree | None = None
        self.held: list[tuple] = []

    def add_words(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.words.append((tokens, counts))

    def add(self, batch: pa.RecordBatch, low: int, high: int, known: np.ndarray) -> None:
        """Keeps the records' tokens; the vocabulary has come before them."""
        if self.tree is None:
            tokens, counts = zip(*self.words, strict=True) if self.words else ((), ())
            self.tree = Tree(np.concatenate([*tokens, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)]))
            self.words = []
        b = [batch.column(f"b{k}") for k in range(PACKED)]
        names = unpacked(b[0], low, high, np.uint32)
        others = unpacked(b[1], low, high, np.uint64)
        size = np.diff(cuts_of(b[0])[low : high + 1]) // 4
        base = (cuts_of(b[1])[low:high] - cuts_of(b[1])[low]) // 8
        strange = names >= UNKNOWN
        words = np.empty(len(names), np.uint64)
        words[~strange] = known[names[~strange]]
        words[strange] = others[(names[strange] - UNKNOWN) + np.repeat(base, size)[strange]]
        trained = batch.column("n").to_numpy()[low:high]
        place = np.arange(len(names)) - np.repeat(np.cumsum(size) - size, size)
        self.held.append(
            (
                self.tree.find(words).astype(np.int32), strange, place < np.repeat(trained, size),
                unpacked(b[2], low, high, np.uint32), unpacked(b[3], low, high, np.uint16), unpacked(b[4], low, high, np.uint16),
                unpacked(b[5], low, high, np.uint16), batch.column("block").to_numpy()[low:high], size,
            )
        )

    def weights(self, rate: float) -> np.ndarray:
        """The shares of the nodes' branches, and after them the features' weights, learned from the training texts."""
        total = sum(int(h[2].sum()) for h in self.held)
        rows = 1 << max(8, (total // 4).bit_length())
        weights = weights_of(self.tree.shares, rows)
        squares = np.zeros(len(weights), np.float32)
        step = min(max(total // 16, 256), BATCH)
        for ends, _, train, *words, _, _, _ in self.held:
            at = np.flatnonzero(train)
            for a in range(0, len(at), step):
                part = at[a : a + step]
                _, rows_, outcome = self.tree.choices(combined(*[w[part].astype(np.uint64) for w in words]), ends[part], len(weights))
                if len(outcome):
                    descend(weights, squares, rows_, outcome, rate)
        return weights

    def scored(self, rate: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of records: blocks, sums of texts and their cuts, and the same of the tokens that no task knew."""
        if not self.held:
            return
        weights = self.weights(rate)
        log_count = np.log10(np.append(self.tree.counts, 0) + 1.0)
        for ends, strange, _, *words, spots, blocks, size in self.held:
            chance = np.zeros(len(ends))
            for a in range(0, len(ends), BATCH):
                part = slice(a, a + BATCH)
                token, rows, outcome = self.tree.choices(combined(*[w[part].astype(np.uint64) for w in words]), ends[part], len(weights))
                if len(token):
                    chance[part] += np.bincount(token, chances(weights, rows, outcome), len(ends[part]))
            record = np.repeat(np.arange(len(size)), size)
            key = (record << 16) | spots
            first = np.flatnonzero(np.diff(key, prepend=-1))
            met = np.flatnonzero(strange & (ends < len(self.tree.counts)))
            begin = np.flatnonzero(np.diff(key[met], prepend=-1))
            yield (
                blocks,
                (spots[first], np.add.reduceat(chance, first).astype(np.float32), np.searchsorted(record[first], np.arange(len(size) + 1))),
                (
                    spots[met[begin]], np.add.reduceat(log_count[ends[met]], begin) if len(met) else np.zeros(0),
                    np.diff(np.append(begin, len(met))), np.searchsorted(record[met[begin]], np.arange(len(size) + 1)),
                ),
            )


def scored(parts: DataFrame, counts: Counts, docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The records of texts, and sums for their texts in place of each record of tokens.

    All of a leaf comes to one task: its vocabulary first, from which the tree is built, then its
    tokens, which are held, 20 bytes each; those of training texts teach the weights before all are scored.
    """
    common = docs.sparkSession.sparkContext.broadcast(counts.tokens)
    empty = pa.array([], arrow_type(docs.select("doc_id")))

    def sums(leaf: Leaf) -> Iterator[pa.RecordBatch]:
        for blocks, (spots, chance, cuts), (met, seen, n, met_cuts) in leaf.scored(rate):
            yield records(
                blocks, 2, blocks, 0, empty,
                (spots, cuts), (chance, cuts), (met, met_cuts), (seen, met_cuts), (n.astype(np.int64), met_cuts),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        number, leaf = -1, Leaf()
        for batch in batches:
            target, kind = batch.column("target").to_numpy(), batch.column("kind").to_numpy()
            plain = int(np.searchsorted(target, 0))
            if plain:
                yield batch.slice(0, plain)
            cuts = [*(plain + np.flatnonzero(np.diff(target[plain:] * 4 + kind[plain:], prepend=-1))).tolist(), len(target)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if target[low] != number:
                    yield from sums(leaf)
                    number, leaf = target[low], Leaf()
                if kind[low] == 1:
                    leaf.add_words(unpacked(batch.column("b0"), low, high, np.uint64), unpacked(batch.column("b1"), low, high, np.int64))
                else:
                    leaf.add(batch, low, high, known)
        yield from sums(leaf)

    sorted_ = parts.repartition("target").sortWithinPartitions("target", "kind", "block")
    return sorted_.mapInArrow(run, record_type(docs))


def added(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per text: the sums of its block's records."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = None, None

        def done() -> pa.RecordBatch:
            held, n, known, seen, chance = sums
            columns = [ids, pa.array(held), *[pa.array(x) for x in (n, known, seen, chance)]]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "seen", "chance"])

        for batch in batches:
            block, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            b = [batch.column(f"b{k}") for k in range(PACKED)]
            first = np.flatnonzero((np.diff(block, prepend=block[0] - 1) != 0) | (np.diff(kinds, prepend=-1) != 0))
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
                if kinds[low] == 0:
                    if ids is not None:
                        yield done()
                    ids = batch.column("ids")[low].values
                    n, known = (unpacked(x, low, high, np.int64) for x in b[:2])
                    seen, chance = (unpacked(x, low, high, np.float64) for x in b[2:4])
                    sums = [unpacked(b[4], low, high, np.uint8) > 0, n, known, seen, chance]
                    continue
                sums[4] += np.bincount(unpacked(b[0], low, high, np.uint16), unpacked(b[1], low, high, np.float32), len(ids))
                met = unpacked(b[2], low, high, np.uint16)
                sums[3] += np.bincount(met, unpacked(b[3], low, high, np.float64), len(ids))
                sums[2] += np.bincount(met, unpacked(b[4], low, high, np.int64), len(ids)).astype(np.int64)
        if ids is not None:
            yield done()

    sorted_ = parts.repartition("block").sortWithinPartitions("block", "kind")
    return sorted_.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, seen double, chance double")


def arrow_type(one: DataFrame) -> pa.DataType:
    """The Arrow type of a table's only column."""
    return to_arrow_schema(one.schema).field(0).type


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN_TOKENS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Held out are documents whose id's crc32, as text, leaves 2 when divided by 7; the others
    train. Scores are log10 probabilities of the text's words and its end: ``base_score`` by
    counts plus one alone, ``score`` by the model. A null id counts as an empty text for the
    rule; repeated ids keep their rows; a null or empty text is its end token. Words are told
    apart by 64-bit hashes. Other columns are ignored; no documents, no rows.
    """
    rule = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    all_ = texts(docs, "doc_id").withColumn("held_out", rule)
    training = all_.where(~F.col("held_out"))
    vocabulary = staged(count_tokens(training))
    counts = summary(vocabulary, known)
    model = train(training, counts, rounds)
    rows = dealt(all_, counts, model)
    if not is_scan(docs):  # a stored table gives its rows in one order, others may not when a task is run again
        rows = staged(rows)
    parts = rows.union(vocabulary_records(vocabulary, all_, counts))
    full = staged(added(scored(parts, counts, all_), all_))
    return full.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("seen") - F.col("n_tokens") * F.log10(F.lit(float(counts.total + counts.kinds + 1)))).alias("base_score"),
        F.col("chance").alias("score"),
    )
