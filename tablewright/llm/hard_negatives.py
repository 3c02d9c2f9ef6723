"""Hard negatives by segment summary filtering.

Vectors are cut into segments, and of each segment the mean and the deviation (the length of what
differs from the mean) are stored, on a coarse and a finer level. The inner product of two
vectors is the sum of the segments' size times means' product, give or take the deviations'
product. So summaries bound a score from both sides: what cannot reach an anchor's list is left
out on the coarse level, what remains is bounded on the finer one, and only what then remains is
scored exactly.

Vectors stand in blocks of bounded size, rows of one label and of like coarse means beside each
other, and a block has its own bounds. Anchors, a hundredth of the rows, travel to the blocks
that may hold something for them; vectors are written once, whatever the number of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import list_array, numbered, staged

SCALE = 256
ANCHORS_EVERY = 100
POSITIVES = NEGATIVES = 5
# A negative's score is from LOW/HIGH of the positive's on, up to it.
LOW, HIGH = 80, 100
# Segments of a vector on each level.
LEVELS = (4, 16)
# Components that a block holds, and scores that are bounded at once.
BLOCK_CELLS = 1 << 22
TILE_CELLS = 1 << 21
# Bytes of block bounds up to which they are sent to every task; beyond it every block is asked.
BOUNDS_BYTES = 32 << 20
# Whole numbers up to which doubles hold every sum exactly.
EXACT = 1 << 53


def cuts(size: int, segments: int) -> np.ndarray:
    """Where the segments of a vector begin."""
    return np.unique(np.arange(segments) * size // segments) if size else np.zeros(0, np.int64)


def summary(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment, the mean times the root of the segment's size, and the deviation.

    Products of the first then are the size times the means' product.
    """
    at = cuts(v.shape[1], segments)
    n = np.diff(np.append(at, v.shape[1]))
    sums = np.add.reduceat(v, at, axis=1)
    rest = v - np.repeat(sums / n, n, axis=1)
    return sums / np.sqrt(n), np.sqrt(np.add.reduceat(rest * rest, at, axis=1))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists_of(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return list_array(values.ravel(), np.arange(len(values) + 1) * values.shape[1], kind)


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): rows with an id, a label and finite components, which become whole numbers."""
    raw, inf = F.col(vector).cast("array<double>"), float("inf")
    whole = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & raw.isNotNull()).where(whole)
    return rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(raw, lambda x: F.floor(x * SCALE)).alias("v"),
    ).where(F.size("v") > 0)


def summarised(rows: DataFrame) -> DataFrame:
    """(id, label, v, size, near, coarse, fine): with means and deviations of both levels.

    ``near`` interleaves the leading bits of the coarse means, so that its order keeps like
    vectors together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                v = matrix(part.column("v")).astype(float)
                levels = [np.hstack(summary(v, n)) for n in LEVELS]
                means = levels[0][:, : levels[0].shape[1] // 2]
                length = np.maximum(np.sqrt((v * v).sum(1)), 1)
                steps = np.clip((means / length[:, None] + 1) * 128, 0, 255).astype(np.int64)
                near = np.zeros(len(v), np.int64)
                for bit in range(7, -1, -1):
                    for k in range(steps.shape[1]):
                        near = near * 2 + ((steps[:, k] >> bit) & 1)
                sizes = pa.array(np.full(len(v), size, np.int32))
                own = [part.column(c) for c in ("id", "label", "v")]
                shown = [*own, sizes, pa.array(near), *[lists_of(x, pa.float64()) for x in levels]]
                yield pa.RecordBatch.from_arrays(shown, ["id", "label", "v", "size", "near", "coarse", "fine"])

    return rows.mapInArrow(
        run, "id long, label long, v array<long>, size int, near long, coarse array<double>, fine array<double>"
    )


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``: a run of bounded length of one size and label, like vectors together."""
    order = [F.col(c) for c in ("size", "label", "near", "id")]
    placed, _ = numbered(rows, *order)
    run = F.floor(F.col("number") / F.floor(F.lit(BLOCK_CELLS) / F.col("size"))).cast("long")
    return placed.withColumn("block", F.xxhash64("size", "label", run)).drop("number", "near")


def block_bounds(rows: DataFrame) -> DataFrame:
    """(block, size, label, low, high, most): the range of the coarse means, and the largest deviations."""
    n = LEVELS[0]
    # A vector shorter than the levels has fewer segments; its places are found by its own halves.
    half = F.size("coarse") / 2
    means = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k < half, F.get("coarse", k)))
    rests = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k < half, F.get("coarse", (k + half).cast("int"))))
    held = rows.select("block", "size", "label", means.alias("m"), rests.alias("d"))

    def folded(column: str, fold) -> Column:
        return F.array(*[F.coalesce(fold(F.get(column, F.lit(k))), F.lit(0.0)) for k in range(n)])

    return held.groupBy("block", "size", "label").agg(
        folded("m", F.min).alias("low"), folded("m", F.max).alias("high"), folded("d", F.max).alias("most")
    )


def asked_blocks(anchors: DataFrame, bounds: DataFrame, own_label: bool) -> DataFrame:
    """``anchors`` with each ``block`` of their own label, or of others, that may hold a score within ``least``..``top``.

    The bounds are a row per block, some million components of vectors each; they are sent to every
    task up to ``BOUNDS_BYTES``. Beyond that the anchors meet all blocks of their size.
    """
    bounds = staged(bounds)
    names = ["block", "size", "label", "low", "high", "most"]
    if bounds.count() * (24 + 24 * LEVELS[0]) > BOUNDS_BYTES:
        other = bounds.select("block", F.col("size").alias("_size"), F.col("label").alias("_label"))
        alike = F.col("label") == F.col("_label")
        met = anchors.join(other, (F.col("size") == F.col("_size")) & (alike if own_label else ~alike))
        return met.drop("_size", "_label")
    held = bounds.select(*names).toArrow()
    table = {c: held.column(c).to_numpy() for c in names[:3]} | {
        c: matrix(held.column(c).combine_chunks()) if held.num_rows else np.zeros((0, LEVELS[0])) for c in names[3:]
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, label = (batch.column(c).to_numpy() for c in ("size", "label"))
            least, top = (batch.column(c).to_numpy() for c in ("least", "top"))
            step = max(1, TILE_CELLS // max(1, len(table["block"])))
            for low in range(0, len(batch), step):
                rows = np.arange(low, min(low + step, len(batch)))
                alike = label[rows][:, None] == table["label"][None, :]
                fit = (size[rows][:, None] == table["size"][None, :]) & (alike if own_label else ~alike)
                upper, lower = np.zeros(fit.shape), np.zeros(fit.shape)
                halves = [np.array(x).reshape(2, -1) for x in batch.column("coarse").take(pa.array(rows)).to_pylist()]
                means, rests = (np.stack([np.pad(h[k], (0, LEVELS[0] - h.shape[1])) for h in halves]) for k in (0, 1))
                for k in range(LEVELS[0]):
                    ends = means[:, k, None] * table["low"][None, :, k], means[:, k, None] * table["high"][None, :, k]
                    rest = rests[:, k, None] * table["most"][None, :, k]
                    upper += np.maximum(*ends) + rest
                    lower += np.minimum(*ends) - rest
                slack = 1e-9 * (1 + np.abs(upper) + np.abs(lower))
                fit &= (upper + slack >= least[rows][:, None]) & (lower - slack <= top[rows][:, None])
                row, at = np.nonzero(fit)
                found = batch.take(pa.array(rows[row]))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(table["block"][at])], [*found.schema.names, "block"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"{fields}, block long")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, row by column, as whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Held:
    """The vectors of a block, with their summaries."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.ids = rows.column("id").to_numpy()
        self.v, self.coarse, self.fine = (matrix(rows.column(c).combine_chunks()) for c in ("v", "coarse", "fine"))

    def scores(self, asked: Held, least: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's row, own row, score) of all pairs that score within ``least``..``top``.

        Bounds leave pairs out level by level, the others are scored.
        """
        half = self.coarse.shape[1] // 2
        middle = asked.coarse[:, :half] @ self.coarse[:, :half].T
        rest = asked.coarse[:, half:] @ self.coarse[:, half:].T
        slack = 1e-9 * (1 + np.abs(middle) + rest)
        row, at = np.nonzero((middle + rest + slack >= least[:, None]) & (middle - rest - slack <= top[:, None]))
        if 4 * len(row) > middle.size:  # too many are left to be looked at one by one
            score = products(asked.v, self.v)[row, at]
            fit = (score >= least[row]) & (score <= top[row])
            return row[fit], at[fit], score[fit]
        half = self.fine.shape[1] // 2
        middle = np.einsum("ij,ij->i", asked.fine[row, :half], self.fine[at, :half])
        rest = np.einsum("ij,ij->i", asked.fine[row, half:], self.fine[at, half:])
        slack = 1e-9 * (1 + np.abs(middle) + rest)
        kept = (middle + rest + slack >= least[row]) & (middle - rest - slack <= top[row])
        row, at = row[kept], at[kept]
        score = np.einsum("ij,ij->i", asked.v[row], self.v[at])
        fit = (score >= least[row]) & (score <= top[row])
        return row[fit], at[fit], score[fit]

    def tiles(self, asked: Held) -> Iterator[slice]:
        step = max(1, TILE_CELLS // max(1, len(self.ids)))
        for low in range(0, len(asked.ids), step):
            yield slice(low, low + step)

    def part(self, rows: slice) -> Held:
        out = object.__new__(Held)
        out.ids, out.v, out.coarse, out.fine = self.ids[rows], self.v[rows], self.coarse[rows], self.fine[rows]
        return out


def by_score(row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by row, then score from the highest, then id."""
    return np.lexsort((ids, -score, row))


def leading(row: np.ndarray, most: int) -> np.ndarray:
    """Which of rows in order are among the first ``most`` of their value."""
    return np.arange(len(row)) - np.searchsorted(row, row, side="left") < most


def positives_in(held: Held, asked: Held, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The best other rows of a block of the anchor's own label."""
    least, top = (run.column(c).to_numpy() for c in ("least", "top"))
    for tile in held.tiles(asked):
        mine = asked.part(tile)
        row, at, score = held.scores(mine, least[tile], top[tile])
        other = held.ids[at] != mine.ids[row]
        row, at, score = row[other], at[other], score[other]
        order = by_score(row, score, held.ids[at])
        order = order[leading(row[order], POSITIVES)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (mine.ids[row[order]], held.ids[at[order]], score[order])], ["anchor_id", "positive_id", "score"]
        )


def negatives_in(held: Held, asked: Held, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For each positive of the anchors, the best rows of a block of another label in its range.

    An anchor's candidates in order of their scores hold each positive's as one run.
    """
    least, top = (run.column(c).to_numpy() for c in ("least", "top"))
    wanted = run.column("scores").to_pylist()
    for tile in held.tiles(asked):
        mine = asked.part(tile)
        row, at, score = held.scores(mine, least[tile], top[tile])
        other = held.ids[at] != mine.ids[row]
        row, at, score = row[other], at[other], score[other]
        order = by_score(row, score, held.ids[at])
        row, at, score = row[order], at[order], score[order]
        begin = np.searchsorted(row, np.arange(len(mine.ids) + 1))
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        for k, scores in enumerate(wanted[tile]):
            own = score[begin[k] : begin[k + 1]]
            for place, positive in enumerate(scores):
                first = int(np.searchsorted(-own, -positive))
                few = own[first : first + NEGATIVES]
                few = few[HIGH * few >= LOW * positive]
                if len(few):
                    found.append((np.arange(first, first + len(few)) + begin[k], place + 1, mine.ids[k]))
        picked = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        n = [len(f[0]) for f in found]
        columns = [
            np.repeat([f[2] for f in found], n).astype(np.int64), np.repeat([f[1] for f in found], n).astype(np.int32),
            held.ids[at[picked]], score[picked],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "place", "negative_id", "score"])


HELD = ["block", "id", "v", "coarse", "fine"]


def met(blocks: DataFrame, anchors: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(held, asked, run)`` for every block and the anchors that ask it.

    A block's vectors come first and are held, its anchors follow batch by batch, however many.
    """
    extra = [c for c in anchors.columns if c not in (*HELD, "size", "label")]
    empty = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    rows = blocks.select(F.lit(0).alias("kind"), *HELD, *empty)
    rows = rows.unionByName(anchors.select(F.lit(1).alias("kind"), *HELD, *extra))
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, held = None, [], None
        for batch in batches:
            block, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            new = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            bounds = [0, *new.tolist(), len(batch)]
            for low, high in zip(bounds[:-1], bounds[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if block[low] != current:
                    current, waiting, held = block[low], [], None
                if kind[low] == 0:
                    waiting.append(part)
                elif waiting or held is not None:
                    if held is None:
                        held, waiting = Held(waiting), []
                    yield from answer(held, Held([part]), part)

    return dealt.mapInArrow(run, schema)


def best(found: DataFrame, within: list[str], name: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group by score, ties to the smaller id, with ``rank``."""
    order = Window.partitionBy(*within).orderBy(F.desc("score"), name)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


POSITIVE_ROW = "anchor_id long, positive_id long, score long"
NEGATIVE_ROW = "anchor_id long, place int, negative_id long, score long"
# Beyond every score.
FAR = float(1 << 62)


def hard_negatives(
    vectors: DataFrame, every: int = ANCHORS_EVERY, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Components count as ``floor(256 * x)``,
    a score is the whole inner product. An anchor's positives are its first five other rows of its
    label, by score, ties to the smaller id; each gives the first five rows of other labels whose
    score is from four fifths of the positive's up to it. A positive without any gives no rows.

    Rows with a null id, label or vector, an empty one, or a null or non-finite component take no
    part. Vectors only meet those of their length. Rows that repeat an id are candidates each; as
    an anchor the id is asked once, with its smallest label and vector, and its own repeats are neither
    positives nor negatives of it. Scores must fit 64 bits. Other columns are ignored; no rows, no result.
    """
    rows = usable(vectors, key, vector, label)
    blocks = staged(in_blocks(staged(summarised(rows))))
    return mined(blocks, every)


def mined(blocks: DataFrame, every: int) -> DataFrame:
    first = F.min(F.struct("label", "v", "size", "coarse", "fine", "block")).alias("own")
    anchors = blocks.where(F.col("id") % every == 0).groupBy("id").agg(first).select("id", "own.*")
    bounds = staged(block_bounds(blocks))
    reach = anchors.withColumns({"least": F.lit(-FAR), "top": F.lit(FAR)})
    # An anchor's own block tells how good the others must be.
    near = best(met(blocks, reach, positives_in, POSITIVE_ROW), ["anchor_id"], "positive_id", POSITIVES)
    near = staged(near.drop("rank"))
    known = near.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    least = F.when(F.col("n") >= POSITIVES, F.col("worst").cast("double")).otherwise(F.lit(-FAR))
    asking = staged(reach.join(known, reach["id"] == known["anchor_id"], "left").withColumn("least", F.coalesce(least, F.lit(-FAR))))
    others = asked_blocks(asking.withColumnRenamed("block", "home").drop("anchor_id", "n", "worst"), bounds, True)
    others = others.where(F.col("block") != F.col("home")).drop("home")
    more = met(blocks, others, positives_in, POSITIVE_ROW)
    positives = staged(best(near.unionByName(more), ["anchor_id"], "positive_id", POSITIVES).withColumnRenamed("rank", "place"))

    listed = F.sort_array(F.collect_list(F.struct("place", "score")))["score"].alias("scores")
    wanted = positives.groupBy("anchor_id").agg(listed)
    seekers = anchors.drop("block").join(wanted, anchors["id"] == wanted["anchor_id"]).drop("anchor_id")
    # Of a negative positive score four fifths are more than all of it: no negative fits.
    fit = F.filter("scores", lambda s: s >= 0)
    seekers = seekers.where(F.size(fit) > 0).withColumns(
        {"least": F.array_min(fit) * float(LOW) / float(HIGH), "top": F.array_max(fit).cast("double")}
    )
    asked = asked_blocks(staged(seekers), bounds, False)
    found = met(blocks, asked, negatives_in, NEGATIVE_ROW)
    ranked = best(found, ["anchor_id", "place"], "negative_id", NEGATIVES)
    named = ranked.withColumnRenamed("score", "negative_score").join(
        positives.withColumnRenamed("score", "positive_score"), ["anchor_id", "place"]
    )
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
