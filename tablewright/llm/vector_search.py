"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors get one more component that makes all norms equal, so that the largest inner product is
the smallest distance, and are rotated at random, so that any first d components tell about the
whole distance. They stand in lists around centres. A query visits its nearest lists; there,
distances grow block by block of components, and a candidate is given up as soon as a
hypothesis test says that its whole distance is beyond the query's k-th best. What survives is
ranked by the exact inner product of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import staged

# Rows that the centres are fitted on: so many, or so many a list, up to a bound; and queries
# that the number of visited lists is fitted on.
SAMPLE_ROWS = 20_000
ROWS_A_CENTRE = 20
MOST_SAMPLE_ROWS = 400_000
SAMPLE_QUERIES = 100
# Rows of a list while there are few lists; beyond so many lists they grow with the root of the rows.
LIST_ROWS = 1000
FEW_LISTS = 1024
# Vectors and queries that meet in one task.
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
# Share of the sampled queries' true neighbours that the visited lists must hold.
AIM = 0.97
# Components added from test to test, and the tests' strictness in standard errors.
STEP = 16
STRICTNESS = 2.1
# Queries and vectors that are compared at once.
TILE = 256
# Distances to centres that are held at once.
ORDER_CELLS = 1 << 21


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that is not zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    inf = float("inf")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull()).where(whole)
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length, row by row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass(frozen=True)
class Layout:
    """Rotation, centres and where the lists lie."""

    rotation: np.ndarray
    reach: float  # the largest squared norm
    centres: np.ndarray
    visits: int = 1

    @classmethod
    def fit(cls, sample: np.ndarray, reach: float, lists: int, seed: int = 7, rounds: int = 8) -> Layout:
        rng = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        rotation, _ = np.linalg.qr(rng.standard_normal((size, size)))
        own = cls(rotation, reach, np.zeros((1, size)))
        points = own.turned(sample)
        kinds = np.unique(points, axis=0)
        centres = kinds[rng.permutation(len(kinds))[:lists]]
        for _ in range(rounds):
            near = cls(rotation, reach, centres).order(points, 1)[:, 0]
            sums = np.stack([np.bincount(near, points[:, k], len(centres)) for k in range(size)], 1)
            n = np.bincount(near, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        return cls(rotation, reach, centres)

    def turned(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.reach - (v * v).sum(1), 0))
        return np.hstack([v, rest[:, None]]) @ self.rotation

    def order(self, points: np.ndarray, most: int | None = None) -> np.ndarray:
        """The ``most`` nearest lists of each turned vector, or all, nearest first."""
        lists = len(self.centres)
        out = np.empty((len(points), min(most or lists, lists)), np.int64)
        squares, step = (self.centres**2).sum(1), max(1, ORDER_CELLS // lists)
        for low in range(0, len(points), step):
            apart = squares[None, :] - 2 * points[low : low + step] @ self.centres.T
            if most == 1:
                out[low : low + step, 0] = apart.argmin(1)
            else:
                out[low : low + step] = np.argsort(apart, axis=1, kind="stable")[:, : out.shape[1]]
        return out

    def parts(self) -> tuple:
        """What a broadcast carries: plain arrays, which a worker reads without this package."""
        return self.rotation, self.reach, self.centres, self.visits


def lists_for(rows: int) -> int:
    """One list for every ``LIST_ROWS`` rows up to ``FEW_LISTS``, then the root of the rows if that is more."""
    return max(1, min(rows // LIST_ROWS, max(FEW_LISTS, math.isqrt(rows))))


def with_lists(rows: DataFrame, layout: Layout, visits: int, query: bool) -> DataFrame:
    """(id, v, lists): each vector with its ``visits`` nearest lists."""
    shared = rows.sparkSession.sparkContext.broadcast(layout.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Layout(*shared.value)
        for batch in batches:
            if len(batch):
                near = plan.order(plan.turned(matrix(batch.column("v")), query), visits)
                lists = pa.ListArray.from_arrays(
                    pa.array((np.arange(len(near) + 1) * near.shape[1]).astype(np.int32)), pa.array(near.ravel().astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], ["id", "v", "lists"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, lists array<int>")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def visits_needed(rows: DataFrame, queries: DataFrame, layout: Layout, k: int) -> int:
    """Lists to visit so that a sample of queries finds the share ``AIM`` of its true neighbours.

    The sample is compared with all vectors; every batch passes on the k best of each query.
    """
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).toArrow()
    if not sample.num_rows:
        return 1
    ids, q = sample.column("id").to_numpy(), matrix(sample.column("v"))
    shared = rows.sparkSession.sparkContext.broadcast((layout.parts(), ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own, asked = shared.value
        plan = Layout(*parts)
        for batch in batches:
            v, at = matrix(batch.column("v")), batch.column("id").to_numpy()
            if not len(v):
                continue
            near = plan.order(plan.turned(v), 1)[:, 0]
            scores = asked @ v.T
            for row, query in enumerate(own):
                scores[row, at == query] = -np.inf
                top = best(scores[row], at, k)
                top = top[np.isfinite(scores[row, top])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top), row)), pa.array(at[top]), pa.array(scores[row, top]), pa.array(near[top])],
                    ["row", "id", "score", "list"],
                )

    found = rows.select("id", "v").mapInArrow(run, "row long, id long, score double, list long")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id")))
    true = found.where(F.col("n") <= k).toArrow()
    if not true.num_rows:
        return 1
    place = np.argsort(layout.order(layout.turned(q, True)), axis=1)
    needed = np.sort(place[true.column("row").to_numpy(), true.column("list").to_numpy()])
    return int(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))) - 1)]) + 1


def shards(sizes: dict[int, int], rows: int) -> list[tuple[int, int, int]]:
    """(list, first shard, number of shards): lists side by side up to ``rows``; a larger one is split."""
    out, shard, filled = [], 0, 0
    for own, n in sorted(sizes.items()):
        parts = -(-n // rows)
        if filled and filled + n > rows:
            shard, filled = shard + 1, 0
        out.append((own, shard, parts))
        if parts > 1:
            shard, filled = shard + parts, 0
        else:
            filled += n
    return out


def numbers(values: list[int]) -> Column:
    """An array of numbers as one literal, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def met_in_parts(placed: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part``: the queries of a shard dealt to slices, its vectors copied to those.

    A shard has as many slices as its own queries fill, so the copies of a vector follow from how
    many queries visit its list and not from how many there are. Vectors that nobody visits go.
    """
    asked = {r[0]: r[1] for r in wanted.groupBy("shard").count().collect()}
    slices = numbers([-(-asked.get(shard, 0) // QUERY_ROWS) for shard in range(max(asked, default=0) + 1)])
    here = F.coalesce(F.get(slices, "shard"), F.lit(0))
    placed = placed.where(here > 0).withColumn("part", F.explode(F.sequence(F.lit(0), (here - 1).cast("int"))))
    return placed, wanted.withColumn("part", F.pmod(F.xxhash64("id"), here).cast("int"))


def scan(layout: Layout, ids: np.ndarray, v: np.ndarray, own: np.ndarray, query_ids: np.ndarray, q: np.ndarray, lists: list[np.ndarray], k: int):
    """(query's number, vector's number, score) of each query's best among its lists' vectors here."""
    x, turned = layout.turned(v), layout.turned(q, True)
    size = x.shape[1]
    asks = np.zeros((len(q), len(layout.centres)), bool)
    for row, near in enumerate(lists):
        asks[row, near] = True
    top_score = np.full((len(q), k), -np.inf)
    top_at = np.full((len(q), k), -1)
    norms = (q * q).sum(1)
    for number in np.unique(own):
        everyone, members = np.flatnonzero(asks[:, number]), np.flatnonzero(own == number)
        for asking in (everyone[i : i + TILE] for i in range(0, len(everyone), TILE)):
            for part in (members[i : i + TILE] for i in range(0, len(members), TILE)):
                # The k-th best's squared distance, as an inner product tells it; infinite before there are k.
                limit = np.maximum(norms[asking] + layout.reach - 2 * top_score[asking, -1], 0)
                seen = min(STEP, size)
                ours, theirs = turned[asking, :seen], x[part, :seen]
                near = (ours**2).sum(1)[:, None] + (theirs**2).sum(1)[None, :] - 2 * ours @ theirs.T
                slack = (1 + STRICTNESS / np.sqrt(seen)) ** 2 * seen / size
                row, col = np.nonzero((near <= slack * limit[:, None] + 1e-9) & (query_ids[asking][:, None] != ids[part][None, :]))
                so_far = near[row, col]
                while seen < size and len(row):
                    nxt = slice(seen, min(seen + STEP, size))
                    so_far = so_far + ((turned[asking[row], nxt] - x[part[col], nxt]) ** 2).sum(1)
                    seen = nxt.stop
                    slack = 1.0 if seen == size else (1 + STRICTNESS / np.sqrt(seen)) ** 2 * seen / size
                    alive = so_far <= slack * limit[row] + 1e-9 * (1 + limit[row])
                    row, col, so_far = row[alive], col[alive], so_far[alive]
                if not len(row):
                    continue
                # The survivors beside the best so far, a line for each query that has some.
                counts = np.bincount(row, minlength=len(asking))
                some = np.flatnonzero(counts)
                line = np.searchsorted(some, row)
                nth = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
                scores = np.full((len(some), k + counts.max()), -np.inf)
                at = np.full(scores.shape, -1)
                scores[:, :k], at[:, :k] = top_score[asking[some]], top_at[asking[some]]
                scores[line, k + nth] = (q[asking[row]] * v[part[col]]).sum(1)
                at[line, k + nth] = part[col]
                names = np.where(at >= 0, ids[np.maximum(at, 0)], np.iinfo(np.int64).max)
                order = np.lexsort((names, -scores), axis=1)[:, :k]
                top_score[asking[some]] = np.take_along_axis(scores, order, 1)
                top_at[asking[some]] = np.take_along_axis(at, order, 1)
    row, place = np.nonzero(top_at >= 0)
    return row, top_at[row, place], top_score[row, place]


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows.

    Nearness is the inner product in doubles, ties go to the smaller id; a query's own id is no
    candidate. Rows with a null id, or a vector that is null, zero or holds null or non-finite
    components, take no part, nor do vectors of another length than the most frequent. Rows that
    repeat an id are candidates each; as a query the id is asked once, with the first of its
    vectors. Other columns are ignored; no rows, no result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = staged(usable(vectors, key, vector))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == lengths["n"])
    reach = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    lists = lists_for(lengths["rows"])
    fitted = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, ROWS_A_CENTRE * lists))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fitted).toArrow()
    layout = Layout.fit(matrix(sample.column("v")), reach, lists)
    visits = visits_needed(rows, asked, layout, k)

    salt = F.xxhash64(F.monotonically_increasing_id())
    placed = staged(with_lists(rows, layout, 1, False).select("id", "v", F.col("lists")[0].alias("list"), salt.alias("salt")))
    sizes = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}
    where = {own: (shard, n) for own, shard, n in shards(sizes, SHARD_ROWS)}
    first = numbers([where.get(own, (-1, 0))[0] for own in range(lists)])
    parts = numbers([where.get(own, (-1, 0))[1] for own in range(lists)])
    placed = placed.withColumn("shard", F.get(first, "list") + F.pmod("salt", F.get(parts, "list")))
    visited = F.flatten(
        F.transform(
            F.filter("lists", lambda x: F.get(first, x) >= 0),
            lambda x: F.sequence(F.get(first, x), F.get(first, x) + F.get(parts, x) - 1),
        )
    )
    wanted = staged(with_lists(asked, layout, visits, True).withColumn("shard", F.explode(F.array_distinct(visited))))
    placed, wanted = met_in_parts(placed.drop("salt"), wanted)
    shared = spark.sparkContext.broadcast(layout.parts())

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        lists = [np.array(x) for x in right.column("lists").to_pylist()]
        row, at, score = scan(
            Layout(*shared.value), ids, matrix(left.column("v")), left.column("list").to_numpy(), query_ids, matrix(right.column("v")), lists, k
        )
        return pa.table({"query_id": query_ids[row], "vec_id": ids[at], "score": score})

    keys = ["shard", "part"]
    found = placed.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

