"""Top-k by cosine similarity, for one vector or a whole table of them.

The similarity of all queries with all vectors is a matrix product; what matters at scale is
where it runs and what leaves the tasks. Only rows that can still be among the best k are ever
emitted. Three forms, all exact, chosen by measured size:

* few queries: the query matrix goes to every task and the index is scanned in place;
* a small index: the index goes to every task, so each query is finished where it lies;
* neither: the index is cut into blocks of like directions, and each query travels to those that
  may hold something for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import is_scan, work_folder

# --- Fixed values -------------------------------------------------------------------
DEFAULT_K = 5
DEFAULT_THRESHOLD = 0.3
SIMILARITY_DIGITS = 4
# ------------------------------------------------------------------------------------
# What a row costs a task beside its vector and id.
ROW_BYTES = 64
BROADCAST_BYTES = 64 << 20
# Hits, an id and a number each, that may be sent to every task to pick up their texts.
BROADCAST_HITS = 500_000
# Beside an index too large to send, this part of the bytes is what few queries have: each gives k rows a task.
FEW_QUERIES = 16
TILE_CELLS = 4 << 20
# Queries whose products with a leaf are looked at together, and rows whose directions are made together.
QUERY_TILE = 512
HELD_TILE = 8192
# Vectors of a leaf at most, the axes of its box, rows that the axes are taken from, and the leaves that
# set a query's bar before the others are looked at.
LEAF_ROWS = 512
LEAF_AXES = 8
AXES_ROWS = 4096
FIRST_LEAVES = 4
# Pairs of a task where the index is in blocks: no less, however many cores, and no more.
LEAST_PAIRS = 200_000_000
MOST_PAIRS = 32_000_000_000
# Signs along random directions that bring like vectors into one block.
NEAR_BITS = 16
# Bytes of the blocks' bounds that may always be sent to the tasks.
CONE_BYTES = 4 << 20


class Vectors:
    """Ids and vectors of one Arrow table, grouped by vector length."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table.column(0).combine_chunks()
        lists = table.column(1).combine_chunks()
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        self.count = len(lengths)
        self.rows: dict[int, np.ndarray] = {}
        self.matrix: dict[int, np.ndarray] = {}
        self.norms: dict[int, np.ndarray] = {}
        self._leaves: dict[int, Leaves] | None = None
        for length in map(int, np.unique(lengths)):
            rows = np.flatnonzero(lengths == length)
            if len(rows) == self.count:
                matrix = values[offsets[0] : offsets[-1]].reshape(self.count, length)
            else:
                matrix = values[offsets[rows][:, None] + np.arange(length)]
            matrix = matrix.astype(np.float64, copy=False)
            norms = np.linalg.norm(matrix, axis=1)
            # A zero vector is similar to nothing: 0 over an endless norm is 0.
            norms[norms == 0] = np.inf
            self.rows[length], self.matrix[length], self.norms[length] = rows, matrix, norms

    def unit(self, length: int, rows: np.ndarray) -> np.ndarray:
        """Directions of rows of one length in single precision; one that is no number is similar to nothing."""
        with np.errstate(invalid="ignore", over="ignore"):
            found = (self.matrix[length][rows] / self.norms[length][rows, None]).astype(np.float32)
        return np.nan_to_num(found, copy=False, nan=0.0, posinf=0.0, neginf=0.0)

    def places(self) -> np.ndarray:
        """The rows in the order of their ids."""
        return pc.sort_indices(self.ids).to_numpy()

    def leaves(self) -> dict[int, Leaves]:
        """The rows of each length in leaves of like directions."""
        if self._leaves is None:
            place = np.empty(self.count, np.int64)
            place[self.places()] = np.arange(self.count)
            self._leaves = {length: Leaves(self, length, place) for length in self.rows if length}
        return self._leaves

    def similarity(self, start: int, stop: int, others: Vectors) -> np.ndarray:
        """Cosine of own rows ``start:stop`` with all of ``others``; 0 where lengths differ."""
        out = None
        for length, rows in self.rows.items():
            low, high = np.searchsorted(rows, (start, stop))
            if length == 0 or low == high or length not in others.rows:
                continue
            cosine = self.matrix[length][low:high] @ others.matrix[length].T
            cosine /= self.norms[length][low:high, None] * others.norms[length][None, :]
            if cosine.shape == (stop - start, others.count):
                return cosine
            out = np.zeros((stop - start, others.count)) if out is None else out
            out[np.ix_(rows[low:high] - start, others.rows[length])] = cosine
        return np.zeros((stop - start, others.count)) if out is None else out


class Leaves:
    """Directions of one length in leaves of like ones, and a box around each.

    A box lies along the axes in which the directions differ most, and one more, the length of what is
    off these axes. Distances there are never more than those of the directions, and a distance tells
    the cosine; so a box bounds the cosine of a query with all of its leaf.
    """

    def __init__(self, own: Vectors, length: int, place: np.ndarray) -> None:
        rows = own.rows[length]
        rows = rows[np.argsort(place[rows], kind="stable")]
        units = np.empty((len(rows), length), np.float32)
        # Places among the vectors of this length, by which a vector is found in its matrix.
        at = np.searchsorted(own.rows[length], rows)
        for start in range(0, len(rows), HELD_TILE):
            units[start : start + HELD_TILE] = own.unit(length, at[start : start + HELD_TILE])
        some = units.any(axis=1)  # what has no direction is never found
        if not some.all():
            units, at, rows = units[some], at[some], rows[some]
        few = units[:: max(1, len(units) // AXES_ROWS)].astype(np.float64)
        self.middle = few.mean(axis=0) if len(few) else np.zeros(length)
        few -= self.middle
        axes = np.random.default_rng(length).standard_normal((length, min(LEAF_AXES, length)))
        for _ in range(3):
            axes = np.linalg.qr(few.T @ (few @ axes))[0]
        self.axes = axes
        along, odd = self.along(units)
        order, leaf = np.arange(len(units)), np.zeros(len(units), np.int64)
        levels = max(0, math.ceil(math.log2(max(1, len(units)) / LEAF_ROWS)))
        for level in range(1, levels + 1):
            # Each half by the axis along which it is widest; equal ones stay in the order of their ids.
            held, begin = along[order], np.flatnonzero(np.diff(leaf, prepend=-1))
            n = np.diff(begin, append=len(order))[:, None]
            spread = np.add.reduceat(held * held, begin) / n - (np.add.reduceat(held, begin) / n) ** 2
            order = order[np.lexsort((held[np.arange(len(order)), spread.argmax(axis=1)[leaf]], leaf))]
            leaf = np.arange(len(order)) * (1 << level) // len(order)
        self.begin = np.flatnonzero(np.diff(leaf, prepend=-1))
        self.end = np.append(self.begin[1:], len(order)).astype(np.int64)
        held = along[order]
        self.low, self.high = (f.reduceat(held, self.begin) if len(order) else held for f in (np.minimum, np.maximum))
        if odd.any():
            loose = np.logical_or.reduceat(odd[order], self.begin)
            self.low[loose], self.high[loose] = -np.inf, np.inf
        self.units, self.at, self.place = units[order], at[order], place[rows[order]]
        self.first = np.minimum.reduceat(self.place, self.begin) if len(order) else self.place

    def along(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions in the axes of the boxes, and which have not the length 1, as with tiny numbers."""
        found, odd = np.empty((len(units), self.axes.shape[1] + 1)), np.empty(len(units), bool)
        for start in range(0, len(units), HELD_TILE):
            part = slice(start, start + HELD_TILE)
            unit = units[part].astype(np.float64)
            odd[part] = np.abs((unit * unit).sum(axis=1) - 1) > 1e-5
            unit -= self.middle
            found[part, :-1] = unit @ self.axes
            rest = (unit * unit).sum(axis=1) - (found[part, :-1] ** 2).sum(axis=1)
            found[part, -1] = np.sqrt(np.maximum(rest, 0))
        return found, odd

    def reach(self, units: np.ndarray) -> np.ndarray:
        """What no cosine of a query with a leaf's vectors is above, per query and leaf."""
        along, odd = self.along(units)
        apart = np.zeros((len(units), len(self.begin)), np.float32)
        along, low, high = along.astype(np.float32), self.low.astype(np.float32), self.high.astype(np.float32)
        for k in range(along.shape[1]):
            off = np.maximum(low[None, :, k] - along[:, k, None], along[:, k, None] - high[None, :, k])
            np.maximum(off, 0, out=off)
            off *= off
            apart += off
        apart *= -0.5
        apart += 1 + 1e-5
        apart[odd] = np.inf
        return apart


def _best(found: pa.Table, k: int) -> pa.Table:
    """The first k rows of each query by similarity, then id, with their rank."""
    order = [("query", "ascending"), ("similarity", "descending"), ("id", "ascending")]
    found = found.take(pc.sort_indices(found, sort_keys=order))
    query = found.column("query").to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    keep = place < k
    return found.filter(pa.array(keep)).append_column("rank", pa.array(place[keep] + 1, pa.int32()))


SLACK = 0.51 * 10.0**-SIMILARITY_DIGITS


def _folded(score: np.ndarray, place: np.ndarray, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
    """Takes new scores of queries into the best k of each, ties to the smaller place."""
    k = score.shape[1]
    rows, own = np.unique(q, return_inverse=True)
    q = np.concatenate([np.repeat(np.arange(len(rows)), k), own])
    s, i = np.concatenate([score[rows].ravel(), s]), np.concatenate([place[rows].ravel(), i])
    order = np.lexsort((i, -s, q))
    q = q[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q, side="left") < k]
    score[rows], place[rows] = s[order].reshape(-1, k), i[order].reshape(-1, k)


def _near(queries: Vectors, batch: Vectors, k: int, threshold: float, cut: np.ndarray) -> Iterator[pa.Table]:
    """The best k rows of ``batch`` of each query that reach its ``cut``, in order of query, similarity and id.

    Leaves that hold nothing above the cut or the best k so far are passed over. In the others, products
    in single precision, whose error is bounded, leave out what is surely below; what remains is
    computed in full.
    """
    held, by_place = batch.leaves(), None
    for length, rows in queries.rows.items():
        if length not in held or not len(held[length].at):
            continue
        leaves = held[length]
        matrix, norms = batch.matrix[length], batch.norms[length]
        error = (length + 32) * 2.0**-24
        step = max(QUERY_TILE, TILE_CELLS // len(leaves.begin))
        for low in range(0, len(rows), step):
            mine = np.arange(low, min(low + step, len(rows)))
            asked, own, sizes = queries.unit(length, mine), queries.matrix[length][mine], queries.norms[length][mine]
            score, place = np.full((len(mine), k), -np.inf), np.full((len(mine), k), -1, np.int64)
            least = np.maximum(cut[rows[mine]], threshold)
            reach = leaves.reach(asked)
            reach[~asked.any(axis=1)] = -np.inf
            pairs = max(1, TILE_CELLS // 4 // length)

            def look(leaf: int, wanting: np.ndarray) -> None:
                begin, end = leaves.begin[leaf], leaves.end[leaf]
                for wanted in (wanting[at : at + QUERY_TILE] for at in range(0, len(wanting), QUERY_TILE)):
                    # Where a smaller id may follow, as good is good enough.
                    later = np.where(leaves.first[leaf] > place[wanted, -1], 0.49, -0.51) * 10.0**-SIMILARITY_DIGITS
                    bar = np.maximum(least[wanted], score[wanted, -1] + later) - error
                    can = reach[wanted, leaf] >= bar
                    wanted, bar = wanted[can], bar[can]
                    if not len(wanted):
                        continue
                    near = asked[wanted] @ leaves.units[begin:end].T
                    if not score[wanted, -1].max() > -np.inf and end - begin > k:
                        last = np.partition(near, end - begin - k, axis=1)[:, end - begin - k].astype(np.float64) - error
                        bar = np.maximum(bar, np.round(last, SIMILARITY_DIGITS) - SLACK - error)
                    found = np.flatnonzero(near >= bar.astype(np.float32)[:, None])
                    for part in (found[at : at + pairs] for at in range(0, len(found), pairs)):
                        q, i = np.divmod(part, end - begin)
                        q, i = wanted[q], begin + i
                        at = leaves.at[i]
                        exact = np.einsum("ij,ij->i", own[q], matrix[at]) / (sizes[q] * norms[at])
                        exact, good = np.round(exact, SIMILARITY_DIGITS), exact >= threshold
                        i, last = leaves.place[i], score[q, -1]
                        good &= (exact > last) | ((exact == last) & (i < place[q, -1]))
                        if good.any():
                            _folded(score, place, q[good], i[good], exact[good])

            few = min(FIRST_LEAVES, reach.shape[1])
            first = np.argpartition(-reach, few - 1, axis=1)[:, :few]
            first = np.take_along_axis(first, np.argsort(-np.take_along_axis(reach, first, axis=1), axis=1), axis=1)
            for turn in first.T:
                order = np.argsort(turn, kind="stable")
                for wanting in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
                    look(turn[wanting[0]], wanting)
            np.put_along_axis(reach, first, -np.inf, axis=1)
            bar = np.maximum(least, score[:, -1] - SLACK) - error
            for leaf in range(reach.shape[1]):
                wanting = np.flatnonzero(reach[:, leaf] >= bar)
                if len(wanting):
                    look(leaf, wanting)
            q, n = np.nonzero(place >= 0)
            if len(q):
                by_place = batch.places() if by_place is None else by_place
                ids = batch.ids.take(pa.array(by_place[place[q, n]]))
                yield pa.table({"query": rows[mine][q], "similarity": score[q, n], "id": ids})


def _matches(queries: Vectors, batch: Vectors, k: int, threshold: float) -> Iterator[pa.Table]:
    """Rows of ``batch`` that can be among each query's best k there, where 0 reaches the threshold.

    The cut is half a rounding step below the k-th value, so all that round to it are kept.
    """
    step = max(1, TILE_CELLS // max(1, batch.count))
    for start in range(0, queries.count, step):
        exact = queries.similarity(start, min(start + step, queries.count), batch)
        cut = np.full((len(exact), 1), threshold)
        if batch.count > k:
            last = np.partition(exact, batch.count - k, axis=1)[:, batch.count - k, None]
            cut = np.maximum(cut, np.round(last, SIMILARITY_DIGITS) - SLACK)
        q, i = np.nonzero(exact >= cut)
        score = np.round(exact[q, i], SIMILARITY_DIGITS)
        yield pa.table({"query": q + start, "similarity": score, "id": batch.ids.take(pa.array(i))})


def _vectors(table: pa.Table, shortest: int) -> Vectors:
    """The rows that have a vector of at least that length."""
    lengths = pc.list_value_length(table.column("vector"))
    return Vectors(table.select(["key", "vector"]).filter(pc.greater_equal(lengths, shortest)))


def _asked(table: pa.Table) -> Vectors:
    return _vectors(table, 0)


def _held(table: pa.Table) -> Vectors:
    """An index row with an empty vector is never found."""
    return _vectors(table, 1)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut so that their vectors stay within the tile size, however long they are."""
    for batch in batches:
        longest = pc.max(pc.list_value_length(batch.column(1))).as_py() or 1
        rows = max(1, TILE_CELLS // longest)
        for start in range(0, batch.num_rows, rows):
            yield pa.Table.from_batches([batch.slice(start, rows)])


def _gathered(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Tables put together up to the tile size: the more vectors, the more of their leaves are passed over."""
    waiting, cells = [], 0
    for table in tables:
        own = pc.sum(pc.list_value_length(table.column(1))).as_py() or 0
        if waiting and cells + own > TILE_CELLS:
            yield pa.concat_tables(waiting)
            waiting, cells = [], 0
        waiting.append(table)
        cells += own
    if waiting:
        yield pa.concat_tables(waiting)


def _output(queries: Vectors, best: pa.Table) -> pa.RecordBatch:
    columns = [
        queries.ids.take(best.column("query").combine_chunks()),
        best.column("id").combine_chunks(),
        best.column("similarity").combine_chunks(),
        best.column("rank").combine_chunks(),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "similarity", "rank"])


def scan_best(queries: Vectors, stream: Iterator[Vectors], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The best k per query over a stream of index batches, holding about k rows per query."""
    best, waiting, rows = None, [], 0
    top, cut, latest = None, np.full(queries.count, threshold, np.float64), []
    for batch in stream:
        if latest:
            # What the batches so far hold is the bar for the next one.
            top = np.full((queries.count, k), -np.inf) if top is None else top
            for found in latest:
                q = found.column("query").to_numpy()
                own, n = np.unique(q, return_counts=True)
                new = np.full((len(own), 2 * k), -np.inf)
                new[:, :k] = top[own]
                new[np.repeat(np.arange(len(own)), n), k + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)] = found.column("similarity").to_numpy()
                top[own] = np.partition(new, k, axis=1)[:, k:]
            cut = np.maximum(threshold, top.min(axis=1) - SLACK)
        latest = []
        for found in _near(queries, batch, k, threshold, cut) if threshold > 0 else _matches(queries, batch, k, threshold):
            waiting.append(found)
            latest += [found] if threshold > 0 else []
            rows += found.num_rows
            # Many copies of one vector all tie at the cut, so a tile may pass on many rows.
            if rows > max(TILE_CELLS // 4, 2 * k * queries.count):
                best, waiting, rows = _merge(best, waiting, k), [], 0
    best = _merge(best, waiting, k)
    if best is not None and best.num_rows:
        yield _output(queries, best)


def _merge(best: pa.Table | None, waiting: list[pa.Table], k: int) -> pa.Table | None:
    kept = [best.drop_columns(["rank"])] if best is not None else []
    parts = kept + waiting
    return _best(pa.concat_tables(parts), k) if parts else None


def _bytes(side: DataFrame, bound: int) -> int:
    """Size of a side (``key, vector``) as held by a task: vectors as doubles, ids, and each row's own.

    First as if all were like the first row. Only what seems to fit the bound is then measured in
    full, so a side is never sent to the tasks on an estimate.
    """
    first = side.select(F.size("vector").alias("n")).first()
    estimate = side.count() * (ROW_BYTES + 8 * max(0, (first["n"] or 0) if first else 0))
    if estimate > bound:
        return estimate
    vector = 8 * F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0))
    key = F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0))
    return side.agg(F.sum(vector + key + ROW_BYTES).alias("n")).first()["n"] or 0


def topk_schema(query_type: T.DataType, index_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("id", index_type),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )


def topk_rows(partial: DataFrame, k: int) -> DataFrame:
    """The first k of each query's rows, ranked; the tasks' surplus is cut before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _staged(rows: DataFrame) -> DataFrame:
    path = work_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _held_once(side: DataFrame) -> DataFrame:
    """What is not simply read, as vectors from a model, is written, so that it is not made for each look at it."""
    return side if is_scan(side) else _staged(side)


def _over_cores(side: DataFrame) -> DataFrame:
    """Rows in enough parts for all cores: their bytes are few beside the work on them."""
    parts = 2 * side.sparkSession.sparkContext.defaultParallelism
    return side.repartition(parts) if side._jdf.rdd().getNumPartitions() < parts else side


def _with_queries_everywhere(queries: DataFrame, index: DataFrame, k: int, threshold: float) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan_best(_asked(shared.value), map(_held, _gathered(_tables(batches))), k, threshold)

    return topk_rows(_over_cores(index).mapInArrow(scan, topk_schema(queries.schema["key"].dataType, index.schema["key"].dataType)), k)


def _with_index_everywhere(queries: DataFrame, index: DataFrame, k: int, threshold: float) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(index.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(shared.value)
        for table in _gathered(_tables(batches)):
            yield from scan_best(_asked(table), iter([held]), k, threshold)

    return _over_cores(queries).mapInArrow(scan, topk_schema(queries.schema["key"].dataType, index.schema["key"].dataType))


def meet_in_cells(held: DataFrame, asked: DataFrame, k: int, threshold: float, cells: int | None = None) -> DataFrame:
    """The best k of each query in each cell that it asks for.

    ``held`` and ``asked`` have ``cell, key, vector``. A cell's vectors come first and are kept, a
    bounded number; its queries follow some batches at a time, however many. Where the cells are numbered
    from 0 and ``cells`` says how many there are, each is a task of its own.
    """
    index_type, query_type = held.schema["key"].dataType, asked.schema["key"].dataType
    nobody, nothing = F.lit(None).cast(query_type), F.lit(None).cast(index_type)
    rows = held.select("cell", "vector", F.lit(0).alias("kind"), F.col("key").alias("held_key"), nobody.alias("asked_key"))
    rows = rows.unionByName(
        asked.select("cell", "vector", F.lit(1).alias("kind"), nothing.alias("held_key"), F.col("key").alias("asked_key"))
    )
    dealt = rows.repartitionById(cells, F.col("cell").cast("int")) if cells else rows.repartition("cell")
    dealt = dealt.sortWithinPartitions("cell", "kind")

    def table(batches: list[pa.RecordBatch], key: str) -> Vectors:
        return Vectors(pa.Table.from_batches(batches).select([key, "vector"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, ready, asking, cells = None, [], None, [], 0
        for batch in batches:
            cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
            ends = [*new.tolist(), len(batch)] if len(batch) else []
            for low, high in zip([0, *new.tolist()], ends):
                part = batch.slice(low, high - low)
                if asking and (cell[low] != current or cells > TILE_CELLS // 4):
                    yield from scan_best(table(asking, "asked_key"), iter([ready]), k, threshold)
                    asking, cells = [], 0
                if cell[low] != current:
                    current, waiting, ready = cell[low], [], None
                if kind[low] == 0:
                    waiting.append(part)
                elif waiting or ready is not None:
                    if ready is None:
                        ready, waiting = table(waiting, "held_key"), []
                    asking.append(part)
                    cells += pc.sum(pc.list_value_length(part.column("vector"))).as_py() or 0
        if asking:
            yield from scan_best(table(asking, "asked_key"), iter([ready]), k, threshold)

    return dealt.mapInArrow(run, topk_schema(query_type, index_type))


def _dealt(index: DataFrame, blocks: int) -> DataFrame:
    """``cell, size, key, vector``: the index in about as many blocks, vectors of like direction together, staged.

    Like directions are those with the same signs along some random ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, near = Vectors(pa.Table.from_batches([batch])), np.zeros(len(batch), np.int64)
            for size, rows in own.rows.items():
                along = np.random.default_rng(size).standard_normal((size, NEAR_BITS))
                near[rows] = (own.matrix[size] @ along > 0) @ (1 << np.arange(NEAR_BITS)[::-1])
            lengths = pa.array(np.diff(batch.column("vector").offsets.to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, lengths, pa.array(near)], ["key", "vector", "size", "near"])

    kind = index.schema["key"].dataType.simpleString()
    coded = index.select("key", "vector").mapInArrow(run, f"key {kind}, vector array<double>, size int, near bigint")
    path = work_folder(index.sparkSession)
    coded.write.parquet(f"{path}/coded")
    coded = index.sparkSession.read.schema(coded.schema).parquet(f"{path}/coded")
    dealt = coded.repartitionByRange(blocks, "size", "near", "key").withColumn("cell", F.spark_partition_id().cast("bigint"))
    dealt.select("cell", "size", "key", "vector").write.parquet(f"{path}/dealt")
    return index.sparkSession.read.parquet(f"{path}/dealt")


def _cones(dealt: DataFrame) -> DataFrame:
    """``cell, size, middle, wide``: the mean direction of a block's vectors of each length, and the
    widest angle between it and one of them."""

    def cone(rows: pa.Table) -> pa.Table:
        own = Vectors(rows.select(["key", "vector"]))
        (size,) = own.matrix
        unit = own.matrix[size] / own.norms[size][:, None]
        middle = unit.sum(axis=0)
        length = np.linalg.norm(middle)
        middle = middle / length if length else middle
        wide = float(np.arccos(np.clip((unit @ middle).min(), -1, 1))) if length else np.pi
        return pa.table({"cell": rows.column("cell")[:1], "size": rows.column("size")[:1], "middle": pa.array([middle.tolist()]), "wide": [wide]})

    return dealt.groupBy("cell", "size").applyInArrow(cone, "cell bigint, size int, middle array<double>, wide double")


def _asking(queries: DataFrame, cones: pa.Table, threshold: float) -> DataFrame:
    """``cell, key, vector``: each query once for every block that may hold a vector of its threshold.

    No vector of a block is nearer to the query than the block's mean direction less its widest angle.
    """
    own = Vectors(cones.select(["cell", "middle"]))
    wide = cones.column("wide").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for t in _tables(batches) for b in t.to_batches()):
            asked = Vectors(pa.Table.from_batches([batch]))
            for size, rows in asked.rows.items():
                if size not in own.rows:
                    continue
                blocks = own.rows[size]
                step = max(1, TILE_CELLS // len(blocks))
                for low in range(0, len(rows), step):
                    part = slice(low, low + step)
                    cosine = asked.matrix[size][part] @ own.matrix[size].T / asked.norms[size][part, None]
                    apart = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - wide[blocks][None, :], 0)
                    row, at = np.nonzero(np.cos(apart) >= threshold - 1e-9)
                    taken = batch.take(pa.array(rows[part][row]))
                    yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(blocks[at])), *taken.columns], ["cell", "key", "vector"])

    kind = queries.schema["key"].dataType.simpleString()
    return queries.select("key", "vector").mapInArrow(run, f"cell bigint, key {kind}, vector array<double>")


def _with_blocks(queries: DataFrame, index: DataFrame, k: int, threshold: float, blocks: int, broadcast_bytes: int) -> DataFrame:
    """Queries travel to the blocks of the index that may hold something for them; vectors are not copied.

    A block's bounds are a direction and an angle, sent to the tasks up to ``broadcast_bytes``.
    With a threshold of 0 or less, or beyond those bytes, every block is asked. A block's queries
    are dealt to as many tasks as the pairs and the cores ask for, each with a copy of the block.
    What the blocks give for a query is merged in two steps, so that no step sees all blocks of a
    query at once.
    """
    spark = index.sparkSession
    queries = _staged(queries.select("key", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL"))
    pairs = queries.count() * index.count()
    tasks = min(math.ceil(pairs / LEAST_PAIRS), max(4 * spark.sparkContext.defaultParallelism, math.ceil(pairs / MOST_PAIRS)))
    dealt = _dealt(index.select("key", F.col("vector").cast("array<double>").alias("vector")), blocks)
    cones = None
    if threshold > 0:
        path = work_folder(index.sparkSession)
        _cones(dealt).write.parquet(path)
        cones = index.sparkSession.read.parquet(path)
        size = cones.agg(F.coalesce(F.sum(8 * F.size("middle") + ROW_BYTES), F.lit(0))).first()[0]
        cones = cones if size <= max(broadcast_bytes, CONE_BYTES) else None
    if cones is not None:
        asking = _asking(queries, cones.toArrow(), threshold)
    else:
        cells = dealt.agg(F.coalesce(F.max("cell"), F.lit(0))).first()[0]
        asking = queries.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells).cast("bigint"))))
    blocks = dealt.agg(F.coalesce(F.max("cell"), F.lit(0))).first()[0] + 1
    slices = max(1, math.ceil(tasks / blocks))
    asking = asking.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)))
    held = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
    held, asking = (side.select((F.col("cell") * slices + F.col("slice")).alias("cell"), "key", "vector") for side in (held, asking))
    partial = meet_in_cells(held, asking, k, threshold, blocks * slices)
    group = F.pmod(F.xxhash64("id"), F.lit(max(1, math.isqrt(blocks))))
    order = Window.partitionBy("query_id", "_group").orderBy(F.desc("similarity"), "id")
    few = partial.withColumn("_group", group).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return topk_rows(few.drop("_group", "_place"), k)


def topk_join(
    queries: DataFrame,
    index: DataFrame,
    k: int = DEFAULT_K,
    threshold: float = DEFAULT_THRESHOLD,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    index_id: str = "id",
    index_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The best k index rows of every query: ``query_id, id, similarity, rank``.

    Rows reach ``threshold`` before rounding; they are ranked by the similarity rounded to four
    digits, then by id. Index rows without a vector are never found; a zero vector or one of
    another length has similarity 0.
    """
    left = queries.select(F.col(query_id).alias("key"), F.col(query_vector).alias("vector"))
    right = index.select(F.col(index_id).alias("key"), F.col(index_vector).alias("vector")).where(F.size("vector") > 0)
    left, right = _held_once(left), _held_once(right)
    query_bytes = _bytes(left, broadcast_bytes)
    if query_bytes <= broadcast_bytes // FEW_QUERIES:
        return _with_queries_everywhere(left, right, k, threshold)
    index_bytes = _bytes(right, broadcast_bytes)
    if index_bytes <= broadcast_bytes:
        return _with_index_everywhere(left, right, k, threshold)
    blocks = math.ceil(index_bytes / broadcast_bytes)
    return _with_blocks(left, right, k, threshold, blocks, broadcast_bytes)


def topk(
    index: DataFrame,
    vector: list[float],
    k: int = DEFAULT_K,
    threshold: float = DEFAULT_THRESHOLD,
    index_id: str = "id",
    index_vector: str = "embedding",
) -> DataFrame:
    """The best k rows for one vector, with all their columns but the vector."""
    query = Vectors(pa.table({"key": [0], "vector": pa.array([vector], pa.list_(pa.float64()))}))
    narrow = index.select(F.col(index_id).alias("key"), F.col(index_vector).alias("vector"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan_best(query, map(_held, _tables(batches)), k, threshold)

    best = narrow.mapInArrow(scan, topk_schema(T.LongType(), narrow.schema["key"].dataType)).orderBy(F.desc("similarity"), "id").limit(k)
    hits = best.select(F.col("id").alias(index_id), "similarity")
    # k rows at most: if that is few, the index is only probed for them and not shuffled.
    hits = F.broadcast(hits) if k <= BROADCAST_HITS else hits
    return index.drop(index_vector).join(hits, index_id).orderBy(F.desc("similarity"), index_id)
