"""Helpers shared by the corpus operators: staging, bounded collects, whole texts from Arrow."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import work_folder

# Rows of some tens of bytes up to which a side may be sent to every task; larger sides are joined by shuffle.
BROADCAST_ROWS = 400_000
# Bytes of text that one step inside a task works on.
BLOCK_BYTES = 1 << 20


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    Everything after this reads the same rows, also after an executor is lost, and nothing
    before it runs twice.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole text; a null text is empty."""
    kept = [F.col(f"`{c}`") for c in columns]
    return docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def heaviest(counts: DataFrame, key: str, count: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys with the largest counts, at most ``most`` of them, and the counts, in no order.

    The threshold is read off a histogram of the counts, of a few hundred rows at any size.
    ``counts`` should be staged, it is read twice.
    """
    bin_ = F.floor(F.log2(F.col(count).cast("double")) * 8)
    total, least = 0, None
    for row in sorted(counts.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        total += row["count"]
        if total > most:
            break
        least = row["bin"]
    picked = counts.where(F.lit(False) if least is None else bin_ >= least)
    found = picked.select(F.col(key).cast("long"), F.col(count).cast("long")).toArrow()
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def matching(df: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """A semi or anti join on one column, null being a value like others.

    The keys are counted first: up to ``BROADCAST_ROWS`` they go to every task, beyond that
    both sides are shuffled.
    """
    keys = keys.select(F.col(column).alias("_matched")).distinct()
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, df[column].eqNullSafe(F.col("_matched")), how)


def numbered(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """``rows`` with ``number``, 1, 2, 3... in the given order, and how many there are.

    No task sees all rows: they are dealt by ranges of the order, equal ones at random, and staged
    with their place in their range; only the ranges' row counts come to the driver. ``rows``
    should be staged, as dealing reads them twice.
    """
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt"))
    placed = staged(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_salt"))
    # The number of the range stands above bit 33 of the row's id, the place in it below.
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(str(total))
        total += counts.get(k, 0)
    starts = F.split(F.lit(",".join(before) or "0"), ",").cast("array<bigint>")
    return placed.withColumn("number", F.get(starts, part.cast("int")) + place + 1).drop("_at"), total


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- Words of a column of texts, hashed without a Python step per word ---------------------
def _lookup(fold: bool) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    return table


def separators(kind: str) -> np.ndarray:
    """For each byte, whether it stands between words. ``space``: blank, tab to carriage return.
    ``plain``: every ASCII character but letters and digits."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[32, 9, 10, 11, 12, 13]] = True
    else:
        table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (the finaliser of splitmix64)."""
    v = values ^ (values >> np.uint64(30))
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


class WordHasher:
    """64-bit hashes of the words of texts, letters A-Z taken as a-z unless ``fold`` is false.

    A word's value is a polynomial over a fixed random table of byte values, read off prefix
    sums, so a block of text costs a dozen array operations and no step per word. With
    ``prefixes`` each word gives as many more values: of its first so many bytes, or its own
    again where it is shorter.
    """

    def __init__(self, kind: str = "space", prefixes: tuple[int, ...] = (), fold: bool = True, block: int = BLOCK_BYTES) -> None:
        self.least = block + (block >> 1)
        self.table, self.between, self.prefixes = _lookup(fold), separators(kind), prefixes
        self.base = 0x9E3779B97F4A7C15 | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if size <= len(self.up):
            return
        size = max(size, self.least)
        for name, base in (("up", self.base), ("down", self.inverse)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            setattr(self, name, np.multiply.accumulate(powers))

    def spans(self, data: np.ndarray, first: np.ndarray, stops: list[np.ndarray]) -> list[np.ndarray]:
        """Hashes of the bytes from ``first`` to each of ``stops``."""
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        return [mixed((sums[e] - sums[first]) * self.down[first] + (e - first).astype(np.uint64)) for e in stops]

    def block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of the bytes, and for each text the number of its first hash.

        ``cuts`` holds the texts' byte positions, the end included.
        """
        n = len(data)
        word = ~self.between[data]
        edge = np.zeros(n + 1, bool)
        edge[cuts] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:n]
        first = np.flatnonzero(starts)
        last = np.flatnonzero(ends) + 1
        bounds = np.searchsorted(first, cuts)
        stops = [last, *[np.where(last - first > k, first + k, last) for k in self.prefixes]]
        each = self.spans(data, first, stops)
        for k in range(1, len(each)):  # a prefix is not the word that looks like it
            each[k] = np.where(stops[k] < last, each[k] ^ np.uint64(0x5851F42D4C957F2D), each[k])
        return (np.stack(each, 1).ravel(), bounds * len(each)) if self.prefixes else (each[0], bounds)


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, end row, bytes, byte positions.

    A longer text is a run of its own, never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
    if len(column):
        release()


def hashed_words(column: pa.Array, hasher: WordHasher, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of texts: first row, end row, word hashes, and where each text's words begin."""
    for low, high, data, cuts in text_blocks(column, most):
        hashes, bounds = hasher.block(data, cuts)
        yield low, high, hashes, bounds


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))



class HashIndex:
    """Positions of 64-bit keys (well mixed, no repeats) in an open-addressed table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.ascontiguousarray(keys, np.uint64)
        size = 1 << max(4, int(4 * len(self.keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        waiting = np.arange(len(self.keys), dtype=np.int32)
        at = self.keys & self.mask
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash among the keys, or -1."""
        at = hashes & self.mask
        found = self.slots[at]
        other = np.flatnonzero(found >= 0)
        other = other[self.keys[found[other]] != hashes[other]]
        while len(other):
            at[other] = (at[other] + np.uint64(1)) & self.mask
            found[other] = self.slots[at[other]]
            other = other[found[other] >= 0]
            other = other[self.keys[found[other]] != hashes[other]]
        return found


def mapped_text(docs: DataFrame, change) -> DataFrame:
    """The same rows and columns with ``change(text)`` as the text and its length as ``n_chars``.

    A null text stays null; ``n_chars`` is set where there is such a column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = batch.schema.names, list(batch.columns)
            new = [None if t is None else change(t) for t in columns[names.index("text")].to_pylist()]
            for name, values in (("text", new), ("n_chars", [None if t is None else len(t) for t in new])):
                if name in names:
                    k = names.index(name)
                    columns[k] = pa.array(values, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            release()

    return docs.mapInArrow(run, docs.schema)
