"""Best-fit packing by linear grouping: token pieces into as few sequences as possible.

Only the histogram of piece lengths, at most ``capacity`` rows, comes to the driver. There the
large lengths, in descending order, are cut into groups of equal cardinality and rounded up to
the largest of their group. For these few sizes the configurations of a sequence are optimised
(a linear program, columns made by a knapsack). The configurations are filled with actual
pieces, and what is left, then the small pieces, goes by best fit into the rooms that remain.

The plan is made of runs ("pieces of this length with ranks a to b go to sequences c to d"), so
its size depends on the number of lengths, not on the number of pieces.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm.chunks import ChunkIds
from tablewright.llm.common import staged, texts

CAPACITY = 2048
GROUPS = 64
# Lengths of at least this share of a sequence are large; the plan with the fewest sequences is taken.
LARGE = (0.2, 0.35, 0.5)
# Pieces a shard of the ranking holds, about.
SHARD_PIECES = 200_000

class LibraryIds:
    """Ids of chunks by a ``tokenizers`` file."""

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes of each token: the vocabulary has one character for each.
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)

    def _ids(self, texts_: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)
        return np.array(list(chain.from_iterable([e.ids for e in found])), np.uint32)

    def _together(self, chunks: list[bytes], most: int = 500) -> list[np.ndarray]:
        """Ids of chunks that begin with white space and end otherwise: many stand in one text.

        The tokens' byte lengths tell which are whose.
        """
        texts_ = [b"".join(chunks[i : i + most]).decode() for i in range(0, len(chunks), most)]
        ids = np.concatenate([*[self._ids(texts_[i : i + 16]) for i in range(0, len(texts_), 16)], np.zeros(0, np.uint32)])
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(c) for c in chunks])) + 1
        return [ids[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def encode_new(self, chunks: list[bytes], among: np.ndarray) -> list[np.ndarray]:
        found: list[np.ndarray] = [self._ids([c.decode()]) if not m else None for c, m in zip(chunks, among.tolist(), strict=True)]
        at = np.flatnonzero(among).tolist()
        for k, ids in zip(at, self._together([chunks[k] for k in at]), strict=True):
            found[k] = ids
        return found


def token_pieces(docs: DataFrame, source: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids and the end id, cut if too long.

    A text of more than ``capacity`` ids is cut from its end into full pieces, so that only the
    first may be shorter. A null or empty text is one piece, the end id.
    """
    # A Python worker keeps its broadcast values, and with them the chunks it knows, over many tasks.
    # A Python worker keeps its broadcast values, and with them the chunks it knows, over many tasks.
    shared = docs.sparkSession.sparkContext.broadcast({"source": source})
    stop = np.array([end_id], np.uint32)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "tokens" not in held:
            library = LibraryIds(held["source"])
            held["tokens"] = ChunkIds(library.special, library.encode_new)
        for batch in batches:
            for low, all_ids, bounds in held["tokens"].encode(batch.column("text")):
                rows: list[tuple[int, int, int, int, int]] = []
                ids = []
                for at, (a, b) in enumerate(pairwise(bounds.tolist()), low):
                    own = np.concatenate([all_ids[a:b], stop])
                    start, n = 0, len(own)
                    for piece in range(-(-n // capacity)):
                        length = (n % capacity or capacity) if piece == 0 else capacity
                        part = own[start : start + length]
                        rows.append((at, piece, start, length, zlib.crc32(part.astype("<u4"))))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                        start += length
                at, piece, start, length, crc = np.array(rows, np.int64).T
                columns = [
                    batch.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids)] if with_ids else []), names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return texts(docs, "doc_id").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one sequence, each size any number of times."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    size = np.array(sizes)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.flatnonzero(size <= room)
        if len(fits):
            gains = value[room - size[fits]] + worth[fits]
            best = int(gains.argmax())
            if gains[best] > value[room] + 1e-12:
                value[room], choice[room] = gains[best], fits[best]
    pattern = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(pattern, how many sequences): the linear program's optimum, rounded down.

    Revised simplex with the patterns as columns, begun with one size a pattern.
    """
    m = len(sizes)
    basis = [np.eye(m, dtype=np.int64)[g] * (capacity // sizes[g]) for g in range(m)]
    need = np.array(demand, float)
    for _ in range(rounds):
        matrix = np.array(basis, float).T
        worth = np.linalg.solve(matrix.T, np.ones(m))
        value, pattern = best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        amounts = np.linalg.solve(matrix, need)
        entering = np.linalg.solve(matrix, pattern.astype(float))
        positive = np.flatnonzero(entering > 1e-9)
        leaving = positive[np.argmin(np.maximum(amounts[positive], 0) / entering[positive])]
        basis[leaving] = pattern
    amounts = np.linalg.solve(np.array(basis, float).T, need)
    return [(p, int(x + 1e-7)) for p, x in zip(basis, amounts, strict=True) if x + 1e-7 >= 1]


@dataclass
class Plan:
    """Runs of pieces: ``count`` of ``length`` from ``rank`` on, ``per`` a sequence, from ``first`` on at ``offset``."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    rooms: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)  # the rooms there are, ascending

    def leave(self, first: int, n: int, used: int) -> None:
        """``n`` sequences from ``first`` on have room left."""
        room = self.capacity - used
        if n <= 0 or room == 0:
            return
        if room not in self.rooms:
            bisect.insort(self.sizes, room)
            self.rooms[room] = []
        self.rooms[room].append((first, n, used))

    def put(self, length: int, rank: int, count: int, first: int, n: int, used: int) -> tuple[int, int]:
        """As many pieces as fit into ``n`` equal sequences, the fullest first; what is left."""
        per = (self.capacity - used) // length
        full = min(n, count // per)
        if full:
            self.runs.append((length, rank, full * per, first, per, used))
            self.leave(first, full, used + full // full * per * length)
            rank, count = rank + full * per, count - full * per
        if full < n and count:
            self.runs.append((length, rank, count, first + full, count, used))
            self.leave(first + full, 1, used + count * length)
            rank, count, full = rank + count, 0, full + 1
        self.leave(first + full, n - full, used)
        return rank, count

    def best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.sizes, length)
            if at < len(self.sizes):
                room = self.sizes[at]
                first, n, used = self.rooms[room].pop()
                if not self.rooms[room]:
                    del self.rooms[room], self.sizes[at]
            else:
                n, used, first = -(-count // (self.capacity // length)), 0, self.sequences
                self.sequences += n
            rank, count = self.put(length, rank, count, first, n, used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = 0.2) -> Plan:
    """Where the pieces of each length go, by rank within their length."""
    done = Plan(capacity)
    least = min(capacity, max(1, int(large * capacity)))
    waiting: list[list[tuple[int, int, int]]] = []  # per group: (length, rank, count), longest first
    big = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if least <= s < capacity and histogram[s]]
    total = sum(n for _, n in big)
    quota, filled = max(1, -(-total // groups)), 0
    for length, count in big:
        rank = 0
        while rank < count:
            if filled % quota == 0:
                waiting.append([])
            taken = min(count - rank, quota - filled % quota)
            waiting[-1].append((length, rank, taken))
            rank, filled = rank + taken, filled + taken
    if waiting:
        sizes, demand = [g[0][0] for g in waiting], [sum(n for *_, n in g) for g in waiting]
        # Groups of one size are one row of the program.
        rows: dict[int, list[int]] = {}
        for g, size in enumerate(sizes):
            rows.setdefault(size, []).append(g)
        needs = [sum(demand[g] for g in own) for own in rows.values()]
        stock = [[piece for g in own for piece in waiting[g]][::-1] for own in rows.values()]
        for pattern, n in configurations(list(rows), needs, capacity):
            parts = [(done.sequences, n, 0)]
            done.sequences += n
            for row in np.repeat(np.arange(len(stock)), pattern):
                after = []
                for first, left, used in parts:
                    while left and stock[row]:
                        length, rank, count = stock[row].pop()
                        taken = min(left, count)
                        done.runs.append((length, rank, taken, first, 1, used))
                        after.append((first, taken, used + length))
                        if taken < count:
                            stock[row].append((length, rank + taken, count - taken))
                        first, left = first + taken, left - taken
                    if left:
                        after.append((first, left, used))
                parts = after
            for part in parts:
                done.leave(*part)
        rest = sorted((piece for own in stock for piece in own), reverse=True)
    else:
        rest = []
    if histogram.get(capacity):
        done.runs.append((capacity, 0, histogram[capacity], done.sequences, 1, 0))
        done.sequences += histogram[capacity]
    for length, rank, count in rest:
        done.best_fit(length, rank, count)
    for length in sorted((s for s in histogram if s < least), reverse=True):
        done.best_fit(length, 0, histogram[length])
    return done


def packed(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every sequence is gapless from 0.

    ``pieces`` has ``length`` of 1 to ``capacity``; its other columns are kept. Equal lengths are
    told apart by their rank, which is counted in shards of bounded size, so that one common
    length is no large group. Ties are broken by the order in which the pieces were written.
    """
    kept = staged(pieces.withColumn("_seq", F.monotonically_increasing_id()))
    shards = max(1, kept.count() // SHARD_PIECES)
    kept = kept.withColumn("_shard", F.pmod("_seq", F.lit(shards)))
    counts = staged(kept.groupBy("length", "_shard").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    best = min((plan(histogram, capacity, groups, share) for share in large), key=lambda p: p.sequences)
    runs = np.array(sorted(best.runs), np.int64).reshape(-1, 6)
    own = Window.partitionBy("length", "_shard").orderBy("_seq")
    ranked = kept.withColumn("_own", F.row_number().over(own) - 1).join(bases, ["length", "_shard"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_own")).alias("_rank"))
    names = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - runs[at, 1]
            sequence, offset = runs[at, 3] + nth // runs[at, 4], runs[at, 5] + nth % runs[at, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    schema = pieces.schema.simpleString()[7:-1]
    return ranked.mapInArrow(run, f"{schema}, sequence_id:bigint, offset:bigint")


def pack(
    docs: DataFrame, source: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
    groups: int = GROUPS, large: tuple[float, ...] = LARGE,
) -> DataFrame:
    """The documents' pieces with their places: ``token_pieces`` and ``sequence_id``, ``offset``.

    Null and repeated ids keep their rows; other columns are ignored; no documents, no rows.
    """
    return packed(token_pieces(docs, source, capacity, end_id, with_ids), capacity, groups, large)
