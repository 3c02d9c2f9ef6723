"""Line dedup: segment-partition join of lines within an edit distance.

A line is cut into threshold + 1 segments. Of two lines within the threshold, the longer holds one
of the shorter's segments unchanged, near its place; so every line is entered under its own
segments and asked for under the few substrings that may be a segment of a line no longer than
itself. Lines that meet are verified by a banded bit-parallel edit distance. Lines that are
shorter may differ by one edit, in two segments, and the shortest must be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import list_array, mixed, release, staged
from tablewright.llm.links import components, impossible, leaders, meeting, merged, possible, unordered, untried

EDITS = 2
# Characters of lines whose keys are made at once, some hundred bytes each.
BLOCK_CHARS = 1 << 18
# Lines from which on ``EDITS`` are allowed.
LEAST_CHARS = 30
# Lines from which on one edit is allowed; shorter ones are alike only when they are equal.
SHORT_CHARS = 12


def segments(n: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each of the ``parts`` segments of lines of ``n`` characters, the last ones longer."""
    base, longer = n // parts, n % parts
    sizes = np.stack([base + (longer >= parts - i) for i in range(parts)], 1)
    return np.cumsum(sizes, 1) - sizes, sizes


class SegmentKeys:
    """Keys of the segments and probe substrings of lines, read off prefix sums of characters."""

    def __init__(self, edits: int) -> None:
        self.edits = edits
        self.base = 0xD6E8FEB86659FD93
        inverse = pow(self.base, -1, 1 << 64)
        size = BLOCK_CHARS * 2
        self.up = self._powers(self.base, size)
        self.down = self._powers(inverse, size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        return np.multiply.accumulate(powers)

    @staticmethod
    def _characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array([len(x) for x in lines], np.int64)
        return text, n, np.cumsum(n) - n

    def sketches(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per line, which of 64 kinds of characters, and of neighbours, it holds an odd number of times."""
        text, n, at = self._characters(lines)
        one = np.uint64(1)
        chars = np.bitwise_xor.reduceat(one << (text.astype(np.uint64) & np.uint64(63)), at)
        both = mixed((text[:-1].astype(np.uint64) << np.uint64(32)) | text[1:].astype(np.uint64)) & np.uint64(63)
        bits = np.append(one << both, np.uint64(0))
        bits[at + n - 1] = 0  # a line's last character has no neighbour
        return chars, np.bitwise_xor.reduceat(bits, at)

    def keys(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per line the keys of its own segments, and of its probes (0 where one repeats)."""
        text, n, at = self._characters(lines)
        if len(text) >= len(self.up):
            self.up, self.down = (self._powers(int(p[1]), 2 * len(text)) for p in (self.up, self.down))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mixed(text.astype(np.uint64) + np.uint64(1)) * self.up[: len(text)], out=sums[1:])

        def key(i: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
            first = at + start
            value = (sums[first + size] - sums[first]) * self.down[first]
            return mixed(value + (size * (self.edits + 1) + i + 1).astype(np.uint64)) | np.uint64(1)

        t, parts = self.edits, self.edits + 1
        starts, sizes = segments(n, parts)
        own = np.stack([key(i, starts[:, i], sizes[:, i]) for i in range(parts)], 1)
        probes = []
        for shorter in range(t + 1):
            starts, sizes = segments(n - shorter, parts)
            for i in range(parts):
                for shift in range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1):
                    start, size = starts[:, i] + shift, sizes[:, i]
                    inside = (start >= 0) & (start + size <= n) & (size > 0)
                    probes.append(np.where(inside, key(i, np.where(inside, start, 0), np.where(inside, size, 0)), 0))
        asked = np.sort(np.stack(probes, 1), 1)
        asked[:, 1:][asked[:, 1:] == asked[:, :-1]] = 0
        asked[(asked[:, :, None] == own[:, None, :]).any(2)] = 0  # its own segments ask as well
        return own, asked


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of two texts is at most ``edits``.

    What the texts share at both ends is set aside. For the rest, one word of bits per number of
    errors holds the diagonals of the band: bit o stands for the prefix of ``a`` that is o - edits
    longer than that of ``b``.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common beginning, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[-middle:] == b[-middle:] else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    band = (1 << (2 * edits + 1)) - 1
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << (i + edits)
    state = [band & ((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]
    for j, char in enumerate(b):
        equal = places.get(char, 0) >> j & band
        before = state
        now = before[0] & equal
        state = [now]
        for e in range(1, edits + 1):
            fewer = before[e - 1]
            now = (before[e] & equal) | fewer | fewer >> 1 | state[e - 1] << 1 & band
            state.append(now)
        if not now:
            return False
    return bool(state[edits] >> (len(a) - len(b) + edits) & 1)


@dataclass(frozen=True)
class Grades:
    """The edits allowed between two lines, by the length of the shorter: ``edits`` from ``least``
    characters on, one from ``short`` on, none below; without ``short`` those below are left out."""

    edits: int = EDITS
    least: int = LEAST_CHARS
    short: int | None = None

    def allowed(self, n: int) -> int:
        return self.edits if n >= self.least else min(1, self.edits) if self.short is not None and n >= self.short else 0

    def allowed_column(self, n: Column) -> Column:
        if self.short is None:
            return F.lit(self.edits)
        return F.when(n >= self.least, self.edits).when(n >= self.short, min(1, self.edits)).otherwise(0)

    def tiers(self) -> list[tuple[int, int, int]]:
        """(from, to, edits): lengths that are entered with so many edits; a pair meets in that of its shorter line."""
        tiers = [(self.least, 1 << 31, self.edits)]
        if self.short is not None and self.short < self.least:
            tiers.append((self.short, self.least - 1 + min(1, self.edits), min(1, self.edits)))
        return tiers


def line_rows(docs: DataFrame, grades: Grades) -> DataFrame:
    """(doc, doc_id, line, text, id, n): the lines that are compared, ``doc`` being a hash of id and text."""
    # The hash of a document is taken before its lines are, or it would be taken anew for each.
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
    each = hashed.select("doc", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    taken = F.col("n") >= grades.least
    if grades.short is not None:
        taken = taken | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return each.withColumn("n", F.char_length("text")).where(taken).withColumn("id", F.xxhash64("text"))


def unique_lines(lines: DataFrame, grades: Grades) -> DataFrame:
    """(id, n, text, chars, pairs, own, asked): a line's sketches, and the keys of its segments and probes.

    Equal lines of a batch are one row. A line whose length stands in two tiers has the keys of both.
    """
    tiers = grades.tiers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [SegmentKeys(edits) for _, _, edits in tiers]
        for batch in batches:
            batch = batch.take(pa.array(np.sort(np.unique(batch.column("id").to_numpy(zero_copy_only=False), return_index=True)[1])))
            column, sizes = batch.column("text"), batch.column("n").to_numpy(zero_copy_only=False)
            low = 0
            while low < len(batch):
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), BLOCK_CHARS)))
                part, n = column.slice(low, high - low).to_pylist(), sizes[low:high]
                chars, pairs = (x.view(np.int64) for x in makers[0].sketches(part))
                found: list[list[np.ndarray]] = [[], []]
                for (least, most, _), maker in zip(tiers, makers, strict=True):
                    inside = np.flatnonzero((n >= least) & (n <= most))
                    if not len(inside):
                        continue
                    for out, keys in zip(found, maker.keys([part[k] for k in inside]), strict=True):
                        whole = np.zeros((len(part), keys.shape[1]), np.uint64)
                        whole[inside] = keys
                        out.append(whole)
                lists = []
                for out in found:
                    keys = np.concatenate([*out, np.zeros((len(part), 0), np.uint64)], 1)
                    bounds = np.concatenate([[0], np.cumsum((keys != 0).sum(1))])
                    lists.append(list_array(keys[keys != 0].view(np.int64), bounds, pa.int64()))
                own = [c.slice(low, high - low) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(chars), pa.array(pairs), *lists], ["id", "n", "text", "chars", "pairs", "own", "asked"])
                low = high
            release()

    compared = lines.where(F.col("n") >= min(least for least, _, _ in tiers))
    return compared.select("id", "n", "text").mapInArrow(
        run, "id long, n int, text string, chars long, pairs long, own array<long>, asked array<long>"
    )


def entries(unique: DataFrame) -> DataFrame:
    """(id, n, chars, pairs, key, own): each line under its segments (``own``) and under its probes."""
    each = unique.select("id", "n", "chars", "pairs", F.size("own").alias("_own"), F.posexplode(F.concat("own", "asked")).alias("_at", "key"))
    return each.withColumn("own", F.col("_at") < F.col("_own")).drop("_own", "_at")


def may_be_within(a: str, b: str, grades: Grades) -> Column:
    """Whether lengths and sketches of two rows, named by prefixes, allow the distance.

    An edit turns at most two kinds of characters from odd to even or back, and four of neighbours.
    """

    def turned(name: str) -> Column:
        return F.bit_count(F.col(f"{a}{name}").bitwiseXOR(F.col(f"{b}{name}")))

    edits = grades.allowed_column(F.least(f"{a}n", f"{b}n"))
    return (F.abs(F.col(f"{a}n") - F.col(f"{b}n")) <= edits) & (turned("chars") <= 2 * edits) & (turned("pairs") <= 4 * edits)


def verified(pairs: DataFrame, unique: DataFrame, grades: Grades) -> DataFrame:
    """The pairs (a, b) of line ids whose lines are within the edits that their lengths allow."""
    pairs = staged(pairs)
    wanted = staged(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    found = merged(possible(unique.select("id", "text"), wanted, "id"), wanted, "id", "left_semi")
    content = staged(found.groupBy("id").agg(F.first("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)
            good = pa.array([within(x, y, grades.allowed(min(len(x), len(y)))) for x, y in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(good)
            release()

    sides = [content.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")) for s in ("a", "b")]
    full = merged(merged(pairs, sides[0], "a"), sides[1], "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(run, "a long, b long")


def similar_lines(lines: DataFrame, grades: Grades) -> DataFrame:
    """(node, root): the class of each line id that has a link to another line.

    Lines under one key are first verified against a few of them. Only those that are then still
    in different classes meet each other.
    """
    unique = staged(unique_lines(lines, grades))
    runs = meeting(entries(unique), "key", "id")
    leads = leaders(runs.where("own"), "key", "id", "n", "chars", "pairs")
    ahead = merged(runs, leads, "key").where((F.col("id") != F.col("lead.id")) & may_be_within("", "lead.", grades))
    tried = staged(ahead.select(*unordered("id", "lead.id")).distinct())
    edges = staged(verified(tried, unique, grades))
    roots = staged(components(edges))
    known = merged(untried(runs, leads, "key", "own"), roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = staged(known)
    mixed_keys = known.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l != h").select("key")
    open_ = staged(merged(known, staged(mixed_keys), "key", "left_semi"))
    x, y = open_.where("own").alias("x"), open_.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("y.n") >= F.col("x.n"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & may_be_within("x.", "y.", grades))
    met = met.select(*unordered("x.id", "y.id")).distinct().join(tried, ["a", "b"], "left_anti")
    met = staged(met)
    if not met.limit(1).count():
        return roots
    more = staged(verified(met, unique, grades))
    return staged(components(edges.union(more))) if more.limit(1).count() else roots


def repeated_lines(docs: DataFrame, grades: Grades) -> DataFrame:
    """(doc, gone): per document, as hash of id and text, the numbers of its lines that stand earlier.

    Lines are alike when they are equal or joined by a chain of lines within the allowed edits
    of each other; of each class the first by document id, then line, stays.
    """
    lines = line_rows(docs.where("text IS NOT NULL").select("doc_id", "text"), grades)
    roots = similar_lines(lines, grades)
    place = staged(lines.select("id", "doc", "doc_id", "line"))
    linked = merged(possible(place, roots.withColumnRenamed("node", "id"), "id"), roots.withColumnRenamed("node", "id"), "id", "left")
    alone = impossible(place, roots.withColumnRenamed("node", "id"), "id").withColumn("root", F.col("id"))
    classed = staged(linked.withColumn("root", F.coalesce("root", "id")).unionByName(alone).drop("id"))
    firsts = classed.groupBy("root").agg(F.min(F.struct("doc_id", "doc", "line")).alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts.where("n > 1").select("root", "first"))
    later = merged(possible(classed, firsts, "root"), firsts, "root")
    later = later.where(~F.struct("doc_id", "doc", "line").eqNullSafe(F.col("first")))
    return later.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _without(docs: DataFrame, grades: Grades) -> DataFrame:
    gone = staged(repeated_lines(docs, grades)).select(F.col("doc").alias("_doc"), F.col("gone").alias("_gone"))
    marked = docs.withColumn("_doc", F.xxhash64("doc_id", "text"))
    # Documents that lose nothing, told by a map of the others, are not shuffled.
    some = merged(possible(marked, gone, "_doc"), gone, "_doc", "left")
    none = impossible(marked, gone, "_doc").withColumn("_gone", F.lit(None).cast("array<int>"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i))
    left = some.withColumn("_text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return left.unionByName(none.withColumn("_text", F.col("text")))


def line_dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, short: int | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped``, ``text`` without repeated lines.

    Lines are what stands between line feeds. Those of fewer than ``least`` characters stay as
    they are, unless ``short`` is given: then one edit is allowed from so many characters on, and
    lines that are shorter still go where they are equal; blank lines stay. A null text stays null, with no lines; a text of which nothing is left becomes
    empty. Rows with the same id and text are treated alike. Null ids come first in the order.
    Lines are told apart by 64-bit hashes. Other columns are ignored; no documents, no rows.
    """
    done = _without(docs.select("doc_id", "text"), Grades(edits, least, short))
    return done.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_text").alias("text"),
    )


def deduped(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, short: int | None = None) -> DataFrame:
    """The documents with repeated lines taken out of ``text`` and ``n_chars`` set to what is left.

    All rows and columns stay, also documents of which nothing is left.
    """
    done = _without(docs, Grades(edits, least, short))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
