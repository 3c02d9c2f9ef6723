"""Which patterns occur inside which texts, without pairing every pattern with every text.

A pattern can only occur where all of its short substrings (grams) do, so it is looked up by the
one that stands in the fewest places. The grams of all patterns are counted over the texts once;
the patterns with their rarest grams are the index, written once. Texts meet it under their own
grams, as 64-bit numbers, each once for a text, and pairs that meet are checked in full. The grams
are taken by array operations over blocks of texts, inside the tasks. Patterns that share a long beginning are told
apart by what follows, and a pattern with a gram that no text holds is not looked up at all.

What a join sends to the tasks is measured first. Where the index is too large for that, the
texts' grams pass a bitmap of its hashes, so that only those that may be in it are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import spread, work_folder

BROADCAST_BYTES = 64 << 20
# What a row costs beside its text, roughly, in a table sent to the tasks.
ROW_BYTES = 64
# A pattern's grams are of the largest of these lengths that it has.
LADDER = (0, 1, 2, 3, 5)
# Bytes of text whose grams are taken together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
# Marks of texts by grams that are held at once; beyond them the pairs are sorted.
MARK_CELLS = 1 << 24
# The bitmap that stands for a large index: 8 million bits in words of 64, so 131,072 rows at most.
BITMAP_BITS = 1 << 23
# Bytes of grams, by the texts' length, that one partition of a shuffle gets at most.
PART_BYTES = 64 << 20
PAIR_BYTES = 40
# Odd numbers that a gram's characters, its length and a key's slot are multiplied by.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
BY_LENGTH, BY_SLOT = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0xFF51AFD7ED558CCD)


def _staged(df: DataFrame) -> DataFrame:
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _head_length(length: Column) -> Column:
    steps = F.array(*[F.lit(n) for n in LADDER])
    return F.array_max(F.filter(steps, lambda n: n <= length))


def _pattern_grams(patterns: DataFrame) -> DataFrame:
    """Distinct patterns with their length, their grams' length ``head``, and the distinct grams."""
    found = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    found = found.withColumn("length", F.char_length("pattern")).withColumn("head", _head_length(F.col("length")))

    def gram(start: Column) -> Column:
        return F.substring(F.col("pattern"), start, F.col("head"))

    starts = F.sequence(F.lit(1), F.col("length") - F.col("head") + 1)
    every = F.when(F.col("head") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(starts, gram)))
    return found.withColumn("grams", every)


def _characters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings' characters as numbers, one string after the other, and where each begins."""
    raw = strings.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    held = raw.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at - at[0]]
    codes = np.frombuffer(_decoded(data.tobytes()), "<u4")
    if len(codes) != bounds[-1]:  # bytes that are no characters
        each = [np.frombuffer(_decoded(t or b""), "<u4") for t in raw.to_pylist()]
        codes, bounds = np.concatenate(each), np.cumsum([0, *map(len, each)])
    return codes.astype(np.uint64), bounds


def _decoded(data: bytes) -> bytes:
    return data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass")


def _gram_keys(codes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the numbers of the grams that begin at each character."""
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        key = key[: max(len(codes) - n + 1, 0)] + codes[n - 1 :] * FACTORS[n - 1]
        if n in lengths:
            yield n, key + np.uint64(n) * BY_LENGTH


@F.arrow_udf(T.LongType())
def _key(grams: pa.Array) -> pa.Array:
    """A gram as a number; what meets under it is compared in full afterwards. An empty one is 0."""
    codes, bounds = _characters(grams)
    found = np.zeros(len(grams), np.uint64)
    for n, keys in _gram_keys(codes, list(range(1, len(FACTORS) + 1))):
        own = np.flatnonzero(np.diff(bounds) == n)
        found[own] = keys[bounds[own]]
    return pa.array(found.view(np.int64))


class _Keys:
    """Positions of numbers in a set, by a table of slots; slots of several are searched."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys.astype(np.int64).view(np.uint64))
        bits = min(24, max(16, (8 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        slot = (self.keys * BY_SLOT) >> self.shift
        self.table = np.zeros(1 << bits, np.int32)
        self.table[slot] = np.arange(len(self.keys))
        self.crowded = np.bincount(slot.astype(np.int64), minlength=1 << bits) > 1

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the values are held, and the position of each."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = (values * BY_SLOT) >> self.shift
        at = self.table[slot]
        held = self.keys[at] == values
        more = np.flatnonzero(self.crowded[slot] & ~held)
        at[more] = np.minimum(np.searchsorted(self.keys, values[more]), len(self.keys) - 1)
        held[more] = self.keys[at[more]] == values[more]
        rows = np.flatnonzero(held)
        return rows, at[rows].astype(np.int64)


def _blocks(parts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, end row, their characters, and each character's string and row, ``(2, n)``."""
    counts = np.diff(parts.offsets.to_numpy())
    strings = parts.flatten()
    first = np.concatenate([[0], np.cumsum(counts)])
    raw = strings.cast(pa.large_binary())
    size = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    ends = size[first]
    low = 0
    while low < len(parts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK_BYTES, side="right")) - 1)
        codes, bounds = _characters(strings.slice(first[low], first[high] - first[low])) if first[high] > first[low] else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        no = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        row = np.repeat(np.arange(high - low), counts[low:high])
        yield low, high, codes, np.stack([no, row[no]]) if len(no) else np.zeros((2, 0), np.int64)
        low = high


def _counted(texts: DataFrame, lengths: list[int], wanted: np.ndarray) -> DataFrame:
    """``key, places``: in how many places of the texts each of the wanted grams stands; tasks count first."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Keys(shared.value)
        total = np.zeros(len(held.keys), np.int64)
        for batch in batches:
            for _, _, codes, (no, _) in _blocks(batch.column(0)):
                for n, keys in _gram_keys(codes, lengths):
                    at, which = held.find(keys)
                    total += np.bincount(which[no[at] == no[at + n - 1]], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys[seen].view(np.int64)), pa.array(total[seen])], ["key", "n"])

    return texts.select("parts").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("places"))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The keys' bits, of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy().view(np.uint64))
            bits = (np.uint64(1) << (bit & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["word", "bits"])

    words = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _bit(keys: np.ndarray) -> np.ndarray:
    return (keys * BY_SLOT) >> np.uint64(64 - (BITMAP_BITS.bit_length() - 1))


def _with_keys(texts: DataFrame, lengths: list[int], wanted: np.ndarray | None, bitmap: np.ndarray | None, names: list[str]) -> DataFrame:
    """Texts with ``keys``: of their grams, each once, those that are ``wanted``, or may be by the bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast((wanted, np.packbits(bitmap) if bitmap is not None else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packed = shared.value
        held = _Keys(own) if own is not None else None
        may = np.unpackbits(packed).astype(bool) if packed is not None else None
        for batch in batches:
            kept = batch.select(names)
            for low, high, codes, (no, row) in _blocks(batch.column("parts")):
                size = high - low
                rows, keys = ([np.arange(size)], [np.zeros(size, np.int64)]) if 0 in lengths else ([], [])
                marks = np.zeros((size, len(held.keys)), bool) if held is not None and size * len(held.keys) <= MARK_CELLS else None
                for n, found in _gram_keys(codes, lengths):
                    at, which = held.find(found) if held is not None else (np.flatnonzero(may[_bit(found)]), None)
                    good = no[at] == no[at + n - 1]
                    at, which = at[good], which[good] if which is not None else None
                    if marks is not None:
                        marks[row[at], which] = True
                    else:
                        rows.append(row[at])
                        keys.append(found[at].view(np.int64))
                if marks is not None:
                    at, which = np.nonzero(marks)
                    rows.append(at)
                    keys.append(held.keys[which].view(np.int64))
                r, k = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*keys, np.zeros(0, np.int64)])
                order = np.lexsort((k, r))
                r, k = r[order], k[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
                r, k = r[new], k[new]
                ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=size))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(k))
                yield pa.RecordBatch.from_arrays([*kept.slice(low, size).columns, lists], [*names, "keys"])

    kinds = ", ".join(f"{n} {texts.schema[n].dataType.simpleString()}" for n in names)
    return texts.mapInArrow(run, f"{kinds}, keys array<bigint>")


def rare_gram_index(
    patterns: DataFrame, texts: DataFrame, gram_bytes: int = BROADCAST_BYTES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``pattern, length, head, gram, key``: each pattern with the gram that stands in the fewest places, staged.

    Patterns with a gram that stands nowhere are left out. Patterns no longer than their grams need
    no count. The distinct grams go to the tasks up to ``gram_bytes``, their counts up to
    ``broadcast_bytes``; beyond that both sides are shuffled, the texts' grams behind a bitmap.
    """
    found = _staged(_pattern_grams(patterns))
    whole = F.size("grams") == 1
    named = ["pattern", "length", "head", "gram", "key"]
    single = found.where(whole).withColumn("gram", F.col("grams")[0]).withColumn("key", _key(F.col("gram"))).select(*named)
    several = found.where(~whole).withColumn("gram", F.explode("grams")).withColumn("key", _key(F.col("gram"))).select(*named)
    wanted = several.groupBy("key").agg(F.first("head").alias("head"))
    use = wanted.agg(F.collect_set("head").alias("lengths"), F.count("*").alias("n")).first()
    if not use["n"]:
        return _staged(single)
    lengths, wanted = sorted(use["lengths"]), wanted.select("key")
    if use["n"] * ROW_BYTES <= gram_bytes:
        counts = _staged(_counted(spread(texts), lengths, wanted.toArrow().column(0).to_numpy()))
    else:
        held = _with_keys(spread(texts), lengths, None, _bitmap(wanted), ["text_id"]).select(F.explode("keys").alias("key"))
        counts = _staged(held.join(wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("places")))
    small = counts.count() * ROW_BYTES <= broadcast_bytes
    counted = several.join(F.broadcast(counts) if small else counts, "key", "left")
    rarest = counted.groupBy("pattern").agg(
        F.first("length").alias("length"),
        F.first("head").alias("head"),
        F.min(F.struct("places", "gram", "key")).alias("rarest"),
        F.count_if(F.col("places").isNull()).alias("nowhere"),
    )
    rarest = rarest.where("nowhere = 0").select("pattern", "length", "head", "rarest.gram", "rarest.key")
    return _staged(single.unionByName(rarest))


def candidate_pairs(
    index: DataFrame, texts: DataFrame, small: str = "patterns", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``pattern, text_id`` of each place where a text holds the pattern's gram.

    ``small`` says which side is the dictionary. It is sent to the tasks when it fits, and then the
    other one is not shuffled; the texts' ``parts`` come along where they are at hand.
    """
    cost = F.octet_length("pattern") + ROW_BYTES
    use = index.agg(F.collect_set("head").alias("lengths"), F.coalesce(F.sum(cost), F.lit(0)).alias("size")).first()
    lengths = sorted(use["lengths"])
    index, texts = index.select("pattern", "key"), spread(texts)
    if small == "patterns" and use["size"] <= broadcast_bytes:
        keys = index.select("key").distinct().toArrow().column(0).to_numpy()
        grams = _with_keys(texts, lengths, keys, None, ["text_id", "parts"])
        return grams.select("text_id", "parts", F.explode("keys").alias("key")).join(F.broadcast(index), "key").drop("key")
    chars = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, t: n + F.coalesce(F.char_length(t), F.lit(0)))
    total = texts.agg(F.coalesce(F.sum(chars), F.lit(0)).alias("n")).first()["n"]
    grams = _with_keys(texts, lengths, None, _bitmap(index), ["text_id"]).select("text_id", F.explode("keys").alias("key"))
    if small == "texts" and total * max(1, len(lengths)) * ROW_BYTES <= broadcast_bytes:
        return index.join(F.broadcast(grams.distinct()), "key").drop("key").distinct().join(F.broadcast(texts), "text_id")
    parts = _parts(texts, total * max(1, len(lengths)) * PAIR_BYTES)
    return grams.repartition(parts, "key").join(index.repartition(parts, "key"), "key").drop("key")


def _parts(df: DataFrame, size: int) -> int:
    """Partitions of a shuffle of up to ``size`` bytes, so that a task's share does not grow with them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))


def _repeated(texts: DataFrame) -> bool:
    """Whether a text's id stands on several rows."""
    return texts.groupBy("text_id").count().where("count > 1").limit(1).count() > 0


def _in_parts() -> Column:
    return F.exists("parts", lambda t: F.contains(t, F.col("pattern")))


def substring_pairs(
    patterns: DataFrame,
    texts: DataFrame,
    small: str,
    gram_bytes: int = BROADCAST_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Pairs ``(pattern, text_id)`` where the pattern occurs in one of the text's parts.

    ``patterns(pattern)`` and ``texts(text_id, parts array<string>)`` are compared as they are.
    Only the gram lengths in use and the sizes of what is sent come to the driver.
    """
    index = rare_gram_index(patterns, texts, gram_bytes, broadcast_bytes)
    met = candidate_pairs(index, texts, small, broadcast_bytes)
    if "parts" in met.columns:
        found = met.where(_in_parts()).select("pattern", "text_id")
    else:
        found = met.join(texts, "text_id").where(_in_parts()).select("pattern", "text_id")
    return found.distinct() if _repeated(texts) else found


def keyword_hits(
    queries: DataFrame,
    dictionary: DataFrame,
    first: int | None = None,
    gram_bytes: int = BROADCAST_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Keywords that occur in each query, in any case: ``query_id, keyword, content, position``.

    ``queries(query_id, text)``, ``dictionary(keyword, content)`` with unique keywords.
    ``position`` numbers a query's hits in keyword order. With ``first`` only the leading hits of
    each query are wanted, as by a search that shows k results.
    """
    entries = dictionary.where(F.col("keyword").isNotNull()).select("keyword", "content", F.lower("keyword").alias("pattern"))
    texts = queries.where(F.col("text").isNotNull()).select(
        F.col("query_id").alias("text_id"), F.array(F.lower("text")).alias("parts")
    )
    pairs = substring_pairs(entries, texts, "patterns", gram_bytes, broadcast_bytes).withColumnRenamed("text_id", "query_id")
    cost = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("keyword", "content", "pattern")]
    size = entries.agg(F.coalesce(F.sum(sum(cost, F.lit(ROW_BYTES))), F.lit(0))).first()[0]
    small = size <= broadcast_bytes
    names, entries = entries.select("pattern", "keyword"), entries.select("keyword", "content")
    order = Window.partitionBy("query_id").orderBy("keyword")
    hits = pairs.join(F.broadcast(names) if small else names, "pattern").select("query_id", "keyword")
    ranked = hits.withColumn("position", F.row_number().over(order))
    ranked = ranked if first is None else ranked.where(F.col("position") <= first)
    # Contents come last: they are not carried through the numbering.
    return ranked.join(F.broadcast(entries) if small else entries, "keyword").select("query_id", "keyword", "content", "position")


def glossary_hits(
    queries: DataFrame, terms: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Terms whose name or definition contains the query: ``query_id, term, definition``.

    ``queries(query_id, text)``, ``terms(term, definition)`` with unique terms. Each distinct
    query text is matched once and then handed to all queries that ask it.
    """
    asked = queries.select("query_id", F.lower("text").alias("pattern")).where("pattern IS NOT NULL")
    parts = F.array(F.lower("term"), F.lower(F.coalesce("definition", F.lit(""))))
    texts = terms.select(F.col("term").alias("text_id"), parts.alias("parts"))
    pairs = substring_pairs(asked, texts, "texts", broadcast_bytes, broadcast_bytes).withColumnRenamed("text_id", "term")
    return asked.join(pairs, "pattern").join(terms, "term").select("query_id", "term", "definition")
