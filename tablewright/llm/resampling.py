"""Importance resampling towards a target distribution over hashed n-grams.

A text's separators collapse to single blanks. One scan with overlapping matches, held to word
boundaries by lookarounds, then gives at each word the spans of the n-grams that begin there;
their CRCs go on from one span to the next and fall into buckets. A bucket's gain is the log of
its share in the target over its share in the corpus, a document's weight the mean gain of its
n-grams, and the draw without replacement takes the largest weights after Gumbel noise that
only depends on the document's id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import list_array, matching, numbered, release, staged, texts

LONGEST = 2
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = (25, 100)
SEED = 7
# Gains and noise are whole thousandths.
UNIT = 1000
# N-grams that a step inside a task works on.
BLOCK_GRAMS = 1 << 18
# Every byte but those of digits, letters and characters beyond ASCII stands between words; A-Z become a-z.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def line_of(text: str) -> bytes:
    """The words of a text, lower-cased, with single blanks between them."""
    return b" ".join(text.encode().translate(FOLDED).split())


def scanner(longest: int) -> regex.Pattern:
    """Matches at a word's beginning: the word, then up to ``longest - 1`` more, a group each."""
    return regex.compile(rb"(?<![^ ])([^ ]++)" + rb"( [^ ]++)?+" * (longest - 1) + rb"(?![^ ])")


def gram_spans(line: bytes, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """Where the n-grams of one to ``longest`` words of a collapsed line stand."""
    for found in scanner(longest).finditer(line, overlapped=True):
        for k in range(1, longest + 1):
            if found.end(k) < 0:
                break
            yield found.start(), found.end(k)


def gram_crcs(line: bytes, scan: regex.Pattern) -> tuple[list[int], int]:
    """The CRC of each n-gram, each word's from the shortest on, and the number of words."""
    crcs, words = [], 0
    for found in scan.finditer(line, overlapped=True):
        words += 1
        crc = 0
        for piece in found.groups():
            if piece is None:
                break
            crc = crc32(piece, crc)
            crcs.append(crc)
    return crcs, words


def gram_buckets(docs: DataFrame, key: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, grams): the bucket of every n-gram of each whole text, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(longest)
        for batch in batches:
            first, held, sizes, words, found = 0, 0, [], [], []

            def part(end: int) -> pa.RecordBatch:
                bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                columns = [batch.column(0).slice(first, end - first), pa.array(words, pa.int64()), list_array(flat, bounds, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, [key, "n_words", "grams"])

            for row, text in enumerate(batch.column(1)):
                crcs, n = gram_crcs(line_of(text.as_py()), scan)
                found.append((np.array(crcs, np.int64) % buckets).astype(np.int32))
                sizes.append(len(crcs))
                words.append(n)
                held += len(crcs)
                if held >= BLOCK_GRAMS:
                    yield part(row + 1)
                    first, held, sizes, words, found = row + 1, 0, [], [], []
            if sizes:
                yield part(batch.num_rows)
            release()

    kind = docs.schema[key].dataType.simpleString()
    return texts(docs, key).mapInArrow(run, f"`{key}` {kind}, n_words bigint, grams array<int>")


def bucket_counts(grams: DataFrame, buckets: int) -> list[int]:
    """How many n-grams fell into each bucket; ``buckets`` rows leave each task and come to the driver."""
    counts = [0] * buckets
    for row in grams.select(F.explode("grams").alias("bucket")).groupBy("bucket").count().collect():
        counts[row["bucket"]] = row["count"]
    return counts


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """Per bucket, the log of the target's share over the corpus's, counts taken plus one, floored to thousandths."""
    n, all_, aim = len(corpus), sum(corpus), sum(target)
    return [math.floor(UNIT * math.log(float((t + 1) * (all_ + n)) / float((s + 1) * (aim + n)))) for s, t in zip(corpus, target)]


def weighed(grams: DataFrame, key: str, gains: list[int]) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean gain of each document's n-grams; none give 0."""
    table = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()
            weight = np.zeros(len(lists), np.int64)
            low = 0
            while low < len(lists):
                high = max(low + 1, int(np.searchsorted(at, at[low] + BLOCK_GRAMS, side="right")) - 1)
                sums = np.concatenate([[0], np.cumsum(table[flat[at[low] : at[high]]])])
                cuts = at[low : high + 1] - at[low]
                weight[low:high] = (sums[cuts[1:]] - sums[cuts[:-1]]) // np.maximum(np.diff(cuts), 1)
                low = high
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(weight)], [key, "n_words", "n_features", "weight"]
            )

    kind = grams.schema[key].dataType.simpleString()
    return grams.select(key, "n_words", "grams").mapInArrow(
        run, f"`{key}` {kind}, n_words bigint, n_features bigint, weight bigint"
    )


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank``.

    ``rank`` counts the drawn documents by ``score``, ties to the smaller id (a null id last, then
    by ``n_features`` and ``weight``); it is null for the others. Of the documents of at least
    ``least_words`` words the share ``share`` is drawn, rounded down.

    A null or empty text has no n-grams and weight 0; a null id is hashed as an empty one; rows
    that repeat an id keep their rows, with one noise. Texts of any length are read whole. Other
    columns are ignored; no rows, no result; a target without texts leaves the corpus's own shares.
    """
    found = staged(gram_buckets(docs, "doc_id", longest, buckets))
    aim = gram_buckets(target.withColumn("_row", F.lit(0)), "_row", longest, buckets)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-UNIT * F.log(-F.log((h + 0.5) / float(1 << 32))))
    scored = staged(weighed(found, "doc_id", gains).withColumn("score", F.col("weight") + noise))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    ranked, n = numbered(scored.where(F.col("n_words") >= least_words), *order)
    drawn = F.when(F.col("number") <= share[0] * n // share[1], F.col("number"))
    shown = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*shown, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*shown, drawn.alias("rank")).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The drawn documents with all their columns; rows that repeat a drawn id all come."""
    drawn = importance_ranks(docs, target, **options).where(F.col("rank").isNotNull()).select("doc_id")
    return matching(docs, drawn, "doc_id", "left_semi")
