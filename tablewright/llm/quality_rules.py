"""Quality rules: hashed n-gram log-likelihood ratio of trusted texts against the whole corpus.

DataFrame functions only. Words and word pairs are hashed to a fixed number of buckets. Two
multinomials over the buckets are counted, one from the trusted texts and one from every text; a
document's score is the mean over its n-grams of log(trusted share / corpus share). A document is
kept if it passes the base rules and its score reaches the threshold, a constant, so the verdict
depends on its own text and the two multinomials alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import matching, texts

# Words are what stands between blanks and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"

BUCKETS = 8192
# N-grams that the corpus's shares weigh in the trusted texts'.
PRIOR = 20 * BUCKETS
THRESHOLD = -0.05


def words(text: Column) -> Column:
    """The words of a text; none give an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def bound_to(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """How many words stand in three-word windows that the text holds twice or more.

    Windows are sorted with their positions, so that equal ones are neighbours; a text without
    equal windows is not sorted.
    """

    def windows(h: Column) -> Column:
        all_ = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return F.slice(all_, 1, F.greatest(F.size(h) - 2, F.lit(0)))

    def starts(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def equal_neighbours(s: Column) -> Column:
            def repeated(x: Column, k: Column) -> Column:
                return (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])

            return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"]))

        return bound_to(ordered, equal_neighbours)

    def covered(at: Column) -> Column:
        """Words in the union of [start, start + 2]."""
        width = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(width, F.lit(0), lambda total, x: total + x)

    def count(w: Column) -> Column:
        unique = F.size(F.array_distinct(w)) == F.size(w)
        return F.when(unique, F.lit(0)).otherwise(bound_to(starts(w), covered))

    return bound_to(bound_to(hashes, windows), count).cast("long")


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """The bucket of each word and of each pair of neighbours, repeats included."""

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        two = F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(one, F.slice(two, 1, F.greatest(F.size(h) - 1, F.lit(0))))

    return bound_to(hashes, both)


def word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: int = PRIOR) -> list[float]:
    """Per bucket, log of the trusted texts' share over the corpus's.

    Corpus counts are taken plus one. The trusted texts' have the corpus's shares as a prior that
    weighs ``prior`` n-grams, so that few trusted texts say little; none say nothing, and every
    ratio is 0. The buckets are counted before the shuffle, so ``buckets`` rows leave each task
    and come to the driver.
    """

    def counts(rows: DataFrame) -> dict[int, int]:
        each = texts(rows).select(F.explode(ngram_buckets(word_hashes(words(F.col("text"))), buckets)).alias("bucket"))
        return {r["bucket"]: r["count"] for r in each.groupBy("bucket").count().collect()}

    good, all_ = counts(trusted), counts(docs)
    n_good, n_all = sum(good.values()), sum(all_.values()) + buckets
    shares = [(all_.get(b, 0) + 1) / n_all for b in range(buckets)]
    return [math.log((good.get(b, 0) / p + prior) / (n_good + prior)) for b, p in enumerate(shares)]


def quality_rules(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: counts, base verdict, ``ratio`` and ``kept``.

    * ``doc_id`` as given (null and repeated ids keep their rows)
    * ``n_words``, ``word_chars`` code points in words, ``n_symbols``, ``n_dup_lines`` lines with a
      word that equal an earlier line, ``n_repeat_words`` words in repeated three-word windows
    * ``base_failed``: fewer than 50 words, or more than half of them in repeated windows
    * ``ratio``: mean log ratio of the n-grams, 0 without words; ``kept``: not ``base_failed`` and
      ``ratio`` at least ``threshold``

    A null or empty text has no words and fails the base rule. Other columns are ignored.
    """
    weights = ",".join(repr(x) for x in log_ratios(docs, trusted, buckets))
    table = F.split(F.lit(weights), ",").cast("array<double>")
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def mean_ratio(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda t, b: t + F.get(table, b))
        return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(total / F.size(found))

    counted = texts(docs, "doc_id").select(
        "doc_id",
        F.char_length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound_to(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bound_to(
            word_hashes(words(text)),
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                repeated_words(h).alias("n_repeat_words"),
                bound_to(ngram_buckets(h, buckets), mean_ratio).alias("ratio"),
            ),
        ).alias("own"),
    )
    n, repeats = F.col("own.n_words"), F.col("own.n_repeat_words")
    failed = (n < 50) | (100 * repeats > 50 * n)
    return counted.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (F.col("own.ratio") >= threshold)).alias("kept"),
        F.col("own.ratio").alias("ratio"),
    )


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents labelled good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    return matching(docs, good, "doc_id", "left_semi")
