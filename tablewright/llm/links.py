"""Classes of linked nodes, found without gathering links or classes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import BROADCAST_ROWS, staged


# Bits of the map that stands for a set of keys: a bound on what is sent to the tasks, a million words.
MAP_BITS = 1 << 26


def joined(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose right side goes to every task if its rows, counted first, are few.

    Beyond that both sides are shuffled, straight from files, so that Spark can split a hot key.
    """
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if small else side, on, how)


def merged(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the corpus. Spark takes their sizes from the files they
    are read from: what is too large to be sent is shuffled, and a hot key can be split."""
    return df.join(side, on, how)


def shuffled(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides at every size, so that a small run does what a large one does."""
    return df.join(side.hint("merge"), on, how)


def _marked(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    bit = F.xxhash64(column).bitwiseAND(MAP_BITS - 1)
    words = keys.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")).alias("_bits")
    )
    placed = df.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    found = F.coalesce(F.expr("getbit(_bits, CAST(_bit & 63 AS INT)) = 1"), F.lit(False))
    return placed.join(F.broadcast(words), "_word", "left").withColumn("_maybe", found).drop("_bit", "_word", "_bits")


def possible(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may be among the keys', told by a map of hashed bits of bounded size.

    Done before a join, it keeps most rows without a partner out of the shuffle; where the keys are
    so many that the map is full, it keeps all.
    """
    return _marked(df, keys, column).where("_maybe").drop("_maybe")


def impossible(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows that ``possible`` leaves out."""
    return _marked(df, keys, column).where("NOT _maybe").drop("_maybe")


def matched(df: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """A semi or anti join by shuffle on one column, null being a value like others."""
    keys = keys.select(F.col(column).alias("_matched")).distinct()
    if how == "left_semi":
        df = possible(df, keys.withColumnRenamed("_matched", column), column)
    return df.join(keys, df[column].eqNullSafe(F.col("_matched")), how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; nulls and loops are left out. In
    each round every node takes its smallest neighbour's name, if smaller than its own, and links
    are renamed; links that become loops go. A link between a node and the one it is named after
    is a link of the next round, unless both have one name, so nothing falls apart. Names and
    links of each round are written to the shared folder; a hub's links are folded to a minimum
    before the shuffle.
    """
    one, other = F.least("a", "b"), F.greatest("a", "b")
    links = staged(edges.where(F.col("a") != F.col("b")).select(one.alias("a"), other.alias("b")).distinct())
    names = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("old"), F.least("a", "m").alias("new")))
        if names is None:
            names = least.select(F.col("old").alias("node"), F.col("new").alias("root"))
        else:
            names = merged(names, least.withColumnRenamed("old", "root"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        renamed = merged(links, least.withColumnRenamed("old", "a"), "a").select("b", F.col("new").alias("x"))
        renamed = merged(renamed, least.withColumnRenamed("old", "b"), "b").select("x", F.col("new").alias("y"))
        renamed = renamed.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = staged(renamed.distinct())
        if not links.limit(1).count():
            return names
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def meeting(posted: DataFrame, key: str, node: str) -> DataFrame:
    """The rows of ``posted`` under keys that two or more nodes share, each once, staged.

    Only the smallest and largest node of each key are gathered, folded before the shuffle; keys
    with one node, mostly the bulk, are gone before rows are brought together, and a key with
    very many nodes is never brought together at all. Keys are as many as the data has, so both
    sides are shuffled, straight from files.
    """
    shared = posted.groupBy(key).agg(F.min(node).alias("_low"), F.max(node).alias("_high"))
    staged_keys = staged(shared.where("_low != _high").select(key))
    return staged(merged(possible(posted, staged_keys, key), staged_keys, key, "left_semi").distinct())


def leaders(runs: DataFrame, key: str, node: str, *carried: str, each: int = 8) -> DataFrame:
    """(key, lead): up to ``each`` nodes of every key, those that meet others under the most keys.

    What many near copies were made from shares more with them than they share with each other,
    so it links most of them at once. The nodes are dealt into ``each`` parts by hash, of which
    each gives its best, folded before the shuffle.
    """
    met = staged(runs.groupBy(node).agg(F.count("*").alias("_met")))
    part = F.pmod(F.xxhash64(node), F.lit(each)).alias("_part")
    best = merged(runs, met, node).groupBy(key, part).agg(F.max(F.struct("_met", node, *carried)).alias("lead"))
    return staged(best.select(key, "lead"))


def unordered(a, b) -> list:
    """A pair's columns ``a`` and ``b``, the smaller first."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def untried(runs: DataFrame, leads: DataFrame, key: str, asked: str = "true") -> DataFrame:
    """The rows under keys where two nodes, one of them ``asked``, may not have met through a lead."""
    n = runs.groupBy(key).agg(F.count("*").alias("_all"), F.count_if(F.expr(asked)).alias("_asked"))
    tried = leads.groupBy(key).agg(F.count("*").alias("_leads"))
    left = n.join(tried, key).where("_all - _leads >= 2 AND _asked > _leads")
    left = staged(left.select(key))
    return merged(possible(runs, left, key), left, key, "left_semi")
