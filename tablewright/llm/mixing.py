"""Mixing sources to target weights by nested thresholds on a hash of the document.

DataFrame functions only. Tokens are summed by source and by the leading bits of the documents'
hashes. Running sums over these histograms tell, for each source, in which bucket its budget
ends; only the documents of that bucket are looked at again, by further bits, until one hash is
left. A source whose budget exceeds its size is taken whole as often as it fits, and the rest by
the threshold, so that the thresholds of all rounds are nested. Documents are then filtered by
their own hash: nothing is sorted, and a rerun takes the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import BROADCAST_ROWS, numbered, staged
from tablewright.llm.quality_rules import words

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
SEED = 13
# Bits of the hash, and how many of them each histogram looks at.
BITS, STEP_BITS = 48, 12
# Into how many parts a source's documents are dealt where the sources are too many to be sent to the tasks.
SALTS = 256
# Bytes of the sources' rows up to which they are sent to every task.
BROADCAST_BYTES = 32 << 20


def document_hash(doc_id: Column, seed: int = SEED) -> Column:
    """48 bits that only depend on the id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 1, BITS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, hash) of every document."""
    n = F.size(words(F.coalesce(F.col("text"), F.lit("")))).cast("bigint")
    return docs.select("doc_id", "source", n.alias("size"), document_hash(F.col("doc_id"), seed).alias("hash"))


def small(rows: DataFrame) -> bool:
    """Whether rows with a ``source`` are few and short enough for every task."""
    own = F.coalesce(F.octet_length("source"), F.lit(0)) + 64
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(own), F.lit(0)).alias("bytes")).first()
    return found["n"] <= BROADCAST_ROWS and found["bytes"] <= BROADCAST_BYTES


def with_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """``sources(source, source_size)`` with ``target``, and how it is reached: ``whole`` and ``rest``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share the
    sum of all sizes; none gets more than ``most`` times its size, and what is left over is shared
    by weight among the others until none is above. Each round is one sum over the sources; what
    comes to the driver is a row.
    """
    rows, _ = numbered(sources, F.asc_nulls_last("source"))
    turn = F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int")
    rows = rows.withColumns(
        {"weight": F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), turn), "cap": F.col("source_size") * most}
    )
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, full, before = total or 0, F.lit(False), 0
    while weight:
        full = F.col("weight") * F.lit(left) / F.lit(weight) > F.col("cap")
        n, above, under = rows.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == before:
            break
        left, weight, before = (total or 0) - above, under, n
    share = F.col("weight") * F.lit(left) / F.lit(weight) if weight else F.lit(0.0)
    target = F.when(full, F.col("cap").cast("double")).otherwise(share)
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(most).cast("bigint"))).otherwise(F.lit(0))
    return (
        rows.withColumn("target", target)
        .withColumn("whole", whole.cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("whole") * size)
        .select("source", "source_size", "target", "whole", "rest")
    )


def same(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with a hash up to it come nearest to the source's ``rest``.

    ``rows(source, size, hash)``, ``budgets(source, rest)``. At most ``2 ** STEP_BITS`` sums per
    source and step; the documents of a step are those of the bucket where the step before ended.
    """
    edge = budgets.where(F.col("rest") > 0).select("source", F.lit(0).cast("bigint").alias("prefix"), "rest")
    order = Window.partitionBy("source").orderBy("prefix")
    for shift in range(BITS - STEP_BITS, -1, -STEP_BITS):
        sums = rows.groupBy("source", F.shiftright("hash", shift).alias("prefix")).agg(F.sum("size").alias("sum"))
        ends = sums.withColumn("end", F.sum("sum").over(order)).withColumn("begin", F.col("end") - F.col("sum"))
        budget = edge.select(F.col("source").alias("of"), "rest")
        met = ends.join(budget, ends["source"].eqNullSafe(budget["of"]))
        met = met.where((F.col("begin") <= F.col("rest")) & (F.col("rest") < F.col("end")))
        edge = staged(met.select("source", "prefix", (F.col("rest") - F.col("begin")).alias("rest"), "sum"))
        if shift:
            # The prefixes spread a hot source's documents, should both sides be shuffled.
            own = edge.select(F.col("source").alias("of"), "prefix")
            own = F.broadcast(own) if small(edge) else own
            at = rows.withColumn("prefix", F.shiftright("hash", shift)).alias("r")
            kept = at.join(own.alias("o"), F.expr("r.source <=> o.of AND r.prefix = o.prefix"), "left_semi")
            rows = staged(kept.select("source", "size", "hash"))
    nearer = F.col("sum") - F.col("rest") < F.col("rest")
    return edge.select("source", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def budgets(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, staged, and per source its size, target, whole rounds and threshold."""
    rows = staged(sized(docs, seed))
    sources = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = with_targets(sources, weights, most)
    last = thresholds(rows, aims).select(F.col("source").alias("of"), "threshold")
    plan = aims.join(last, aims["source"].eqNullSafe(last["of"]), "left")
    return rows, staged(plan.select("source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1)).alias("threshold")))


def with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and ``copies``. A source may hold most rows: where the plan
    is too large for every task, its rows are repeated and a source's documents dealt among them."""
    plan = plan.withColumnRenamed("source", "_of")
    if small(plan.withColumnRenamed("_of", "source")):
        met = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_of")))
    else:
        dealt = rows.withColumn("_salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
        salted = plan.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = F.col("source").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_of_salt"))
        met = dealt.join(salted, both).drop("_salt", "_of_salt")
    once_more = (F.col("hash") <= F.col("threshold")).cast("bigint")
    return met.withColumn("copies", F.col("whole") + once_more).drop("_of", "whole", "threshold")


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, and ``copies``.

    ``size`` counts the words, ``target`` is what the document's source shall give, ``taken`` what
    the mix takes of the document: its size times ``copies``, at most ``most``. A source's taken
    words miss its target by no more than half of the document at its threshold.

    A null or empty text has size 0, a null source is one of its own, the last. Rows that repeat an
    id have one hash and are taken alike; a null id is hashed as an empty one. Texts are read whole,
    other columns are ignored; no rows, no result; where all sizes are 0 all targets are.
    """
    rows, plan = budgets(docs, weights, most, seed)
    found = with_source(rows, plan)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken, "copies")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns and ``epoch`` from 1."""
    _, plan = budgets(docs, weights, most, seed)
    held = docs.select(F.struct("*").alias("_row"), "source", document_hash(F.col("doc_id"), seed).alias("hash"))
    found = with_source(held, plan).where(F.col("copies") > 0)
    epochs = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("epoch")
    return found.select("_row", epochs).select("_row.*", "epoch")
