"""Exact quantiles per group without bringing a group together."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import work_folder

# Slices per group, fewer where there are many groups, so that all edges stay within a bound.
MAX_SLICES, MIN_SLICES = 2048, 128
SLICE_BYTES = 16
BROADCAST_BYTES = 32 << 20
SALTS = 32


def exact_quantiles(
    df: DataFrame, group: str, value: str, points: list[float], groups: int | None = None
) -> DataFrame:
    """Interpolated quantiles: ``group, n, quantiles array<double>`` in the order of ``points``.

    A sketch per group proposes slice edges, counts per slice say in which slice each wanted rank
    lies, and only those slices are ordered, with equal values folded to a count. So the rows
    themselves are scanned and not shuffled, and a group with most of the rows never meets in one
    task. The sketch's error moves edges, not results.
    """
    rows = df.where(F.col(value).isNotNull()).select(
        F.col(group).alias("g"), F.col(value).cast("double").alias("v")
    )
    groups = count_groups(rows, "g") if groups is None else groups
    slices = MAX_SLICES
    while slices > MIN_SLICES and groups * slices * SLICE_BYTES > BROADCAST_BYTES:
        slices //= 2
    sliced = _with_slice(rows, groups, slices)
    sizes = sliced.groupBy("g", "slice").agg(F.count("*").alias("size"))
    # At most one row per group and slice in these windows.
    start = F.sum("size").over(Window.partitionBy("g").orderBy("slice")) - F.col("size")
    sizes = sizes.withColumns({"start": start, "n": F.sum("size").over(Window.partitionBy("g"))})
    targets = F.array(*[F.lit(p) * (F.col("n") - 1) for p in points])
    ranks = F.array_distinct(F.flatten(F.transform(targets, lambda r: F.array(F.floor(r), F.ceil(r)))))
    here = F.filter(ranks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("size")))
    wanted = sizes.withColumn("ranks", here).where(F.size("ranks") > 0).drop("size")
    folded = (
        join_groups(sliced, wanted, ["g", "slice"], groups * len(points) * 2 * SLICE_BYTES * 8)
        .groupBy("g", "n", "slice", "start", "ranks", "v")
        .agg(F.count("*").alias("c"))
    )
    through = F.sum("c").over(Window.partitionBy("g", "slice").orderBy("v"))
    placed = folded.withColumn("next", F.col("start") + through)
    hits = F.filter("ranks", lambda r: (r >= F.col("next") - F.col("c")) & (r < F.col("next")))
    values = placed.select("g", "n", "v", F.explode(hits).alias("rank"))
    # At most two rows per group and point.
    found = values.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def interpolated(p: float) -> Column:
        rank = F.lit(p) * (F.col("n") - 1)
        low, high = F.col("at")[F.floor(rank)], F.col("at")[F.ceil(rank)]
        return low + (high - low) * (rank - F.floor(rank))

    return found.select(
        F.col("g").alias(group), "n", F.array(*[interpolated(p) for p in points]).alias("quantiles")
    )


def _with_slice(rows: DataFrame, groups: int, slices: int) -> DataFrame:
    """Adds the number of the group's edges that lie below the value, by binary search.

    The proposed edges depend on the order in which sketches are merged, and the slices are used
    twice; so the edges are written to the shared folder once, and stay what they are when a lost
    executor's work is done again.
    """
    shares = [i / slices for i in range(1, slices)]
    proposed = F.percentile_approx("v", shares, 10 * slices)
    edges = rows.groupBy("g").agg(F.array_sort(F.array_distinct(proposed)).alias("edges"))
    path = work_folder(rows.sparkSession)
    edges.write.parquet(path)
    edges = rows.sparkSession.read.schema(edges.schema).parquet(path)
    sliced = join_groups(rows, edges, ["g"], groups * slices * SLICE_BYTES).withColumn("slice", F.lit(0))
    step = slices // 2
    while step:
        below = F.get("edges", F.col("slice") + (step - 1)) < F.col("v")
        sliced = sliced.withColumn("slice", F.col("slice") + F.when(below, step).otherwise(0))
        step //= 2
    return sliced.drop("edges")


def count_groups(df: DataFrame, group: str) -> int:
    return df.select(group).distinct().count()


def join_groups(rows: DataFrame, per_group: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows with what is known of their group; null groups meet.

    The group side goes to the tasks when ``size`` (bytes, from the counted groups) is within the
    bound. Otherwise both sides are joined by shuffle, the rows of each group spread over salts,
    so that a group with most of the rows is no hot task.
    """
    other = per_group.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(other), condition)
    else:
        salted = rows.withColumn("_salt", (F.rand(SALTS) * SALTS).cast("int"))
        copies = other.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, condition & (F.col("_salt") == F.col("_copy"))).drop("_salt", "_copy")
    return joined.drop(*[f"_{k}" for k in keys])
