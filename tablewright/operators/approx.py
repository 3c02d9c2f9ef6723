"""Approximate top-k: vectors in tables of buckets by the signs of random projections.

Each table deals all vectors into buckets by the signs of their products with random directions,
so that vectors of like direction mostly share a bucket. A query looks into its own bucket and
then into those that differ in the signs it is least sure of. What stands there is ranked by the
exact cosine, as in ``topk_join``. The number of buckets looked into is fitted once, when the
tables are built, on a bounded sample of vectors compared with the whole index, so that the
share of true hits found is measured and stored beside the tables.

Buckets are cut into slices of bounded size, so a bucket that holds a third of all vectors is no
hot group. Queries travel to the slices they ask for, and each passes on its best k there.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.topk import DEFAULT_K, DEFAULT_THRESHOLD, Vectors, meet_in_cells, topk_join, topk_rows

logger = logging.getLogger(__name__)

TABLES = 2
BUCKET_ROWS = 4096
SLICE_BYTES = 32 << 20
MOST_BITS = 30
# Signs a query is least sure of; all their combinations are buckets it may look into.
UNSURE_BITS = 10
# The share of a sample's true hits that the buckets looked into must hold, and the sample's size.
AIM = 0.95
SAMPLE_QUERIES = 200
# Bytes of the copies of queries, one for each bucket, that a task makes at a time.
COPY_BYTES = 8 << 20
# A list of buckets up to which it is sent to every task.
BROADCAST_ROWS = 500_000
PLAN_SCHEMA = "seed int, tables int, bits int, probes int, k int, threshold double, recall double, vectors bigint"


@dataclass(frozen=True)
class Plan:
    """How the tables were made, how many buckets of each a query looks into, and the recall measured so."""

    seed: int
    tables: int
    bits: int
    probes: int = 1
    k: int = DEFAULT_K
    threshold: float = DEFAULT_THRESHOLD
    recall: float = 1.0
    vectors: int = 0


def directions(seed: int, tables: int, bits: int, size: int) -> np.ndarray:
    """The random directions for vectors of one length, table by table."""
    return np.random.default_rng((seed, size)).standard_normal((tables * bits, size))


def _margins(vectors: np.ndarray, plan: tuple[int, int, int]) -> np.ndarray:
    """(rows, tables, bits): products with the directions."""
    seed, tables, bits = plan
    return (vectors @ directions(seed, tables, bits, vectors.shape[1]).T).reshape(len(vectors), tables, bits)


def _codes(margins: np.ndarray) -> np.ndarray:
    return (margins > 0) @ (1 << np.arange(margins.shape[2], dtype=np.int64))


def probe_codes(margins: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes): buckets from the likeliest on, the own one first.

    A bucket is as unlikely as the squares of the margins whose signs it turns; the turned signs
    are among the ``UNSURE_BITS`` with the smallest margins.
    """
    rows, tables, bits = margins.shape
    own, few = _codes(margins), min(bits, UNSURE_BITS)
    turns = (np.arange(1 << few)[:, None] >> np.arange(few)) & 1
    unsure = np.argsort(np.abs(margins), axis=2, kind="stable")[:, :, :few]
    cost = (np.take_along_axis(margins, unsure, 2) ** 2) @ turns.T
    first = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    turned = (np.int64(1) << unsure.astype(np.int64)) @ turns.T
    return own[:, :, None] ^ np.take_along_axis(turned, first, 2)


def _copies(batch: pa.RecordBatch, rows: np.ndarray, codes: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch once for each of their ``codes`` (rows, tables, buckets), in bounded parts."""
    _, tables, each = codes.shape
    step = max(1, COPY_BYTES // (tables * each * (8 * size + 64)))
    for low in range(0, len(rows), step):
        few = codes[low : low + step]
        taken = batch.take(pa.array(np.repeat(rows[low : low + step], tables * each)))
        columns = [
            *taken.columns,
            pa.array(np.full(taken.num_rows, size, np.int32)),
            pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), len(few))),
            pa.array(few.ravel()),
            pa.array(np.tile(np.arange(each, dtype=np.int32), len(few) * tables)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["key", "vector", "size", "tab", "code", "place"])


def _coded(rows: DataFrame, plan: Plan, probes: int | None) -> DataFrame:
    """``rows(key, vector)`` once per table and bucket: ``key, vector, size, tab, code``.

    With ``probes`` None the own bucket of each table, else the likeliest ones, with ``place``.
    """
    shape = (plan.seed, plan.tables, plan.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Vectors(pa.Table.from_batches([batch]))
            for size, at in own.rows.items():
                step = max(1, (1 << 19) // max(size, plan.tables * (1 << min(plan.bits, UNSURE_BITS))))
                for low in range(0, len(at), step):
                    margins = _margins(own.matrix[size][low : low + step], shape)
                    codes = _codes(margins)[:, :, None] if probes is None else probe_codes(margins, probes)
                    yield from _copies(batch, at[low : low + step], codes, size)

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, vector array<double>, size int, tab int, code bigint, place int"
    return rows.select("key", "vector").mapInArrow(run, schema)


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that can be similar to anything: a vector that is neither empty nor zero, its missing values as 0."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
    held = rows.select(F.col(key).alias("key"), v.alias("vector"))
    return held.where(F.col("key").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0))


def _cell(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", F.xxhash64("size", "tab", "code", "slice"))


def build_tables(
    index: DataFrame,
    path: str,
    k: int = DEFAULT_K,
    threshold: float = DEFAULT_THRESHOLD,
    tables: int = TABLES,
    bucket_rows: int = BUCKET_ROWS,
    aim: float = AIM,
    seed: int = 1,
    index_id: str = "id",
    index_vector: str = "embedding",
) -> Plan:
    """Writes the tables of an index below ``path`` and fits how many buckets a query looks into.

    Every vector stands in a bucket of each table; there are about as many buckets as hold
    ``bucket_rows`` each. A vector that is missing, empty or zero reaches no positive threshold and
    is left out. Where not even all likely buckets hold the share ``aim`` of the sample's hits, the
    plan says what they do hold.
    """
    spark = index.sparkSession
    rows = _usable(index, index_id, index_vector)
    n = rows.count()
    plan = Plan(seed, tables, max(0, min(MOST_BITS, round(math.log2(max(1, n / bucket_rows))))), 1, k, threshold, 1.0, n)
    _coded(rows, plan, None).drop("place").write.parquet(f"{path}/coded")
    coded = spark.read.parquet(f"{path}/coded")
    per_slice = F.greatest(F.floor(F.lit(SLICE_BYTES) / (8 * F.col("size"))), F.lit(1))
    cells = coded.groupBy("size", "tab", "code").agg(F.count("*").alias("rows"))
    cells.withColumn("slices", F.ceil(F.col("rows") / per_slice).cast("int")).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    dealt = coded.join(_sent(cells.select("size", "tab", "code", "slices")), ["size", "tab", "code"])
    dealt = _cell(dealt.withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")))
    dealt = dealt.select("cell", "key", "vector").repartition("cell").sortWithinPartitions("cell")
    dealt.write.parquet(f"{path}/vectors")
    plan = _fitted(spark, path, plan, rows, coded, aim)
    spark.createDataFrame([tuple(asdict(plan).values())], PLAN_SCHEMA).coalesce(1).write.json(f"{path}/plan")
    return plan


def _sent(rows: DataFrame) -> DataFrame:
    """A list that goes to every task where its counted size allows."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _fitted(spark: SparkSession, path: str, plan: Plan, rows: DataFrame, coded: DataFrame, aim: float) -> Plan:
    """The plan with the fewest probes that hold the share ``aim`` of the true hits of a sample of vectors.

    ``SAMPLE_QUERIES`` vectors are compared with the whole index; their hits' buckets, a bounded
    number of rows, come to the driver.
    """
    if not plan.vectors or not plan.bits:
        return plan
    sample = rows.orderBy(F.xxhash64("key", F.lit(plan.seed)), "key").limit(SAMPLE_QUERIES)
    sample.write.parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    true = topk_join(sample, rows, plan.k, plan.threshold, "key", "vector", "key", "vector").select("query_id", "id")
    held = coded.select(F.col("key").alias("id"), "size", "tab", "code")
    true = held.join(F.broadcast(true), "id").toArrow().to_pylist()
    asked = sample.toArrow()
    vectors = Vectors(asked)
    order = {}
    for size, at in vectors.rows.items():
        codes = probe_codes(_margins(vectors.matrix[size], (plan.seed, plan.tables, plan.bits)), 1 << UNSURE_BITS)
        for row, own in zip(at, codes):
            for tab, few in enumerate(own):
                order[vectors.ids[int(row)].as_py(), size, tab] = {int(c): n for n, c in enumerate(few)}
    needed: dict[tuple, float] = {}
    for r in true:
        place = order.get((r["query_id"], r["size"], r["tab"]), {}).get(r["code"], math.inf)
        pair = (r["query_id"], r["id"])
        needed[pair] = min(needed.get(pair, math.inf), place)
    places = sorted(needed.values())
    if not places:
        return plan
    last = places[math.ceil(aim * len(places)) - 1]
    probes = int(last) + 1 if last < math.inf else 1 << min(plan.bits, UNSURE_BITS)
    recall = sum(p < probes for p in places) / len(places)
    if recall < aim:
        logger.warning("%d buckets of each table hold %.3f of the sample's hits", probes, recall)
    return Plan(**{**asdict(plan), "probes": probes, "recall": recall})


def read_plan(spark: SparkSession, path: str) -> Plan:
    return Plan(**spark.read.schema(PLAN_SCHEMA).json(f"{path}/plan").first().asDict())


def topk_approx(
    queries: DataFrame,
    path: str,
    k: int | None = None,
    threshold: float | None = None,
    probes: int | None = None,
    without: DataFrame | None = None,
    query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """The best k found of every query: ``query_id, id, similarity, rank``, as ``topk_join`` has them.

    ``path`` holds what ``build_tables`` wrote. Similarities are exact; a hit can only be missed.
    ``k`` and ``threshold`` are those that the tables were fitted for unless given, ``probes`` the
    number of buckets of each table. Where that is all of them, the buckets of one table hold every
    vector once, and no query is copied for each: the hits are exact. Vectors whose ``id`` is among
    ``without`` are left out. The threshold must be above 0, as vectors of another length and zero
    vectors, which have similarity 0, are not looked at.
    """
    spark = queries.sparkSession
    plan = read_plan(spark, path)
    k, threshold = plan.k if k is None else k, plan.threshold if threshold is None else threshold
    if threshold <= 0:
        raise ValueError("buckets only find what is similar; use topk_join for a threshold of 0 or less")
    asked = _usable(queries, query_id, query_vector)
    cells = spark.read.parquet(f"{path}/cells").select("size", "tab", "code", "slices")
    held = spark.read.parquet(f"{path}/vectors")
    if without is not None:
        held = held.join(without.select(F.col("id").alias("key")), "key", "left_anti")
    in_slice = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    if (probes or plan.probes) >= 1 << plan.bits:
        first = _cell(cells.where("tab = 0").withColumn("slice", in_slice)).select("cell")
        held = held.join(_sent(first), "cell", "left_semi")
        return topk_join(asked, held, k, threshold, "key", "vector", "key", "vector")
    wanted = _coded(asked, plan, min(probes or plan.probes, 1 << min(plan.bits, UNSURE_BITS))).drop("place")
    wanted = wanted.join(_sent(cells), ["size", "tab", "code"])
    wanted = _cell(wanted.withColumn("slice", in_slice))
    found = meet_in_cells(held, wanted.select("cell", "key", "vector"), k, threshold)
    once = found.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    return topk_rows(once, k).select("query_id", "id", "similarity", "rank")
