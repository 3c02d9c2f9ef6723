"""Read-only SQL with a row cap, a truncation flag and an audit log."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import SharedFolder, work_folder
from tablewright.sources.query_log import append_query_log

logger = logging.getLogger(__name__)

# --- Fixed values -------------------------------------------------------------------
DEFAULT_LIMIT = 5000
# ------------------------------------------------------------------------------------
# Commands that only read, by the beginning of their plan's class; EXPLAIN plans its statement without running it.
READ_PLANS = ("Show", "Describe", "Explain")
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."


def _plan(spark: SparkSession, query: str):
    """The query's plan as the session's parser reads it. Nothing is analysed or run."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(query)


def _parses(spark: SparkSession, query: str) -> bool:
    try:
        _plan(spark, query)
        return True
    except ParseException:
        return False


def _nodes(plan) -> Iterator:
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _reads(spark: SparkSession, query: str) -> tuple[bool, bool]:
    """Whether the text is one query, and whether it is one command that only reads.

    The text alone must be one statement, none of whose nodes is a command or a write; and it
    must be what the grammar takes inside a CTE, which is a query only. Either alone could be
    deceived: by a text that closes the CTE, or by a statement that is no command.
    """
    plan = _plan(spark, query)
    if plan.getClass().getSimpleName().startswith(READ_PLANS):
        return False, True
    kind = spark._jvm.java.lang.Class
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    acting = [kind.forName(LOGICAL + name, False, loader) for name in ("Command", "ParsedStatement")]
    if any(act.isInstance(node) for node in _nodes(plan) for act in acting):
        return False, False
    return _parses(spark, f"WITH guarded AS (\n{query}\n) SELECT * FROM guarded"), False


def assert_read_only(spark: SparkSession, query: str) -> None:
    """Raises ``ValueError`` for anything but a query or a read-only command, ``ParseException`` for
    what is no statement. Only Spark's parser sees the text; nothing runs."""
    if not any(_reads(spark, query)):
        raise ValueError("only read queries are allowed here; this statement would change something")


def _has_limit(spark: SparkSession, query: str) -> bool:
    """Whether the query itself, not a part of it, ends in a LIMIT."""
    plan = _plan(spark, query)
    while plan.getClass().getSimpleName() in ("UnresolvedWith", "WithWindowDefinition"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit")


def _read(spark: SparkSession, query: str) -> tuple[DataFrame, bool]:
    query = query.strip().rstrip(";")
    is_query, is_command = _reads(spark, query)
    if not is_query and not is_command:
        assert_read_only(spark, query)
    return spark.sql(query), is_command or _has_limit(spark, query)


def safe_sql(spark: SparkSession, query: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """The query as a lazy DataFrame, capped at ``limit`` rows unless it has its own LIMIT.

    ``limit=None`` takes the whole result.
    """
    df, limited = _read(spark, query)
    return df if limited or limit is None else df.limit(limit)


def _storable(kind: T.DataType) -> T.DataType:
    """The type under which values of ``kind`` are written: a type without values, and intervals, as text."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_storable(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_storable(kind.keyType), _storable(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _storable(f.dataType), f.nullable) for f in kind.fields])
    return T.StringType() if isinstance(kind, (T.NullType, T.CalendarIntervalType)) else kind


def _is_sorted(df: DataFrame) -> bool:
    """Whether the query's rows come in an order it asks for."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "GlobalLimit", "LocalLimit", "Offset") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "Sort"


def _stored(df: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """The rows written to the shared folder, in their order where they have one, and their number.

    The rows are counted as they are written; nothing is held on executors.
    """
    own, kinds = [f"c{i}" for i in range(len(df.columns))], [f.dataType for f in df.schema.fields]
    ordered = _is_sorted(df)
    held = df.toDF(*own).select(*[F.col(c) if _storable(k) == k else F.col(c).cast(_storable(k)).alias(c) for c, k in zip(own, kinds)])
    if ordered:
        held = held.withColumn("place", F.monotonically_increasing_id())
    seen = Observation()
    held.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
    back = df.sparkSession.read.schema(held.schema).parquet(folder)
    back = back.orderBy("place").drop("place") if ordered else back
    shown = [F.lit(None).alias(c) if isinstance(k, T.NullType) else F.col(c).cast(k).alias(c) if isinstance(k, T.CalendarIntervalType) else F.col(c) for c, k in zip(own, kinds)]
    return back.select(*shown).toDF(*df.columns), seen.get["rows"]


@dataclass(frozen=True)
class QueryRun:
    frame: DataFrame
    rows: int
    truncated: bool
    elapsed_ms: float
    folder: str

    def release(self) -> None:
        """Removes the rows that were kept for ``frame``."""
        SharedFolder(self.frame.sparkSession, self.folder).remove()


def run_sql(
    spark: SparkSession,
    query: str,
    limit: int | None = DEFAULT_LIMIT,
    log_path: str | None = None,
) -> QueryRun:
    """Runs a query once, keeps its rows in the shared folder, and logs rows and time.

    One row more than the cap is asked for, so ``truncated`` is exact. A log that cannot be
    written is reported and never fails the query.
    """
    start = time.monotonic()
    df, limited = _read(spark, query)
    folder = work_folder(spark)
    if limited or limit is None:
        frame, rows = _stored(df, folder)
        truncated = False
    else:
        kept, found = _stored(df.limit(limit + 1), folder)
        frame, rows, truncated = kept.limit(limit), min(found, limit), found > limit
    elapsed_ms = (time.monotonic() - start) * 1000
    if log_path:
        try:
            append_query_log(spark, log_path, [(query, rows, elapsed_ms)])
        except Exception as error:  # noqa: BLE001 - the log must never fail the query
            logger.warning("query log not written: %s", error)
    return QueryRun(frame, rows, truncated, elapsed_ms, folder)
