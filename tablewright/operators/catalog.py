"""Table listing, column description and profiling."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import stable_id, value_text
from tablewright.session import is_scan, spread, work_folder

logger = logging.getLogger(__name__)

# --- Fixed values -------------------------------------------------------------------
SAMPLE_ROWS = 3
HIDDEN_SCHEMA = "information_schema"
TABLE_QUESTION = "What data is in the %s table?"
TABLE_DESCRIPTION = "Table: %s\nColumns:\n%s"
COLUMN_LINE = "  - %s (%s, %s)"
NULLABLE, NOT_NULL = "nullable", "not null"
# ------------------------------------------------------------------------------------
# Longer values are counted by their 32-byte digest, which no value kept as it is can equal.
KEPT_BYTES = 31
RANGED_TYPES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
UNCOUNTED_TYPES = (T.MapType, T.VariantType)

# Columns that one pass and one plan take.
GROUP_COLUMNS = 64
# Tables whose branches one plan takes.
GROUP_TABLES = 32
# Registers of a sketch, as a power of two: an error of about 0.8 percent.
SKETCH_LG_K = 14
# Nested values are compared by their JSON, times to the last digit.
JSON_FORMAT = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}

PROFILE_COLUMNS = ("column", "type", "total_rows", "nulls", "null_pct", "distinct", "min", "max")


def _uncounted(kind: T.DataType) -> bool:
    """Whether values of the type cannot be grouped: maps and variants, at any depth."""
    if isinstance(kind, T.ArrayType):
        return _uncounted(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_uncounted(f.dataType) for f in kind.fields)
    return isinstance(kind, UNCOUNTED_TYPES)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Table names of a schema (the current one by default), sorted."""
    shown = spark.sql(f"SHOW TABLES IN `{schema}`" if schema else "SHOW TABLES")
    return shown.select(F.col("tableName").alias("table")).orderBy("table")


def list_all_tables(spark: SparkSession) -> DataFrame:
    """``schema.table`` of every schema; a schema that cannot be read is left out."""
    names = []
    for database in spark.catalog.listDatabases():
        if database.name == HIDDEN_SCHEMA:
            continue
        try:
            shown = spark.sql(f"SHOW TABLES IN `{database.name}`").where(~F.col("isTemporary"))
        except Exception as error:  # noqa: BLE001 - one bad schema must not hide the others
            logger.warning("schema %s not listed: %s", database.name, error)
            continue
        names += [(f"{row['namespace']}.{row['tableName']}",) for row in shown.collect()]
    return spark.createDataFrame(sorted(names), "table string")


def _by_column(df: DataFrame, values: dict[str, Column]) -> Column:
    """An array with one struct per column of ``df``; the last entry of each is from ``values``."""
    return F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.lit(field.nullable).alias("nullable"),
                values[field.name].alias("value"),
            )
            for position, field in enumerate(df.schema.fields)
        ]
    )


def column_rows(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Position, name, type and nullability of each column, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def describe(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Name, type, nullability and the non-null values among the first three rows.

    ``order_by`` says which rows are first; without it they are whichever Spark reads first.
    """
    head = df.orderBy(*order_by) if order_by else df
    texts = {
        f.name: F.collect_list(value_text(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields
    }
    sampled = head.limit(SAMPLE_ROWS).agg(_by_column(df, texts).alias("columns"))
    return (
        sampled.select(F.inline("columns"))
        .select("column", "type", "nullable", F.array_join("value", ", ").alias("samples"))
    )


WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType)
REAL_TYPES = (T.FloatType, T.DoubleType)


def _lane(name: str, kind: T.DataType) -> tuple[str, Column]:
    """How a value is compared with others, and where: as a whole number, a double, or bytes.

    Bytes are a value's text, or the digest of a longer one. The range of a type is found among its
    distinct values, which can be read back from there.
    """
    c = F.col(f"`{name}`")
    if _uncounted(kind):
        return "text", F.when(c.isNotNull(), F.lit("").cast("binary"))
    if isinstance(kind, REAL_TYPES):
        return "real", c.cast("double")
    if isinstance(kind, WHOLE_TYPES):
        days = F.unix_date(c) if isinstance(kind, T.DateType) else c
        return "whole", (F.unix_micros(c) if isinstance(kind, T.TimestampType) else days).cast("bigint")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return "text", F.when(F.octet_length(c) <= KEPT_BYTES, c.cast("binary")).otherwise(F.unhex(F.sha2(c, 256)))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)
        whole = c.cast("string") if plain else F.to_json(F.struct(c), JSON_FORMAT)
        return "text", F.when(c.isNotNull(), F.unhex(F.sha2(whole, 256)))
    return "text", c.cast("string").cast("binary")


def _value_of(kind: T.DataType, lane: dict[str, Column]) -> Column:
    """A ranged type's value read back from its lane."""
    if isinstance(kind, REAL_TYPES):
        return lane["real"].cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(lane["whole"])
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(lane["whole"].cast("int"))
    return lane["whole"].cast(kind) if isinstance(kind, WHOLE_TYPES) else lane["text"].cast("string").cast(kind)


def _key(name: str, kind: T.DataType) -> Column:
    """A value for a sketch, equal for equal values."""
    lane, value = _lane(name, kind)
    return value if lane != "real" else F.when(value == 0, F.lit(0.0)).otherwise(value).cast("string").cast("binary")


def _ranges(kinds: list[T.DataType], number: Column, low: dict[str, Column], high: dict[str, Column]) -> tuple[list[Column], Column, Column]:
    """Aggregates of the lanes' smallest and largest values by column, and the ranges' texts from them.

    Texts are read back by type, so a type of that lane has two aggregates more, however many columns.
    """
    ranged = {k.simpleString(): k for k in kinds if isinstance(k, RANGED_TYPES)}
    aggregates = [f(side[lane]).alias(f"{name}_{lane}") for f, side, name in ((F.min, low, "low"), (F.max, high, "high")) for lane in ("whole", "real")]
    texts: dict[str, list[Column]] = {"low": [], "high": []}
    for n, (name, kind) in enumerate(sorted(ranged.items())):
        own = number.isin([i for i, k in enumerate(kinds) if k.simpleString() == name])
        for f, side, end in ((F.min, low, "low"), (F.max, high, "high")):
            if isinstance(kind, WHOLE_TYPES + REAL_TYPES):
                value = _value_of(kind, {lane: F.col(f"{end}_{lane}") for lane in ("whole", "real")})
            else:
                value = F.col(f"{end}_{n}")
                aggregates.append(f(F.when(own, _value_of(kind, side))).alias(f"{end}_{n}"))
            texts[end].append(F.when(own, value_text(value, kind)))
    none = F.lit(None).cast("string")
    return aggregates, F.coalesce(*texts["low"], none), F.coalesce(*texts["high"], none)


def _columns_of(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """``number, column, type`` of the given columns, without running ``df``."""
    named = [F.struct(F.lit(i).alias("number"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString().upper()).alias("type")) for i, f in enumerate(fields)]
    return df.sparkSession.range(1).select(F.inline(F.array(*named)))


def _shares(found: DataFrame) -> DataFrame:
    rows, nulls = F.coalesce("total_rows", F.lit(0)), F.coalesce("nulls", F.lit(0))
    share = F.when(rows > 0, F.round(nulls / rows * 100, 1)).otherwise(0.0)
    return found.select(
        "number", "column", "type", rows.alias("total_rows"), nulls.alias("nulls"), share.alias("null_pct"), "distinct", "min", "max"
    )


def _fold(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Statistics of a group of columns from one pass over ``df``, with the column's ``number``.

    Each row becomes pairs of a column's number and its value's bytes; equal pairs are counted in
    the task before anything is shuffled, so neither a hot value nor a wide row gathers anywhere.
    """
    kinds = [f.dataType for f in fields]
    lanes = {"whole": "bigint", "real": "double", "text": "binary"}
    cells = []
    for i, f in enumerate(fields):
        own, value = _lane(f.name, f.dataType)
        held = [value.alias(lane) if lane == own else F.lit(None).cast(t).alias(lane) for lane, t in lanes.items()]
        cells.append(F.struct(F.lit(i).alias("number"), *held))
    counted = spread(df.select(*[F.col(f"`{f.name}`") for f in fields])).select(F.inline(F.array(*cells))).groupBy("number", *lanes).agg(F.count("*").alias("n"))
    uncounted = [i for i, k in enumerate(kinds) if _uncounted(k)]
    sides = {lane: F.col(lane) for lane in lanes}
    aggregates, low, high = _ranges(kinds, F.col("number"), sides, sides)
    missing = F.col("whole").isNull() & F.col("real").isNull() & F.col("text").isNull()
    folded = counted.groupBy("number").agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("nulls"),
        F.count_if(~missing).alias("distinct"),
        *aggregates,
    )
    shown = folded.select(F.col("number").alias("_number"), "total_rows", "nulls", "distinct", low.alias("min"), high.alias("max"))
    columns = _columns_of(df, fields)
    # A row per column of the group: few enough for every task.
    found = columns.join(F.broadcast(shown), columns["number"] == shown["_number"], "left")
    distinct = F.when(~F.col("number").isin(uncounted), F.coalesce("distinct", F.lit(0)))
    return _shares(found.withColumn("distinct", distinct))


def _written(df: DataFrame) -> DataFrame:
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _groups(df: DataFrame, size: int) -> list[list[T.StructField]]:
    fields = df.schema.fields
    return [fields[k : k + size] for k in range(0, len(fields), size)]


def _rows_in_order(parts: list[DataFrame], size: int) -> DataFrame:
    numbered = (part.withColumn("number", F.col("number") + k * size) for k, part in enumerate(parts))
    return union_all(numbered).orderBy("number").select(*PROFILE_COLUMNS)


def profile(df: DataFrame, group: int = GROUP_COLUMNS) -> DataFrame:
    """Rows, nulls, distinct values and range of every column.

    Up to ``group`` columns are one pass over ``df`` and one plan of bounded size. A wider frame is
    taken group by group, each written when it is done; if it is not a stored table it is written
    first, so that it runs once.
    """
    groups = _groups(df, group)
    if len(groups) == 1:
        return _fold(df, groups[0]).select(*PROFILE_COLUMNS)
    if not is_scan(df):
        df = _written(df.toDF(*[f"c{i}" for i in range(len(df.columns))])).toDF(*df.columns)
    return _rows_in_order([_written(_fold(df, fields)) for fields in groups], group)


def _failed(df: DataFrame, field: T.StructField, error: Exception) -> DataFrame:
    empty = {"total_rows": "bigint", "nulls": "bigint", "null_pct": "double", "distinct": "bigint", "min": "string", "max": "string"}
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in empty.items()]
    reason = next((x for x in str(error).splitlines() if x.strip()), type(error).__name__)
    found = re.search(r"\[([A-Z][A-Z_.0-9]+)\]", str(error))
    return _columns_of(df, [field]).select("number", "column", "type", *blank, F.lit(found.group(1) if found else reason).alias("error"))


def _isolated(df: DataFrame, fields: list[T.StructField], first: int) -> list[DataFrame]:
    try:
        rows = _written(_fold(df, fields)).withColumn("error", F.lit(None).cast("string"))
    except Exception as error:  # noqa: BLE001 - told in the column's row
        if len(fields) > 1:
            half = len(fields) // 2
            return _isolated(df, fields[:half], first) + _isolated(df, fields[half:], first + half)
        logger.warning("column %s not profiled: %s", fields[0].name, error)
        rows = _failed(df, fields[0], error)
    return [rows.withColumn("number", F.col("number") + first)]


def profile_isolated(df: DataFrame, group: int = GROUP_COLUMNS) -> DataFrame:
    """``profile`` with ``error``: a column that cannot be computed has no figures but the reason.

    A group of columns that fails is halved and tried again, so that ``k`` bad ones among ``n`` cost
    about ``2 k log n`` passes; each part is written when it is done. The reason is Spark's
    condition where the error names one, else its first line.
    """
    parts = [rows for k, fields in enumerate(_groups(df, group)) for rows in _isolated(df, fields, k * group)]
    return union_all(parts).orderBy("number").select(*PROFILE_COLUMNS, "error")


# --- Sketches: approximate profiles that are kept and merged ---------------------------------------
def column_sketches(df: DataFrame, part: Column, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """``part, number, column, type, total_rows, nulls, sketch`` and the range: a row per part of a table and column.

    One pass. The sketch of the distinct values has ``2 ** lg_k`` registers at most, whatever the
    part's size, and is null for columns whose values cannot be counted. The range stands in the
    type's lane, ``low_whole`` to ``high_text``.
    """
    lanes = {"whole": "bigint", "real": "double", "text": "binary"}
    values = []
    for i, f in enumerate(df.schema.fields):
        kind, c = f.dataType, F.col(f"`{f.name}`")
        own, _ = _lane(f.name, kind)
        ends = []
        for fold, end in ((F.min, "low"), (F.max, "high")):
            for lane, t in lanes.items():
                if isinstance(kind, RANGED_TYPES) and lane == own:
                    ends.append(_lane_of(fold(c), kind).cast(t).alias(f"{end}_{lane}"))
                else:
                    ends.append(F.lit(None).cast(t).alias(f"{end}_{lane}"))
        counted = F.hll_sketch_agg(_key(f.name, kind), lg_k) if not _uncounted(kind) else F.lit(None).cast("binary")
        named = [F.lit(i).alias("number"), F.lit(f.name).alias("column"), F.lit(kind.simpleString().upper()).alias("type")]
        values.append(F.struct(*named, F.count(F.lit(1)).alias("total_rows"), F.count_if(c.isNull()).alias("nulls"), counted.alias("sketch"), *ends))
    return df.groupBy(part.alias("part")).agg(F.array(*values).alias("columns")).select("part", F.inline("columns"))


def _lane_of(value: Column, kind: T.DataType) -> Column:
    """A value of a ranged type as it stands in its lane."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    return F.unix_date(value) if isinstance(kind, T.DateType) else value if isinstance(kind, WHOLE_TYPES + REAL_TYPES) else value.cast("string")


def merged_profile(sketches: DataFrame, schema: T.StructType) -> DataFrame:
    """The profile of a table of that schema from the sketches of its parts; ``distinct`` is an estimate.

    Sketches of parts that came later are appended to the stored ones; no part is read again.
    """
    kinds = [f.dataType for f in schema.fields]
    low_side, high_side = ({lane: F.col(f"{end}_{lane}") for lane in ("whole", "real", "text")} for end in ("low", "high"))
    aggregates, low, high = _ranges(kinds, F.col("number"), low_side, high_side)
    merged = sketches.groupBy("number", "column", "type").agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"),
        *aggregates,
    )
    uncounted = [i for i, k in enumerate(kinds) if _uncounted(k)]
    distinct = F.when(~F.col("number").isin(uncounted), F.coalesce("distinct", F.lit(0)))
    shown = merged.select("number", "column", "type", "total_rows", "nulls", distinct.alias("distinct"), low.alias("min"), high.alias("max"))
    return _shares(shown).orderBy("number").select(*PROFILE_COLUMNS)


def profile_approx(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """``profile`` in a single pass with sketched distinct counts, for an opt-in quick look."""
    total = F.count(F.lit(1))
    values = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        ranged = isinstance(field.dataType, RANGED_TYPES)
        counted = not isinstance(field.dataType, UNCOUNTED_TYPES)
        values[field.name] = F.struct(
            total.alias("total_rows"),
            F.count_if(c.isNull()).alias("nulls"),
            (F.approx_count_distinct(_key(field.name, field.dataType), rsd) if counted
             else F.lit(None).cast("bigint")).alias("distinct"),
            (value_text(F.min(c), field.dataType) if ranged else F.lit(None).cast("string")).alias("min"),
            (value_text(F.max(c), field.dataType) if ranged else F.lit(None).cast("string")).alias("max"),
        )
    rows = df.agg(_by_column(df, values).alias("columns")).select(F.inline("columns"))
    share = F.round(F.col("value.nulls") / F.col("value.total_rows") * 100, 1)
    return rows.select(
        "column",
        F.upper("type").alias("type"),
        "value.total_rows",
        "value.nulls",
        F.when(F.col("value.total_rows") > 0, share).otherwise(0.0).alias("null_pct"),
        "value.distinct",
        "value.min",
        "value.max",
    )


def profile_all(tables: Mapping[str, DataFrame], plans: int = GROUP_TABLES) -> DataFrame:
    """``profile`` of several tables in one result, with the table's name first.

    Up to ``plans`` tables are one plan, a branch each; more are written by and by.
    """
    found = [profile(df).select(F.lit(name).alias("table"), *PROFILE_COLUMNS) for name, df in tables.items()]
    if len(found) <= plans:
        return union_all(found)
    return union_all(_written(union_all(found[k : k + plans])) for k in range(0, len(found), plans))


def table_docs(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One searchable document per table, naming its columns in order."""
    rows = union_all(
        column_rows(spark, df).withColumn("table", F.lit(name)) for name, df in tables.items()
    )
    can_be_null = F.when(F.col("nullable"), NULLABLE).otherwise(NOT_NULL)
    line = F.format_string(COLUMN_LINE, "column", "type", can_be_null)
    columns = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    listing = F.array_join(F.transform(columns, lambda c: c["line"]), "\n")
    return (
        rows.groupBy("table")
        .agg(listing.alias("listing"))
        .select(
            stable_id("warehouse", F.lit("schema"), F.col("table")).alias("id"),
            "table",
            F.format_string(TABLE_QUESTION, "table").alias("question"),
            F.format_string(TABLE_DESCRIPTION, "table", "listing").alias("description"),
        )
    )
