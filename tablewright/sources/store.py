"""Versioned tables and the stored index.

A table's version is a new folder, named by a row of its own below ``versions``. The index is a
base, cut into parts by the hash of the id, and a log of changes: a batch is written as it is,
beside what was there, and readers merge. Compaction folds the log into the parts it touches,
splits those that have grown, and ``vacuum`` removes what no kept version names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import index as ix
from tablewright.operators.approx import Plan, build_tables, topk_approx
from tablewright.operators.index import INDEX_SCHEMA
from tablewright.operators.topk import DEFAULT_K, DEFAULT_THRESHOLD, topk_join, topk_rows
from tablewright.session import SharedFolder, work_folder

VERSION_SCHEMA = "version bigint, folder string, created timestamp"
# Seconds after which a claimed version without a row is taken for that of a lost writer.
LEASE = 3600


class LostRace(RuntimeError):
    """Another writer made the next version first; read again and repeat the change."""


# --- Versions: a claimed number, then a row of its own --------------------------------------------
def _numbers(folder: SharedFolder) -> list[int]:
    """Versions by number, the latest complete one last."""
    numbers = sorted(int(n) for n in folder.names("versions") if n.isdigit())
    while numbers and not any(n.startswith("part-") for n in folder.names(f"versions/{numbers[-1]:08d}")):
        numbers.pop()
    return numbers


def _claim(folder: SharedFolder, latest: int) -> int:
    """Takes the next version's number for this writer alone, by creating its file.

    A number that a writer claimed and never used is passed over once its lease is out.
    """
    number = latest + 1
    while not folder.create(f"claims/{number:08d}"):
        age = folder.names("claims").get(f"{number:08d}", 0.0)
        if age < LEASE:
            raise LostRace(f"version {number} of {folder.path} is another writer's; nothing of this change is kept")
        number += 1
    return number


def _publish(folder: SharedFolder, number: int, row: tuple, schema: str) -> int:
    """Makes a version the current one; fails if a later one was made meanwhile."""
    made = folder.spark.createDataFrame([row], schema).coalesce(1)
    made.write.json(f"{folder.path}/versions/{number:08d}")
    if _numbers(folder)[-1] > number:
        raise LostRace(f"version {number} of {folder.path} came after its lease; repeat the change")
    return number


def _row(folder: SharedFolder, schema: str) -> Row | None:
    numbers = _numbers(folder)
    if not numbers:
        return None
    return folder.spark.read.schema(schema).json(f"{folder.path}/versions/{numbers[-1]:08d}").first()


def _new_folder(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, root: str, now: datetime | None = None) -> int:
    """Writes ``df`` beside the versions it may have been read from, then makes it the current one."""
    folder = SharedFolder(df.sparkSession, root)
    latest = _numbers(folder)
    name = _new_folder("table")
    df.write.parquet(f"{root}/{name}")
    number = _claim(folder, latest[-1] if latest else 0)
    return _publish(folder, number, (number, name, now or datetime.now(timezone.utc)), VERSION_SCHEMA)


def read_table(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The current version; an empty table of ``schema`` where nothing was written yet."""
    row = _row(SharedFolder(spark, root), VERSION_SCHEMA)
    if row is None:
        if schema is None:
            raise FileNotFoundError(root)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/{row['folder']}")


# --- The index: parts by hash of the id, and a log of changes -------------------------------------
# Bytes of a part's vectors and texts at which it is split.
PART_BYTES = 4 << 30
# The log is folded into the base when it has so many batches, or this share of the base's bytes.
MOST_BATCHES = 32
FOLD_SHARE = 0.25
# Bytes of log that are never too many.
LEAST_FOLD_BYTES = 64 << 20

PART_SCHEMA = "struct<depth: int, prefix: bigint, folder: string, bytes: bigint>"
BATCH_SCHEMA = "struct<folder: string, version: bigint, bytes: bigint>"
INDEX_VERSION_SCHEMA = (
    f"version bigint, created timestamp, parts array<{PART_SCHEMA}>, log array<{BATCH_SCHEMA}>, "
    "streams map<string, bigint>, search struct<folder: string, version: bigint>"
)
LOG_SCHEMA = f"{INDEX_SCHEMA}, deleted boolean, version bigint"


@dataclass(frozen=True)
class Part:
    """Rows whose id's hash ends in ``prefix``, taken ``depth`` bits long."""

    depth: int
    prefix: int
    folder: str = ""
    bytes: int = 0

    @property
    def name(self) -> str:
        return f"{self.depth}-{self.prefix}"


@dataclass(frozen=True)
class Batch:
    folder: str
    version: int
    bytes: int


@dataclass(frozen=True)
class Version:
    """What the index is made of: parts, the batches written since, and what streams have loaded."""

    version: int = 0
    parts: tuple[Part, ...] = ()
    log: tuple[Batch, ...] = ()
    streams: tuple[tuple[str, int], ...] = ()
    search: tuple[str, int] | None = None

    def row(self, now: datetime | None) -> tuple:
        parts = [(p.depth, p.prefix, p.folder, p.bytes) for p in self.parts]
        log = [(b.folder, b.version, b.bytes) for b in self.log]
        return self.version, now or datetime.now(timezone.utc), parts, log, dict(self.streams), self.search


def index_version(spark: SparkSession, root: str) -> Version:
    """The current version; version 0 where nothing was written yet."""
    row = _row(SharedFolder(spark, root), INDEX_VERSION_SCHEMA)
    if row is None:
        return Version()
    return Version(
        row["version"],
        tuple(Part(*p) for p in row["parts"]),
        tuple(Batch(*b) for b in row["log"]),
        tuple(sorted((row["streams"] or {}).items())),
        tuple(row["search"]) if row["search"] else None,
    )


def _even(count: int) -> list[Part]:
    depth = max(0, math.ceil(math.log2(max(1, count))))
    return [Part(depth, prefix) for prefix in range(1 << depth)]


def _part_of(parts: Iterable[Part], id_: Column) -> Column:
    """The name of the part that an id falls in."""
    by_depth: dict[int, list[int]] = {}
    for part in parts:
        by_depth.setdefault(part.depth, []).append(part.prefix)
    names = []
    for depth, prefixes in by_depth.items():
        prefix = F.xxhash64(id_).bitwiseAND((1 << depth) - 1)
        named = F.concat(F.lit(f"{depth}-"), prefix.cast("string"))
        names.append(F.when(prefix.isin(prefixes), named) if len(prefixes) < 1 << depth else named)
    return F.coalesce(*names)


def _row_bytes() -> Column:
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("id", *ix.INDEX_DEFAULTS)]
    return sum(texts, F.lit(64)) + 8 * F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0))


def _base(spark: SparkSession, root: str, parts: Iterable[Part]) -> DataFrame:
    """The given parts, each from the folder that holds it; others are not listed or read."""
    by_folder: dict[str, list[str]] = {}
    for part in parts:
        by_folder.setdefault(part.folder, []).append(part.name)
    found = spark.createDataFrame([], INDEX_SCHEMA)
    for folder, names in by_folder.items():
        rows = spark.read.schema(f"{INDEX_SCHEMA}, part string").parquet(f"{root}/{folder}")
        found = found.unionByName(rows.where(F.col("part").isin(names)).drop("part"))
    return found


def _last_changes(spark: SparkSession, root: str, log: Iterable[Batch]) -> DataFrame:
    """The last logged row of each id, deleted ones included."""
    folders = [f"{root}/{b.folder}" for b in log]
    rows = spark.read.schema(LOG_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], LOG_SCHEMA)
    if len(folders) < 2:
        return rows
    last = rows.groupBy("id").agg(F.max("version").alias("version"))
    return rows.join(last, ["id", "version"], "left_semi")


def _merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    kept = base.join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(changes.where(~F.col("deleted")).select(*base.columns))


def _read(spark: SparkSession, root: str, version: Version, parts: Iterable[Part]) -> DataFrame:
    base = _base(spark, root, parts)
    return _merged(base, _last_changes(spark, root, version.log)) if version.log else base


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The current index, empty where nothing was written yet."""
    return _current(spark, root, index_version(spark, root))


def _current(spark: SparkSession, root: str, version: Version) -> DataFrame:
    return _read(spark, root, version, [p for p in version.parts if p.folder])


def _held(spark: SparkSession, root: str, version: Version, ids: DataFrame) -> DataFrame:
    """The current rows of the given ids; only the parts they fall in are read.

    Part names, a bounded list, come to the driver.
    """
    if not version.parts:
        return spark.createDataFrame([], INDEX_SCHEMA)
    touched = {r[0] for r in ids.select(_part_of(version.parts, F.col("id")).alias("part")).distinct().collect()}
    rows = _read(spark, root, version, [p for p in version.parts if p.name in touched and p.folder])
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def change_index(
    spark: SparkSession,
    root: str,
    ids: DataFrame,
    change: Callable[[DataFrame], DataFrame],
    parts: int | None = None,
    now: datetime | None = None,
    batch: tuple[str, int] | None = None,
) -> int:
    """Applies a change that concerns only rows with the given ids, as a new version.

    ``change`` gets the current rows of those ids and returns what is to be written, a row per id;
    where it has a column ``deleted``, true removes the id. What is written is that batch alone.
    Of two writers that began from one version the second raises ``LostRace``, and nothing of the
    first is lost. ``batch`` names a stream and the number of its batch, committed together with the
    rows: a batch that the index already holds changes nothing when it comes again.
    """
    folder = SharedFolder(spark, root)
    version = index_version(spark, root)
    if batch and batch[1] <= loaded_batch(version, batch[0]):
        return version.version
    changed = change(_held(spark, root, version, ids))
    deleted = F.col("deleted") if "deleted" in changed.columns else F.lit(False).alias("deleted")
    # Batches are ordered by the version they were made from; the number is claimed when they are written.
    stamp, name = version.version + 1, _new_folder("log")
    changed.select(*_columns(), deleted, F.lit(stamp).cast("bigint").alias("version")).write.parquet(f"{root}/{name}")
    number = _claim(folder, version.version)
    streams = {**dict(version.streams), **(dict([batch]) if batch else {})}
    log = (*version.log, Batch(name, stamp, folder.bytes(name)))
    first = version.parts or tuple(_even(parts or 1))
    after = replace(version, version=number, parts=first, log=log, streams=tuple(sorted(streams.items())))
    _publish(folder, number, after.row(now), INDEX_VERSION_SCHEMA)
    base, logged = sum(p.bytes for p in first), sum(b.bytes for b in log)
    if len(log) >= MOST_BATCHES or logged > max(LEAST_FOLD_BYTES, FOLD_SHARE * base):
        return compact_index(spark, root, now=now)
    return number


def _columns() -> list[str]:
    return [field.split()[0] for field in INDEX_SCHEMA.split(", ")]


def _write_parts(spark: SparkSession, root: str, rows: DataFrame, parts: list[Part], part_bytes: int) -> list[Part]:
    """Writes rows in the given parts, those split that would hold more than ``part_bytes``.

    ``rows`` is read twice, once for the parts' sizes, which come to the driver.
    """
    own = rows.withColumn("part", _part_of(parts, F.col("id")))
    sizes = {r["part"]: r["bytes"] for r in own.groupBy("part").agg(F.sum(_row_bytes()).alias("bytes")).collect()}
    split: list[Part] = []
    for part in parts:
        more = max(0, math.ceil(math.log2(max(1, sizes.get(part.name, 0) / part_bytes))))
        split += [Part(part.depth + more, part.prefix + (k << part.depth)) for k in range(1 << more)]
    name = _new_folder("base")
    dealt = rows.withColumn("part", _part_of(split, F.col("id"))).hint("rebalance", "part")
    dealt.write.partitionBy("part").parquet(f"{root}/{name}")
    folder = SharedFolder(spark, root)
    written = [n.removeprefix("part=") for n in folder.names(name) if n.startswith("part=")]
    return [replace(p, folder=name, bytes=folder.bytes(f"{name}/part={p.name}")) if p.name in written else p for p in split]


def _staged(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = work_folder(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def compact_index(spark: SparkSession, root: str, part_bytes: int = PART_BYTES, now: datetime | None = None) -> int:
    """Folds the log into the parts it touches, as a new version; other parts stay where they are.

    Parts that have grown beyond ``part_bytes`` are split by further bits of the hash. Search tables
    that do not know all of the log are given up.
    """
    version = index_version(spark, root)
    if not version.log:
        return version.version
    changes = _last_changes(spark, root, version.log)
    parts = version.parts or tuple(_even(1))
    touched = {r[0] for r in changes.select(_part_of(parts, F.col("id")).alias("part")).distinct().collect()}
    old = [p for p in parts if p.name in touched]
    rows = _merged(_base(spark, root, [p for p in old if p.folder]), changes)
    written = _write_parts(spark, root, rows, old, part_bytes)
    kept = [p for p in parts if p.name not in touched]
    known = version.search is not None and all(b.version <= version.search[1] for b in version.log)
    folder = SharedFolder(spark, root)
    number = _claim(folder, version.version)
    after = replace(version, version=number, parts=tuple(kept + written), log=(), search=version.search if known else None)
    return _publish(folder, number, after.row(now), INDEX_VERSION_SCHEMA)


def write_index(
    index: DataFrame, root: str, parts: int | None = None, part_bytes: int = PART_BYTES, now: datetime | None = None
) -> int:
    """Replaces the whole index. It is cut into ``parts``, or as many as hold ``part_bytes`` each."""
    spark = index.sparkSession
    version = index_version(spark, root)
    rows = _staged(spark, index.select(*_columns()))
    written = _write_parts(spark, root, rows, _even(parts or 1), part_bytes)
    folder = SharedFolder(spark, root)
    number = _claim(folder, version.version)
    after = replace(version, version=number, parts=tuple(written), log=(), search=None)
    return _publish(folder, number, after.row(now), INDEX_VERSION_SCHEMA)


def _moment(now: datetime | Column) -> datetime | None:
    return now if isinstance(now, datetime) else None


def loaded_batch(version: Version, stream: str) -> int:
    """The last batch of a stream that the index holds, -1 before the first."""
    return dict(version.streams).get(stream, -1)


def upsert_index(
    rows: DataFrame,
    root: str,
    now: datetime | Column,
    order_by: str | None = None,
    parts: int | None = None,
    batch: tuple[str, int] | None = None,
) -> int:
    """Inserts rows, or replaces all but ``created_at`` where the id is known."""

    def change(held: DataFrame) -> DataFrame:
        return ix.changes(held, rows, now, order_by)

    return change_index(rows.sparkSession, root, rows, change, parts, _moment(now), batch)


def edit_index(rows: DataFrame, root: str, now: datetime | Column, order_by: str | None = None) -> int:
    """Replaces the text fields and carries the stored vectors over."""

    def change(held: DataFrame) -> DataFrame:
        return ix.edit_changes(held, rows, now, order_by)

    return change_index(rows.sparkSession, root, rows, change, now=_moment(now))


def delete_from_index(ids: DataFrame, root: str, now: datetime | None = None) -> int:
    """Removes the rows of the given ids; ids that the index does not hold leave no trace."""

    def change(held: DataFrame) -> DataFrame:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema if f.name != "id"]
        return held.select("id", *empty, F.lit(True).alias("deleted"))

    return change_index(ids.sparkSession, root, ids, change, now=now)


# --- Search tables beside the index ---------------------------------------------------------------
def write_search_tables(spark: SparkSession, root: str, now: datetime | None = None, **options: object) -> Plan:
    """Builds the approximate search tables of the current index; later changes are merged in by readers."""
    version = index_version(spark, root)
    name = _new_folder("search")
    plan = build_tables(_current(spark, root, version), f"{root}/{name}", **options)
    folder = SharedFolder(spark, root)
    number = _claim(folder, version.version)
    after = replace(version, version=number, search=(name, max((b.version for b in version.log), default=0)))
    _publish(folder, number, after.row(now), INDEX_VERSION_SCHEMA)
    return plan


def search_index(
    queries: DataFrame, root: str, k: int = DEFAULT_K, threshold: float = DEFAULT_THRESHOLD, exact: bool = False
) -> DataFrame:
    """The best k rows of the stored index for every query: ``query_id, id, similarity, rank``.

    With search tables it is their approximate search, and rows changed since they were built are
    compared one by one; without any, or with ``exact``, it is ``topk_join``.
    """
    spark = queries.sparkSession
    version = index_version(spark, root)
    if exact or version.search is None or threshold <= 0:
        return topk_join(queries, _current(spark, root, version), k, threshold)
    path, known = f"{root}/{version.search[0]}", version.search[1]
    later = [b for b in version.log if b.version > known]
    if not later:
        return topk_approx(queries, path, k, threshold)
    fresh = _last_changes(spark, root, later)
    found = topk_approx(queries, path, k, threshold, without=fresh.select("id"))
    near = topk_join(queries, fresh.where(~F.col("deleted")), k, threshold)
    return topk_rows(found.drop("rank").unionByName(near.drop("rank")), k)


# --- Removing what is not used any more -----------------------------------------------------------
def vacuum(spark: SparkSession, root: str, keep: int = 2, grace: float = 24 * 3600.0) -> list[str]:
    """Removes the folders below ``root`` that none of the last ``keep`` versions names.

    Folders younger than ``grace`` seconds stay: a reader or a writer may be at work on them. What a
    lost writer left behind goes like any other. Returns the names of what was removed.
    """
    folder = SharedFolder(spark, root)
    numbers = _numbers(folder)
    kept = numbers[-keep:]
    named = set()
    for number in kept:
        named |= _names_of(spark, f"{root}/versions/{number:08d}")
    prefixes = ("table-", "base-", "log-", "search-")
    gone = [n for n, age in folder.names().items() if n.startswith(prefixes) and n not in named and age > grace]
    oldest = kept[0] if kept else 0
    for sub in ("versions", "claims"):
        gone += [f"{sub}/{n}" for n, age in folder.names(sub).items() if n.isdigit() and int(n) < oldest and age > grace]
    for name in gone:
        folder.remove(name)
    return sorted(gone)


def _names_of(spark: SparkSession, path: str) -> set[str]:
    """The folders that a version of a table or of the index names."""
    schema = f"folder string, {INDEX_VERSION_SCHEMA}"
    row = spark.read.schema(schema).json(path).first()
    found = {row["folder"]} | {p["folder"] for p in row["parts"] or []} | {b["folder"] for b in row["log"] or []}
    return {n for n in found | ({row["search"]["folder"]} if row["search"] else set()) if n}


def import_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vectors and times are text (a JSON array, ISO times) as index rows."""
    vector = F.coalesce(F.from_json(F.col(vector_col), "array<double>"), F.array().cast("array<double>"))
    return rows.withColumns(
        {
            vector_col: vector,
            "created_at": F.col("created_at").cast("timestamp"),
            "updated_at": F.col("updated_at").cast("timestamp"),
        }
    )
