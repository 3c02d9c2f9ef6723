"""Session helpers and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tablewright", cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one named in ``spark.checkpoint.dir``.

    Only a local master may go without the setting; anywhere else a folder on one
    machine would be out of reach of the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="tablewright-")
    return os.path.join(base, f"tablewright-{uuid.uuid4().hex}")


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a stored table, or columns or rows of one."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
    except (AttributeError, TypeError):  # a session without a plan at hand
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation", "HiveTableRelation")


def spread(df: DataFrame) -> DataFrame:
    """A stored table of fewer splits than there are cores, dealt to all of them; others as they are.

    For costly work on the rows of small tables: a large one has many splits and is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if is_scan(df) and df._jdf.rdd().getNumPartitions() < cores else df


class SharedFolder:
    """A folder of a file system that the whole cluster sees, through the session's Hadoop settings."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._paths(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> dict[str, float]:
        """What lies in it, with the age in seconds."""
        if not self._files.exists(self._at(name)):
            return {}
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self._files.listStatus(self._at(name))}

    def create(self, name: str) -> bool:
        """Makes an empty file; false if there is one."""
        return self._files.createNewFile(self._at(name))

    def bytes(self, name: str) -> int:
        at = self._at(name)
        return self._files.getContentSummary(at).getLength() if self._files.exists(at) else 0

    def remove(self, name: str = "") -> None:
        self._files.delete(self._at(name), True)


def clean_work(spark: SparkSession, grace: float = 24 * 3600.0) -> list[str]:
    """Removes the work folders below ``spark.checkpoint.dir`` that are older than ``grace`` seconds.

    For a session whose results have all been written elsewhere; returns what was removed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return []
    folder = SharedFolder(spark, base)
    old = sorted(n for n, age in folder.names().items() if n.startswith("tablewright-") and age > grace)
    for name in old:
        folder.remove(name)
    return old
