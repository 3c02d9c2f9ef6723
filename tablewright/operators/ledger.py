"""The ledger of load jobs, from an append-only table of their events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.times import moment

# --- Fixed values -------------------------------------------------------------------
JOBS_KEPT = 50
OPEN_STATES = ("pending", "running")
FINAL_STATES = ("completed", "failed")
STALE_ERROR = "Server restarted while job was running"
# ------------------------------------------------------------------------------------


def job_states(events: DataFrame, order_by: str = "at", keep: int | None = JOBS_KEPT) -> DataFrame:
    """The latest state of each job, newest start first; the ledger keeps 50.

    ``events(id, source, status, at, progress)``. The latest event is found by a partial
    aggregate, so a job with most of the events is no hot group.
    """
    last = F.max_by(F.struct("source", "status", "progress", "at"), F.col(order_by))
    jobs = events.groupBy("id").agg(F.min("at").alias("started_at"), last.alias("last"))
    done = F.col("last.status").isin(*FINAL_STATES)
    states = jobs.select(
        "id",
        F.col("last.source").alias("source"),
        "started_at",
        F.when(done, F.col("last.at")).alias("finished_at"),
        F.col("last.status").alias("status"),
        F.when(~done, F.col("last.progress")).alias("progress"),
    )
    if keep is None:
        return states
    return states.orderBy(F.desc("started_at"), "id").limit(keep)


def sweep_stale(jobs: DataFrame, now: datetime | Column) -> DataFrame:
    """Jobs left open by a restart become failed, without progress."""
    stale = F.col("status").isin(*OPEN_STATES)
    return jobs.withColumns(
        {
            "error": F.when(stale, STALE_ERROR),
            "finished_at": F.when(stale, moment(now)).otherwise(F.col("finished_at")),
            "progress": F.when(~stale, F.col("progress")),
            "status": F.when(stale, "failed").otherwise(F.col("status")),
        }
    )
