"""Moments given by the caller."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(at: datetime | Column) -> Column:
    """The caller's clock as a column; a column is taken as it is."""
    return at if isinstance(at, Column) else F.lit(at)
