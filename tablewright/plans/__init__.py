"""Registered queries and the SQL they are checked against."""

from tablewright.plans import catalog_checks, ingest_checks, knowledge_checks, report_checks, sql_pack, text_checks
from tablewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
