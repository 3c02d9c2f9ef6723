"""Every registered query beside its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
from compare import compare, connect  # noqa: E402

from tablewright.plans import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(data) -> duckdb.DuckDBPyConnection:
    return connect(data)


def test_contract(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["region", "month", "orders", "revenue"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    agrees, note = compare(spark, con, data, name)
    assert agrees, note


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_of_all_rows(spark, data, name, capsys):
    entry.queries()[name](spark, data).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def plan_of(spark, data, name, capsys):
    entry.queries()[name](spark, data).explain()
    return capsys.readouterr().out


@pytest.mark.parametrize(
    "name", ["first_seen_dedupe", "pattern_records", "job_stale_sweep", "index_upsert", "dictionary_put_remove"]
)
def test_hot_keys_are_folded_before_the_shuffle(spark, data, name, capsys):
    plan = plan_of(spark, data, name, capsys)
    assert "Window" not in plan and "partial_m" in plan


@pytest.mark.parametrize("name", ["profile_lineitem", "profile_all_tables", "profile_rated_documents"])
def test_profile_does_not_multiply_rows(spark, data, name, capsys):
    assert "Expand" not in plan_of(spark, data, name, capsys)


@pytest.mark.parametrize("name", ["topk_join", "unified_search", "sql_window_rank"])
def test_ranks_are_cut_before_the_shuffle(spark, data, name, capsys):
    plan = plan_of(spark, data, name, capsys)
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") and plan.count("Partial") >= 1


@pytest.mark.parametrize("name", ["keyword_match", "keyword_match_by_join", "topk_single", "lakeview_extract"])
def test_texts_are_not_shuffled_by_key(spark, data, name, capsys):
    plan = plan_of(spark, data, name, capsys)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(gram") == 0


@pytest.mark.parametrize(
    "name,columns",
    [("histogram", "l_extendedprice:double"), ("index_listing", "vec_id:bigint,label:int"), ("sql_topk", "o_orderkey:bigint,o_totalprice:double")],
)
def test_scans_read_only_what_is_used(spark, data, name, columns, capsys):
    assert f"ReadSchema: struct<{columns}>" in plan_of(spark, data, name, capsys)
