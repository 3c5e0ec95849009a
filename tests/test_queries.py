"""Every registered query against its SQL on the smallest tables; plans without unwanted joins."""

import io
import contextlib

import pytest
from compare import connect, rows

import __spark_entry__ as entry
from corpuslake import catalogue

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() >= 0


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


#: Joins with one row: of totals, or of whether something is there.
ONE_ROW = {"agg_02_counts", "agg_14_reconciliation", "agg_21_project_counts", "prj_08_envelope", "flt_05_project_filter", "jon_11_ranks", "q_10_project_ids", "snk_17_purge_report", "snk_24_delete_counts"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ONE_ROW))
def test_no_nested_loops(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["src_04_partition_scan"](spark, sf_dir))
    assert "EqualTo(source,src3)" in plan and "ReadSchema: struct<doc_id:bigint,source:string,n_chars:" in plan
    assert "LocalTableScan" in plan_of(QUERIES["acl_06_empty_scope"](spark, sf_dir)) or "LocalRelation" in plan_of(QUERIES["acl_06_empty_scope"](spark, sf_dir))
