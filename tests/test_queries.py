"""Registered queries against their checking SQL, and the shape of their plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from forklore.catalog import load
from forklore.catalog.views import BASE

NAMES = sorted(load()[0])
ORACLES = entry_module.oracle_sql()
ITERATIVE = ("g0", "g1", "m22", "a15_first", "t0", "s")
SAMPLE = [
    "m01_hot_commits_per_pr", "m04_commit_based_hotness", "m10_merge_verdicts", "m14_core_team",
    "m20_modularity", "a10_project_easiness", "j05_prior_window_join", "j13_foreign_copies_theta",
    "o05_stratified_pr_sample", "p14_reconciled_branches", "s05_pull_request_export",
    "s22_upsert", "t02_resumed_insert", "u08_contained_branches", "w04_close_right_after_merge",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for table in BASE:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return made


def cell(value):
    return round(value, 6) if isinstance(value, float) else value


def table(records):
    return sorted(repr(tuple(cell(v) for v in r)) for r in records)


@pytest.mark.parametrize("name", NAMES if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_equals_checking_sql(spark, sf_dir, con, name):
    df = entry_module.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    want = table([r[i] for i in order] for r in cursor.fetchall())
    assert table(df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(ITERATIVE)])
def test_no_plan_compares_all_pairs(spark, sf_dir, name):
    plan = entry_module.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["project_id", "pr_id", "n_hot_commits"]


def test_every_query_has_checking_sql():
    assert set(load()[0]) == set(load()[1])
