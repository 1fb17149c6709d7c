"""Every registered query against its DuckDB oracle on the sf0.001 testdata,
and the shape of the plans that matter at scale."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check import value_hash  # noqa: E402
from inocula.plans import registry  # noqa: E402
from inocula.sources.derived import RAW_TABLES, derived_tables  # noqa: E402

SF = "/root/testdata/sf0.001"
# the reports and operator runs; the training-data operators have their own tests
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for r in RAW_TABLES:
        con.sql(f"CREATE VIEW {r} AS SELECT * FROM read_parquet('{SF}/{r}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "name", "frequency", "relative_frequency"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dd = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert value_hash(sp, 9) == value_hash(dd, 9)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_prunes_before_the_shuffle(spark):
    from inocula.plans.raw import top_event_types_per_user

    plan = _plan(top_event_types_per_user(spark, SF))
    assert "WindowGroupLimit" in plan


def test_filters_reach_the_scan(spark, scratch):
    from inocula.plans.catalogue import q4_critical_after
    from inocula.sources.store import load_tables, read_tables

    load_tables(derived_tables(spark, SF), scratch, audit=False)
    plan = _plan(q4_critical_after(read_tables(spark, scratch)))
    assert "GreaterThan(date,1998-06-01)" in plan
    assert "EqualTo(criticality,1)" in plan


def test_no_pairwise_join_in_prior_counting(spark):
    from inocula.plans.catalogue import q7_symptom_frequency
    from inocula.plans.tasks import t7a_vaccine_per_diagnosis

    for df in (q7_symptom_frequency(derived_tables(spark, SF)), t7a_vaccine_per_diagnosis(derived_tables(spark, SF))):
        plan = _plan(df)
        # the "on or before" rule must never become a join condition
        for line in plan.splitlines():
            if "Join" in line:
                assert "<=" not in line and ">=" not in line, line


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
