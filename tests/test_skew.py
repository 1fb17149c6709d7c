"""One key holding a third of all rows: the pair-free operators stay exact
and never form the hot key's pairs (DuckDB's plain pair join is the oracle)."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from inocula.operators import count_prior_pairs, latest_prior, top_n_per_group

SF = "/root/testdata/sf0.01"
HOT = "o_orderkey % 3 = 0"  # these orders all move to customer 0


@pytest.fixture(scope="module")
def orders(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    return o.select(
        F.when(F.expr(HOT), F.lit(0)).otherwise(F.col("o_custkey")).alias("k"),
        F.col("o_orderdate").cast("date").alias("d"),
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
    )


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(
        f"""CREATE VIEW o AS SELECT CASE WHEN {HOT} THEN 0 ELSE o_custkey END AS k,
            CAST(o_orderdate AS DATE) AS d, o_orderkey, o_orderpriority, o_orderstatus
            FROM read_parquet('{SF}/orders.parquet')"""
    )
    return con


def test_hot_key_share(orders):
    n = orders.count()
    hot = orders.where("k = 0").count()
    assert hot * 3 >= n - 3


def test_count_prior_pairs_hot_key(orders, duck):
    got = {
        (r.o_orderpriority, r.o_orderstatus): r.pairs
        for r in count_prior_pairs(orders, orders, "k", "d", "d", "o_orderpriority", "o_orderstatus", "pairs").collect()
    }
    want = {
        (a, b): n
        for a, b, n in duck.sql(
            """SELECT a.o_orderpriority, b.o_orderstatus, COUNT(*) FROM o a JOIN o b
               ON a.k = b.k AND a.d <= b.d GROUP BY ALL"""
        ).fetchall()
    }
    assert got == want
    assert sum(got.values()) > 10_000_000  # the hot key alone has > 12M pairs
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    by_cols = count_prior_pairs(
        orders, orders, "k", "d", "d", "o_orderpriority", "o_orderstatus", "pairs", labels=priorities
    )
    assert {(r.o_orderpriority, r.o_orderstatus): r.pairs for r in by_cols.collect()} == want


def test_latest_prior_hot_key(orders, duck):
    low = orders.where("o_orderpriority = '5-LOW'").select("k", "d", F.col("o_orderkey").alias("prior"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "k", "d")
    got = {r.o_orderkey: r.prior for r in latest_prior(low, urgent, "k", "d", "d", ["prior"], ["prior"]).collect()}
    want = dict(
        duck.sql(
            """SELECT o_orderkey, prior FROM (
                 SELECT u.o_orderkey, l.o_orderkey AS prior,
                        row_number() OVER (PARTITION BY u.o_orderkey ORDER BY l.d DESC, l.o_orderkey) AS rn
                 FROM o u JOIN o l ON u.k = l.k AND l.d <= u.d
                 WHERE u.o_orderpriority = '1-URGENT' AND l.o_orderpriority = '5-LOW') WHERE rn = 1"""
        ).fetchall()
    )
    assert got == want


def test_top_n_hot_group_is_pruned_before_shuffle(orders):
    top = top_n_per_group(orders, "k", [F.desc("d"), F.asc("o_orderkey")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    hot = [r.o_orderkey for r in top.where("k = 0").orderBy("rank").collect()]
    assert len(hot) == 2
