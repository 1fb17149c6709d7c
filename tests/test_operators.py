"""Operators against brute force on small random fixtures."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

import pytest

from conftest import d, rows_of
from inocula.operators import (
    count_prior_pairs,
    crosstab,
    first_n_wide,
    latest_per_key,
    latest_prior,
    one_per_key,
    orphans,
    pivot_fixed,
    running_total,
    share_of_group,
    top_n_per_group,
)


def _dates(n, rnd):
    return [d(f"2021-05-{rnd.randint(1, 6):02d}") for _ in range(n)]


def test_latest_per_key_keeps_ties_and_drops_nulls(spark):
    rows = [
        ("a", d("2021-01-02"), 1),
        ("a", d("2021-01-02"), 2),
        ("a", d("2021-01-01"), 3),
        ("b", None, 4),
        ("b", d("2021-01-01"), 5),
        (None, d("2021-01-05"), 6),
        ("c", None, 7),
    ]
    df = spark.createDataFrame(rows, "k string, o date, v int")
    got = sorted(r.v for r in latest_per_key(df, "k", "o").collect())
    assert got == [1, 2, 5]


def test_count_prior_pairs_matches_brute_force(spark):
    rnd = random.Random(7)
    # one hot key holding most rows on both sides
    ev = [(rnd.choice(["h", "h", "h", "x", "y", None]), dt, rnd.choice(["V1", "V2"])) for dt in _dates(200, rnd)]
    ev.append(("h", None, "V1"))
    pr = [(rnd.choice(["h", "h", "x", "z"]), dt, rnd.choice(["s1", "s2", "s3"])) for dt in _dates(150, rnd)]
    e = spark.createDataFrame(ev, "k string, d date, v string")
    p = spark.createDataFrame(pr, "k string, d date, s string")
    got = {(r.v, r.s): r.frequency for r in count_prior_pairs(e, p, "k", "d", "d", "v", "s").collect()}
    want = Counter()
    for (ek, ed, ev_), (pk, pd_, ps) in itertools.product(ev, pr):
        if ek is not None and ek == pk and ed is not None and pd_ is not None and ed <= pd_:
            want[(ev_, ps)] += 1
    assert got == dict(want)


def test_latest_prior_matches_brute_force(spark):
    rnd = random.Random(11)
    ev = [(rnd.choice(["h", "h", "x"]), dt, rnd.choice(["F1", "F2", "F3"]), rnd.choice(["V1", "V2"])) for dt in _dates(60, rnd)]
    pr = list({(rnd.choice(["h", "x", "q"]), dt, rnd.choice(["s1", "s2"])) for dt in _dates(40, rnd)})
    e = spark.createDataFrame(ev, "k string, d date, f string, v string")
    p = spark.createDataFrame(pr, "k string, d date, s string")
    got = {(r.k, r.d, r.s): r.v for r in latest_prior(e, p, "k", "d", "d", pick=["f", "v"], payload=["v"]).collect()}
    want = {}
    for pk, pd_, ps in pr:
        cands = [x for x in ev if x[0] == pk and x[1] <= pd_]
        if cands:
            best = sorted(cands, key=lambda x: (-x[1].toordinal(), x[2], x[3]))[0]
            want[(pk, pd_, ps)] = best[3]
    assert got == want


def test_first_n_wide_and_short_groups(spark):
    df = spark.createDataFrame(
        [("a", 3, "z"), ("a", 1, "x"), ("a", 2, "y"), ("b", 5, "q")], "k string, o int, v string"
    )
    got = rows_of(first_n_wide(df, "k", ["o"], ["v"], 2))
    assert got == [("a", "x", "y"), ("b", "q", None)]


def test_top_n_and_one_per_key(spark):
    df = spark.createDataFrame(
        [("g", "a", 3), ("g", "b", 3), ("g", "c", 5), ("g", "d", 1), ("h", "e", 1)], "g string, s string, n int"
    )
    top = rows_of(top_n_per_group(df, "g", [F.desc("n"), F.asc("s")], 3).select("g", "rank", "s"))
    assert top == [("g", 1, "c"), ("g", 2, "a"), ("g", 3, "b"), ("h", 1, "e")]
    one = rows_of(one_per_key(df, "g", [F.asc("n"), F.asc("s")]).select("g", "s"))
    assert one == [("g", "d"), ("h", "e")]


def test_share_running_crosstab_pivot(spark):
    c = spark.createDataFrame([("A", "x", 1), ("A", "y", 3), ("B", "x", 2)], "g string, c string, n long")
    shares = {(r.g, r.c): r.share for r in share_of_group(c, "g", "n").collect()}
    assert shares == {("A", "x"): 0.25, ("A", "y"): 0.75, ("B", "x"): 1.0}
    days = spark.createDataFrame([(d("2021-01-02"), 2), (d("2021-01-01"), 1), (d("2021-01-03"), 4)], "dt date, n long")
    assert [(r.dt.day, r.cumulative) for r in running_total(days, "dt", "n").orderBy("dt").collect()] == [
        (1, 1),
        (2, 3),
        (3, 7),
    ]
    raw = spark.createDataFrame([("s1", "V1"), ("s1", "V1"), ("s2", "V2")], "s string, v string")
    with pytest.raises(Exception, match="outside the list"):
        pivot_fixed(c, "g", "c", ["x"], "n").collect()
    two = {r["s"]: r for r in crosstab(raw, "s", "v", ["V1"]).collect()}
    full = {r["s"]: r for r in crosstab(raw, "s", "v", ["V1", "V2", "V3"]).collect()}
    assert all(r["other"] == full[s]["V2"] + full[s]["V3"] + full[s]["other"] for s, r in two.items())
    ct = rows_of(crosstab(raw, "s", "v", ["V1", "V2", "V3"]).drop("other"))
    assert ct == [("s1", 2, 0, 0), ("s2", 0, 1, 0)]
    pv = rows_of(pivot_fixed(c, "g", "c", ["x", "y"], "n"))
    assert pv == [("A", 1, 3), ("B", 2, None)]


def test_orphans_two_forms(spark):
    child = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    parent = spark.createDataFrame([("a",)], "pk string")
    assert rows_of(orphans(child, parent, [("k", "pk")])) == [("b", 2), (None, 3)]
    parent2 = spark.createDataFrame([("b",)], "k string")
    assert rows_of(orphans(child, parent2, ["k"])) == [("a", 1), (None, 3)]


def test_count_std_exact(spark):
    import statistics

    from inocula.operators import count_std

    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([(v,) for v in vals], "c long")
    sd = count_std(df, "c").first()[0]
    assert abs(sd - statistics.stdev(vals)) < 1e-12
    # order and partitioning do not change a single bit
    assert count_std(df.repartition(7), "c").first()[0] == sd
    assert count_std(df.limit(1), "c").first()[0] is None


def test_prior_pairs_are_dealt_by_key_once(spark):
    """Each side is collapsed, dealt by key, and summed: no further shuffle between."""
    day = d("2024-01-01")
    ev = spark.createDataFrame([("a", day, "x"), ("a", day, None)], "k string, d date, l string")
    pr = spark.createDataFrame([("a", day, "p"), ("a", day, "p"), ("b", day, None)], "k string, d date, s string")
    pairs = count_prior_pairs(ev, pr, "k", "d", "d", "l", "s")
    assert {tuple(r) for r in pairs.collect()} == {("x", "p", 2), (None, "p", 2)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange hashpartitioning.*plan_id=(\d+)", plan.split("== Initial Plan ==")[0]))) == 5
