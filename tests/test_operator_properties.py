"""Randomised equivalence of the pair-free operators with their brute-force
definitions (hypothesis drives the shapes: hot keys, ties, NULLs)."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inocula.operators import count_prior_pairs, latest_per_key, latest_prior

BASE = dt.date(2021, 5, 1)
keys = st.sampled_from(["h", "h", "h", "a", "b", None])
days = st.one_of(st.none(), st.integers(0, 6).map(lambda i: BASE + dt.timedelta(days=i)))
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(
    ev=st.lists(st.tuples(keys, days, st.sampled_from(["V1", "V2", None])), max_size=40),
    pr=st.lists(st.tuples(keys, days, st.sampled_from(["s1", "s2"])), max_size=40),
)
def test_count_prior_pairs(spark, ev, pr):
    e = spark.createDataFrame(ev, "k string, d date, v string")
    p = spark.createDataFrame(pr, "k string, d date, s string")
    got = {(r.v, r.s): r.frequency for r in count_prior_pairs(e, p, "k", "d", "d", "v", "s").collect()}
    want = Counter(
        (a[2], b[2])
        for a in ev
        for b in pr
        if a[0] is not None and a[0] == b[0] and a[1] is not None and b[1] is not None and a[1] <= b[1]
    )
    assert got == dict(want)


@SETTINGS
@given(
    ev=st.lists(st.tuples(keys, days, st.sampled_from(["F1", "F2"]), st.sampled_from(["V1", "V2"])), max_size=30),
    pr=st.lists(st.tuples(keys, days, st.sampled_from(["s1", "s2"])), max_size=30, unique=True),
)
def test_latest_prior(spark, ev, pr):
    e = spark.createDataFrame(ev, "k string, d date, f string, v string")
    p = spark.createDataFrame(pr, "k string, d date, s string")
    out = latest_prior(e, p, "k", "d", "d", pick=["f", "v"], payload=["v"], hit_date="hd").collect()
    got = sorted((r.k, r.d, r.s, r.v, r.hd) for r in out)
    want = []
    for k, d, s in pr:
        if k is None or d is None:
            continue
        cands = [x for x in ev if x[0] == k and x[1] is not None and x[1] <= d]
        if cands:
            best = min(cands, key=lambda x: (-x[1].toordinal(), x[2], x[3]))
            want.append((k, d, s, best[3], best[1]))
    assert got == sorted(want)


@SETTINGS
@given(rows=st.lists(st.tuples(keys, days, st.integers(0, 99)), max_size=40))
def test_latest_per_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, d date, v int")
    got = sorted(tuple(r) for r in latest_per_key(df, "k", "d").collect())
    mx = {}
    for k, d, _ in rows:
        if k is not None and d is not None:
            mx[k] = max(mx.get(k, d), d)
    want = sorted(r for r in rows if r[0] is not None and r[1] is not None and r[1] == mx[r[0]])
    assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["h", "h", "a", "b"]), st.integers(0, 5), st.integers(0, 999)), max_size=40, unique_by=lambda r: r[2]))
def test_first_n_wide_and_top_n(spark, rows):
    from pyspark.sql import functions as F

    from inocula.operators import first_n_wide, top_n_per_group

    df = spark.createDataFrame(rows, "k string, o int, v int")
    wide = {r.k: (r.v1, r.v2) for r in first_n_wide(df, "k", ["o", "v"], ["v"], 2).collect()}
    top = sorted((r.k, r.rank, r.v) for r in top_n_per_group(df, "k", [F.desc("o"), F.asc("v")], 3).collect())
    want_wide, want_top = {}, []
    for k in {r[0] for r in rows}:
        asc = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        want_wide[k] = (asc[0][2], asc[1][2] if len(asc) > 1 else None)
        desc = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:3]
        want_top += [(k, i + 1, r[2]) for i, r in enumerate(desc)]
    assert wide == want_wide
    assert top == sorted(want_top)


@SETTINGS
@given(
    ev=st.lists(st.tuples(keys, days, st.sampled_from(["V1", "V2", "V3"])), max_size=40),
    pr=st.lists(st.tuples(keys, days, st.sampled_from(["s1", "s2"])), max_size=40),
)
def test_count_prior_pairs_known_labels(spark, ev, pr):
    e = spark.createDataFrame(ev, "k string, d date, v string")
    p = spark.createDataFrame(pr, "k string, d date, s string")
    generic = {(r.v, r.s): r.frequency for r in count_prior_pairs(e, p, "k", "d", "d", "v", "s").collect()}
    known = {
        (r.v, r.s): r.frequency
        for r in count_prior_pairs(e, p, "k", "d", "d", "v", "s", labels=["V1", "V2", "V3"]).collect()
    }
    assert known == generic
