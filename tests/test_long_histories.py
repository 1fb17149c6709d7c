"""Time blocks, the kept view, SQL texts, ordered results and the finer words."""

from __future__ import annotations

import datetime as dt
import random
import uuid
from collections import Counter

import pytest
from conftest import base_rows, d, make_tables, rows_of
from pyspark.sql import functions as F

from inocula.operators import count_prior_pairs_by_time, latest_prior_by_time
from inocula.plans import catalogue as C
from inocula.plans import charts as V
from inocula.plans import registry, sql_text
from inocula.plans import tasks as T
from inocula.plans.params import Params
from inocula.plans.raw import prior_event_pairs
from inocula.sources.derived import derived_tables
from inocula.sources.kept import append_attendances, count_load, create_dose_counts, kept_vaccination_status, load_counts
from inocula.sources.tables import KeysViolated, create_tables, open_tables, replace_rows

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ time blocks
def history(seed: int):
    rng = random.Random(seed)
    start = dt.datetime(2024, 3, 30, 23, 0)

    def one(i):
        key = None if rng.random() < 0.05 else 0 if rng.random() < 0.4 else rng.randrange(1, 5)
        at = None if rng.random() < 0.05 else start + dt.timedelta(seconds=rng.randrange(0, 9000), microseconds=rng.choice([0, 0, 1, 999999]))
        return (i, key, at, rng.choice(["x", "y", None]))

    return [one(i) for i in range(150)], [one(i) for i in range(150)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("seconds", [1, 600, 86400])
def test_blocks_of_time_match_brute_force(spark, kind, seconds):
    events, probes = history(seconds)
    e = spark.createDataFrame(events, f"id int, k int, at {kind}, label string")
    p = spark.createDataFrame(probes, f"pid int, k int, at {kind}, told string")
    before = [(x, y) for x in events for y in probes if None not in (x[1], x[2], y[1], y[2]) and x[1] == y[1] and x[2] <= y[2]]
    got = {(r[0], r[1]): r[2] for r in count_prior_pairs_by_time(e, p, "k", "at", "at", "label", "told", block_seconds=seconds).collect()}
    assert got == Counter((x[3], y[3]) for x, y in before)
    latest = {}
    for x, y in before:
        at = latest.get(y[0])
        if at is None or (x[2], -x[0]) > (at[0], -at[1]):
            latest[y[0]] = (x[2], x[0])
    hits = latest_prior_by_time(e, p, "k", "at", "at", ["id"], ["id"], hit_time="hit", block_seconds=seconds).collect()
    assert {r["pid"]: (r["hit"], r["id"]) for r in hits} == latest
    assert len(hits) == len(latest)


def test_blocks_of_empty_tables_and_wrong_kinds(spark):
    e = spark.createDataFrame([], "id int, k int, at timestamp, label string")
    assert count_prior_pairs_by_time(e, e.withColumnRenamed("label", "told"), "k", "at", "at", "label", "told").collect() == []
    assert latest_prior_by_time(e, e.withColumnRenamed("id", "pid"), "k", "at", "at", ["id"], ["id"]).collect() == []
    text = e.withColumn("at", F.col("at").cast("string"))
    with pytest.raises(TypeError):
        count_prior_pairs_by_time(text, text.withColumnRenamed("label", "told"), "k", "at", "at", "label", "told")
    with pytest.raises(TypeError):
        count_prior_pairs_by_time(text, e.withColumnRenamed("label", "told"), "k", "at", "at", "label", "told")


def test_a_busy_key_is_dealt_by_blocks(spark):
    """Every window is dealt by key and block, or holds one row per block of a key."""
    plan = prior_event_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert sum("_b#" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows) == 1
    for line in plan.splitlines():
        if "Join" in line:
            assert "<=" not in line and ">=" not in line


# ------------------------------------------------------------------ kept view
@pytest.fixture()
def campaign(spark, scratch):
    name = f"k_{uuid.uuid4().hex}"
    create_tables(spark, name, f"{scratch}/tables", buckets=4)
    create_dose_counts(spark, name, f"{scratch}/kept", buckets=4)
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", "b", None, "M", 0), ("P3", "c", None, "M", 0)]
    t = make_tables(spark, **r)
    for n in ("vaccine", "manufacturer", "healthcarefacility", "batch", "vaccination", "patient"):
        replace_rows(spark, name, n, t[n])
    return name


def attendances(spark, *rows):
    return make_tables(spark, attends=[(d(day), place, who) for day, place, who in rows])["attends"]


def test_kept_status_equals_the_view_after_every_append(spark, campaign):
    loads = [
        attendances(spark, ("2021-05-03", "H2", "P1"), ("2021-05-03", "H1", "P2")),
        attendances(spark, ("2021-05-10", "H2", "P1"), ("2021-05-10", "H2", "P2")),
    ]
    assert {r.vaccinationstatus for r in kept_vaccination_status(spark, campaign).collect()} == {0}
    for i, rows in enumerate(loads):
        append_attendances(spark, campaign, rows, f"load-{i}")
        assert rows_of(kept_vaccination_status(spark, campaign)) == rows_of(C.q5_vaccination_status(open_tables(spark, campaign)))
    kept = rows_of(kept_vaccination_status(spark, campaign))
    # P1 has both of two doses; P2 the one of H1 and one of two of H2; P3 none
    assert [(r[0], r[4]) for r in kept] == [("P1", 1), ("P2", 0), ("P2", 1), ("P3", 0)]
    count_load(spark, campaign, loads[1], "load-1")  # again, as after a failure
    assert rows_of(kept_vaccination_status(spark, campaign)) == kept
    with pytest.raises(KeysViolated):
        append_attendances(spark, campaign, loads[1], "load-2")
    assert rows_of(kept_vaccination_status(spark, campaign)) == kept
    with pytest.raises(ValueError):
        count_load(spark, campaign, loads[1], "a/b")


def test_an_update_reads_its_own_rows_and_the_view_only_counts(spark, campaign, scratch):
    append_attendances(spark, campaign, attendances(spark, ("2021-05-03", "H2", "P1")), "first")
    new = f"{scratch}/new"
    attendances(spark, ("2021-05-10", "H2", "P1")).write.parquet(new)
    read = load_counts(spark, campaign, spark.read.schema(open_tables(spark, campaign)["attends"].schema).parquet(new)).inputFiles()
    assert any("/new/" in f for f in read)
    assert not any("/attends" in f for f in read)
    assert not any("/attends" in f for f in kept_vaccination_status(spark, campaign).inputFiles())


# ------------------------------------------------------------------ SQL text
def test_values_are_bound_and_no_view_is_left(spark):
    t = derived_tables(spark, SF)
    before = {x.name for x in spark.catalog.listTables()}
    evil = Params(ill_staff="S0' OR '1' = '1", doctor_role="x' OR ssno <> '")
    assert sql_text.ask(t, "t10_patients_met", evil).count() == 0
    assert sql_text.ask(t, "q2_doctors_on_day", evil).count() == 0
    assert {x.name for x in spark.catalog.listTables()} == before


@pytest.mark.parametrize("name", sorted(sql_text.TEXTS))
def test_sql_text_equals_the_report(spark, name):
    t = derived_tables(spark, SF)
    text, report = sql_text.ask(t, name), registry.TABLE_REPORTS[name](t)
    assert sorted(text.columns) == sorted(report.columns)
    assert rows_of(text.select(*report.columns)) == rows_of(report)


def test_sql_text_edges(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", None, None, None, 0)]
    r["attends"] = [(d("2021-05-10"), "H1", "P1"), (d("2021-05-03"), "H2", "P1"), (None, None, "P1")]
    r["diagnosis"] = [("P1", "fever", d("2021-05-10")), ("P2", "rash", None), (None, "rash", d("2021-05-11"))]
    r["transportationlog"] = []
    for t in (make_tables(spark, **r), make_tables(spark)):
        for name in sql_text.TEXTS:
            report = registry.TABLE_REPORTS[name](t)
            assert rows_of(sql_text.ask(t, name).select(*report.columns)) == rows_of(report), name


# ------------------------------------------------------------------ order
def campaign_tables(spark):
    r = base_rows()
    r["batch"] = [*r["batch"], ("B3", None, "M1", None, "H3", None)]
    r["batch"][0] = ("B1", None, "M1", d("2021-01-01"), "H1", d("2022-01-01"))
    r["patient"] = [(f"P{i}", "a", None, "F", 0) for i in (3, 1, 2)]
    r["attends"] = [
        (None, "H9", "P1"), (d("2021-05-10"), "H1", "P1"), (d("2021-05-10"), "H2", "P2"),
        (d("2021-05-03"), "H2", "P2"), (d("2021-05-03"), "H1", "P3"),
    ]
    r["diagnosis"] = [
        ("P2", "fever", d("2021-05-11")), ("P1", "rash", d("2021-02-05")), ("P1", "fever", d("2020-11-05")), ("P3", "rash", d("2021-11-05")),
    ]
    return make_tables(spark, **r)


def test_o1_running_total_comes_in_date_order(spark):
    got = [(r.day, r.cumulative) for r in T.t9_cumulative_vaccinated(campaign_tables(spark)).collect()]
    assert got == [("2021-05-03", 2), ("2021-05-10", 4)]


def test_o2_null_sums_come_first(spark):
    got = [tuple(r) for r in V.v4_doses_per_manufacturer(campaign_tables(spark)).collect()]
    assert got == [(None, "M1"), (20, "M2")]


def test_o3_a_dose_without_a_date_comes_last(spark):
    got = {r[0]: tuple(r)[1:] for r in T.t2_first_two_doses(campaign_tables(spark)).collect()}
    assert got["P1"] == (d("2021-05-10"), "One", None, None)
    assert got["P2"] == (d("2021-05-03"), "Two", d("2021-05-10"), "Two")


def test_o5_symptoms_come_in_calendar_order(spark):
    got = [(r.month_no, r.criticality) for r in V.v6_symptoms_by_month(campaign_tables(spark)).collect()]
    assert got == [(2, "Critical"), (5, "Non-Critical"), (11, "Critical"), (11, "Non-Critical")]


def test_o7_index_follows_patient_symptom_and_date(spark):
    rows = T.t1_patient_symptoms_indexed(campaign_tables(spark)).collect()
    by_index = [tuple(r[c] for c in ("ssNO", "symptom", "diagnosisDate")) for r in sorted(rows, key=lambda r: r["index"])]
    assert by_index == sorted(by_index)
    assert [r["index"] for r in sorted(rows, key=lambda r: r["index"])] == list(range(len(rows)))


# ------------------------------------------------------------------ words
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_finer_words_show_all_four(spark, sf):
    rows = T.t7e_symptom_vaccine_words_fine(derived_tables(spark, f"/root/testdata/sf{sf}")).collect()
    assert {w for r in rows for w in tuple(r)[1:]} == {"very common", "common", "rare", "-"}
    assert {r["V9"] for r in rows} == {"-"}
