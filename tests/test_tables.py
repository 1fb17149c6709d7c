"""Catalogue tables, key checks at append, prefix sums, bitmaps, rejected rows."""

from __future__ import annotations

import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from inocula.operators import distinct_bitmaps, distinct_counts, key_filter, number_values, possibly_in, prefix_sum, roll_up
from inocula.plans import catalogue, tasks
from inocula.plans.loading import DOSE_TABLES
from inocula.sources.derived import derived_tables
from inocula.sources.tables import READ_CONF, KeysViolated, append_rows, append_violations, create_tables, open_tables, replace_rows
from inocula.sources.workbook import read_sheet_rows

from conftest import base_rows, d, make_tables


def exchanges_above(plan: str, scan: str) -> list[str]:
    """Exchanges between a table's scan and the root, from the printed tree."""
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    found = []
    for at, line in enumerate(lines):
        if f".{scan}[" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :|+-*"))
        for above in reversed(lines[:at]):
            own = len(above) - len(above.lstrip(" :|+-*"))
            if own < depth:
                depth = own
                if re.search(r"(?<!Broadcast)Exchange (hash|range|Single)", above):
                    found.append(above.strip())
    return found


@pytest.fixture()
def database(spark, scratch):
    name = f"t_{uuid.uuid4().hex}"
    return name, f"{scratch}/tables"


def test_facts_bucketed_by_person_are_not_shuffled(spark, database):
    name, root = database
    create_tables(spark, name, root, buckets=4)
    t = derived_tables(spark, "/root/testdata/sf0.001")
    for n in [*DOSE_TABLES, "patient", "symptoms", "diagnosis"]:
        replace_rows(spark, name, n, t[n])
    own = open_tables(spark, name)
    limits = {k: "4k" for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    before = {k: spark.conf.get(k, None) for k in [*READ_CONF, *limits]}
    try:
        for k, v in {**READ_CONF, **limits}.items():
            spark.conf.set(k, v)
        for report, results in ((catalogue.q5_vaccination_status, 0), (catalogue.q7_symptom_frequency, 2), (tasks.t7a_vaccine_per_diagnosis, 0)):
            df = report(own)
            rows = df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            for fact in ("attends", "diagnosis", "patient"):
                # what is left groups the counted result by its labels; no exchange deals out rows by person
                left = exchanges_above(plan, fact)
                assert all(re.search(r"hashpartitioning\((_el|id)#", x) for x in left), (report.__name__, fact, left)
                assert results or not left, (report.__name__, fact, left)
            assert "Bucketed: true" in plan
            assert sorted(map(str, rows)) == sorted(map(str, report(t).collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_later_session_finds_the_rows(spark, database):
    name, root = database
    t = make_tables(spark, **base_rows())
    create_tables(spark, name, root)
    append_rows(spark, name, "vaccine", t["vaccine"])
    append_rows(spark, name, "vaccine", spark.createDataFrame([("V3", "Three", 1, 0, 0)], t["vaccine"].schema))
    again = create_tables(spark, f"{name}_again", root)
    assert sorted(r["id"] for r in again["vaccine"].collect()) == ["V1", "V2", "V3"]


def test_appends_that_break_keys_write_nothing(spark, database):
    name, root = database
    create_tables(spark, name, root)
    t = make_tables(spark, **base_rows(), patient=[("P1", "a", d("2000-01-01"), "F", 0)])
    for n in ("vaccine", "manufacturer", "healthcarefacility", "batch", "vaccination", "patient"):
        append_rows(spark, name, n, t[n])
    schema = t["attends"].schema
    order = schema.fieldNames()
    row = lambda **k: tuple(k[c] for c in order)
    day = d("2021-05-03")
    good = row(date=day, healthcarefacilityname="H1", ssno="P1")
    append_rows(spark, name, "attends", spark.createDataFrame([good], schema))
    bad = [good, row(date=day, healthcarefacilityname="H3", ssno="P9"), row(date=None, healthcarefacilityname="H2", ssno="P1")]
    bad += [row(date=day, healthcarefacilityname="H2", ssno="P1")] * 2
    found = {tuple(r) for r in append_violations(spark, name, "attends", spark.createDataFrame(bad, schema)).collect()}
    assert found == {
        ("primary_key", "2021-05-03|H1|P1"), ("primary_key", "NULL|H2|P1"), ("primary_key", "2021-05-03|H2|P1"),
        ("foreign_key(ssno)", "P9"), ("foreign_key(date,healthcarefacilityname)", "2021-05-03|H3"),
    }
    with pytest.raises(KeysViolated, match="primary_key=3"):
        append_rows(spark, name, "attends", spark.createDataFrame(bad, schema))
    assert open_tables(spark, name)["attends"].count() == 1


def test_partitions_are_replaced_one_by_one(spark, database):
    name, root = database
    create_tables(spark, name, root, bucket_by={}, partition_by={"diagnosis": ["symptom"]}, names=["diagnosis"])
    schema = open_tables(spark, name, ["diagnosis"])["diagnosis"].schema
    rows = [("P1", "fever", d("2021-01-01")), ("P2", "fever", d("2021-01-02")), ("P1", "rash", d("2021-01-03"))]
    replace_rows(spark, name, "diagnosis", spark.createDataFrame(rows, schema))
    replace_rows(spark, name, "diagnosis", spark.createDataFrame([("P3", "fever", d("2021-02-01"))], schema))
    left = open_tables(spark, name, ["diagnosis"])["diagnosis"].collect()
    assert sorted((r["ssno"], r["symptom"]) for r in left) == [("P1", "rash"), ("P3", "fever")]
    again = create_tables(spark, f"{name}_again", root, bucket_by={}, partition_by={"diagnosis": ["symptom"]}, names=["diagnosis"])
    assert again["diagnosis"].count() == 2


def test_the_filter_lets_matches_and_few_others_through(spark):
    many = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("_word"))
    some = spark.range(0, 400_000, 400).select(F.concat(F.lit("k"), "id").alias("k")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    left = possibly_in(many, ["k"], key_filter(some, ["k"]))
    assert left.columns == ["k", "_word"]
    got = {r["k"] for r in left.collect()}
    assert {f"k{i}" for i in range(0, 200_000, 400)} <= got
    assert len(got) < 500 + 0.03 * 200_000
    assert key_filter(some, ["k"], most=10) is None


def test_only_possible_matches_of_the_stored_rows_go_on(spark, database):
    name, root = database
    create_tables(spark, name, root, names=["patient"])
    stored = spark.range(50_000).select(F.concat(F.lit("P"), "id").alias("ssno"), F.lit("n").alias("name"), F.lit(None).cast("date").alias("birthday"), F.lit("F").alias("gender"), F.lit(0).alias("vaccinationstatus"))
    replace_rows(spark, name, "patient", stored)
    load = stored.where("ssno in ('P7', 'P8')")
    passed = possibly_in(open_tables(spark, name, ["patient"])["patient"].select("ssno"), ["ssno"], key_filter(load, ["ssno"]))
    assert 2 <= passed.count() < 2_500


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_prefix_sum_equals_the_window(spark, partitions):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), i, rng.choice([None, 1, -2, 5, 10**15])) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(5)
    got = prefix_sum(df, ["a", "b"], "v", partitions=partitions).collect()
    total, want = None, {}
    for a, b, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total = v if total is None else total + (v or 0)
        want[a, b] = total
    assert {(r["a"], r["b"]): r["cumulative"] for r in got} == want


def test_prefix_sum_has_no_single_task_over_rows(spark):
    df = prefix_sum(spark.range(10_000).withColumn("v", F.lit(1)), ["id"], "v")
    df.collect()
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert prefix_sum(spark.range(0).withColumn("v", F.lit(1)), ["id"], "v").count() == 0


def test_bitmaps_count_and_roll_up(spark):
    rng = random.Random(4)
    values = [None, *map(str, range(70_000))]
    rows = [(rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice(values)) for _ in range(90_000)]
    df = spark.createDataFrame(rows, "g string, h int, x string")
    fine = distinct_bitmaps(df, ["g", "h"], "x", number_values(df, "x"))
    want, coarse = {}, {}
    for g, h, x in rows:
        if x is not None:
            want.setdefault((g, h), set()).add(x)
            coarse.setdefault(g, set()).add(x)
    assert {(r["g"], r["h"]): r["distinct"] for r in distinct_counts(fine, ["g", "h"]).collect()} == {k: len(v) for k, v in want.items()}
    assert {r["g"]: r["distinct"] for r in distinct_counts(roll_up(fine, ["g"]), ["g"]).collect()} == {k: len(v) for k, v in coarse.items()}


def test_csv_rows_that_do_not_parse_come_back(spark, scratch):
    os.makedirs(f"{scratch}/Diagnosis")
    with open(f"{scratch}/Diagnosis/a.csv", "w", encoding="utf-8") as f:
        f.write('patient,symptom,date\n1,fever,2021-01-01\n2,fever\n3,rash,2021-01-02,more\n4,"a, b",2021-01-03\n')
    good, rejected = read_sheet_rows(spark, scratch, "Diagnosis")
    assert sorted(r["patient"] for r in good.collect()) == ["1", "4"]
    got = sorted((r["reason"], r["row"], r["file"].rsplit("/", 1)[-1]) for r in rejected.collect())
    assert got == [("too few fields", "2,fever", "a.csv"), ("too many fields", "3,rash,2021-01-02,more", "a.csv")]
    assert (good.count(), rejected.count()) == (2, 2)


def test_json_rows_that_do_not_parse_come_back(spark, scratch):
    os.makedirs(f"{scratch}/Diagnosis")
    with open(f"{scratch}/Diagnosis/a.json", "w", encoding="utf-8") as f:
        f.write('{"patient": 1, "symptom": "fever"}\n{"patient": 2, "symp\nnothing\n{"patient": "3", "date": "2021-01-01"}\n')
    good, rejected = read_sheet_rows(spark, scratch, "Diagnosis", "json")
    assert sorted(r["patient"] for r in good.collect()) == ["1", "3"]
    assert sorted(r["row"] for r in rejected.collect()) == ["nothing", '{"patient": 2, "symp']
    with pytest.raises(ValueError):
        read_sheet_rows(spark, scratch, "Diagnosis", "xlsx")
