"""Workbook ingest, audits, storage and the streaming append on a hand-made
dirty export."""

from __future__ import annotations

import csv
import os

import pytest

from conftest import d, rows_of
from inocula.operators import audit_summary, violations
from inocula.sources.store import AuditFailed, current_folders, load_tables, read_tables, with_row_index
from inocula.sources.workbook import clean_sheet, ingest_workbook, read_sheet, unreadable_dates
from inocula.streaming import sheet_stream

SHEETS = {
    "VaccineType": (["ID", "name", "doses", "tempMin", "tempMax"], [["V01", "Alpha", "2", "-80", "-60"]]),
    "Manufacturer": (["ID", "country", "phone", "vaccine"], [["M1", "FI", "09-1", "V01"]]),
    "VaccinationStations": (["name", "address", "phone"], [["H1", "Street 1", "040-1"], ["H2", "Street 2", "040-2"]]),
    "VaccineBatch": (
        ["batchID", "amount", "type", "manufacturer", "manufDate", "expiration", "location"],
        [["B01 ", "10", "V01", "M1", "2021-01-01", "2022-01-01", "H1"]],
    ),
    "StaffMembers": (
        ["social security number", "name", "date of birth", "phone", "role", "vaccination status", "hospital"],
        [["S1", "Ann", "1980-01-01", "041-1", "nurse", "1", "H1"]],
    ),
    "Shifts": (["station", "weekday", "worker"], [["H1", "Monday", "S1"], ["H1", "Funday", "S1"]]),
    "Transportation log": (
        ["batchID", "arrival", "departure ", "dateArr", "dateDep"],
        [["B01", "H1", "H2", "2021-02-02", "2021-02-01"]],
    ),
    "Patients": (["ssNo", "name", "date of birth", "gender"], [["P1", "Pat", "1990-01-01", "F"]]),
    "Vaccinations": (["date", "location ", "batchID"], [["2021-05-03", "H1", "B01"], ["2021-05-04", "H1", "B01"], ["2021-05-05", "H1", "B01"]]),
    "VaccinePatients": (
        ["patientSsNo", "location", "date"],
        [["P1", "H1", "2021-05-03"], ["P1", "H1", "2021-05-04"], ["P1", "H1", "2021-05-05"], ["P9", "H1", "2021-05-03"]],
    ),
    "Symptoms": (["name", "criticality"], [["fever", "0"], ["rash", "1"]]),
    "Diagnosis": (
        ["patient", "symptom", "date", "Unnamed: 3"],
        [["P1", "fever", "2021-02-29", ""], ["P1", "rash", "", ""], ["P1", "rash", "2021-05-06", ""]],
    ),
}


def write_export(root, sheets=SHEETS):
    for sheet, (header, rows) in sheets.items():
        os.makedirs(os.path.join(root, sheet), exist_ok=True)
        with open(os.path.join(root, sheet, "part-0.csv"), "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(header)
            w.writerows(rows)
    return root


def test_ingest_cleans_every_sheet(spark, scratch):
    t = ingest_workbook(spark, write_export(scratch))
    assert rows_of(t["vaccine"]) == [("V01", "Alpha", 2, -80, -60)]
    # trailing blank on a char(n) key trimmed, 'type' dropped, renamed
    assert rows_of(t["batch"]) == [("B01", 10, "M1", d("2021-01-01"), "H1", d("2022-01-01"))]
    assert t["batch"].columns == ["id", "numberofvaccines", "manufacturerid", "manufactureddate", "healthcarefacilityname", "expirydate"]
    # header with trailing blank renamed
    assert rows_of(t["transportationlog"]) == [("B01", "H2", "H1", d("2021-02-01"), d("2021-02-02"))]
    assert rows_of(t["vaccination"])[0] == (d("2021-05-03"), "H1", "B01")
    # unknown weekday -> NULL
    assert rows_of(t["shift"]) == [(1, "S1"), (None, "S1")]
    # impossible and missing dates repaired, filler column dropped
    assert t["diagnosis"].columns == ["ssno", "symptom", "date"]
    assert rows_of(t["diagnosis"]) == [
        ("P1", "fever", d("2021-02-28")),
        ("P1", "rash", d("2021-02-28")),
        ("P1", "rash", d("2021-05-06")),
    ]
    # status = attendances; an attendee missing from the sheet becomes a patient
    assert rows_of(t["patient"]) == [("P1", "Pat", d("1990-01-01"), "F", 3), ("P9", None, None, None, 1)]


def test_audits_find_planted_violations(spark, scratch):
    t = ingest_workbook(spark, write_export(scratch))
    v = violations(t, "patient")
    # three attendances break the 0..2 status check
    assert rows_of(v[("check", "vaccinationstatus")].select("ssno")) == [("P1",)]
    # the attendee-made patient row keeps the attends -> patient key valid
    assert violations(t, "attends")[("foreign_key", "ssno->patient")].count() == 0
    assert rows_of(violations(t, "diagnosis")[("primary_key_duplicate", "ssno,symptom,date")]) == []
    summary = {(r.table, r.rule, r.detail): r.violations for r in audit_summary(t).collect()}
    assert summary[("patient", "check", "vaccinationstatus")] == 1
    assert summary[("shift", "primary_key_null", "workday,ssno")] == 1
    assert summary[("batch", "length", "id<=4")] == 0
    # duplicate key, orphan, out-of-range and over-long values on a second load
    bad = dict(t)
    bad["vaccine"] = t["vaccine"].unionByName(t["vaccine"])
    bad["manufacturer"] = spark.createDataFrame([("M1", "1", "FI", "V99"), ("M2222", "1", "FI", None)], t["manufacturer"].schema)
    s2 = {(r.table, r.rule, r.detail): r.violations for r in audit_summary(bad, ["vaccine", "manufacturer"]).collect()}
    assert s2[("vaccine", "primary_key_duplicate", "id")] == 1
    assert s2[("manufacturer", "foreign_key", "vaccineid->vaccine")] == 1  # NULL reference passes
    assert s2[("manufacturer", "length", "id<=3")] == 1


def test_unreadable_dates_report(spark, scratch):
    raw = read_sheet(spark, write_export(scratch), "Diagnosis")
    got = rows_of(unreadable_dates(raw))
    assert got == [("P1", "fever", "2021-02-29"), ("P1", "rash", None)]


def test_load_refuses_violations_then_round_trips(spark, scratch):
    t = ingest_workbook(spark, write_export(os.path.join(scratch, "x")))
    with pytest.raises(AuditFailed):
        load_tables(t, os.path.join(scratch, "db"))
    assert current_folders(spark, os.path.join(scratch, "db")) == {}
    assert os.listdir(os.path.join(scratch, "db", "_loads"))  # kept for inspection
    clean = dict(t)
    clean["patient"] = t["patient"].selectExpr("ssno", "name", "birthday", "gender", "least(vaccinationstatus, 2) AS vaccinationstatus")
    clean["shift"] = t["shift"].where("workday IS NOT NULL")
    load_tables(clean, os.path.join(scratch, "db"))
    back = read_tables(spark, os.path.join(scratch, "db"))
    for name, df in clean.items():
        assert rows_of(back[name]) == rows_of(df), name
    # appending the same rows again breaks the keys across loads
    with pytest.raises(AuditFailed, match="primary_key_duplicate"):
        load_tables({"vaccine": clean["vaccine"]}, os.path.join(scratch, "db"))
    # a partial load is checked against the parents already stored
    orphan = spark.createDataFrame([(d("2021-05-03"), "H1", "P404")], clean["attends"].schema)
    with pytest.raises(AuditFailed, match="ssno->patient"):
        load_tables({"attends": orphan}, os.path.join(scratch, "db"))
    more = spark.createDataFrame([("V02", "Beta", 1, -20, -10)], clean["vaccine"].schema)
    load_tables({"vaccine": more}, os.path.join(scratch, "db"))
    assert rows_of(read_tables(spark, os.path.join(scratch, "db"), ["vaccine"])["vaccine"]) == [
        ("V01", "Alpha", 2, -80, -60),
        ("V02", "Beta", 1, -20, -10),
    ]


def test_row_index_is_contiguous_across_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("id * 3 AS v")
    got = with_row_index(df).collect()
    assert sorted(r["index"] for r in got) == list(range(1000))
    assert sorted(r.v for r in got) == [i * 3 for i in range(1000)]


def test_streaming_append_is_exactly_once(spark, scratch):
    root = os.path.join(scratch, "export")
    header, rows = SHEETS["Shifts"]
    write_export(root, {"Shifts": (header, rows)})
    db = os.path.join(scratch, "db")
    ckpt = os.path.join(scratch, "ckpt")
    q = sheet_stream(spark, root, "Shifts", header, db, checkpoint=ckpt)
    q.awaitTermination(120)
    # a new export file arrives; a second run appends only it
    with open(os.path.join(root, "Shifts", "part-1.csv"), "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerow(["H1", "Sunday", "S2"])
    q = sheet_stream(spark, root, "Shifts", header, db, checkpoint=ckpt)
    q.awaitTermination(120)
    got = rows_of(read_tables(spark, db, ["shift"])["shift"])
    assert got == [(1, "S1"), (7, "S2"), (None, "S1")]
    # a batch load into the same table stays visible next to the streamed rows
    load_tables({"shift": spark.createDataFrame([(3, "S3")], "workday int, ssno string")}, db, audit=False)
    got = rows_of(read_tables(spark, db, ["shift"])["shift"])
    assert got == [(1, "S1"), (3, "S3"), (7, "S2"), (None, "S1")]
    # an overwrite replaces streamed rows too, and its audit sees what will be read
    load_tables({"shift": spark.createDataFrame([(3, "S3")], "workday int, ssno string")}, db, mode="overwrite", audit=False)
    assert rows_of(read_tables(spark, db, ["shift"])["shift"]) == [(3, "S3")]
    with pytest.raises(ValueError):
        sheet_stream(spark, root, "Patients", ["ssNo"], db)


def test_another_column_order_is_refused(spark, scratch):
    write_export(scratch, {"Symptoms": SHEETS["Symptoms"]})
    with open(os.path.join(scratch, "Symptoms", "part-1.csv"), "w", newline="") as f:
        csv.writer(f).writerows([["criticality", "name"], ["0", "chills"]])
    with pytest.raises(Exception, match="(?i)header"):
        read_sheet(spark, scratch, "Symptoms").collect()


def test_bad_rows_end_the_read_and_quoted_breaks_do_not(spark, scratch):
    header, rows = SHEETS["Symptoms"]
    write_export(os.path.join(scratch, "a"), {"Symptoms": (header, [*rows, ["a\nb", "1"]])})
    assert read_sheet(spark, os.path.join(scratch, "a"), "Symptoms").count() == 3
    write_export(os.path.join(scratch, "b"), {"Symptoms": (header, [*rows, ["x", "1", "2"]])})
    with pytest.raises(Exception, match="(?i)malformed"):
        read_sheet(spark, os.path.join(scratch, "b"), "Symptoms").collect()


def test_whole_numbers_only(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1.0"), ("c", "1.7"), ("d", "x"), ("e", " -2 ")], "name string, criticality string")
    assert [r[1] for r in rows_of(clean_sheet("Symptoms", df))] == [1, 1, None, None, -2]


def test_a_date_is_repaired_exactly_when_it_is_listed(spark):
    dates = ["2021-05-10", "2021-05-10 00:00:00", "2021-02-29", "2021-02-29 01:00:00", None, "", "10.5.2021", " 2021-05-11 "]
    df = spark.createDataFrame([(str(i), "rash", x) for i, x in enumerate(dates)], "patient string, symptom string, date string")
    repaired = {r.ssno for r in clean_sheet("Diagnosis", df).collect() if r.date == d("2021-02-28")}
    assert repaired == {r.patient for r in unreadable_dates(df).collect()} == {"2", "3", "4", "5", "6"}


def test_clean_sheet_missing_column_is_null(spark):
    df = spark.createDataFrame([("fever",)], "name string")
    assert rows_of(clean_sheet("Symptoms", df)) == [("fever", None)]


def test_date_partitioned_fact_table_prunes(spark, scratch):
    from conftest import base_rows, make_tables
    from inocula.plans.catalogue import q4_critical_after
    from inocula.plans.params import Params

    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0)]
    r["diagnosis"] = [("P1", "rash", d("2021-05-09")), ("P1", "rash", d("2021-05-11")), ("P1", "fever", d("2021-05-12"))]
    t = make_tables(spark, **r)
    db = os.path.join(scratch, "db")
    parts = {"diagnosis": ["date"], "vaccination": ["date"]}
    load_tables(t, db, mode="overwrite", audit=True, ignore=(), partition_by=parts)
    # a second append of new days lands in new partition folders
    more = spark.createDataFrame([("P1", "fever", d("2021-05-13"))], t["diagnosis"].schema)
    load_tables({"diagnosis": more, "patient": spark.createDataFrame([], t["patient"].schema)}, db, partition_by=parts)
    back = read_tables(spark, db)
    assert back["diagnosis"].columns == ["ssno", "symptom", "date"]
    assert len(back["diagnosis"].collect()) == 4
    folders = current_folders(spark, db)["diagnosis"]
    assert any(n.startswith("date=2021-05-13") for f in folders for n in os.listdir(f))
    q4 = q4_critical_after(back, Params(diagnosed_after="2021-05-10"))
    assert rows_of(q4.select("date")) == [(d("2021-05-11"),)]
    plan = q4._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_command_line_ingest_audit_report(spark, scratch):
    from inocula.__main__ import main

    export = write_export(os.path.join(scratch, "export"))
    store = os.path.join(scratch, "store")
    # the export plants a status-3 patient (CHECK) and a NULL workday (key):
    # the load is refused until those rule kinds are let through
    with pytest.raises(AuditFailed):
        main(["ingest", "--export", export, "--store", store])
    assert main(["ingest", "--export", export, "--store", store, "--ignore", "check,primary_key_null", "--partition-dates"]) == 0
    assert main(["audit", "--store", store, "--out", os.path.join(scratch, "audit")]) == 0
    audit = {(r.table, r.rule): r.violations for r in spark.read.parquet(os.path.join(scratch, "audit")).collect()}
    assert audit[("patient", "check")] == 1
    out = os.path.join(scratch, "out")
    args = ["report", "--store", store, "--out", out, "--names", "q5_vaccination_status,t9_cumulative_vaccinated,q1_staff_on_duty"]
    with pytest.raises(SystemExit, match="event_workday"):
        main(args + ["--set", "event_date=2021-05-03"])
    assert main(args + ["--set", "event_date=2021-05-03", "--set", "event_workday=1"]) == 0
    assert rows_of(spark.read.parquet(os.path.join(out, "q5_vaccination_status")).select("ssno", "vaccinationstatus")) == [
        ("P1", 1),  # three doses of a two-dose vaccine
        ("P9", 0),  # one dose
    ]
    assert spark.read.parquet(os.path.join(out, "t9_cumulative_vaccinated")).count() == 3
