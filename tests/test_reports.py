"""Reports on hand-made campaign rows: the edge cases each report must keep."""

from __future__ import annotations

import pytest

from conftest import base_rows, d, make_tables, rows_of
from inocula.plans import catalogue as C
from inocula.plans import charts as V
from inocula.plans import tasks as T
from inocula.plans.params import Params

P = Params(
    event_date="2021-05-10",
    facilities=("H1", "H2"),
    diagnosed_after="2021-05-10",
    ill_staff="S1",
    range_start="2021-05-05",
    range_end="2021-05-15",
)


def test_q1_distinct_staff_on_event_day(spark):
    r = base_rows()
    r["staff"] = [
        ("S1", "Ann", d("1980-01-01"), "041-1", "nurse", 1, "H1"),
        ("S2", "Bob", d("1980-01-01"), "041-2", "doctor", 0, "H3"),  # no event at H3
    ]
    r["shift"] = [(1, "S1"), (2, "S1"), (1, "S2")]
    got = rows_of(C.q1_staff_on_duty(make_tables(spark, **r), P))
    assert got == [("S1", "Ann", "041-1", "nurse", 1, "H1")]


def test_q3_ties_kept_missing_logs_and_null_destination_dropped(spark):
    r = base_rows()
    r["batch"].append(("B3", 5, "M1", d("2021-01-01"), "H1", d("2022-01-01")))  # no log
    r["transportationlog"] = [
        ("B1", "H2", "H1", d("2021-02-01"), d("2021-02-02")),
        ("B1", "H3", "H2", d("2021-02-01"), d("2021-02-02")),  # tie on latest arrival
        ("B1", "H2", "H3", d("2021-01-01"), d("2021-01-02")),
        ("B2", "H1", None, d("2021-02-01"), d("2021-02-05")),  # latest has no destination
        ("B2", "H1", "H2", d("2021-01-01"), d("2021-01-03")),
    ]
    got = rows_of(C.q3_batch_locations(make_tables(spark, **r)))
    assert got == [("B1", "H1", "H1", ""), ("B1", "H1", "H2", "040-1")]


def test_q4_strictly_after(spark):
    r = base_rows()
    r["patient"] = [("P1", "Pat", d("1990-01-01"), "F", 0)]
    r["diagnosis"] = [("P1", "rash", d("2021-05-10")), ("P1", "rash", d("2021-05-11")), ("P1", "fever", d("2021-05-12"))]
    got = rows_of(C.q4_critical_after(make_tables(spark, **r), P))
    assert got == [("P1", "Pat", d("1990-01-01"), "F", 0, "rash", d("2021-05-11"), 1)]


def test_q5_no_attendance_and_mixed_dosage(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", "b", None, "M", 0), ("P3", "c", None, "M", 0)]
    r["attends"] = [
        (d("2021-05-03"), "H1", "P2"),  # V1 (dosage 1)
        (d("2021-05-03"), "H2", "P3"),  # V2 (dosage 2)
        (d("2021-05-10"), "H2", "P3"),  # V2
        (d("2021-05-10"), "H2", "P2"),  # V2 -> P2 spans two dosages
    ]
    got = rows_of(C.q5_vaccination_status(make_tables(spark, **r)).select("ssno", "vaccinationstatus"))
    assert got == [("P1", 0), ("P2", 0), ("P2", 1), ("P3", 1)]


def test_q6_facility_without_batches(spark):
    got = {r.facility_name: (r.total_vaccines, r.different_types) for r in C.q6_facility_stock(make_tables(spark, **base_rows())).collect()}
    assert got == {"H1": (10, 1), "H2": (20, 1), "H3": (None, 0)}


def test_q7_counts_each_prior_attendance_t7a_once(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 2)]
    r["attends"] = [(d("2021-05-03"), "H1", "P1"), (d("2021-05-10"), "H1", "P1")]
    r["diagnosis"] = [("P1", "fever", d("2021-05-11")), ("P1", "rash", d("2021-05-05"))]
    t = make_tables(spark, **r)
    q7 = rows_of(C.q7_symptom_frequency(t))
    assert q7 == [("V1", "fever", 2, 200.0 / 3), ("V1", "rash", 1, 100.0 / 3)]
    t7a = rows_of(T.t7a_vaccine_per_diagnosis(t))
    assert t7a == [("P1", "fever", d("2021-05-11"), "V1"), ("P1", "rash", d("2021-05-05"), "V1")]
    assert rows_of(C.q7b_symptom_frequency_per_catalogue(t)) == [("V1", "fever", 2, 1.0), ("V1", "rash", 1, 0.5)]


def test_t2_all_patients_and_same_day_tie_break(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", "b", None, "M", 0)]
    r["attends"] = [(d("2021-05-10"), "H2", "P1"), (d("2021-05-10"), "H1", "P1"), (d("2021-05-03"), "H2", "P1")]
    got = rows_of(T.t2_first_two_doses(make_tables(spark, **r)))
    assert got == [
        ("P1", d("2021-05-03"), "Two", d("2021-05-10"), "One"),
        ("P2", None, None, None, None),
    ]


def test_t3_top_symptoms_text(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", "b", None, "M", 0)]
    r["diagnosis"] = [
        ("P1", "rash", d("2021-01-01")),
        ("P1", "rash", d("2021-01-02")),
        ("P1", "fever", d("2021-01-01")),
        ("P2", "fever", d("2021-01-01")),
    ]
    got = rows_of(T.t3_top_symptoms_text(make_tables(spark, **r)))
    assert got == [("F", "rash, fever."), ("M", "fever.")]


def test_t6_null_status_in_divisor_not_a_row(spark):
    r = base_rows()
    r["patient"] = [
        ("P1", "a", d("2015-01-01"), "F", 1),
        ("P2", "b", d("2015-01-01"), "F", None),
        ("P3", "c", d("2015-01-01"), "F", 1),
        ("P4", "d", d("1950-01-01"), "F", 0),
    ]
    t = make_tables(spark, **r)
    long = rows_of(T.t6_status_share_long(t, P))
    assert long == [("0-10", 1, 2.0 / 3), ("60+", 0, 1.0)]
    wide = {r_[0]: tuple(r_[1:]) for r_ in rows_of(T.t6_status_share(t, P))}
    assert wide == {0: (None, None, None, None, 1.0), 1: (2.0 / 3, None, None, None, None)}


TWO = Params(vaccines=("V1", "V2"))


@pytest.mark.parametrize("n", [65, 1200])
def test_any_number_of_vaccines(spark, n):
    """One plan and no read at build time, whatever the number of vaccines."""
    from inocula.plans import catalogue as C

    r = base_rows()
    r["vaccine"] = [(f"V{i}", f"N{i}", 1, 0, 0) for i in range(n)]
    r["manufacturer"] = [(f"M{i}", "1", "FI", f"V{i}") for i in range(n + 1)]  # the last vaccine is in no catalogue
    r["batch"] = [(f"B{i}", 1, f"M{i}", d("2021-01-01"), "H1", d("2022-01-01")) for i in range(n + 1)]
    r["healthcarefacility"] = [(f"H{i}", "a", "1") for i in range(n + 1)]
    r["vaccination"] = [(d("2021-05-03"), f"H{i}", f"B{i}") for i in range(n + 1)]
    r["patient"] = [(f"P{i}", "a", None, "F", 0) for i in range(n + 1)]
    r["attends"] = [(d("2021-05-03"), f"H{i}", f"P{i}") for i in range(n + 1)]
    r["diagnosis"] = [(f"P{i}", "rash", d("2021-05-04")) for i in range(n + 1)]
    t = make_tables(spark, **r)
    assert C.q7_symptom_frequency(t).count() == n
    assert C.q7b_symptom_frequency_per_catalogue(t).count() == n
    assert T.t7_symptom_vaccine_long(t).count() == n + 1
    row = T.t7c_symptom_vaccine_counts(t, TWO).first()
    assert (row["V1"], row["V2"], row["other"]) == (1, 1, n - 1)
    with pytest.raises(Exception, match="outside the list"):
        T.t7d_symptom_vaccine_rates(t, TWO).collect()


def test_t7c_to_t7e_absent_cells(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", "b", None, "M", 0)]
    r["attends"] = [(d("2021-05-03"), "H1", "P1"), (d("2021-05-03"), "H2", "P2"), (d("2021-05-10"), "H2", "P1")]
    r["diagnosis"] = [("P1", "fever", d("2021-05-04")), ("P2", "rash", d("2021-05-04"))]
    t = make_tables(spark, **r)
    assert rows_of(T.t7c_symptom_vaccine_counts(t, TWO).drop("other")) == [("fever", 1, 0), ("rash", 0, 1)]
    # V1 has 1 dose, V2 has 2
    assert rows_of(T.t7d_symptom_vaccine_rates(t, TWO)) == [("fever", 1.0, 0.0), ("rash", 0.0, 0.5)]
    assert rows_of(T.t7e_symptom_vaccine_words(t, TWO)) == [("fever", "very common", "-"), ("rash", "-", "very common")]


def test_t8b_single_event_std_is_null(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", "b", None, "F", 0)]
    r["attends"] = [(d("2021-05-03"), "H1", "P1")]
    t = make_tables(spark, **r)
    assert rows_of(T.t8a_event_attendance(t)) == [(d("2021-05-03"), "H1", 50.0)]
    assert rows_of(T.t8b_dose_reserve(t)) == [(d("2021-05-03"), "H1", None)]


def test_t9_running_total_ends_at_attendance_count(spark):
    r = base_rows()
    r["attends"] = [(d("2021-05-03"), "H1", "P1"), (d("2021-05-03"), "H2", "P2"), (d("2021-05-10"), "H1", "P3")]
    got = rows_of(T.t9_cumulative_vaccinated(make_tables(spark, **r)))
    assert got == [(d("2021-05-03"), "2021-05-03", 2, 2), (d("2021-05-10"), "2021-05-10", 1, 3)]


def test_t10_range_exclusive_and_weekday(spark):
    r = base_rows()
    r["vaccination"] += [
        (d("2021-05-05"), "H1", "B1"),  # range start: excluded
        (d("2021-05-15"), "H1", "B1"),  # range end: excluded
        (d("2021-05-09"), "H1", "B1"),  # Sunday
    ]
    r["staff"] = [
        ("S1", "Ill", None, "", "doctor", 1, "H1"),
        ("S2", "Mon", None, "", "nurse", 1, "H1"),
        ("S3", "Sun", None, "", "nurse", 1, "H1"),
        ("S4", "Other", None, "", "nurse", 1, "H2"),
    ]
    r["shift"] = [(1, "S1"), (7, "S1"), (1, "S2"), (7, "S3"), (1, "S4")]
    r["patient"] = [("P1", "a", None, "F", 0), ("P2", "b", None, "F", 0)]
    r["attends"] = [(d("2021-05-10"), "H1", "P1"), (d("2021-05-05"), "H1", "P2"), (d("2021-05-10"), "H2", "P2")]
    t = make_tables(spark, **r)
    staff = rows_of(T.t10_staff_met(t, P))
    # Monday 2021-05-10 and Sunday 2021-05-09 events at H1, within the range
    assert staff == [("S1", "Ill"), ("S1", "Ill"), ("S2", "Mon"), ("S3", "Sun")]
    assert rows_of(T.t10_patients_met(t, P)) == [("P1", "a")]
    assert len(T.t10_contacts(t, P).collect()) == 5


def test_v2_v3_v4_v5_v6(spark):
    r = base_rows()
    r["attends"] = [(d("2021-05-03"), "H1", "P1")]
    r["diagnosis"] = [("P1", "fever", d("2021-07-03")), ("P2", "rash", d("2021-01-03")), ("P2", "rash", d("2022-01-09"))]
    r["staff"] = [
        ("S1", "a", None, "", "nurse", 1, "H1"),
        ("S2", "b", None, "", "nurse", None, "H1"),
        ("S3", "c", None, "", "nurse", 0, "H2"),
    ]
    r["batch"].append(("B9", None, "M2", None, "H3", None))
    r["manufacturer"].append(("M3", "3", "NO", "V1"))
    r["batch"].append(("B8", None, "M3", None, "H3", None))
    t = make_tables(spark, **r)
    assert rows_of(V.v2_diagnoses_without_attendance(t)) == [("P2", "rash", d("2021-01-03")), ("P2", "rash", d("2022-01-09"))]
    assert rows_of(V.v3_staff_vaccinated_by_facility(t)) == [("H1", None, 1), ("H2", 1, None)]
    v4 = [tuple(x) for x in V.v4_doses_per_manufacturer(t).collect()]
    assert v4[0] == (None, "M3") and v4[1:] == [(20, "M2"), (10, "M1")]
    assert rows_of(V.v5_patients_per_facility(t)) == [("H1", 1, 100.0)]
    assert rows_of(V.v6_symptoms_by_month(t)) == [(1, "January", "Critical", 2), (7, "July", "Non-Critical", 1)]


def test_q5_as_named_view(spark):
    r = base_rows()
    r["patient"] = [("P1", "a", None, "F", 0)]
    r["attends"] = [(d("2021-05-03"), "H1", "P1")]
    C.register_vaccination_status_view(make_tables(spark, **r))
    got = rows_of(spark.sql("SELECT ssno, vaccinationstatus FROM vaccination_status_view"))
    assert got == [("P1", 1)]
    assert rows_of(spark.table("vaccination_status_view").select("ssno")) == [("P1",)]


def test_sql_over_registered_views(spark):
    """Tables registered as views answer plain SQL (here the doctors-on-a-
    weekday and stock-per-facility reports) with the DataFrame plans' rows."""
    from inocula.sources.store import register_views

    r = base_rows()
    r["staff"] = [
        ("S1", "Ann", None, "", "doctor", 1, "H1"),
        ("S2", "Bob", None, "", "nurse", 1, "H1"),
        ("S3", "Cid", None, "", "doctor", 1, "H3"),
    ]
    r["shift"] = [(3, "S1"), (3, "S2"), (3, "S3"), (1, "S1")]
    t = make_tables(spark, **r)
    register_views(t)
    q2 = spark.sql(
        """SELECT DISTINCT s.ssno, s.name, s.role, s.healthcarefacilityname
           FROM staff s, shift w
           WHERE w.ssno = s.ssno AND w.workday = 3 AND s.role = 'doctor'
             AND s.healthcarefacilityname IN ('H1', 'H2')"""
    )
    assert rows_of(q2) == rows_of(C.q2_doctors_on_day(t, P)) == [("S1", "Ann", "doctor", "H1")]
    q6 = spark.sql(
        """WITH stock AS (
             SELECT b.healthcarefacilityname AS f, b.numberofvaccines AS n, v.id AS kind
             FROM batch b LEFT JOIN manufacturer m ON m.id = b.manufacturerid
             LEFT JOIN vaccine v ON v.id = m.vaccineid)
           SELECT h.name AS facility_name, SUM(s.n) AS total_vaccines, COUNT(DISTINCT s.kind) AS different_types
           FROM healthcarefacility h LEFT JOIN stock s ON s.f = h.name GROUP BY h.name"""
    )
    assert rows_of(q6) == rows_of(C.q6_facility_stock(t))
