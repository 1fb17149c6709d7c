"""Properties and independently known row counts on the derived testdata."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inocula.plans import catalogue as C
from inocula.plans import charts as V
from inocula.plans import tasks as T
from inocula.sources.derived import derived_tables

SF = "/root/testdata/sf0.001"

# Row counts stated in FIXTURES.md section 5 for sf0.001 (computed there by
# scratch runs of Spark and DuckDB, independently of this code).
EXPECTED = {
    "q1_staff_on_duty": (C.q1_staff_on_duty, 50),
    "q2_doctors_on_day": (C.q2_doctors_on_day, 10),
    "q4_critical_after": (C.q4_critical_after, 136),
    "q5_vaccination_status": (C.q5_vaccination_status, 225),
    "q6_facility_stock": (C.q6_facility_stock, 10),
    "q7_symptom_frequency": (C.q7_symptom_frequency, 75),
    "q7b_symptom_frequency_per_catalogue": (C.q7b_symptom_frequency_per_catalogue, 75),
    "t2_first_two_doses": (T.t2_first_two_doses, 150),
    "t3_top_symptoms": (T.t3_top_symptoms, 6),
    "t7b_doses_per_vaccine": (T.t7b_doses_per_vaccine, 5),
    "t8b_dose_reserve": (T.t8b_dose_reserve, 826),
    "t9_cumulative_vaccinated": (T.t9_cumulative_vaccinated, 83),
    "t10_staff_met": (T.t10_staff_met, 30),
    "t10_patients_met": (T.t10_patients_met, 130),
    "v2_diagnoses_without_attendance": (V.v2_diagnoses_without_attendance, 744),
    "v3_staff_vaccinated_by_facility": (V.v3_staff_vaccinated_by_facility, 10),
    "v4_doses_per_manufacturer": (V.v4_doses_per_manufacturer, 25),
    "v5_patients_per_facility": (V.v5_patients_per_facility, 10),
    "v6_symptoms_by_month": (V.v6_symptoms_by_month, 24),
}


@pytest.fixture(scope="module")
def t(spark):
    return derived_tables(spark, SF)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_row_counts_match_fixtures(t, name):
    fn, n = EXPECTED[name]
    assert fn(t).count() == n


def test_q3_split_of_places(t):
    q3 = C.q3_batch_locations(t)
    assert q3.where("phone != ''").count() == 181
    assert q3.where("phone = ''").count() == 19


def test_t7a_per_vaccine_symptom_and_t4_bands(t):
    assert T.t7a_vaccine_per_diagnosis(t).select("vaccine", "symptom").distinct().count() == 75


def test_q7_shares_sum_to_100_per_vaccine(t):
    sums = C.q7_symptom_frequency(t).groupBy("id").agg(F.sum("relative_frequency").alias("s")).collect()
    assert sums and all(abs(r.s - 100.0) < 1e-9 for r in sums)


def test_t6_shares_within_age_group_at_most_one(t):
    sums = T.t6_status_share_long(t).groupBy("ageGroup").agg(F.sum("frequency").alias("s")).collect()
    assert sums and all(r.s <= 1.0 + 1e-12 for r in sums)


def test_t9_ends_at_attendance_total(t):
    last = T.t9_cumulative_vaccinated(t).orderBy(F.desc("date")).first()
    joined = t["attends"].join(t["vaccination"], ["date", "healthcarefacilityname"]).count()
    assert last.cumulative == joined


def test_q7_frequency_equals_pair_count(t):
    # the pair-free count equals the plain pair join on this data
    a = t["attends"].join(t["vaccination"], ["date", "healthcarefacilityname"])
    d = t["diagnosis"]
    pairs = d.alias("d").join(a.alias("a"), (F.col("d.ssno") == F.col("a.ssno")) & (F.col("d.date") >= F.col("a.date")))
    total = C.q7_symptom_frequency(t).agg(F.sum("frequency")).first()[0]
    assert total == pairs.count()


def test_lazy_tables_build_on_access(spark):
    t = derived_tables(spark, SF)
    assert "batch" in t and len(t) == 12 and "nothing" not in t
    assert dict.__len__(t) == 0  # nothing built yet
    assert t.get("batch") is t["batch"] and t.get("nothing") is None
    assert dict.__len__(t) == 1
