"""Analysis tasks T1-T10 (SQL + dataframe post-processing in the reference,
one lazy Spark plan each here)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import age_band, age_years, format_day, rate_words, round_half_even, same_weekday, sentence
from ..functions.scalars import AGE_BAND_LABELS
from ..operators import (
    count_rows,
    count_std,
    crosstab,
    distinct_bitmaps,
    distinct_counts,
    first_n_wide,
    latest_prior,
    number_values,
    pivot_fixed,
    roll_up,
    running_total,
    semi_on,
    share_of_group,
    top_n_per_group,
    with_scalar,
)
from ..sources.store import with_row_index
from .builders import EVENT_KEY, Tables, doses, event_vaccines
from .params import TESTDATA, Params


# ------------------------------------------------------------------ T1 - T3
def t1_patient_symptoms(t: Tables) -> DataFrame:
    """Patients with their diagnoses: ssNO, gender, dateOfBirth, symptom,
    diagnosisDate (case-preserving names)."""
    p = t["patient"].select("ssno", "gender", "birthday")
    d = t["diagnosis"].select("ssno", "symptom", "date")
    return p.join(d, "ssno").select(
        F.col("ssno").alias("ssNO"),
        "gender",
        F.col("birthday").alias("dateOfBirth"),
        "symptom",
        F.col("date").alias("diagnosisDate"),
    )


def t1_patient_symptoms_indexed(t: Tables) -> DataFrame:
    """T1 as persisted by the source: with a 0-based ``index`` column, here
    the row's rank in (ssNO, symptom, diagnosisDate) order."""
    return with_row_index(t1_patient_symptoms(t), "index", order_by=["ssNO", "symptom", "diagnosisDate"])


def t2_first_two_doses(t: Tables) -> DataFrame:
    """Per patient the first two doses (date, vaccine name); all patients,
    NULLs when fewer doses.  Same-day doses are ordered by facility, then
    vaccine id (the source leaves them unordered)."""
    d = doses(t, how="left").select("ssno", "date", "healthcarefacilityname", "vaccine_id", "vaccine_name")
    wide = first_n_wide(
        d,
        "ssno",
        [F.col("date").asc_nulls_last(), F.col("healthcarefacilityname").asc_nulls_last(), F.col("vaccine_id").asc_nulls_last()],
        ["date", "vaccine_name"],
        2,
        name=lambda c, i: f"date{i}" if c == "date" else f"vaccinetype{i}",
    )
    return (
        t["patient"]
        .select("ssno")
        .join(wide, "ssno", "left")
        .select(F.col("ssno").alias("patientssNO"), "date1", "vaccinetype1", "date2", "vaccinetype2")
    )


def t3_top_symptoms(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Top-k symptoms per gender by number of diagnoses (ties: symptom name).
    Columns: gender, rank, symptom, n."""
    # diagnoses are counted per (patient, symptom) before meeting the patient
    # table, so a patient with many diagnoses ships one row per symptom
    per = t["diagnosis"].groupBy("ssno", "symptom").agg(F.count(F.lit(1)).alias("_n"))
    pt = t["patient"].where(F.col("gender").isin(list(p.genders))).select("ssno", "gender")
    counts = per.join(pt, "ssno").groupBy("gender", "symptom").agg(F.sum("_n").alias("n"))
    return top_n_per_group(counts, "gender", [F.desc("n"), F.asc("symptom")], p.top_k).select(
        "gender", "rank", "symptom", "n"
    )


def t3_top_symptoms_text(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """The same as one sentence per gender: 'a, b, c.'.  Columns: gender, text."""
    top = t3_top_symptoms(t, p)
    return top.groupBy("gender").agg(
        sentence(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symptom"))), lambda s: s["symptom"])).alias(
            "text"
        )
    )


# ------------------------------------------------------------------ T4 - T6
def t4_age_groups(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Patients with age group at ``p.as_of`` and status: ssno, name,
    birthday, gender, ageGroup, vaccinationStatus."""
    pt = t["patient"]
    return pt.select(
        "ssno",
        "name",
        "birthday",
        "gender",
        age_band(age_years("birthday", p.as_of)).alias("ageGroup"),
        F.col("vaccinationstatus").alias("vaccinationStatus"),
    )


def t6_status_share_long(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Share of each status within each age group (long form): ageGroup,
    vaccinationStatus, frequency.  The divisor counts the whole age group,
    NULL statuses included; NULL-status rows are not reported."""
    g = t4_age_groups(t, p).groupBy("ageGroup", "vaccinationStatus").agg(F.count(F.lit(1)).alias("_n"))
    s = share_of_group(g, "ageGroup", "_n", alias="frequency")
    return s.where(F.col("vaccinationStatus").isNotNull()).select("ageGroup", "vaccinationStatus", "frequency")


def t6_status_share(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Wide: one row per status, one column per age group; absent cell NULL."""
    return pivot_fixed(t6_status_share_long(t, p), "vaccinationStatus", "ageGroup", AGE_BAND_LABELS, "frequency")


# ------------------------------------------------------------------ T7
def _t7_doses(t: Tables) -> DataFrame:
    # inner chain without the vaccine table: vaccine = manufacturer.vaccineid
    return doses(t, how="inner", with_vaccine_table=False)


def t7a_vaccine_per_diagnosis(t: Tables) -> DataFrame:
    """One vaccine per diagnosis (ssno, symptom, date) among the patient's
    doses on or before it: the latest such dose (same day: smallest
    facility, then vaccine id).  Columns: ssno, symptom, date, vaccine."""
    ev = _t7_doses(t).select("ssno", "date", "healthcarefacilityname", F.col("vaccineid").alias("vaccine"))
    probes = t["diagnosis"].select("ssno", "symptom", "date").distinct()
    return latest_prior(ev, probes, "ssno", "date", "date", pick=["healthcarefacilityname", "vaccine"], payload=["vaccine"])


def _attendance_per_event(t: Tables) -> DataFrame:
    """Attendances (rows, and non-NULL ssno) per vaccination event: the fact
    table collapsed before it meets the event side."""
    return t["attends"].groupBy(*EVENT_KEY).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("ssno").alias("_people")
    )


def t7b_doses_per_vaccine(t: Tables) -> DataFrame:
    """Attendances per vaccine: vaccine, count (attendances are counted per
    event first, then summed over the events of each vaccine)."""
    ev = event_vaccines(t, how="inner", with_vaccine_table=False)
    return (
        _attendance_per_event(t)
        .join(ev, EVENT_KEY)
        .groupBy(F.col("vaccineid").alias("vaccine"))
        .agg(F.sum("_rows").alias("count"))
    )


def t7_symptom_vaccine_long(t: Tables, digits: int = 2) -> DataFrame:
    """Symptom x vaccine in long form, for any number of vaccines: symptom,
    vaccine, n, rate (n / doses of that vaccine, half-even to ``digits``;
    NULL for a vaccine without doses), words."""
    cnt = t7a_vaccine_per_diagnosis(t).groupBy("symptom", "vaccine").agg(F.count(F.lit(1)).alias("n"))
    tot = t7b_doses_per_vaccine(t).select(F.col("vaccine").alias("_v"), F.col("count").alias("_doses"))
    rate = round_half_even(F.col("n").cast("double") / F.col("_doses").cast("double"), digits)
    rated = cnt.join(tot, F.col("vaccine").eqNullSafe(F.col("_v")), "left").withColumn("rate", rate)
    return rated.select("symptom", "vaccine", "n", "rate", rate_words("rate").alias("words"))


def t7c_symptom_vaccine_counts(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Symptom x vaccine table of T7a counts; absent cells 0.  Columns:
    symptom, one per id of ``p.vaccines``, and ``other`` for all other ids."""
    return crosstab(t7a_vaccine_per_diagnosis(t), "symptom", "vaccine", p.vaccines, other="other")


def _t7_rates(t: Tables, digits: int = 2) -> DataFrame:
    # a diagnosis without a vaccine id has no column to go to, as in a crosstab
    return t7_symptom_vaccine_long(t, digits).where(F.col("vaccine").isNotNull() & F.col("rate").isNotNull())


def t7d_symptom_vaccine_rates(t: Tables, p: Params = TESTDATA, digits: int = 2) -> DataFrame:
    """count / doses of that vaccine, rounded half-even to ``digits``; absent
    cells 0.0.  An id outside ``p.vaccines`` is refused (a rate cannot be
    put into a common column); the long form takes any ids."""
    wide = pivot_fixed(_t7_rates(t, digits), "symptom", "vaccine", p.vaccines, "rate")
    return wide.na.fill(0.0, subset=list(p.vaccines))


def t7e_symptom_vaccine_words(t: Tables, p: Params = TESTDATA, words=None, digits: int = 2) -> DataFrame:
    """T7d's rates in words ('very common' / 'common' / 'rare' / '-')."""
    kw = {} if words is None else {"words": words}
    rates = t7d_symptom_vaccine_rates(t, p, digits)
    return rates.select("symptom", *[rate_words(F.col(f"`{v}`"), **kw).alias(v) for v in p.vaccines])


def t7e_symptom_vaccine_words_fine(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """T7e for symptoms of about one in a hundred doses: five digits and ``p.fine_words`` as
    bounds, with a column for a vaccine that nobody had yet ('-')."""
    return t7e_symptom_vaccine_words(t, replace(p, vaccines=(*p.vaccines, p.new_vaccine)), p.fine_words, digits=5)


# ------------------------------------------------------------------ T8 - T9
def _event_attendance_counts(t: Tables) -> DataFrame:
    return t["attends"].groupBy(*EVENT_KEY).agg(F.count_distinct("ssno").alias("_d"))


def _pct(count: str, total: str) -> F.Column:
    return F.col(count).cast("double") * 100.0 / F.col(total).cast("double")


def t8a_event_attendance(t: Tables) -> DataFrame:
    """% of all patients attending each event: date, healthcarefacilityname,
    percentage_patient_attending.  The patient count is a one-row aggregate
    attached to every event (no round trip through the driver)."""
    n = count_rows(t["patient"], "_np")
    return with_scalar(_event_attendance_counts(t), n).select(
        *EVENT_KEY, _pct("_d", "_np").alias("percentage_patient_attending")
    )


def t8b_dose_reserve(t: Tables) -> DataFrame:
    """Per event: attendance % plus the sample std of that % over events:
    date, healthcarefacilityname, vaccine_percentage.

    The % is a count scaled by 100 / patients, so its std is the counts' std
    scaled the same way; that std is computed exactly (``count_std``), which
    makes the result independent of partitioning.
    """
    per = _event_attendance_counts(t)
    n = count_rows(t["patient"], "_np")
    sd = count_std(per, "_d", "_sdc")
    return with_scalar(with_scalar(per, n), sd).select(
        *EVENT_KEY, (_pct("_d", "_np") + _pct("_sdc", "_np")).alias("vaccine_percentage")
    )


def t8_attendance_by_event_and_month(t: Tables) -> DataFrame:
    """Distinct attendees per event and, rolled up from the same bitmaps, per month:
    level ('event' or 'month'), date (of a month its first day),
    healthcarefacilityname (null for a month), patients."""
    a = t["attends"]
    per_event = distinct_bitmaps(a, EVENT_KEY, "ssno", number_values(a, "ssno"))
    months = roll_up(per_event, [F.trunc("date", "month").alias("date")])
    event = distinct_counts(per_event, EVENT_KEY, "patients").select(F.lit("event").alias("level"), *EVENT_KEY, "patients")
    month = distinct_counts(months, ["date"], "patients").select(
        F.lit("month").alias("level"), "date", F.lit(None).cast("string").alias("healthcarefacilityname"), "patients"
    )
    return event.unionByName(month)


def t9_cumulative_vaccinated(t: Tables) -> DataFrame:
    """Vaccinated per event date and running total, in date order: date,
    day ('yyyy-MM-dd' text, the chart's axis), total_vaccinated, cumulative.
    Aggregated per date before the (global) running sum, so the single
    ordered partition holds one row per calendar day."""
    v = t["vaccination"].select(*EVENT_KEY)
    per_day = (
        _attendance_per_event(t)
        .join(v, EVENT_KEY)
        .groupBy("date")
        .agg(F.sum("_people").alias("total_vaccinated"))
    )
    return (
        running_total(per_day, "date", "total_vaccinated", "cumulative")
        .select("date", format_day("date").alias("day"), "total_vaccinated", "cumulative")
        .orderBy("date")
    )


# ------------------------------------------------------------------ T10
def _in_range(col: str, p: Params):
    c = F.col(col)
    return (c > F.lit(p.range_start).cast("date")) & (c < F.lit(p.range_end).cast("date"))


def t10_staff_met(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Staff sharing an event day with ``p.ill_staff``: ssno, name, one row
    per matching (shift, event).

    The key set is the ill person's (event date, facility, weekday) triples
    within the open range and on their own shift weekdays -- tiny.  It is
    resolved against vaccination first, then joined to staff x shift on
    (facility, weekday); the staff-by-event product the SQL states is never
    formed.
    """
    v = t["vaccination"].select(*EVENT_KEY)
    hf = t["healthcarefacility"].select(F.col("name").alias("_hn"))
    ill = t["staff"].where(F.col("ssno") == p.ill_staff).select(F.col("ssno").alias("_is"), F.col("healthcarefacilityname").alias("_if"))
    ill_sh = t["shift"].select(F.col("ssno").alias("_iss"), "workday")
    keys = (
        v.where(_in_range("date", p))
        .join(hf, F.col("healthcarefacilityname") == F.col("_hn"))
        .join(ill, F.col("_hn") == F.col("_if"))
        .join(ill_sh, F.col("_iss") == F.col("_is"))
        .where(same_weekday("workday", "date"))
        .select(*EVENT_KEY, "workday")
        .distinct()
    )
    events = v.join(keys, EVENT_KEY)  # vaccination rows in the key set, with their weekday
    # only staff of the key set's facilities can match: cut staff down with a
    # semi join against that tiny set before meeting the shift table
    staff = semi_on(t["staff"].select("ssno", "name", "healthcarefacilityname"), keys, ["healthcarefacilityname"])
    staff_shifts = staff.join(t["shift"].select("ssno", "workday"), "ssno").join(
        hf, F.col("healthcarefacilityname") == F.col("_hn")
    )
    return staff_shifts.join(events, ["healthcarefacilityname", "workday"]).select("ssno", "name")


def t10_patients_met(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Patients attending events at the ill person's facility within the
    open range: ssno, name, one row per attendance."""
    v = t["vaccination"].where(_in_range("date", p)).select(*EVENT_KEY)
    hf = t["healthcarefacility"].select(F.col("name").alias("_hn"))
    ill = t["staff"].where(F.col("ssno") == p.ill_staff).select(F.col("healthcarefacilityname").alias("_if"))
    keys = v.join(hf, F.col("healthcarefacilityname") == F.col("_hn")).join(ill, F.col("_hn") == F.col("_if"))
    a = semi_on(t["attends"], keys, EVENT_KEY)
    return t["patient"].select("ssno", "name").join(a.select("ssno"), "ssno")


def t10_contacts(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Both lists tagged with role 'S' / 'P', duplicates kept."""
    s = t10_staff_met(t, p).withColumn("role", F.lit("S"))
    q = t10_patients_met(t, p).withColumn("role", F.lit("P"))
    return s.unionByName(q)
