"""The catalogue queries Q1-Q8 over the twelve campaign tables.

Each function takes the table dict (see ``sources``) and parameters and
returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import count_prior_pairs, count_rows, latest_per_key, share_of_group, with_scalar
from .builders import Tables, doses
from .params import TESTDATA, Params


def q1_staff_on_duty(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Staff with a shift on ``p.event_workday`` at facilities holding a
    vaccination event on ``p.event_date``.

    The event side is one date -> at most one row per facility; it is joined
    first so the staff/shift joins run against a small build side.
    """
    ev = t["vaccination"].where(F.col("date") == F.lit(p.event_date).cast("date")).select(
        F.col("healthcarefacilityname").alias("_vf")
    )
    hf = t["healthcarefacility"].select(F.col("name").alias("facility"))
    st = t["staff"].select("ssno", "name", "phone", "role", "vaccinationstatus", F.col("healthcarefacilityname").alias("_sf"))
    sh = t["shift"].where(F.col("workday") == p.event_workday).select(F.col("ssno").alias("_shs"))
    return (
        ev.join(hf, F.col("_vf") == F.col("facility"))
        .join(st, F.col("facility") == F.col("_sf"))
        .join(sh, F.col("_shs") == F.col("ssno"))
        .select("ssno", "name", "phone", "role", "vaccinationstatus", "facility")
        .distinct()
    )


def q2_doctors_on_day(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Distinct staff of role ``p.doctor_role`` at ``p.facilities`` with a
    shift on ``p.doctor_workday``: ssno, name, role, healthcarefacilityname."""
    st = t["staff"].where(
        (F.col("role") == p.doctor_role) & F.col("healthcarefacilityname").isin(list(p.facilities))
    )
    sh = t["shift"].where(F.col("workday") == p.doctor_workday).select("ssno")
    return st.join(sh, "ssno").select("ssno", "name", "role", "healthcarefacilityname").distinct()


def q3_batch_locations(t: Tables) -> DataFrame:
    """Each batch's last known place vs. its recorded facility.

    Latest arrival per batch (ties kept), one pass instead of the two
    complementary UNION branches: phone is the facility's phone when the
    places differ, '' when equal; comparisons with NULL drop the row (as
    in both branches); the distinct reproduces UNION's de-duplication.
    Columns: batchid, currentlocation, lastlocation, phone.
    """
    tl = latest_per_key(
        t["transportationlog"].select("batchid", "tolocation", "arrivaldate"), "batchid", "arrivaldate"
    )
    b = t["batch"].select(F.col("id").alias("_bid"), F.col("healthcarefacilityname").alias("currentlocation"))
    hf = t["healthcarefacility"].select(F.col("name").alias("_hn"), F.col("phone").alias("_hp"))
    j = (
        b.join(tl, F.col("_bid") == F.col("batchid"))
        .join(hf, F.col("currentlocation") == F.col("_hn"))
        .where(F.col("tolocation").isNotNull())
    )
    return j.select(
        "batchid",
        "currentlocation",
        F.col("tolocation").alias("lastlocation"),
        F.when(F.col("currentlocation") == F.col("tolocation"), F.lit("")).otherwise(F.col("_hp")).alias("phone"),
    ).distinct()


def q4_critical_after(t: Tables, p: Params = TESTDATA) -> DataFrame:
    """Patients with a critical symptom diagnosed strictly after
    ``p.diagnosed_after``: patient columns, symptom, date, criticality."""
    d = t["diagnosis"].where(F.col("date") > F.lit(p.diagnosed_after).cast("date"))
    s = t["symptoms"].where(F.col("criticality") == 1).select(F.col("name").alias("_sn"), "criticality")
    pt = t["patient"]
    return (
        d.join(s, F.col("symptom") == F.col("_sn"))
        .join(pt, "ssno")
        .select("ssno", "name", "birthday", "gender", "vaccinationstatus", "symptom", "date", "criticality")
    )


def q5_vaccination_status(t: Tables) -> DataFrame:
    """Fully-vaccinated flag per patient and vaccine dosage.

    As in the view: patients LEFT JOIN attendances and their vaccine, grouped
    by (patient, dosage); flag 1 when the attendances in the group reach the
    dosage.  A patient whose doses span vaccines of different dosage gets one
    row per dosage; a patient with no attendance gets one row, flag 0.
    Attendances are counted per (ssno, dosage) before meeting the patient
    table (partial aggregation absorbs hot patients).
    """
    per = doses(t, how="left").groupBy("ssno", "dosage").agg(F.count(F.lit(1)).alias("_n"))
    pt = t["patient"].select("ssno", "name", "birthday", "gender")
    j = pt.join(per, "ssno", "left")
    flag = F.when(F.coalesce(F.col("_n"), F.lit(0)) >= F.col("dosage"), 1).otherwise(0)
    return j.select("ssno", "name", "birthday", "gender", flag.alias("vaccinationstatus"))


VACCINATION_STATUS_VIEW = "vaccination_status_view"


def register_vaccination_status_view(t: Tables, name: str = VACCINATION_STATUS_VIEW) -> DataFrame:
    """Register Q5 as a named view (``SELECT * FROM vaccination_status_view``
    then works in ``spark.sql``) and return it.  A temp view is a named
    logical plan: every read re-plans it against the current tables."""
    df = q5_vaccination_status(t)
    df.createOrReplaceTempView(name)
    return df


def q6_facility_stock(t: Tables) -> DataFrame:
    """Per facility: doses in its batches and number of vaccine types.

    Facilities without batches: total NULL, types 0.  Batches are aggregated
    per facility first, then the facility table is left-joined.
    """
    b = t["batch"].select("healthcarefacilityname", "numberofvaccines", F.col("manufacturerid").alias("_mid"))
    m = t["manufacturer"].select(F.col("id").alias("_m"), F.col("vaccineid").alias("_vid"))
    v = t["vaccine"].select(F.col("id").alias("_v"))
    bv = b.join(m, F.col("_mid") == F.col("_m"), "left").join(v, F.col("_vid") == F.col("_v"), "left")
    per = bv.groupBy(F.col("healthcarefacilityname").alias("_f")).agg(
        F.sum("numberofvaccines").cast("bigint").alias("total_vaccines"),
        F.count_distinct("_v").alias("different_types"),
    )
    hf = t["healthcarefacility"].select(F.col("name").alias("facility_name"))
    return hf.join(per, F.col("facility_name") == F.col("_f"), "left").select(
        "facility_name",
        "total_vaccines",
        F.coalesce(F.col("different_types"), F.lit(0).cast("bigint")).alias("different_types"),
    )


def _vaccine_symptom_pairs(t: Tables, symptom_col: str) -> DataFrame:
    """Per (vaccine id, symptom): number of (diagnosis, earlier-or-same-day
    attendance of the same patient) pairs, counted without forming pairs.
    One plan for any number of vaccines; nothing is read to build it."""
    dz = doses(t, how="inner").select("ssno", "date", F.col("vaccine_id").alias("id"))
    s = t["symptoms"].select(F.col("name").alias("_sn"))
    dg = t["diagnosis"].join(s, F.col("symptom") == F.col("_sn")).select(
        "ssno", "date", F.col("symptom").alias(symptom_col)
    )
    # catalogue tables lie bucketed by person
    bucketed = getattr(t, "most_event_bytes", 0) > 0
    return count_prior_pairs(dz, dg, "ssno", "date", "date", "id", symptom_col, alias="frequency", bucketed=bucketed)


def q7_symptom_frequency(t: Tables) -> DataFrame:
    """Per vaccine and symptom: frequency and its % of that vaccine's total.

    A diagnosis counts once per attendance of the patient on or before the
    diagnosis date.  Columns: id, name, frequency, relative_frequency.
    """
    pairs = _vaccine_symptom_pairs(t, "name")
    return share_of_group(pairs, "id", "frequency", alias="relative_frequency", scale=100.0)


def q7b_symptom_frequency_per_catalogue(t: Tables) -> DataFrame:
    """Variant: frequency divided by the number of catalogue symptoms.
    Columns: id, symptom, frequency, relative_frequency."""
    pairs = _vaccine_symptom_pairs(t, "symptom")
    n = count_rows(t["symptoms"], "_ns")
    return with_scalar(pairs, n).select(
        "id",
        "symptom",
        "frequency",
        (F.col("frequency").cast("double") / F.col("_ns").cast("double")).alias("relative_frequency"),
    )


def q8_symptom_count(t: Tables) -> DataFrame:
    """Number of catalogue symptoms (column ``count``)."""
    return count_rows(t["symptoms"], "count")


__all__ = [
    "q1_staff_on_duty",
    "q2_doctors_on_day",
    "q3_batch_locations",
    "q4_critical_after",
    "q5_vaccination_status",
    "q6_facility_stock",
    "q7_symptom_frequency",
    "q7b_symptom_frequency_per_catalogue",
    "q8_symptom_count",
]
