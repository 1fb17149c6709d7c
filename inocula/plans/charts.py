"""Datasets behind the dashboard charts and data-quality findings (V2-V6).

Only the data is built; drawing is left to whatever renders it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import criticality_label, month_name
from ..operators import group_size, orphans, pivot_fixed, with_scalar
from .builders import EVENT_KEY, Tables


def v2_diagnoses_without_attendance(t: Tables) -> DataFrame:
    """Diagnoses of patients with no attendance (NOT EXISTS -> anti join)."""
    return orphans(t["diagnosis"], t["attends"].select("ssno"), ["ssno"])


def v3_staff_vaccinated_by_facility(t: Tables) -> DataFrame:
    """Staff per facility, non-vaccinated (0) vs vaccinated (1), wide.

    Rows with a NULL facility or status are not counted (a pandas group-by
    drops them); absent cells stay NULL.  Columns: Healthcare Facility,
    non-vaccinated, vaccinated.
    """
    s = t["staff"].where(F.col("vaccinationstatus").isin(0, 1))
    g = group_size(s, ["healthcarefacilityname", "vaccinationstatus"], alias="_n")
    w = pivot_fixed(g, "healthcarefacilityname", "vaccinationstatus", [0, 1], "_n")
    return w.select(
        F.col("healthcarefacilityname").alias("Healthcare Facility"),
        F.col("0").alias("non-vaccinated"),
        F.col("1").alias("vaccinated"),
    )


def v4_doses_per_manufacturer(t: Tables) -> DataFrame:
    """Doses shipped per manufacturer, largest first (NULL sums first, as the
    source database orders DESC): numberofvaccines, manufacturerid."""
    b = t["batch"].select("numberofvaccines", "manufacturerid")
    m = t["manufacturer"].select(F.col("id").alias("_mid"))
    return (
        b.join(m, F.col("manufacturerid") == F.col("_mid"))
        .groupBy("manufacturerid")
        .agg(F.sum("numberofvaccines").cast("bigint").alias("numberofvaccines"))
        .select("numberofvaccines", "manufacturerid")
        .orderBy(F.desc_nulls_first("numberofvaccines"), "manufacturerid")
    )


def v5_patients_per_facility(t: Tables) -> DataFrame:
    """Patients vaccinated per facility and their % of the total:
    hospital, patients, pct."""
    v = t["vaccination"].select(*EVENT_KEY)
    # attendances counted per event before the join (one row per event)
    a = t["attends"].groupBy(*EVENT_KEY).agg(F.count("ssno").alias("_people"))
    per = a.join(v, EVENT_KEY).groupBy(F.col("healthcarefacilityname").alias("hospital")).agg(
        F.sum("_people").alias("patients")
    )
    tot = per.agg(F.sum("patients").alias("_tot"))
    return with_scalar(per, tot).select(
        "hospital", "patients", (F.col("patients").cast("double") * 100.0 / F.col("_tot").cast("double")).alias("pct")
    )


def v6_symptoms_by_month(t: Tables) -> DataFrame:
    """Diagnoses by calendar month (any year) and criticality, labelled:
    month_no, month, criticality, no_of_symptoms; ordered by month."""
    d = t["diagnosis"].select("symptom", "date")
    s = t["symptoms"].select(F.col("name").alias("_sn"), "criticality")
    g = (
        d.join(s, F.col("symptom") == F.col("_sn"))
        .groupBy(F.month("date").alias("month_no"), "criticality")
        .agg(F.count(F.lit(1)).alias("no_of_symptoms"))
    )
    return g.select(
        "month_no",
        month_name(F.make_date(F.lit(2000), F.col("month_no"), F.lit(1))).alias("month"),
        criticality_label("criticality").alias("criticality"),
        "no_of_symptoms",
    ).orderBy("month_no", "criticality")
