"""Shared sub-plans: vaccination events resolved to their vaccine, and doses.

Several reports walk the same chain vaccination -> batch -> manufacturer ->
vaccine; building it once keeps their plans identical (Spark reuses the
exchange inside one query, and a caller running several reports together can
``cache()`` the result).  The chain's right sides are dimensions keyed by
their primary key, so joins are many-to-one: no fan-out, and Catalyst/AQE
broadcast them when their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

EVENT_KEY = ["date", "healthcarefacilityname"]


def event_vaccines(t: Tables, how: str = "inner", with_vaccine_table: bool = True) -> DataFrame:
    """Vaccination events with their vaccine.

    Columns: date, healthcarefacilityname, batchid, vaccineid (from the
    manufacturer) and, with the vaccine table, vaccine_id, vaccine_name,
    dosage.  ``how`` = "inner" drops events whose chain breaks, "left" keeps
    them with NULLs.
    """
    v = t["vaccination"].select("date", "healthcarefacilityname", "batchid")
    b = t["batch"].select(F.col("id").alias("_bid"), F.col("manufacturerid").alias("_mid"))
    m = t["manufacturer"].select(F.col("id").alias("_mid2"), "vaccineid")
    out = v.join(b, F.col("batchid") == F.col("_bid"), how).join(m, F.col("_mid") == F.col("_mid2"), how)
    if with_vaccine_table:
        vc = t["vaccine"].select(
            F.col("id").alias("vaccine_id"), F.col("name").alias("vaccine_name"), "dosage"
        )
        out = out.join(vc, F.col("vaccineid") == F.col("vaccine_id"), how)
    return out.drop("_bid", "_mid", "_mid2")


def doses(t: Tables, how: str = "inner", with_vaccine_table: bool = True) -> DataFrame:
    """One row per attendance with its event's vaccine (``attends`` NATURAL
    JOIN ``vaccination`` then the chain).  Columns: ssno, date,
    healthcarefacilityname + the ``event_vaccines`` columns."""
    a = t["attends"].select("ssno", *EVENT_KEY)
    events = event_vaccines(t, how, with_vaccine_table)
    most = getattr(t, "most_event_bytes", 0)
    # facts that lie bucketed by person stay where they are, if the planner's
    # estimate of the event side (no job: statistics of the catalogue) allows
    if most and events._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most:
        events = events.hint("broadcast")
    return a.join(events, EVENT_KEY, how)
