"""The catalogue's questions as SQL text with named parameters.

``ask(t, name, p)`` runs one over a table dict: the tables stand in the text as
``{name}`` (no view is left in the session) and values as ``:name`` markers, bound
by Spark and never pasted into the text.  Subqueries are stated as the
question is asked (a batch's latest arrival, a pair of columns in a list, no
attendance at all), and the analyser turns them into joins on their keys.  The
symptom frequencies keep running counts per patient and vaccine instead of
joining every diagnosis with every earlier dose.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .builders import Tables
from .params import TESTDATA, Params

_CHAIN = """
  JOIN {batch} b ON b.id = e.batchid
  JOIN {manufacturer} m ON m.id = b.manufacturerid
  JOIN {vaccine} k ON k.id = m.vaccineid"""

TEXTS = {
    "q1_staff_on_duty": """
SELECT DISTINCT s.ssno, s.name, s.phone, s.role, s.vaccinationstatus, h.name AS facility
FROM {vaccination} e
  JOIN {healthcarefacility} h ON h.name = e.healthcarefacilityname
  JOIN {staff} s ON s.healthcarefacilityname = h.name
WHERE e.date = CAST(:event_date AS DATE)
  AND s.ssno IN (SELECT ssno FROM {shift} WHERE workday = :event_workday)""",
    "q2_doctors_on_day": """
SELECT DISTINCT s.ssno, s.name, s.role, s.healthcarefacilityname
FROM {staff} s JOIN {shift} w ON w.ssno = s.ssno
WHERE w.workday = :doctor_workday AND s.role = :doctor_role
  AND array_contains(:facilities, s.healthcarefacilityname)""",
    "q3_batch_locations": """
SELECT DISTINCT b.id AS batchid, b.healthcarefacilityname AS currentlocation, l.tolocation AS lastlocation,
       CASE l.tolocation WHEN b.healthcarefacilityname THEN '' ELSE h.phone END AS phone
FROM {batch} b
  JOIN {transportationlog} l ON l.batchid = b.id
  JOIN {healthcarefacility} h ON h.name = b.healthcarefacilityname
WHERE l.tolocation IS NOT NULL
  AND l.arrivaldate = (SELECT max(any.arrivaldate) FROM {transportationlog} any WHERE any.batchid = b.id)""",
    "q4_critical_after": """
SELECT p.*, d.symptom, d.date, s.criticality
FROM {diagnosis} d JOIN {symptoms} s ON s.name = d.symptom JOIN {patient} p ON p.ssno = d.ssno
WHERE s.criticality = 1 AND d.date > CAST(:diagnosed_after AS DATE)""",
    "q5_vaccination_status": """
WITH per AS (
  SELECT a.ssno, k.dosage, count(*) AS n
  FROM {attends} a
    LEFT JOIN {vaccination} e ON e.date = a.date AND e.healthcarefacilityname = a.healthcarefacilityname
    LEFT JOIN {batch} b ON b.id = e.batchid
    LEFT JOIN {manufacturer} m ON m.id = b.manufacturerid
    LEFT JOIN {vaccine} k ON k.id = m.vaccineid
  GROUP BY a.ssno, k.dosage)
SELECT p.ssno, p.name, p.birthday, p.gender, CASE WHEN per.n >= per.dosage THEN 1 ELSE 0 END AS vaccinationstatus
FROM {patient} p LEFT JOIN per ON per.ssno = p.ssno""",
    "q6_facility_stock": """
SELECT h.name AS facility_name, sum(b.numberofvaccines) AS total_vaccines, count(DISTINCT k.id) AS different_types
FROM {healthcarefacility} h
  LEFT JOIN {batch} b ON b.healthcarefacilityname = h.name
  LEFT JOIN {manufacturer} m ON m.id = b.manufacturerid
  LEFT JOIN {vaccine} k ON k.id = m.vaccineid
GROUP BY h.name""",
    "q7_symptom_frequency": """
WITH dose AS (
  SELECT e.ssno, e.date, k.id, count(*) AS n
  FROM (SELECT * FROM ({attends} NATURAL JOIN {vaccination})) e """
    + _CHAIN
    + """
  GROUP BY e.ssno, e.date, k.id),
told AS (
  SELECT d.ssno, d.date, d.symptom, count(*) AS n
  FROM {diagnosis} d WHERE d.symptom IN (SELECT name FROM {symptoms})
  GROUP BY d.ssno, d.date, d.symptom),
line AS (
  SELECT ssno, id, date, 0 AS asked, n FROM dose
  UNION ALL
  SELECT ssno, id, date, 1, 0 FROM (SELECT DISTINCT ssno, date FROM told) JOIN (SELECT DISTINCT ssno, id FROM dose) USING (ssno)),
counted AS (
  SELECT *, sum(n) OVER (PARTITION BY ssno, id ORDER BY date, asked ROWS UNBOUNDED PRECEDING) AS had FROM line),
pairs AS (
  SELECT c.id, t.symptom AS name, sum(c.had * t.n) AS frequency
  FROM told t JOIN counted c ON c.ssno = t.ssno AND c.date = t.date
  WHERE c.asked = 1 AND c.had > 0
  GROUP BY c.id, t.symptom)
SELECT id, name, frequency,
       CAST(frequency AS DOUBLE) * 100.0D / CAST(sum(frequency) OVER (PARTITION BY id) AS DOUBLE) AS relative_frequency
FROM pairs""",
    "t10_patients_met": """
SELECT p.ssno, p.name
FROM {attends} a JOIN {patient} p ON p.ssno = a.ssno
WHERE (a.date, a.healthcarefacilityname) IN (
  SELECT e.date, h.name
  FROM {vaccination} e JOIN {healthcarefacility} h ON h.name = e.healthcarefacilityname
  WHERE e.date > CAST(:range_start AS DATE) AND e.date < CAST(:range_end AS DATE)
    AND h.name IN (SELECT healthcarefacilityname FROM {staff} WHERE ssno = :ill_staff))""",
    "v2_diagnoses_without_attendance": """
SELECT d.ssno, d.symptom, d.date
FROM {diagnosis} d
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT ssno FROM {attends}) a WHERE a.ssno = d.ssno)""",
}


def ask(t: Tables, name: str, p: Params = TESTDATA) -> DataFrame:
    """The question ``name`` over the tables ``t`` with the values of ``p``."""
    text = TEXTS[name]
    spark = next(iter(t.values())).sparkSession
    told = {k: F.array(*map(F.lit, v)) if isinstance(v, tuple) else v for k, v in vars(p).items() if f":{k}" in text}
    return spark.sql(text, args=told, **{k: df for k, df in t.items() if f"{{{k}}}" in text})


def _report(name: str):
    @functools.wraps(ask)
    def run(t: Tables, p: Params = TESTDATA) -> DataFrame:
        return ask(t, name, p)

    run.__name__ = f"sql_{name}"
    return run


REPORTS = {f"sql_{name}": _report(name) for name in TEXTS}
