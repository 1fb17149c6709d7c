"""Name -> query callable ``(spark, sf_dir) -> DataFrame`` for every report
and operator run, and name -> DuckDB oracle SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import oracle
from ..sources.derived import derived_tables
from . import catalogue as C
from . import charts as V
from . import loading as L
from . import raw as R
from . import sql_text as S
from . import tasks as T

Query = Callable[[SparkSession, str], DataFrame]

# Reports over the twelve campaign tables: name -> fn(tables) -> DataFrame
TABLE_REPORTS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "q1_staff_on_duty": C.q1_staff_on_duty,
    "q2_doctors_on_day": C.q2_doctors_on_day,
    "q3_batch_locations": C.q3_batch_locations,
    "q4_critical_after": C.q4_critical_after,
    "q5_vaccination_status": C.q5_vaccination_status,
    "q6_facility_stock": C.q6_facility_stock,
    "q7_symptom_frequency": C.q7_symptom_frequency,
    "q7b_symptom_frequency_per_catalogue": C.q7b_symptom_frequency_per_catalogue,
    "q8_symptom_count": C.q8_symptom_count,
    "t1_patient_symptoms": T.t1_patient_symptoms,
    "t1_patient_symptoms_indexed": T.t1_patient_symptoms_indexed,
    "t2_first_two_doses": T.t2_first_two_doses,
    "t3_top_symptoms": T.t3_top_symptoms,
    "t3_top_symptoms_text": T.t3_top_symptoms_text,
    "t4_age_groups": T.t4_age_groups,
    "t6_status_share_long": T.t6_status_share_long,
    "t6_status_share": T.t6_status_share,
    "t7a_vaccine_per_diagnosis": T.t7a_vaccine_per_diagnosis,
    "t7b_doses_per_vaccine": T.t7b_doses_per_vaccine,
    "t7_symptom_vaccine_long": T.t7_symptom_vaccine_long,
    "t7c_symptom_vaccine_counts": T.t7c_symptom_vaccine_counts,
    "t7d_symptom_vaccine_rates": T.t7d_symptom_vaccine_rates,
    "t7e_symptom_vaccine_words": T.t7e_symptom_vaccine_words,
    "t7e_symptom_vaccine_words_fine": T.t7e_symptom_vaccine_words_fine,
    "t8a_event_attendance": T.t8a_event_attendance,
    "t8b_dose_reserve": T.t8b_dose_reserve,
    "t8_attendance_by_event_and_month": T.t8_attendance_by_event_and_month,
    "t9_cumulative_vaccinated": T.t9_cumulative_vaccinated,
    "t10_staff_met": T.t10_staff_met,
    "t10_patients_met": T.t10_patients_met,
    "t10_contacts": T.t10_contacts,
    "v2_diagnoses_without_attendance": V.v2_diagnoses_without_attendance,
    "v3_staff_vaccinated_by_facility": V.v3_staff_vaccinated_by_facility,
    "v4_doses_per_manufacturer": V.v4_doses_per_manufacturer,
    "v5_patients_per_facility": V.v5_patients_per_facility,
    "v6_symptoms_by_month": V.v6_symptoms_by_month,
    **S.REPORTS,
}

# Runs that read the raw testdata tables (or sheets derived from them) directly
SOURCE_RUNS: dict[str, Query] = {**R.RUNS, **L.RUNS}


def _on_derived(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(derived_tables(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {name: _on_derived(fn) for name, fn in TABLE_REPORTS.items()}
    q.update(SOURCE_RUNS)
    return q


def oracle_sql() -> dict[str, str]:
    out = {
        k: oracle.with_derived(v)
        for part in (oracle.CATALOGUE, oracle.TASKS, oracle.CHARTS, oracle.SQL_TEXT, oracle.LOADING_ON_DERIVED)
        for k, v in part.items()
    }
    out.update({k: oracle.with_derived(v) for k, v in oracle.STORE.items()})
    out.update({k: oracle.with_planted(v) for k, v in oracle.PLANTED.items()})
    out.update(oracle.RAW)
    out.update(oracle.LOADING)
    out["audit_derived_tables"] = oracle.with_derived(oracle._audit_sql())
    names = queries()
    return {k: v for k, v in out.items() if k in names}
