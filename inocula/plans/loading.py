"""Ingest checks on testdata-derived raw sheets: L1 cleaning, L2 patient
status, V1 unreadable dates, and the audit of all derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    audit_summary,
    check_violations,
    duplicate_keys,
    foreign_key_orphans,
    length_violations,
    not_null_violations,
)
from ..schema import TABLES
from ..session import ensure_checkpoint_dir
from ..sources.derived import derived_tables, planted_tables, raw_diagnosis_sheet, raw_shift_sheet
from ..sources.store import file_system, load_tables, preview, read_table
from ..sources.tables import BUCKETS, append_rows, append_violations, create_tables, open_tables, replace_rows
from ..sources.workbook import SHEET_TABLE, clean_sheet, export_sheet, patient_status, read_sheet, read_sheet_rows, unreadable_dates
from ..sources.kept import append_attendances, create_dose_counts, kept_vaccination_status
from .catalogue import q5_vaccination_status, q7_symptom_frequency, register_vaccination_status_view
from .tasks import t7a_vaccine_per_diagnosis


def l1_clean_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis sheet cleaned: renamed, filler dropped, bad dates repaired."""
    return clean_sheet("Diagnosis", raw_diagnosis_sheet(spark, sf_dir))


def l1_clean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts sheet cleaned: weekday names -> 1..7 (unknown -> NULL)."""
    return clean_sheet("Shifts", raw_shift_sheet(spark, sf_dir))


def l2_patient_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient status recomputed as the number of attendances."""
    t = derived_tables(spark, sf_dir)
    return patient_status(t["patient"], t["attends"])


def v1_unreadable_diagnosis_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw diagnosis rows whose date is not a calendar date (or missing)."""
    return unreadable_dates(raw_diagnosis_sheet(spark, sf_dir))


def _shared(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, tables) -> dict[str, DataFrame]:
    """The tables as stored: an audit reads each several times, so they are
    derived once and written first, as a load does."""
    root = _shared(spark, "audit")
    load_tables(tables, root, mode="overwrite", audit=False)
    return {n: read_table(spark, root, n) for n in TABLES}


def audit_planted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (table, rule): violations of the tables with planted ones."""
    return audit_summary(_written(spark, planted_tables(spark, sf_dir)))


def audit_planted_duplicate_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary keys that occur more than once."""
    return duplicate_keys(planted_tables(spark, sf_dir)["patient"], ["ssno"])


def audit_planted_staff_without_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose one-column reference has no parent."""
    t = planted_tables(spark, sf_dir)
    return foreign_key_orphans(t["staff"], t["healthcarefacility"], ["healthcarefacilityname"], ["name"])


def audit_planted_attends_without_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose two-column reference has no parent."""
    t = planted_tables(spark, sf_dir)
    key = ["date", "healthcarefacilityname"]
    return foreign_key_orphans(t["attends"], t["vaccination"], key, key)


def audit_planted_status_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a CHECK."""
    return check_violations(planted_tables(spark, sf_dir)["patient"], TABLES["patient"].checks[0])


def audit_planted_symptom_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a UNIQUE column that occur more than once."""
    return duplicate_keys(planted_tables(spark, sf_dir)["symptoms"], ["name"])


BUCKET_BYTES = 8 << 20  # of lineitem, which has the attendances, for each bucket


def _buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets in proportion to the load, so that the rows of one, which a task sorts, stay as many."""
    fs, path = file_system(spark, sf_dir)
    size = fs.getContentSummary(path(f"{sf_dir.rstrip('/')}/lineitem.parquet")).getLength()
    return max(BUCKETS, -(-size // BUCKET_BYTES))


def _declared(spark: SparkSession, sf_dir: str, **layout) -> str:
    """A new database with the declared tables."""
    database = f"campaign_{uuid.uuid4().hex}"
    create_tables(spark, database, _shared(spark, "tables"), buckets=_buckets(spark, sf_dir), **layout)
    return database


def s6_append_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnoses in two appends to their catalogue table, read back."""
    database, d = _declared(spark, sf_dir, names=["diagnosis"]), derived_tables(spark, sf_dir)["diagnosis"]
    first = F.pmod(F.xxhash64("ssno"), F.lit(2)) == 0
    append_rows(spark, database, "diagnosis", d.where(first), check=False)
    append_rows(spark, database, "diagnosis", d.where(~first), check=False)
    return open_tables(spark, database, ["diagnosis"])["diagnosis"]


def s6_append_refused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keys refuse of an append: attendances of a month already loaded, and of
    patients and events that are not there."""
    database, t = _declared(spark, sf_dir), derived_tables(spark, sf_dir)
    month = F.month("date")
    replace_rows(spark, database, "patient", t["patient"].where("gender = 'F'"))
    replace_rows(spark, database, "vaccination", t["vaccination"].where(month <= 8))
    replace_rows(spark, database, "attends", t["attends"].where(month <= 6))
    return append_violations(spark, database, "attends", t["attends"].where((month >= 6) & (month <= 9)))


def s7_overwrite_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symptoms loaded, then replaced by the critical ones, read back."""
    database, s = _declared(spark, sf_dir, names=["symptoms"]), derived_tables(spark, sf_dir)["symptoms"]
    append_rows(spark, database, "symptoms", s, check=False)
    replace_rows(spark, database, "symptoms", s.where("criticality = 1"))
    return open_tables(spark, database, ["symptoms"])["symptoms"]


def s7_replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnoses partitioned by symptom; the partitions of critical symptoms are
    replaced by their rows of the last year, all others stay."""
    database = _declared(spark, sf_dir, names=["diagnosis"], bucket_by={}, partition_by={"diagnosis": ["symptom"]})
    t = derived_tables(spark, sf_dir)
    replace_rows(spark, database, "diagnosis", t["diagnosis"])
    critical = t["symptoms"].where("criticality = 1").select(F.col("name").alias("symptom"))
    last = t["diagnosis"].agg(F.add_months(F.max("date"), -12)).scalar()
    replace_rows(spark, database, "diagnosis", t["diagnosis"].where(F.col("date") >= last).join(critical, "symptom", "left_semi"))
    return open_tables(spark, database, ["diagnosis"])["diagnosis"]


def _bucketed(report: Callable, names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        database, t = _declared(spark, sf_dir, names=names), derived_tables(spark, sf_dir)
        for name in names:
            replace_rows(spark, database, name, t[name])
        return report(open_tables(spark, database, names))

    run.__name__ = f"s8_bucketed_{report.__name__}"
    run.__doc__ = f"{report.__name__} over catalogue tables bucketed by person."
    return run


DOSE_TABLES = ["vaccine", "manufacturer", "batch", "vaccination", "attends"]
BUCKETED = [
    _bucketed(q5_vaccination_status, [*DOSE_TABLES, "patient"]),
    _bucketed(q7_symptom_frequency, [*DOSE_TABLES, "symptoms", "diagnosis"]),
    _bucketed(t7a_vaccine_per_diagnosis, [*DOSE_TABLES, "diagnosis"]),
]


def s9_vaccination_status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named view, defined and read whole."""
    register_vaccination_status_view(derived_tables(spark, sf_dir))
    return spark.sql("SELECT * FROM vaccination_status_view")


def s9_kept_status_after_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 from kept counts, after attendances were appended in two loads."""
    database, t = _declared(spark, sf_dir, names=[*DOSE_TABLES, "patient"]), derived_tables(spark, sf_dir)
    create_dose_counts(spark, database, _shared(spark, "kept"), _buckets(spark, sf_dir))
    for name in [*DOSE_TABLES[:-1], "patient"]:
        replace_rows(spark, database, name, t[name])
    early = F.month("date") <= 6
    for load, rows in (("first", t["attends"].where(early)), ("second", t["attends"].where(~early))):
        append_attendances(spark, database, rows, load, check=False)
    return kept_vaccination_status(spark, database)


def s10_status_counts_from_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over the named view."""
    register_vaccination_status_view(derived_tables(spark, sf_dir))
    return spark.sql("SELECT vaccinationstatus, COUNT(*) AS patients FROM vaccination_status_view GROUP BY vaccinationstatus")


def o6_first_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview: the first ten diagnoses by date, patient and symptom."""
    return preview(derived_tables(spark, sf_dir)["diagnosis"], 10, ["date", "ssno", "symptom"])


def _from_csv(sheet: str) -> Callable[[SparkSession, str], DataFrame]:
    table = SHEET_TABLE[sheet]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = derived_tables(spark, sf_dir)
        df = t[table]
        if table == "shift":  # the sheet has weekday names; 2024-01-01 is a Monday
            df = df.withColumn("workday", F.date_format(F.make_date(F.lit(2024), F.lit(1), F.col("workday")), "EEEE"))
        root = _shared(spark, "export")
        export_sheet(df, root, sheet)
        return clean_sheet(sheet, read_sheet(spark, root, sheet))

    run.__name__ = f"l1_csv_{table}"
    run.__doc__ = f"Sheet {sheet}: exported as CSV, read back by name and cleaned."
    return run


def _damaged_json_sheet(spark: SparkSession, sf_dir: str) -> str:
    """The diagnosis sheet as JSON lines; of January's rows the last two characters are lost."""
    root, d = _shared(spark, "export"), derived_tables(spark, sf_dir)["diagnosis"]
    line = F.to_json(F.struct(F.col("ssno").alias("patient"), "symptom", F.col("date").cast("string").alias("date")))
    cut = F.when(F.month("date") == 1, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    d.select(cut.alias("value")).write.text(f"{root}/Diagnosis")
    return root


def l1_json_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON sheet that do not parse, with the reason."""
    _, rejected = read_sheet_rows(spark, _damaged_json_sheet(spark, sf_dir), "Diagnosis", "json")
    return rejected.select("reason", "row")


def l1_json_good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheet's other rows, cleaned into the table."""
    good, _ = read_sheet_rows(spark, _damaged_json_sheet(spark, sf_dir), "Diagnosis", "json")
    return clean_sheet("Diagnosis", good)


def audit_derived_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (table, rule): number of violating rows in the derived tables."""
    return audit_summary(_written(spark, derived_tables(spark, sf_dir)))


def audit_rows_batch_id_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose id is longer than its declared width (char(4))."""
    return length_violations(derived_tables(spark, sf_dir)["batch"], "id", 4)


def audit_rows_attends_event_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attendances whose (date, facility) has no vaccination event (the
    two-column foreign key)."""
    t = derived_tables(spark, sf_dir)
    return foreign_key_orphans(t["attends"], t["vaccination"], ["date", "healthcarefacilityname"], ["date", "healthcarefacilityname"])


def audit_rows_staff_unknown_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff rows without a vaccination status."""
    return not_null_violations(derived_tables(spark, sf_dir)["staff"], "vaccinationstatus")


RUNS = {
    "l1_clean_diagnosis": l1_clean_diagnosis,
    "l1_clean_shift": l1_clean_shift,
    "l1_json_rejected_rows": l1_json_rejected_rows,
    "l1_json_good_rows": l1_json_good_rows,
    "l2_patient_status": l2_patient_status,
    "v1_unreadable_diagnosis_dates": v1_unreadable_diagnosis_dates,
    "audit_derived_tables": audit_derived_tables,
    "audit_rows_batch_id_width": audit_rows_batch_id_width,
    "audit_rows_attends_event_fk": audit_rows_attends_event_fk,
    "audit_rows_staff_unknown_status": audit_rows_staff_unknown_status,
    "audit_planted_tables": audit_planted_tables,
    "audit_planted_duplicate_patients": audit_planted_duplicate_patients,
    "audit_planted_staff_without_facility": audit_planted_staff_without_facility,
    "audit_planted_attends_without_event": audit_planted_attends_without_event,
    "audit_planted_status_range": audit_planted_status_range,
    "audit_planted_symptom_names": audit_planted_symptom_names,
    "s6_append_then_read": s6_append_then_read,
    "s6_append_refused_keys": s6_append_refused_keys,
    "s7_overwrite_then_read": s7_overwrite_then_read,
    "s7_replace_partitions": s7_replace_partitions,
    **{run.__name__: run for run in BUCKETED},
    "s9_vaccination_status_view": s9_vaccination_status_view,
    "s9_kept_status_after_appends": s9_kept_status_after_appends,
    "s10_status_counts_from_view": s10_status_counts_from_view,
    "o6_first_diagnoses": o6_first_diagnoses,
    **{f"l1_csv_{t}": _from_csv(s) for s, t in SHEET_TABLE.items()},
}
