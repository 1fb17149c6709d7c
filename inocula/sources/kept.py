"""The vaccination-status view kept up to date by its appends.

Q5 counts attendances per patient and dosage.  Counts add up, so each load of
attendances leaves its own, one row per (patient, dosage) it met, in the
table ``dose_counts``: a partition per load, bucketed by patient like the
tables it is joined with.  An append counts its own rows only; the view sums a
patient's few rows and never goes back to the attendances.

A load's partition is replaced as a whole, so counting a load again after a
failure changes nothing.  Events must be loaded before their attendances
(the key check of the append asks for that): a dose is counted with the dosage
its event has at that time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.builders import doses
from ..schema import TABLES
from .store import file_system
from .tables import BUCKETS, PersonTables, _insert, append_rows, open_tables

COUNTS = "dose_counts"
EVENT_TABLES = ["vaccine", "manufacturer", "batch", "vaccination"]


def create_dose_counts(spark: SparkSession, database: str, root: str, buckets: int = BUCKETS) -> None:
    """Declare the table of counts in ``database`` (kept if it is there)."""
    folder = f"{root.rstrip('/')}/{COUNTS}-{buckets}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{database}`.`{COUNTS}` (ssno string, dosage int, n bigint, `load` string) USING parquet "
        f"PARTITIONED BY (`load`) CLUSTERED BY (ssno) SORTED BY (ssno) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    fs, path = file_system(spark, folder)
    if fs.exists(path(folder)):
        spark.sql(f"MSCK REPAIR TABLE `{database}`.`{COUNTS}`")


def load_counts(spark: SparkSession, database: str, rows: DataFrame) -> DataFrame:
    """(ssno, dosage, n) of the attendances ``rows``; of the stored tables only the events and
    what tells their vaccine are read."""
    t = PersonTables({**open_tables(spark, database, EVENT_TABLES), "attends": rows})
    return doses(t, how="left").groupBy("ssno", "dosage").agg(F.count(F.lit(1)).alias("n"))


def count_load(spark: SparkSession, database: str, rows: DataFrame, load: str) -> None:
    """Keep the counts of one load, in place of those kept under its name before."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", load):
        raise ValueError(f"a load's name has letters, digits, '_', '.' and '-': {load!r}")
    _insert(spark, database, COUNTS, load_counts(spark, database, rows).withColumn("load", F.lit(load)), overwrite=True)


def append_attendances(spark: SparkSession, database: str, rows: DataFrame, load: str, check: bool = True) -> None:
    """Append attendances to their table and keep their counts.

    If this ends between the two steps, ``count_load`` with the same rows and name
    makes up for it.
    """
    rows = rows.select(*TABLES["attends"].schema.fieldNames())
    append_rows(spark, database, "attends", rows, check)
    count_load(spark, database, rows, load)


def kept_vaccination_status(spark: SparkSession, database: str) -> DataFrame:
    """Q5 from the kept counts: ssno, name, birthday, gender, vaccinationstatus."""
    counts = spark.table(f"`{database}`.`{COUNTS}`").groupBy("ssno", "dosage").agg(F.sum("n").alias("_n"))
    patients = open_tables(spark, database, ["patient"])["patient"].select("ssno", "name", "birthday", "gender")
    flag = F.when(F.col("_n") >= F.col("dosage"), 1).otherwise(0)
    return patients.join(counts, "ssno", "left").select("ssno", "name", "birthday", "gender", flag.alias("vaccinationstatus"))
