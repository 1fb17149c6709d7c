"""Ingest of the campaign workbook, exported as one CSV folder per sheet.

Each sheet is read with every column as text (no inference pass over the
data), junk ``Unnamed*`` columns are dropped, columns are renamed to the
table's names, values are repaired and cast to the declared schema.  All
cleaning is row-local column expressions, so the same ``clean_sheet`` serves
batch and streaming reads; the one non-local rule -- a patient's status is
their number of attendances -- is ``patient_status``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import coerce_date, parse_date, weekday_number
from ..schema import TABLES

# Sheet -> table, per-sheet column renames and dropped columns
# (names as they appear in the workbook, including trailing blanks).
SHEET_TABLE: dict[str, str] = {
    "VaccineType": "vaccine",
    "Manufacturer": "manufacturer",
    "VaccinationStations": "healthcarefacility",
    "VaccineBatch": "batch",
    "StaffMembers": "staff",
    "Shifts": "shift",
    "Transportation log": "transportationlog",
    "Patients": "patient",
    "Vaccinations": "vaccination",
    "VaccinePatients": "attends",
    "Symptoms": "symptoms",
    "Diagnosis": "diagnosis",
}

RENAMES: dict[str, dict[str, str]] = {
    "VaccineType": {"doses": "dosage", "ID": "id", "tempMin": "tempmin", "tempMax": "tempmax"},
    "Manufacturer": {"vaccine": "vaccineid", "ID": "id"},
    "VaccineBatch": {
        "expiration": "expirydate",
        "manufacturer": "manufacturerid",
        "batchID": "id",
        "amount": "numberofvaccines",
        "manufDate": "manufactureddate",
        "location": "healthcarefacilityname",
    },
    "StaffMembers": {
        "social security number": "ssno",
        "date of birth": "birthday",
        "vaccination status": "vaccinationstatus",
        "hospital": "healthcarefacilityname",
    },
    "Shifts": {"weekday": "workday", "worker": "ssno"},
    "Transportation log": {
        "batchID": "batchid",
        "arrival": "tolocation",
        "departure ": "fromlocation",
        "dateArr": "arrivaldate",
        "dateDep": "departuredate",
    },
    "Patients": {"ssNo": "ssno", "date of birth": "birthday"},
    "VaccinePatients": {"location": "healthcarefacilityname", "patientSsNo": "ssno"},
    "Vaccinations": {"location ": "healthcarefacilityname", "batchID": "batchid"},
    "Diagnosis": {"patient": "ssno"},
}

DROPS: dict[str, tuple[str, ...]] = {"VaccineBatch": ("type",), "Shifts": ("station",)}

def sheet_path(root: str, sheet: str) -> str:
    return f"{root.rstrip('/')}/{sheet}"


def read_sheet(spark: SparkSession, root: str, sheet: str, multi_line: bool = True) -> DataFrame:
    """One exported sheet, all columns as text, header names kept verbatim.

    Every file must have the same header in the same order as the first:
    with ``enforceSchema`` off a file that differs ends the read, instead of
    its columns being taken by position.  A row with more or fewer fields
    ends it as well (``read_sheet_rows`` hands such rows back instead).
    ``multi_line`` reads quoted line breaks; a file is then one task, so turn it
    off for large files without them.
    """
    options = {
        "header": True,
        "inferSchema": False,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "multiLine": multi_line,
        "escape": '"',
    }
    path = sheet_path(root, sheet)
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in names])
    return spark.read.options(**options, enforceSchema=False, mode="FAILFAST").schema(schema).csv(path)


def read_sheet_rows(
    spark: SparkSession, root: str, sheet: str, form: str = "csv", multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, rows that do not) of one sheet, CSV or JSON lines.

    The first has the sheet's columns as text, the second ``file``, ``reason``
    and ``row``, the text as it stands in the file: a load can go on with the
    good rows and hand back the others.  Every CSV file still must have the same
    header.  JSON sheets take their columns from all objects; a value that is no
    text is kept as JSON writes it.
    """
    path, bad = sheet_path(root, sheet), "_inocula_rejected"
    text = T.StringType()
    if form == "csv":
        options = {
            "header": True, "inferSchema": False, "multiLine": multi_line, "escape": '"',
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        }
        names = spark.read.options(**options).csv(path).columns
        some = F.coalesce(*[F.col(f"`{c}`") for c in names])
        few = F.when(F.col(f"`{names[-1]}`").isNull(), "too few fields")
        reason = F.when(some.isNull(), "no fields").otherwise(F.coalesce(few, F.lit("too many fields")))
    elif form == "json":
        options = {"primitivesAsString": True, "multiLine": multi_line}
        names = [c for c in spark.read.options(**options, columnNameOfCorruptRecord=bad).json(path).columns if c != bad]
        reason = F.when(F.coalesce(*[F.col(f"`{c}`") for c in names], F.lit("")) == "", "no JSON object").otherwise("a part is no JSON")
    else:
        raise ValueError(f"sheets are csv or json, not {form}")
    schema = T.StructType([T.StructField(c, text, True) for c in [*names, bad]])
    reader = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=bad).schema(schema)
    rows = reader.option("enforceSchema", False).csv(path) if form == "csv" else reader.json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_inocula_file"))
    # a plain null test would be pushed into the parser, which has not filled the column yet;
    # and every column is read, or the parser would not look whether a row has too many
    size = F.coalesce(F.length(bad), F.lit(0))
    read = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in names])) >= 0
    good = rows.where((size == 0) & read).select(*[F.col(f"`{c}`") for c in names])
    rejected = rows.where((size > 0) & read).select(
        F.col("_inocula_file").alias("file"), reason.alias("reason"), F.col(bad).alias("row")
    )
    return good, rejected


def read_sheets(spark: SparkSession, root: str, sheets=None) -> dict[str, DataFrame]:
    """Every sheet of the workbook export as a dict sheet -> DataFrame."""
    return {s: read_sheet(spark, root, s) for s in (sheets or SHEET_TABLE)}


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop spreadsheet filler columns (header starting with 'Unnamed')."""
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])


def _to_int(c: Column) -> Column:
    # the export may write integers as '1' or '1.0'; anything else -> NULL
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_extract(s, r"^([+-]?[0-9]+)", 1).try_cast("int"))


def _cast(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.DateType):
        return parse_date(c)
    if isinstance(dt, T.IntegerType):
        return _to_int(c)
    return c.cast(dt)


def export_sheet(df: DataFrame, root: str, sheet: str) -> None:
    """Write a table as a workbook sheet: the sheet's headers, text, a filler column."""
    back = {v: k for k, v in RENAMES.get(sheet, {}).items()}
    cols = [F.col(c).cast("string").alias(back.get(c, c)) for c in df.columns]
    drops = [F.lit("x").alias(c) for c in DROPS.get(sheet, ())]
    filler = F.lit(None).cast("string").alias(f"Unnamed: {len(cols)}")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*cols, *drops, filler).write.options(**options).csv(sheet_path(root, sheet))


def clean_sheet(sheet: str, df: DataFrame) -> DataFrame:
    """Row-local cleaning of one sheet into its table's declared schema.

    Unknown weekday names become NULL workdays; an unreadable or missing
    diagnosis date becomes 2021-02-28; declared char(n) columns are
    right-trimmed (the source database ignores their trailing blanks).
    Columns the table does not declare are dropped; declared columns the
    sheet lacks are NULL.
    """
    table = SHEET_TABLE[sheet]
    spec = TABLES[table]
    df = drop_unnamed(df)
    ren = RENAMES.get(sheet, {})
    cols: dict[str, Column] = {}
    for c in df.columns:
        if c in DROPS.get(sheet, ()):
            continue
        cols[ren.get(c, c.lower())] = F.col(f"`{c}`")
    out = []
    for f in spec.schema:
        src = cols.get(f.name, F.lit(None))
        if table == "shift" and f.name == "workday":
            val = weekday_number(F.trim(src.cast("string")))
        elif table == "diagnosis" and f.name == "date":
            val = coerce_date(src)
        else:
            val = _cast(src, f.dataType)
        if f.name in spec.char_columns:
            val = F.rtrim(val)
        out.append(val.cast(f.dataType).alias(f.name))
    return df.select(*out)


def unreadable_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Raw rows whose date does not parse as a calendar date (missing dates
    included), e.g. 2021-02-29.  Filler columns are dropped."""
    raw = drop_unnamed(df)
    return raw.where(parse_date(F.col(f"`{column}`")).isNull())


def patient_status(patients: DataFrame, attends: DataFrame) -> DataFrame:
    """Patient ``vaccinationstatus`` = number of attendances (0 if none).

    A full outer merge on ssno, as the source does: an attendee missing from
    the patient sheet becomes a patient row with NULL attributes (so the
    attends -> patient key then holds).  Attendance is counted per ssno
    first (partial aggregation), then merged.
    """
    counts = attends.where(F.col("ssno").isNotNull()).groupBy("ssno").agg(F.count(F.lit(1)).alias("_n"))
    base = patients.drop("vaccinationstatus") if "vaccinationstatus" in patients.columns else patients
    merged = base.join(counts, "ssno", "full")
    cols = [F.col(f.name) for f in TABLES["patient"].schema if f.name != "vaccinationstatus"]
    return merged.select(*cols, F.coalesce(F.col("_n"), F.lit(0)).cast("int").alias("vaccinationstatus"))


def ingest_workbook(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All twelve clean tables from an exported workbook (lazy)."""
    sheets = read_sheets(spark, root)
    tables = {SHEET_TABLE[s]: clean_sheet(s, df) for s, df in sheets.items()}
    tables["patient"] = patient_status(tables["patient"], tables["attends"])
    return tables
