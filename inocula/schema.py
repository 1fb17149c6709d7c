"""The twelve campaign tables: typed schemas plus their keys and value rules.

Constraints are data, not enforcement: ``operators.audit`` turns each entry
into a Spark job that returns the violating rows (the database the reference
targets rejects them at insert time instead).  All names are lower case.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DateType()


def _st(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    """A CHECK rule: ``column`` must be in [lo, hi] (``values`` if given)."""

    column: str
    lo: int | None = None
    hi: int | None = None
    values: tuple[int, ...] | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    # declared char(n)/varchar(n) widths, audited (not enforced)
    max_length: dict[str, int] = field(default_factory=dict)
    # columns declared char(n): the database pads/ignores trailing blanks,
    # Spark compares them literally, so ingest right-trims them
    char_columns: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()


def _fk(cols, parent, pcols) -> ForeignKey:
    return ForeignKey(tuple(cols), parent, tuple(pcols))


# The declared schema of the campaign database (types, keys,
# CHECK ranges and declared string widths), in declaration order.
TABLES: dict[str, TableSpec] = {
    "vaccine": TableSpec(
        "vaccine",
        _st(("id", S), ("name", S), ("dosage", I), ("tempmin", I), ("tempmax", I)),
        ("id",),
        checks=(Check("dosage", 1, 2),),
        max_length={"id": 4, "name": 20},
        char_columns=("id",),
    ),
    "manufacturer": TableSpec(
        "manufacturer",
        _st(("id", S), ("phone", S), ("country", S), ("vaccineid", S)),
        ("id",),
        foreign_keys=(_fk(["vaccineid"], "vaccine", ["id"]),),
        max_length={"id": 3, "phone": 20, "country": 20, "vaccineid": 4},
        char_columns=("id", "vaccineid"),
    ),
    "healthcarefacility": TableSpec(
        "healthcarefacility",
        _st(("name", S), ("address", S), ("phone", S)),
        ("name",),
        max_length={"name": 255, "address": 100, "phone": 20},
    ),
    "batch": TableSpec(
        "batch",
        _st(
            ("id", S),
            ("numberofvaccines", I),
            ("manufacturerid", S),
            ("manufactureddate", D),
            ("healthcarefacilityname", S),
            ("expirydate", D),
        ),
        ("id",),
        foreign_keys=(
            _fk(["manufacturerid"], "manufacturer", ["id"]),
            _fk(["healthcarefacilityname"], "healthcarefacility", ["name"]),
        ),
        max_length={"id": 4, "manufacturerid": 3, "healthcarefacilityname": 255},
        char_columns=("id", "manufacturerid"),
    ),
    "staff": TableSpec(
        "staff",
        _st(
            ("ssno", S),
            ("name", S),
            ("birthday", D),
            ("phone", S),
            ("role", S),
            ("vaccinationstatus", I),
            ("healthcarefacilityname", S),
        ),
        ("ssno",),
        foreign_keys=(_fk(["healthcarefacilityname"], "healthcarefacility", ["name"]),),
        checks=(Check("vaccinationstatus", 0, 1),),
        max_length={
            "ssno": 20,
            "name": 255,
            "phone": 255,
            "role": 255,
            "healthcarefacilityname": 255,
        },
    ),
    "shift": TableSpec(
        "shift",
        _st(("workday", I), ("ssno", S)),
        ("workday", "ssno"),
        foreign_keys=(_fk(["ssno"], "staff", ["ssno"]),),
        checks=(Check("workday", values=(1, 2, 3, 4, 5, 6, 7)),),
        max_length={"ssno": 20},
    ),
    "transportationlog": TableSpec(
        "transportationlog",
        _st(
            ("batchid", S),
            ("fromlocation", S),
            ("tolocation", S),
            ("departuredate", D),
            ("arrivaldate", D),
        ),
        ("fromlocation", "batchid", "departuredate"),
        foreign_keys=(
            _fk(["batchid"], "batch", ["id"]),
            _fk(["fromlocation"], "healthcarefacility", ["name"]),
            _fk(["tolocation"], "healthcarefacility", ["name"]),
        ),
        max_length={"batchid": 4, "fromlocation": 255, "tolocation": 255},
        char_columns=("batchid",),
    ),
    "patient": TableSpec(
        "patient",
        _st(("ssno", S), ("name", S), ("birthday", D), ("gender", S), ("vaccinationstatus", I)),
        ("ssno",),
        checks=(Check("vaccinationstatus", values=(0, 1, 2)),),
        max_length={"ssno": 20, "name": 255, "gender": 1},
        char_columns=("gender",),
    ),
    "vaccination": TableSpec(
        "vaccination",
        _st(("date", D), ("healthcarefacilityname", S), ("batchid", S)),
        ("date", "healthcarefacilityname"),
        foreign_keys=(
            _fk(["healthcarefacilityname"], "healthcarefacility", ["name"]),
            _fk(["batchid"], "batch", ["id"]),
        ),
        max_length={"healthcarefacilityname": 255, "batchid": 4},
        char_columns=("batchid",),
    ),
    "attends": TableSpec(
        "attends",
        _st(("date", D), ("healthcarefacilityname", S), ("ssno", S)),
        ("date", "healthcarefacilityname", "ssno"),
        foreign_keys=(
            _fk(["ssno"], "patient", ["ssno"]),
            _fk(["date", "healthcarefacilityname"], "vaccination", ["date", "healthcarefacilityname"]),
        ),
        max_length={"healthcarefacilityname": 255, "ssno": 20},
    ),
    "symptoms": TableSpec(
        "symptoms",
        _st(("name", S), ("criticality", I)),
        ("name",),
        checks=(Check("criticality", 0, 1),),
        max_length={"name": 100},
        not_null=("name",),
        unique=(("name",),),
    ),
    "diagnosis": TableSpec(
        "diagnosis",
        _st(("ssno", S), ("symptom", S), ("date", D)),
        ("ssno", "symptom", "date"),
        foreign_keys=(
            _fk(["ssno"], "patient", ["ssno"]),
            _fk(["symptom"], "symptoms", ["name"]),
        ),
        max_length={"ssno": 20, "symptom": 100},
    ),
}

# Parents before children: the order in which the tables are appended.
LOAD_ORDER: tuple[str, ...] = (
    "vaccine",
    "manufacturer",
    "healthcarefacility",
    "batch",
    "staff",
    "shift",
    "transportationlog",
    "patient",
    "vaccination",
    "attends",
    "symptoms",
    "diagnosis",
)

TABLE_NAMES: tuple[str, ...] = LOAD_ORDER


def schema_of(name: str) -> T.StructType:
    return TABLES[name].schema
