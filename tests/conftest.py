from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from inocula.schema import TABLES  # noqa: E402
from inocula.session import DEFAULT_CONF, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    b = SparkSession.builder.master("local[*]").appName("inocula-tests").config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.config("spark.driver.memory", "8g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="inocula-test-", dir="/tmp")


def d(s: str | None):
    return None if s is None else dt.date.fromisoformat(s)


def make_tables(spark, **rows):
    """The twelve tables from hand-made rows (tuples in declared column
    order); unspecified tables are empty."""
    return {
        name: spark.createDataFrame(rows.get(name, []), schema=spec.schema) for name, spec in TABLES.items()
    }


def base_rows():
    """A tiny consistent campaign: two vaccines (dosage 1 and 2), two
    facilities, batches, and events."""
    return dict(
        vaccine=[("V1", "One", 1, -10, 0), ("V2", "Two", 2, -20, 0)],
        manufacturer=[("M1", "1", "FI", "V1"), ("M2", "2", "SE", "V2")],
        healthcarefacility=[("H1", "a", "040-1"), ("H2", "b", "040-2"), ("H3", "c", "040-3")],
        batch=[
            ("B1", 10, "M1", d("2021-01-01"), "H1", d("2022-01-01")),
            ("B2", 20, "M2", d("2021-01-01"), "H2", d("2022-01-01")),
        ],
        vaccination=[
            (d("2021-05-03"), "H1", "B1"),
            (d("2021-05-03"), "H2", "B2"),
            (d("2021-05-10"), "H1", "B1"),
            (d("2021-05-10"), "H2", "B2"),
        ],
        symptoms=[("fever", 0), ("rash", 1)],
    )


def rows_of(df, order=None):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r)) if order is None else out
