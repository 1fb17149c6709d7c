from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import d
from inocula.functions import (
    age_band,
    age_years,
    coerce_date,
    criticality_label,
    iso_weekday,
    month_name,
    rate_words,
    round_half_even,
    same_weekday,
    sentence,
    weekday_number,
)


def one_col(spark, values, dtype):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", dtype, True)]))


def test_age_years_leap_day(spark):
    df = one_col(spark, [d("2000-02-29")], T.DateType())
    got = df.select(age_years("x", "2021-02-28").alias("a"), age_years("x", "2021-03-01").alias("b")).first()
    assert (got.a, got.b) == (20, 21)


def test_age_years_null_birthday(spark):
    df = one_col(spark, [None], T.DateType())
    assert df.select(age_years("x", "2021-05-15").alias("a")).first().a is None


def test_age_band_edges_and_null(spark):
    df = one_col(spark, [0, 10, 11, 20, 40, 60, 61, None], T.IntegerType())
    got = [r.b for r in df.select(age_band("x").alias("b")).collect()]
    assert got == ["0-10", "0-10", "10-20", "10-20", "20-40", "40-60", "60+", "60+"]


def test_same_weekday_sunday_and_monday(spark):
    # 2021-05-09 is a Sunday, 2021-05-10 a Monday
    df = spark.createDataFrame(
        [(7, d("2021-05-09")), (1, d("2021-05-09")), (1, d("2021-05-10")), (0, d("2021-05-09")), (8, d("2021-05-10"))],
        "w int, dt date",
    )
    got = [r.m for r in df.select(same_weekday("w", "dt").alias("m")).collect()]
    assert got == [True, False, True, True, True]
    iso = [r.i for r in df.select(iso_weekday("dt").alias("i")).collect()]
    assert iso == [7, 7, 1, 7, 1]


def test_weekday_number_unknown_is_null(spark):
    df = one_col(spark, ["Monday", "Sunday", "Funday", None], T.StringType())
    assert [r.n for r in df.select(weekday_number("x").alias("n")).collect()] == [1, 7, None, None]


def test_coerce_date_repairs_impossible_and_null(spark):
    df = one_col(spark, ["2021-02-29", None, "2021-05-10", "garbage", "2021-05-10 00:00:00", "2021-02-30 10:00:00"], T.StringType())
    got = [r.v for r in df.select(coerce_date("x").alias("v")).collect()]
    assert got == [d("2021-02-28"), d("2021-02-28"), d("2021-05-10"), d("2021-02-28"), d("2021-05-10"), d("2021-02-28")]
    raw = [r.v for r in df.select(coerce_date("x", fill=None).alias("v")).collect()]
    assert raw == [None, None, d("2021-05-10"), None, d("2021-05-10"), None]


def test_round_half_even_like_numpy(spark):
    import numpy as np

    vals = [0.045, 0.125, 0.575, 0.005, 0.015, 1.0 / 3.0]
    df = one_col(spark, vals, T.DoubleType())
    got = [r.v for r in df.select(round_half_even("x", 2).alias("v")).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]
    assert got[:3] == [0.04, 0.12, 0.57]


def test_rate_words_on_rounded_values(spark):
    df = one_col(spark, [0.1, 0.05, 0.01, 0.004, None, float("nan"), 0.0], T.DoubleType())
    got = [r.w for r in df.select(rate_words(round_half_even("x", 2)).alias("w")).collect()]
    assert got == ["very common", "common", "rare", "-", "-", "-", "-"]


def test_month_name_and_criticality(spark):
    df = spark.createDataFrame([(d("2021-07-03"), 1), (d("2021-01-01"), 0), (d("2021-12-31"), 5)], "dt date, c int")
    got = df.select(month_name("dt").alias("m"), criticality_label("c").alias("c")).collect()
    assert [(r.m, r.c) for r in got] == [("July", "Critical"), ("January", "Non-Critical"), ("December", None)]


def test_sentence(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "xs array<string>")
    assert df.select(sentence("xs").alias("s")).first().s == "a, b, c."
    assert df.select(sentence(F.slice("xs", 1, 1)).alias("s")).first().s == "a."
