"""What a task or a row holds stays the same size when the tables grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from inocula.operators import distinct_bitmaps, distinct_counts, number_values, roll_up
from inocula.plans import loading


def test_small_groups_over_many_values_take_a_word_a_value(spark):
    n = 70_000  # numbers beyond one block of 32,768
    df = spark.range(n).select((F.col("id") % 20_000).alias("g"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("x"))
    df = df.unionByName(df.limit(100)).unionByName(spark.createDataFrame([(1, None), (None, "P5")], "g long, x string"))
    fine = distinct_bitmaps(df, ["g"], "x", number_values(df, "x"))
    assert fine.schema["bits"].dataType.simpleString() == "bigint"
    assert fine.count() <= n + 1
    want = {g: 4 if g < 10_000 else 3 for g in range(20_000)} | {None: 1}
    assert {r["g"]: r["distinct"] for r in distinct_counts(fine, ["g"]).collect()} == want
    whole = roll_up(fine, [F.lit(1).alias("all")])
    assert [r["distinct"] for r in distinct_counts(whole, ["all"]).collect()] == [n]


def tiny_tables(spark, folder: str) -> str:
    """A few rows of the raw tables that the doses and diagnoses come from."""
    n = spark.range(60)
    k = F.col("id")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (k * 11).cast("int"))
    raw = {
        "region": spark.range(5).select(k.alias("r_regionkey"), F.concat(F.lit("R"), k).alias("r_name")),
        "nation": spark.range(25).select(k.alias("n_nationkey"), F.concat(F.lit("N"), k).alias("n_name"), (k % 5).alias("n_regionkey")),
        "supplier": spark.range(4).select(k.alias("s_suppkey"), F.concat(F.lit("F"), k).alias("s_name"), k.alias("s_nationkey")),
        "part": spark.range(30).select(k.alias("p_partkey"), (k + 1).alias("p_size")),
        "orders": n.select(
            k.alias("o_orderkey"),
            (k % 12).alias("o_custkey"),
            F.when(k % 3 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"),
            F.lit("F").alias("o_orderstatus"),
            day.alias("o_orderdate"),
        ),
        "lineitem": n.select(
            k.alias("l_orderkey"), (k % 30).alias("l_partkey"), (k % 4).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), day.alias("l_shipdate")
        ),
    }
    for name, df in raw.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_buckets_follow_the_load(spark, monkeypatch, scratch):
    sf_dir = tiny_tables(spark, scratch)
    run = loading.BUCKETED[2]
    before = sorted(run(spark, sf_dir).collect())
    assert before and loading._buckets(spark, sf_dir) == loading.BUCKETS
    monkeypatch.setattr(loading, "BUCKET_BYTES", 100)
    n = loading._buckets(spark, sf_dir)
    assert n > loading.BUCKETS
    database = loading._declared(spark, sf_dir, names=["attends"])
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {database}.attends").collect()}
    assert int(told["Num Buckets"]) == n
    assert sorted(run(spark, sf_dir).collect()) == before
