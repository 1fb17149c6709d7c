"""Hot-key demonstration: a third of the orders re-keyed to one customer.

Times ``count_prior_pairs`` against the plain pair join it replaces
(``a.k = b.k AND a.d <= b.d``, then grouped), on the same data, and checks
that both give the same counts.

usage: python tools/skew_demo.py [SF_DIR] [naive_timeout_sec]   (0 skips the plain joins)
"""

from __future__ import annotations

import os
import sys
import threading
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from pyspark.sql import Window  # noqa: E402

from inocula.operators import count_prior_pairs, latest_prior  # noqa: E402
from inocula.session import build_session  # noqa: E402


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.1"
    limit = float(argv[1]) if len(argv) > 1 else 600
    spark = build_session(shuffle_partitions=16)
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")).alias("k"),
        F.col("o_orderdate").cast("date").alias("d"),
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
    )
    n, hot = o.count(), o.where("k = 0").count()
    print(f"rows {n}, hot key rows {hot} ({hot / n:.0%}), hot-key pairs ~{hot * hot / 2:.2e}")

    t0 = time.time()
    fast = {tuple(r[:2]): r[2] for r in count_prior_pairs(o, o, "k", "d", "d", "o_orderpriority", "o_orderstatus", "n").collect()}
    t1 = time.time()
    print(f"count_prior_pairs: {t1 - t0:.1f} s, {sum(fast.values()):,} pairs counted")
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    t0 = time.time()
    cols = count_prior_pairs(o, o, "k", "d", "d", "o_orderpriority", "o_orderstatus", "n", labels=priorities)
    by_cols = {tuple(r[:2]): r[2] for r in cols.collect()}
    print(f"count_prior_pairs, one column per label: {time.time() - t0:.1f} s, same counts: {by_cols == fast}")
    if limit <= 0:
        return

    a, b = o.alias("a"), o.alias("b")
    naive = (
        a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.d") <= F.col("b.d")))
        .groupBy(F.col("a.o_orderpriority"), F.col("b.o_orderstatus"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    result = {}

    def run():
        result["rows"] = naive.collect()

    spark.sparkContext.setJobGroup("naive", "plain pair join")
    t2 = time.time()
    th = threading.Thread(target=run, daemon=True)
    th.start()
    th.join(limit)
    t3 = time.time()
    if th.is_alive():
        spark.sparkContext.cancelJobGroup("naive")
        print(f"plain pair join: not finished after {limit:.0f} s (cancelled)")
    else:
        slow = {tuple(r[:2]): r[2] for r in result["rows"]}
        print(f"plain pair join: {t3 - t2:.1f} s, same counts: {slow == fast}")


    # as-of: for each urgent order, the latest low-priority order on or before
    low = o.where("o_orderpriority = '5-LOW'").select("k", "d", F.col("o_orderkey").alias("prior"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "k", "d")
    t4 = time.time()
    got = {r[0]: r[1] for r in latest_prior(low, urgent, "k", "d", "d", ["prior"], ["prior"]).select("o_orderkey", "prior").collect()}
    t5 = time.time()
    print(f"latest_prior: {t5 - t4:.1f} s, {len(got):,} urgent orders resolved")
    w = Window.partitionBy("u.o_orderkey").orderBy(F.desc("l.d"), F.asc("l.prior"))
    plain = (
        urgent.alias("u")
        .join(low.alias("l"), (F.col("u.k") == F.col("l.k")) & (F.col("l.d") <= F.col("u.d")))
        .withColumn("rn", F.row_number().over(w))
        .where("rn = 1")
        .select("u.o_orderkey", "l.prior")
    )
    t6 = time.time()
    want = {r[0]: r[1] for r in plain.collect()}
    print(f"join + row_number: {time.time() - t6:.1f} s, same answers: {want == got}")


if __name__ == "__main__":
    main(sys.argv[1:])
