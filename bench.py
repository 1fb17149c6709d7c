"""Benchmark: ingest once, then every report and operator run.

    BENCH_SF_DIR   testdata folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] (default 8)
    BENCH_REPEAT   runs per query, best kept (default 2)
    BENCH_ONLY     comma-separated query names (default: all)
    BENCH_EVENTLOG 1 -> write Spark's event log into the scratch folder
    BENCH_SHUFFLE_PARTITIONS  initial shuffle partitions (default 2 x cpus;
                   AQE coalesces small ones at runtime)
    BENCH_CONF     extra Spark settings, "key=value,key=value" (tuning runs)

Phases, each timed:
  ingest   derive the twelve campaign tables from the testdata, audit keys
           and checks, write them as Parquet (what loading the database is)
  <report> each catalogue/task/chart report over the stored tables
  <run>    each operator run over the raw testdata tables
Every query is fully executed into Spark's no-op sink (no rows collected).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from inocula.plans.registry import SOURCE_RUNS, TABLE_REPORTS  # noqa: E402
from inocula.session import build_session  # noqa: E402
from inocula.sources.derived import derived_tables  # noqa: E402
from inocula.sources.store import load_tables, read_tables  # noqa: E402


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, repeat: int) -> float:
    best = float("inf")
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        best = min(best, time.perf_counter() - t0)
    return best


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    scratch = tempfile.mkdtemp(prefix="inocula-bench-")
    extra = dict(kv.split("=", 1) for kv in os.environ.get("BENCH_CONF", "").split(",") if "=" in kv)
    if os.environ.get("BENCH_EVENTLOG") == "1":
        os.makedirs(f"{scratch}/events", exist_ok=True)
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{scratch}/events"})
    spark = build_session(
        app="inocula-bench", cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus))), driver_memory="16g", extra=extra
    )

    # warm the JVM (class loading, codegen caches) on an untimed scan
    run_noop(spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count())

    times: dict[str, float] = {}
    store = f"{scratch}/db"
    t0 = time.perf_counter()
    # derived ids are longer than the declared char(n) widths by construction,
    # and some attendees are no patients, so those findings are reported, not blocking
    load_tables(derived_tables(spark, sf_dir), store, mode="overwrite", audit=True, ignore=("length", "foreign_key"))
    times["ingest"] = time.perf_counter() - t0

    tables = read_tables(spark, store)
    for name, fn in TABLE_REPORTS.items():
        if only and name not in only:
            continue
        times[name] = timed(lambda fn=fn: run_noop(fn(tables)), repeat)
    for name, fn in SOURCE_RUNS.items():
        if only and name not in only:
            continue
        times[name] = timed(lambda fn=fn: run_noop(fn(spark, sf_dir)), repeat)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
