"""Command line entry for cluster runs (``spark-submit -m inocula ...`` or
``python -m inocula ...``).

    ingest  --export DIR --store DIR [--mode append|overwrite] [--partition-dates]
    audit   --store DIR [--out DIR]
    report  --store DIR --out DIR [--names q1_staff_on_duty,...] [--set key=value ...]

Reports are written as Parquet folders under ``--out`` (one per report);
nothing is collected to the driver except with ``--show N`` (a preview).
"""

from __future__ import annotations

import argparse
import dataclasses
import inspect
import sys

from pyspark.sql import SparkSession

from .operators import audit_summary
from .plans.params import TESTDATA, Params
from .plans.registry import TABLE_REPORTS
from .session import cluster_conf, ensure_checkpoint_dir
from .sources.store import load_tables, read_tables
from .sources.workbook import ingest_workbook

DATED_FACTS = {"diagnosis": ["date"], "attends": ["date"], "vaccination": ["date"]}


def _session(input_bytes: int, executors: int, cores: int) -> SparkSession:
    """The platform's session.  The cluster profile fills in what the
    submitted settings leave open; it never replaces one of them."""
    spark = SparkSession.builder.appName("inocula").getOrCreate()
    submitted = dict(spark.sparkContext.getConf().getAll())
    for k, v in cluster_conf(input_bytes, executors, cores).items():
        if k.startswith("spark.sql.") and k not in submitted and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def _params(pairs: list[str]) -> Params:
    fields = {f.name: f for f in dataclasses.fields(Params)}
    values = {}
    for pair in pairs:
        key, _, raw = pair.partition("=")
        if key not in fields:
            raise SystemExit(f"unknown parameter {key}; known: {', '.join(fields)}")
        current = getattr(TESTDATA, key)
        if isinstance(current, tuple):
            values[key] = tuple(x for x in raw.split(",") if x)
        elif isinstance(current, int):
            values[key] = int(raw)
        else:
            values[key] = raw
    return dataclasses.replace(TESTDATA, **values)


# The parameters that a report reads: it is refused while one is not given.
READS = {
    "q1_staff_on_duty": ("event_date", "event_workday"),
    "q2_doctors_on_day": ("doctor_workday", "doctor_role", "facilities"),
    "q4_critical_after": ("diagnosed_after",),
    "t3_top_symptoms": ("genders", "top_k"),
    "t3_top_symptoms_text": ("genders", "top_k"),
    "t4_age_groups": ("as_of",),
    "t6_status_share_long": ("as_of",),
    "t6_status_share": ("as_of",),
    "t7c_symptom_vaccine_counts": ("vaccines",),
    "t7d_symptom_vaccine_rates": ("vaccines",),
    "t7e_symptom_vaccine_words": ("vaccines",),
    "t10_staff_met": ("ill_staff", "range_start", "range_end"),
    "t10_patients_met": ("ill_staff", "range_start", "range_end"),
    "t10_contacts": ("ill_staff", "range_start", "range_end"),
}


def _require(names: list[str], pairs: list[str]) -> None:
    given = {p.partition("=")[0] for p in pairs}
    missing = {n: [k for k in READS.get(n, ()) if k not in given] for n in names}
    missing = {n: ks for n, ks in missing.items() if ks}
    if missing:
        raise SystemExit("; ".join(f"{n} needs --set {', '.join(ks)}" for n, ks in missing.items()))


def _run_report(name: str, tables, params: Params):
    fn = TABLE_REPORTS[name]
    return fn(tables, params) if "p" in inspect.signature(fn).parameters else fn(tables)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="inocula")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest", help="clean an exported workbook and load it into the store")
    a.add_argument("--export", required=True)
    a.add_argument("--store", required=True)
    a.add_argument("--mode", choices=["append", "overwrite"], default="append")
    a.add_argument("--partition-dates", action="store_true", help="partition dated fact tables by date")
    a.add_argument("--ignore", default="", help="comma-separated rule kinds that do not block the load")
    b = sub.add_parser("audit", help="count violations of every declared rule")
    b.add_argument("--store", required=True)
    b.add_argument("--out")
    c = sub.add_parser("report", help="write reports as Parquet")
    c.add_argument("--store", required=True)
    c.add_argument("--out")
    c.add_argument("--names", default=",".join(TABLE_REPORTS))
    c.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    c.add_argument("--show", type=int, default=0, help="print the first N rows instead of writing")
    for x in (a, b, c):
        x.add_argument("--input-bytes", type=int, default=0, help="size of the input: sets the shuffle partitions")
        x.add_argument("--executors", type=int, default=2)
        x.add_argument("--cores", type=int, default=4, help="cores of an executor")
    args = ap.parse_args(argv)
    if args.cmd == "report":
        _require([n for n in args.names.split(",") if n], args.set)

    spark = _session(args.input_bytes, args.executors, args.cores)
    if args.cmd == "ingest":
        summary = load_tables(
            ingest_workbook(spark, args.export),
            args.store,
            mode=args.mode,
            ignore=[x for x in args.ignore.split(",") if x],
            partition_by=DATED_FACTS if args.partition_dates else None,
        )
        if summary is not None:
            summary.where("violations > 0").show(200, truncate=False)
        return 0
    tables = read_tables(spark, args.store)
    if args.cmd == "audit":
        summary = audit_summary(tables)
        if args.out:
            summary.write.mode("overwrite").parquet(args.out)
        else:
            summary.show(500, truncate=False)
        return 0
    params = _params(args.set)
    for name in [n for n in args.names.split(",") if n]:
        if name not in TABLE_REPORTS:
            raise SystemExit(f"unknown report {name}")
        df = _run_report(name, tables, params)
        if args.show:
            print(f"== {name}")
            df.show(args.show, truncate=False)
        elif args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        else:
            raise SystemExit("report needs --out or --show")
    return 0


if __name__ == "__main__":
    sys.exit(main())
