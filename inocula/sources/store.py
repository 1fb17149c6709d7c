"""Table storage: load (append in key order / overwrite), read back, views.

A load writes each table as Parquet through Spark's committer into a folder
of its own, ``<root>/_loads/<run>/<table>``; what a table consists of is a
list of such folders.  The lists are one small file, ``<root>/_current/<n>``;
writing the next one is the only step that changes what readers see, for all
tables at once.  So a load that fails or is refused leaves the store as it
was, no data file is moved or deleted, and the audit reads the very folders
that readers will.  One writer at a time.
"""

from __future__ import annotations

import json
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.audit import audit_summary
from ..operators.core import literal_rows, union_all
from ..schema import LOAD_ORDER, TABLES
from ..session import ensure_checkpoint_dir


class AuditFailed(ValueError):
    """Raised by ``load_tables`` when a declared rule is violated."""


_publishing = threading.Lock()


def file_system(spark: SparkSession, path: str):
    """Hadoop FileSystem handle and Path class for ``path`` (any scheme the
    cluster is configured for: hdfs, s3a, abfs, file, ...)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, Path = file_system(spark, root)
    folder = Path(f"{root.rstrip('/')}/_current")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def current_folders(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Table -> the folders it consists of, as published last."""
    versions = _versions(spark, root)
    if not versions:
        return {}
    fs, Path = file_system(spark, root)
    stream = fs.open(Path(f"{root.rstrip('/')}/_current/{versions[-1]}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, change: Callable[[dict[str, list[str]]], dict[str, list[str]]]) -> None:
    """Make ``change(current folders)`` the current ones: one file, renamed into place."""
    with _publishing:
        folders = change(current_folders(spark, root))
        fs, Path = file_system(spark, root)
        base = f"{root.rstrip('/')}/_current"
        n = (_versions(spark, root) or [0])[-1] + 1
        draft = Path(f"{base}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(folders).encode())
        out.close()
        if not fs.rename(draft, Path(f"{base}/{n}")):
            raise OSError(f"could not publish version {n} of {root}")


def write_folder(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Write one table folder.  With ``partition_by`` (e.g. ``["date"]`` for
    the dated fact tables) rows are clustered by those columns first, so each
    partition directory gets few files, and filters on them prune whole
    directories when the table is read."""
    w = df.repartition(*partition_by).write.partitionBy(*partition_by) if partition_by else df.write
    w.mode("overwrite").parquet(path)


def _read_folders(spark: SparkSession, name: str, folders: Sequence[str]) -> DataFrame:
    # partition columns, which Parquet keeps in folder names, are put back in place
    schema = TABLES[name].schema
    return union_all([spark.read.schema(schema).parquet(p).select(*schema.fieldNames()) for p in folders])


def load_tables(
    tables: dict[str, DataFrame],
    root: str,
    mode: str = "append",
    audit: bool = True,
    ignore: Sequence[str] = (),
    parallel_writes: int = 12,
    partition_by: dict[str, Sequence[str]] | None = None,
) -> DataFrame | None:
    """Load the tables into ``root``: write, audit, publish.

    Each table is computed once.  With ``audit`` the declared keys and checks
    of the loaded tables are verified on the store as it would be after the
    load -- stored rows included when appending, so a key duplicated across
    loads is caught -- and nothing is published when a rule fails
    (``AuditFailed`` names the rules; the written files stay for inspection).
    Rule kinds in ``ignore`` (e.g. "length") are reported but do not block.
    ``partition_by`` maps table -> partition columns (e.g. ``{"diagnosis":
    ["date"]}``).  Returns the audit summary (or None).
    """
    names = [n for n in LOAD_ORDER if n in tables]
    if not names:
        return None
    spark = tables[names[0]].sparkSession
    run = f"{root.rstrip('/')}/_loads/{uuid.uuid4().hex}"
    # independent jobs: submit them together so small tables overlap
    with ThreadPoolExecutor(max_workers=min(len(names), parallel_writes)) as pool:
        list(pool.map(lambda n: write_folder(tables[n], f"{run}/{n}", (partition_by or {}).get(n)), names))

    def after(current: dict[str, list[str]]) -> dict[str, list[str]]:
        kept = {n: current.get(n, []) if mode == "append" else [] for n in names}
        return {**current, **{n: [*kept[n], f"{run}/{n}"] for n in names}}

    summary = None
    if audit:
        view = {n: _read_folders(spark, n, f) for n, f in after(current_folders(spark, root)).items()}
        found = audit_summary(view, names)
        # one row per declared rule (a few per table): safe to bring back
        rows = found.collect()
        summary = literal_rows(spark, [tuple(r) for r in rows], found.columns)
        failing = [r for r in rows if r["violations"] > 0 and r["rule"] not in set(ignore)]
        if failing:
            raise AuditFailed(
                "; ".join(f"{r['table']}.{r['rule']}({r['detail']})={r['violations']}" for r in failing)
                + f" [written to {run}]"
            )
    publish(spark, root, after)
    return summary


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema and column order."""
    folders = current_folders(spark, root).get(name)
    if not folders:
        raise FileNotFoundError(f"no stored table {name} under {root}")
    return _read_folders(spark, name, folders)


def read_tables(spark: SparkSession, root: str, names: Sequence[str] = LOAD_ORDER) -> dict[str, DataFrame]:
    """``SELECT * FROM t`` for every stored table, with the declared schema."""
    current = current_folders(spark, root)
    missing = [n for n in names if not current.get(n)]
    if missing:
        raise FileNotFoundError(f"no stored tables {missing} under {root}")
    return {n: _read_folders(spark, n, current[n]) for n in names}


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in the given order, numbered from 1 in ``position``
    (a top-n per task, then of those)."""
    top = df.orderBy(*order_by).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order_by)))


def register_views(tables: dict[str, DataFrame], extra: dict[str, DataFrame] | None = None) -> None:
    """Expose tables (and derived views such as the vaccination-status view)
    to ``spark.sql`` under their names."""
    for name, df in {**tables, **(extra or {})}.items():
        df.createOrReplaceTempView(name)


def with_row_index(df: DataFrame, name: str = "index", order_by: Sequence[str] | None = None) -> DataFrame:
    """Add a 0-based, gap-free row index without moving rows to one task.

    With ``order_by`` the rows are first sorted (a range-partitioned,
    distributed sort), so the index is the row's rank in that order.
    ``monotonically_increasing_id`` numbers rows inside each partition
    (partition id in the upper bits); a per-partition count -- one row per
    partition, so a bounded broadcast -- turns that into global offsets.  The
    numbered frame is checkpointed first (to the session's shared checkpoint
    folder) so both passes see the same rows in the same partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    src = df.orderBy(*order_by) if order_by else df
    base = src.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), 33)
    counts = base.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    return (
        base.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .select(
            (F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid"), 33)).alias(name),
            *[F.col(f"`{c}`") for c in df.columns],
        )
    )


def write_indexed(
    df: DataFrame, path: str, mode: str = "overwrite", index: str = "index", order_by: Sequence[str] | None = None
) -> None:
    """Overwrite ``path`` with the frame plus a 0-based ``index`` column."""
    with_row_index(df, index, order_by).write.mode(mode).parquet(path)
