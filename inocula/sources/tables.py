"""Catalogue tables: declared in DDL, bucketed by their key, written by Spark's own writer.

``create_tables`` declares the twelve tables in a database of the session's
catalogue (``CREATE TABLE IF NOT EXISTS ... USING parquet``), with the declared
types, over folders below ``root``.  The large tables are bucketed by
``ssno``: the rows of a person lie in one bucket of every table, so joins,
groupings and windows by person read the buckets and shuffle nothing.  The
bucket count is part of the folder's name, so a later session (or one without a
metastore) that declares the same layout finds the rows it can use.

Rows go in by ``INSERT``: append, or overwrite of the table or, where it is
partitioned, of just the partitions that the rows are in.  Every write is one
job of Spark's committer: it shows its files when the job has ended, and a lost
executor only runs tasks again.  ``append_rows`` checks keys against what is
stored before it writes; see ``append_violations``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bloom import key_filter, possibly_in
from ..operators.core import union_all
from ..schema import LOAD_ORDER, TABLES, TableSpec
from ..session import ensure_checkpoint_dir
from .store import file_system

BUCKETS = 16
# tables whose rows belong to a person
BY_PERSON: dict[str, tuple[str, ...]] = {"patient": ("ssno",), "attends": ("ssno",), "diagnosis": ("ssno",)}


# Session settings under which these tables are read without shuffles: sides that are
# dealt by a part of the join keys meet as they are, bucketed scans stay bucketed,
# and joins of the small tables are sized from their statistics.
READ_CONF = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.cbo.enabled": "true",
}


class KeysViolated(ValueError):
    """Raised by ``append_rows`` when rows break a declared key."""


def create_tables(
    spark: SparkSession,
    database: str,
    root: str,
    buckets: int = BUCKETS,
    bucket_by: Mapping[str, Sequence[str]] = BY_PERSON,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    names: Sequence[str] = LOAD_ORDER,
) -> PersonTables:
    """Declare the tables (kept if they are there) and return them."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name in names:
        parts, keys = list((partition_by or {}).get(name, ())), list(bucket_by.get(name, ()))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name].schema)
        told = ["USING parquet"]
        if parts:
            told.append(f"PARTITIONED BY ({', '.join(parts)})")
        if keys:
            told.append(f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS")
        folder = f"{root.rstrip('/')}/{name}" + (f"-{buckets}-by-{'-'.join(keys)}" if keys else "")
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) {' '.join(told)} LOCATION '{folder}'")
        fs, path = file_system(spark, folder)
        if parts and fs.exists(path(folder)):  # partitions that an earlier session wrote
            spark.sql(f"MSCK REPAIR TABLE `{database}`.`{name}`")
    return open_tables(spark, database, names)


class PersonTables(dict):
    """Tables of which the facts are bucketed by person: the event side of a join goes to
    them, if its size in the catalogue's statistics allows, rather than them to it."""

    most_event_bytes = 64 << 20


def open_tables(spark: SparkSession, database: str, names: Sequence[str] = LOAD_ORDER) -> PersonTables:
    """The declared tables, columns in declared order."""
    return PersonTables({n: spark.table(f"`{database}`.`{n}`").select(*TABLES[n].schema.fieldNames()) for n in names})


def _insert(spark: SparkSession, database: str, name: str, rows: DataFrame, overwrite: bool) -> None:
    table = f"{database}.{name}"
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    keys = [c.strip(" `") for c in described.get("Bucket Columns", "[]").strip("[]").split(",") if c.strip(" `")]
    order = [c for c in spark.table(table).columns]
    rows = rows.select(*order)
    if keys:
        # one task, so one file, per bucket
        rows = rows.repartition(int(described["Num Buckets"]), *keys)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.insertInto(table, overwrite=overwrite)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    # sizes for the planner: of the tables of a person's rows from the file system alone,
    # of the others (events, batches, vaccines, ...) with rows and distinct values
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS {'NOSCAN' if keys else 'FOR ALL COLUMNS'}")


def append_violations(spark: SparkSession, database: str, name: str, rows: DataFrame) -> DataFrame:
    """(rule, key) of rows that the declared keys refuse, from the rows and their possible matches.

    ``primary_key``: keys that are null, occur twice in the rows, or are stored
    already.  ``foreign_key(<columns>)``: references that no stored parent has.  Of
    the stored tables only the key columns are scanned, and what a Bloom filter
    of the appended keys lets through goes on: the shuffles and joins are of the
    size of the load, not of the history.
    """
    spec: TableSpec = TABLES[name]
    stored = open_tables(spark, database)
    told = lambda cols: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])
    key = list(spec.primary_key)
    keys = rows.select(*key)
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    twice = keys.where(~null).groupBy(*key).count().where("count > 1").select(*key)
    again = keys.where(~null).distinct().join(_matches(stored[name].select(*key), keys, key), key, "left_semi")
    found = [part.select(F.lit("primary_key").alias("rule"), told(key).alias("key")) for part in (keys.where(null), twice, again)]
    for fk in spec.foreign_keys:
        own, parent_cols = list(fk.columns), list(fk.parent_columns)
        refs = rows.select(*own).dropna().distinct().toDF(*[f"r{i}" for i in range(len(own))])
        names = refs.columns
        parent = stored[fk.parent].select(*parent_cols).toDF(*names)
        missing = refs.join(_matches(parent, refs, names).distinct(), names, "left_anti")
        found.append(missing.select(F.lit(f"foreign_key({','.join(own)})").alias("rule"), told(names).alias("key")))
    return union_all(found).distinct()


def _matches(stored: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``stored`` that may have one of ``keys``."""
    bits = key_filter(keys, on)
    return stored if bits is None else possibly_in(stored, on, bits)


def append_rows(spark: SparkSession, database: str, name: str, rows: DataFrame, check: bool = True) -> None:
    """Append; with ``check`` nothing is written if a declared key is broken (``KeysViolated``)."""
    path = f"{ensure_checkpoint_dir(spark)}/append-{uuid.uuid4().hex}"
    rows.select(*TABLES[name].schema.fieldNames()).write.parquet(path)  # computed once, checked and inserted
    staged = spark.read.schema(TABLES[name].schema).parquet(path)
    if check:
        bad = append_violations(spark, database, name, staged).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()
        if bad:
            raise KeysViolated("; ".join(f"{name}.{r['rule']}={r['n']}" for r in sorted(bad, key=lambda r: r["rule"])))
    _insert(spark, database, name, staged, overwrite=False)


def replace_rows(spark: SparkSession, database: str, name: str, rows: DataFrame) -> None:
    """Overwrite the table; of a partitioned one the partitions that the rows are in."""
    _insert(spark, database, name, rows, overwrite=True)
