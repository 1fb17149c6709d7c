"""The audit of all tables and the derivation before it: the same rows, by steps that stay cheap on larger tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import d, make_tables, rows_of
from inocula.operators import audit, audit_summary
from inocula.schema import TABLES
from inocula.sources import derived


@pytest.fixture()
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def campaign(spark):
    day, other = d("2021-05-03"), d("2021-05-04")
    return make_tables(
        spark,
        healthcarefacility=[("H1", "a", "1"), ("H1", "a", "1"), (None, "b", "2")],
        patient=[("P1", "x", None, "F", 0), ("P2", "y", None, "M", 1)],
        vaccination=[(day, "H1", "B1"), (day, "H1", "B1"), (other, None, "B1"), (None, "H1", "B1")],
        attends=[(day, "H1", "P1")] * 3
        + [(day, "H1", "P2"), (other, "H1", "P1"), (other, "H1", "P9"), (other, "H1", "P9")]
        + [(None, "H1", "P1"), (None, "H1", "P1"), (day, None, "P1"), (day, "H1", None)],
        diagnosis=[("P1", "fever", day), ("P1", "fever", day), ("P1", "fever", other), (None, "fever", day)],
        symptoms=[("fever", 0), (None, 1), (None, 1)],
    )


@pytest.mark.parametrize("words", [1, 1 << 14])
def test_key_rules_count_as_their_rows_do(spark, monkeypatch, no_broadcast, words):
    monkeypatch.setattr(audit, "SUSPECT_WORDS", words, raising=False)
    t = campaign(spark)
    got = {(r.table, r.rule, r.detail): r.violations for r in audit_summary(t).collect()}
    for name in TABLES:
        want = {(name, *rule): df.count() for rule, df in audit.violations(t, name).items()}
        assert {k: got[k] for k in want} == want
    assert got[("attends", "primary_key_duplicate", "date,healthcarefacilityname,ssno")] == 2
    assert got[("attends", "foreign_key", "date,healthcarefacilityname->vaccination")] == 3
    assert got[("attends", "foreign_key", "ssno->patient")] == 2


def test_only_rows_of_repeated_hashes_are_grouped_by_their_key(spark):
    key = list(TABLES["attends"].primary_key)
    t = spark.range(5000).select(
        F.lit(d("2021-05-03")).alias("date"), F.concat(F.lit("H"), F.col("id") % 7).alias(key[1]), F.concat(F.lit("P"), "id").alias(key[2])
    )
    assert audit._suspect_rows(t, key).count() == 0
    twice = t.unionByName(t.where("ssno IN ('P7', 'P8')"))
    assert 4 <= audit._suspect_rows(twice, key).count() < 50
    assert rows_of(audit.duplicate_keys(audit._suspect_rows(twice, key), key)) == rows_of(audit.duplicate_keys(twice, key))


def test_references_are_collapsed_before_they_meet_the_parent(spark, no_broadcast):
    t = campaign(spark)
    text = plan(audit._orphan_rows(t["attends"], t["patient"], ["ssno"], ["ssno"]))
    join = text.splitlines()
    at = next(i for i, line in enumerate(join) if "Join" in line)
    below = [line for line in join[at + 1 :] if "Aggregate" in line]
    assert len(below) == 2, text  # the references and the parent's keys, each grouped below the join


def raw_tables(spark, folder: str) -> str:
    """Repeated and null names and keys, keys without a partner, negative customers."""
    day = "CAST(date_add(DATE'1995-01-01', CAST(id * 7 % 100 AS INT)) AS TIMESTAMP)"
    for name, rows, cols in (
        ("supplier", 12, "IF(id = 11, NULL, id % 10) s_suppkey, IF(id % 5 = 3, NULL, concat('F', id % 7 % 4 * 3)) s_name, id % 3 s_nationkey"),
        ("orders", 400, "IF(id % 50 = 1, NULL, id % 390) o_orderkey, IF(id % 40 = 2, NULL, id - 150) o_custkey"),
        (
            "lineitem",
            3000,
            f"IF(id % 60 = 3, NULL, id % 410) l_orderkey, IF(id % 70 = 4, NULL, id % 9) l_partkey, IF(id % 80 = 5, NULL, id % 13) l_suppkey,"
            f" IF(id % 90 = 6, NULL, CAST(id % 6 AS INT)) l_linenumber, IF(id % 55 = 7, NULL, {day}) l_shipdate",
        ),
    ):
        spark.range(rows).selectExpr(*[f"{c}" for c in split(cols)]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def split(cols: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(cols):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(cols[last:i])
            last = i + 1
    return [*out, cols[last:]]


PLAIN = {
    "vaccination": """
        SELECT CAST(trunc(CAST(l_shipdate AS DATE), 'month') AS DATE), s_name, concat('B', min(l_partkey))
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "attends": """
        SELECT DISTINCT CAST(trunc(CAST(l_shipdate AS DATE), 'month') AS DATE), s_name,
          CASE WHEN o_custkey % 97 = 1 THEN concat('X', o_custkey) ELSE concat('P', o_custkey - o_custkey % 2) END
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "transportationlog": """
        SELECT concat('B', l_partkey), f.s_name, min(t.s_name), CAST(l_shipdate AS DATE),
          min(date_add(CAST(l_shipdate AS DATE), CAST(l_orderkey % 3 AS INT)))
        FROM lineitem JOIN supplier f ON l_suppkey = f.s_suppkey
        JOIN supplier t ON (l_suppkey + l_linenumber) % (SELECT count(*) FROM supplier) = t.s_suppkey
        GROUP BY l_partkey, f.s_name, CAST(l_shipdate AS DATE)""",
}


def test_tables_by_numbered_names_are_those_by_names(spark, scratch, monkeypatch):
    folder = raw_tables(spark, scratch)
    for n in ("supplier", "orders", "lineitem"):
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
    for ranges in (64, 2):
        monkeypatch.setattr(derived, "NAME_RANGES", ranges, raising=False)
        t = derived.derived_tables(spark, folder)
        for name, sql in PLAIN.items():
            assert rows_of(t[name]) == rows_of(spark.sql(sql)), name


def test_trips_are_grouped_without_sorting_the_lines(spark, scratch):
    trips = derived.derived_tables(spark, raw_tables(spark, scratch))["transportationlog"]
    text = trips._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in text.splitlines() if "Aggregate" in line and "l_partkey" in line and "min(" in line]
    assert grouped and all("HashAggregate" in line for line in grouped), text
