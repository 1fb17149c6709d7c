"""Data-quality audits: the schema's integrity rules as Spark jobs.

The database behind the reference rejects a violating insert; here each rule
returns the violating rows instead (so a whole load can be audited in one
pass and the offending rows inspected).  NULL semantics follow SQL: a NULL
foreign-key part or a NULL checked value is not a violation; NULLs are not
duplicates for UNIQUE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TABLES, Check, TableSpec
from .core import literal_rows, union_all


def _any_null(cols: Sequence[str]):
    cond = None
    for c in cols:
        e = F.col(c).isNull()
        cond = e if cond is None else cond | e
    return cond


def _all_not_null(cols: Sequence[str]):
    cond = None
    for c in cols:
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    return cond


def duplicate_keys(df: DataFrame, keys: Sequence[str], alias: str = "n") -> DataFrame:
    """Key values occurring more than once (rows with a NULL part excluded)."""
    ks = list(keys)
    return (
        df.where(_all_not_null(ks))
        .groupBy(*ks)
        .agg(F.count(F.lit(1)).alias(alias))
        .where(F.col(alias) > 1)
    )


def null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any primary-key column."""
    return df.where(_any_null(list(keys)))


def foreign_key_orphans(
    child: DataFrame, parent: DataFrame, child_cols: Sequence[str], parent_cols: Sequence[str]
) -> DataFrame:
    """Child rows whose (fully non-NULL) reference has no parent row."""
    cc, pc = list(child_cols), list(parent_cols)
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(pc)]).distinct()
    cond = None
    for i, c in enumerate(cc):
        e = child[c] == keys[f"_p{i}"]
        cond = e if cond is None else cond & e
    return child.where(_all_not_null(cc)).join(keys, cond, "left_anti")


def _breaks(check: Check) -> F.Column:
    """True when a non-NULL value breaks the CHECK range / value set."""
    c = F.col(check.column)
    if check.values is not None:
        ok = c.isin(list(check.values))
    else:
        ok = F.lit(True)
        if check.lo is not None:
            ok = ok & (c >= check.lo)
        if check.hi is not None:
            ok = ok & (c <= check.hi)
    return c.isNotNull() & ~ok


def check_violations(df: DataFrame, check: Check) -> DataFrame:
    """Rows whose non-NULL value breaks the CHECK range / value set."""
    return df.where(_breaks(check))


def length_violations(df: DataFrame, column: str, max_len: int) -> DataFrame:
    """Rows whose string is longer than the declared width."""
    return df.where(F.length(F.col(column)) > max_len)


def not_null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def violations(tables: dict[str, DataFrame], name: str) -> dict[tuple[str, str], DataFrame]:
    """Every declared rule of table ``name`` -> its violating rows."""
    spec = TABLES[name]
    df = tables[name]
    out: dict[tuple[str, str], DataFrame] = {}
    pk = list(spec.primary_key)
    out[("primary_key_duplicate", ",".join(pk))] = duplicate_keys(df, pk)
    out[("primary_key_null", ",".join(pk))] = null_keys(df, pk)
    for fk in spec.foreign_keys:
        if fk.parent in tables:
            out[("foreign_key", f"{','.join(fk.columns)}->{fk.parent}")] = foreign_key_orphans(
                df, tables[fk.parent], fk.columns, fk.parent_columns
            )
    for ch in spec.checks:
        out[("check", ch.column)] = check_violations(df, ch)
    for c, n in spec.max_length.items():
        out[("length", f"{c}<={n}")] = length_violations(df, c, n)
    for c in spec.not_null:
        out[("not_null", c)] = not_null_violations(df, c)
    for u in spec.unique:
        out[("unique", ",".join(u))] = duplicate_keys(df, list(u))
    return out


def _row_rules(spec: TableSpec) -> list[tuple[str, str, F.Column]]:
    """Rules decidable row by row: (kind, detail, "row violates" predicate)."""
    pk = list(spec.primary_key)
    out = [("primary_key_null", ",".join(pk), _any_null(pk))]
    out += [("check", ch.column, _breaks(ch)) for ch in spec.checks]
    out += [("length", f"{c}<={n}", F.length(F.col(c)) > n) for c, n in spec.max_length.items()]
    out += [("not_null", c, F.col(c).isNull()) for c in spec.not_null]
    return out


def _orphan_rows(child: DataFrame, parent: DataFrame, cols, pcols) -> DataFrame:
    """Orphan references of the child with their row counts (``_n``).

    For a one-column reference the child is first collapsed to one row per
    distinct reference (partial aggregation absorbs hot keys); only those keys
    meet the parent.  References of several columns repeat too little within a
    task for that: their rows are looked up as they are in a hash table of the
    parent's keys, without a sort, and a hot key's rows can be split.
    """
    cc, pc = list(cols), list(pcols)
    refs = child.where(_all_not_null(cc)).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cc)])
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(pc)]).distinct()
    if len(cc) == 1:
        # an outer join, as the optimizer puts an anti join below the grouping
        counted = refs.groupBy("_c0").agg(F.count(F.lit(1)).alias("_n"))
        return counted.join(keys, counted["_c0"] == keys["_p0"], "left").where(keys["_p0"].isNull()).select("_c0", "_n")
    cond = None
    for i in range(len(cc)):
        e = refs[f"_c{i}"] == keys[f"_p{i}"]
        cond = e if cond is None else cond & e
    return refs.withColumn("_n", F.lit(1)).join(keys.hint("shuffle_hash"), cond, "left_anti")


SUSPECT_WORDS = 1 << 14  # of 64 bits each: the filter of hashes that occur twice


def _suspect_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key columns of every row whose key may occur more than once, and of few others.

    Only 8-byte hashes of the keys are counted.  Those that occur twice set bits of
    a filter of fixed size; where none does, or a row's bit is not set, its key is
    unique.  Equal keys have equal hashes, so none is lost.
    """
    keyed = df.where(_all_not_null(keys)).select(*keys)
    h = F.xxhash64(*keys)
    one = F.lit(1).cast("bigint")

    def place(col, mask: int, shift: int):
        return F.shiftrightunsigned(col, shift).bitwiseAND(F.lit(mask).cast("bigint")).cast("int")

    word, bit = lambda c: place(c, SUSPECT_WORDS - 1, 6), lambda c: place(c, 63, 0)
    twice = keyed.groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = twice.select(word(F.col("_h")).alias("_w"), F.call_function("shiftleft", one, bit(F.col("_h"))).alias("_b"))
    zero = df.sparkSession.range(SUSPECT_WORDS).select(F.col("id").cast("int").alias("_w"), F.lit(0).cast("bigint").alias("_b"))
    words = found.unionByName(zero).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    bits = F.transform(F.array_sort(F.collect_list(F.struct("_w", "_b"))), lambda x: x["_b"])
    # NULL if no bit is set: then no row's hash need be taken again
    seen = words.agg(F.when(F.bit_or("_b") != 0, bits).alias("_bits")).scalar()
    return keyed.where(F.call_function("getbit", F.get(seen, word(h)), bit(h)) == 1)


_TAG = ("table", "rule", "detail")


def _tagged(df: DataFrame, table: str, kind: str, detail: str, n) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(kind).alias("rule"), F.lit(detail).alias("detail"), n.alias("_v"))


def audit_summary(tables: dict[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """One row per (table, rule, detail) with the number of violations.

    All rules feed one final aggregate: row-local rules (NULL key part,
    CHECK, width, NOT NULL) are conditional counts in one pass per table; each
    key rule emits one row per duplicated key value (one grouped aggregate, of
    keys of several columns only over rows whose hash occurs twice); each
    foreign key emits its orphan references with their row counts (one anti
    join).  The tagged rows are summed per
    rule in a single shuffle and laid over the list of declared rules, so a
    rule without violations reads 0.  Key rules count duplicated key values;
    the others count violating rows.
    """
    spark = None
    parts: list[DataFrame] = []
    declared: list[tuple[str, str, str]] = []
    for name in names or [n for n in TABLES if n in tables]:
        spec, df = TABLES[name], tables[name]
        spark = spark or df.sparkSession
        rules = _row_rules(spec)
        declared += [(name, kind, detail) for kind, detail, _ in rules]
        # one codegen'd pass: a conditional count per rule (partial
        # aggregation per task), then the single result row is unpivoted
        counts = df.agg(*[F.count(F.when(pred, 1)).alias(f"_r{i}") for i, (_, _, pred) in enumerate(rules)])
        local = counts.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(kind).alias("rule"), F.lit(detail).alias("detail"), F.col(f"_r{i}").alias("n"))
                        for i, (kind, detail, _) in enumerate(rules)
                    ]
                )
            ).alias("_x")
        )
        parts.append(local.select(F.lit(name).alias("table"), "_x.rule", "_x.detail", F.col("_x.n").alias("_v")))
        key_rules = [("primary_key_duplicate", list(spec.primary_key))] + [("unique", list(u)) for u in spec.unique]
        for kind, keys in key_rules:
            declared.append((name, kind, ",".join(keys)))
            # hashes of wide keys are much cheaper to group than the keys
            rows = _suspect_rows(df, keys) if len(keys) > 1 else df
            parts.append(_tagged(duplicate_keys(rows, keys), name, kind, ",".join(keys), F.lit(1).cast("bigint")))
        for fk in spec.foreign_keys:
            if fk.parent in tables:
                detail = f"{','.join(fk.columns)}->{fk.parent}"
                declared.append((name, "foreign_key", detail))
                orphans = _orphan_rows(df, tables[fk.parent], fk.columns, fk.parent_columns)
                parts.append(_tagged(orphans, name, "foreign_key", detail, F.col("_n").cast("bigint")))
    found = union_all(parts).groupBy(*_TAG).agg(F.sum("_v").alias("_found"))
    # the declared rules are metadata (a few rows per table), not data
    rules_df = literal_rows(spark, declared, _TAG)
    return (
        rules_df.join(found, list(_TAG), "left")
        .select(*_TAG, F.coalesce(F.col("_found"), F.lit(0)).cast("bigint").alias("violations"))
    )
