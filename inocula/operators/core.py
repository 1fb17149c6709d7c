"""Reusable DataFrame -> DataFrame building blocks.

Design rules applied throughout (the reason for each shape is given inline):

* a hot key may hold a third of all rows, so nothing gathers a raw group in
  one task: aggregations use map-side partial aggregation, top-k windows use
  ``row_number() <= k`` which Catalyst turns into a partial WindowGroupLimit
  *before* the shuffle, and "rows at the max" uses aggregate + semi join;
* only one-row global aggregates are broadcast by hand (their size is fixed
  by construction); every other join size is left to Catalyst statistics and
  AQE's runtime measurement;
* no driver collects; pivot values are passed in, never discovered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str
Names = str | Sequence[str]


def _names(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _order(cols: Sequence[ColumnOrName]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def latest_per_key(df: DataFrame, keys: Names, order_col: str) -> DataFrame:
    """Rows whose ``order_col`` equals the maximum within their key; ties kept.

    Same rows as ``WHERE t.o = (SELECT MAX(o) FROM t t2 WHERE t2.k = t.k)``:
    NULL keys and NULL order values never match.  Plan: partial/final
    aggregate of the max (one row per key), then a left-semi join on
    (keys, order_col).  Unlike a ``rank()`` window this never sorts a whole
    key group in one task; the join is many-to-one, so AQE can broadcast the
    max side or split a hot key's partition.
    """
    ks = _names(keys)
    mx = df.groupBy(*ks).agg(F.max(order_col).alias(order_col))
    return df.join(mx, on=[*ks, order_col], how="left_semi")


def top_n_per_group(
    df: DataFrame,
    group: Names,
    order: Sequence[ColumnOrName],
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """First ``n`` rows per group by ``order`` (a total order is the caller's
    job: add tie-break columns).  Adds ``rank_col`` 1..n.

    ``row_number() <= n`` directly above the window lets Catalyst insert a
    partial WindowGroupLimit under the shuffle: each map task keeps at most
    ``n`` rows per group, so a hot group ships ``n x tasks`` rows, not all.
    """
    w = Window.partitionBy(*_names(group)).orderBy(*_order(order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def one_per_key(df: DataFrame, keys: Names, order: Sequence[ColumnOrName]) -> DataFrame:
    """One row per key: the first by ``order`` (``DISTINCT ON`` with an order)."""
    return top_n_per_group(df, keys, order, 1, rank_col="_rn").drop("_rn")


def first_n_wide(
    df: DataFrame,
    key: Names,
    order: Sequence[ColumnOrName],
    values: Sequence[str],
    n: int,
    name: Callable[[str, int], str] = lambda c, i: f"{c}{i}",
) -> DataFrame:
    """First ``n`` rows per key spread into columns ``name(value, i)``.

    Keys with fewer rows get NULLs in the missing slots.  The top-n step is
    ``top_n_per_group`` (pruned before the shuffle); the spread is a grouped
    aggregate over at most ``n`` rows per key on the window's partitioning,
    so it adds no exchange.
    """
    ks = _names(key)
    ranked = top_n_per_group(df, ks, order, n, rank_col="_rn")
    aggs = [
        F.max(F.when(F.col("_rn") == i, F.col(v))).alias(name(v, i))
        for i in range(1, n + 1)
        for v in values
    ]
    return ranked.groupBy(*ks).agg(*aggs)


def share_of_group(
    df: DataFrame,
    group: Names,
    value_col: str,
    alias: str = "share",
    scale: float = 1.0,
) -> DataFrame:
    """``value * scale / SUM(value) OVER (PARTITION BY group)`` as a double.

    Meant for already-aggregated input (one row per group x category), so the
    window partitions are small.
    """
    w = Window.partitionBy(*_names(group))
    return df.withColumn(
        alias, F.col(value_col).cast("double") * F.lit(scale) / F.sum(F.col(value_col)).over(w).cast("double")
    )


def running_total(df: DataFrame, order_col: str, value_col: str, alias: str = "cumulative") -> DataFrame:
    """Cumulative sum of ``value_col`` in ``order_col`` order.

    A global running sum has no partition key, so Spark evaluates it in one
    partition: feed it one row per ``order_col`` value (aggregate first; a
    calendar of dates is small at any data size).
    """
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(alias, F.sum(value_col).over(w))


def crosstab(df: DataFrame, row: Names, col: str, values: Sequence, fill: int = 0, other: str = "other") -> DataFrame:
    """Count table ``row x col``; absent cells = ``fill`` (0 like a crosstab).

    ``values`` fixes the columns, which saves the distinct-values job a pivot
    would otherwise run and keeps the output schema stable.  Values outside
    the list are counted in the column ``other``, so a row's cells always add
    up to its rows; rows whose value is NULL have no column.  One aggregate,
    no pivot.
    """
    c = F.col(col)
    cells = [F.count(F.when(c == F.lit(v), 1)).alias(str(v)) for v in values]
    outside = F.count(F.when(~c.isin(list(values)), 1)).alias(other)
    out = df.groupBy(*_names(row)).agg(*cells, outside)
    if fill == 0:
        return out
    cut = [F.when(F.col(f"`{x}`") == 0, fill).otherwise(F.col(f"`{x}`")).alias(x) for x in (*map(str, values), other)]
    return out.select(*_names(row), *cut)


def pivot_fixed(df: DataFrame, row: Names, col: str, values: Sequence, value_col: str) -> DataFrame:
    """Long -> wide with fixed ``values``; absent cells stay NULL.

    A value outside the list ends the query with an error rather than vanish.
    """
    c = F.col(col)
    kind = df.schema[col].dataType
    refuse = F.raise_error(F.concat(F.lit(f"{col} outside the list: "), c.cast("string"))).cast(kind)
    known = F.when(c.isNull() | c.isin(list(values)), c).otherwise(refuse)
    return df.withColumn(col, known).groupBy(*_names(row)).pivot(col, list(values)).agg(F.first(value_col))


def orphans(child: DataFrame, parent: DataFrame, on: Names | list[tuple[str, str]]) -> DataFrame:
    """Child rows with no parent row (``NOT EXISTS``), a left-anti join.

    ``on`` is a column name list (same names both sides) or a list of
    (child column, parent column) pairs.
    """
    # Only the parent's distinct keys matter; de-duplicating them first
    # (partial aggregation) keeps a hot parent key from filling one task on
    # the build side, which AQE's skew split cannot divide for an anti join.
    if on and isinstance(on, list) and isinstance(on[0], tuple):
        keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(on)]).distinct()
        cond = None
        for i, (c, _) in enumerate(on):
            e = child[c] == keys[f"_p{i}"]
            cond = e if cond is None else cond & e
        return child.join(keys, cond, "left_anti")
    return child.join(parent.select(*_names(on)).distinct(), _names(on), "left_anti")


def semi_on(df: DataFrame, keys: DataFrame, on: Names) -> DataFrame:
    """Rows of ``df`` whose ``on`` tuple occurs in ``keys`` (tuple ``IN``).
    The key side is de-duplicated first, as in ``orphans``."""
    return df.join(keys.select(*_names(on)).distinct(), _names(on), "left_semi")


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row.

    Pass a global aggregate (``df.agg(...)`` without grouping): it has exactly
    one row whatever the input size.  Each column becomes a scalar subquery,
    which Spark evaluates once and inlines as a value -- no join, nothing
    broadcast but the value itself (identical subqueries are reused).
    """
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def literal_rows(spark, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small constant table built from literals inside the JVM plan (no
    Python data transfer): for metadata such as rule lists, not for data."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def count_std(df: DataFrame, count_col: str, alias: str = "_sd") -> DataFrame:
    """Sample standard deviation of an integer column, exactly, as one row.

    ``sqrt((n * sum(c^2) - sum(c)^2) / (n * (n - 1)))`` with the sums in
    38-digit decimals: the sums are exact, so the result does not depend on
    row order or partitioning (a double ``stddev_samp`` can differ in its last
    bits from run to run on a cluster).  NULL for fewer than two rows.
    """
    c = F.col(count_col).cast("decimal(38,0)")
    s = df.agg(F.count(c).alias("_n"), F.sum(c).alias("_s1"), F.sum(c * c).alias("_s2"))
    n = F.col("_n").cast("decimal(38,0)")
    num = (n * F.col("_s2") - F.col("_s1") * F.col("_s1")).cast("double")
    den = (n * (n - 1)).cast("double")
    return s.select(F.when(F.col("_n") >= 2, F.sqrt(num / den)).alias(alias))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of frames with the same columns, combined as a balanced
    tree: a left-deep chain of n unions re-analyses the growing plan n
    times; the tree keeps driver-side planning near n log n."""
    parts = list(dfs)
    if not parts:
        raise ValueError("union_all needs at least one frame")
    while len(parts) > 1:
        nxt = [parts[i].unionByName(parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0]


def count_rows(df: DataFrame, alias: str = "count") -> DataFrame:
    """``COUNT(*)`` of a whole frame as a one-row frame (bigint)."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def drop_null_keys(df: DataFrame, keys: Names) -> DataFrame:
    """Drop rows with a NULL in any key (a pandas group-by drops them)."""
    cond = None
    for k in _names(keys):
        e = F.col(k).isNotNull()
        cond = e if cond is None else cond & e
    return df.where(cond)


def group_size(df: DataFrame, keys: Names, alias: str = "n", keep_null_keys: bool = False) -> DataFrame:
    """Rows per group; by default NULL-key groups are dropped (pandas rule)."""
    src = df if keep_null_keys else drop_null_keys(df, keys)
    return src.groupBy(*_names(keys)).agg(F.count(F.lit(1)).alias(alias))
