"""Joins on a key plus "on or before" in time, without emitting row pairs.

``a JOIN b ON a.k = b.k AND a.d <= b.d`` emits every pair within a key; when
one key holds a large share of both sides that is quadratic work in one task.
``count_prior_pairs`` and ``latest_prior`` first collapse each side to one row per (key, date[,
label]) with partial aggregation -- a bounded calendar per key -- and then
resolve "on or before" with a running window over the union of the two
collapsed sides, so work stays linear in the input and every window partition
is bounded by (labels x distinct dates) of one key.

``count_prior_pairs_by_time`` and ``latest_prior_by_time`` take timestamps, of which
one key may have any number.  A key's time is cut into blocks of equal width: what
lies in one block is resolved there, and what earlier blocks add is carried
over as one row per (key, block).  A key's rows so spread over as many tasks as it
has blocks, and the window over a key's blocks holds one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _require_dates(**columns: tuple[DataFrame, str]) -> None:
    """A key's history is bounded by the calendar only if days are dates."""
    for role, (df, c) in columns.items():
        if not isinstance(df.schema[c].dataType, T.DateType):
            raise TypeError(f"{role} {c} must be a date, not {df.schema[c].dataType.simpleString()}; cast it")


_KIND = "_kind"  # 0 = event row, 1 = probe row; events sort first on a date tie


def count_prior_pairs(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    event_date: str,
    probe_date: str,
    event_label: str,
    probe_label: str,
    alias: str = "frequency",
    labels: Sequence | None = None,
    bucketed: bool = False,
) -> DataFrame:
    """Per (event_label, probe_label): the number of (event, probe) pairs with
    equal ``key`` and ``event_date <= probe_date``.

    ``labels``: the complete, small set of event labels, if the caller knows
    it.  One running count per label is then kept as a column; a label outside
    the set ends the query with an error, and NULL labels are not counted.

    ``bucketed``: both sides lie bucketed by ``key`` and are not dealt anew.

    Same counts as ``SELECT e.label, p.label, COUNT(*) FROM events e JOIN
    probes p ON e.key = p.key AND e.date <= p.date GROUP BY 1, 2`` (pairs
    with a NULL key or date never match; label groups with no pair are
    absent).  Output columns: ``event_label, probe_label, alias`` (bigint).
    """
    _require_dates(event_date=(events, event_date), probe_date=(probes, probe_date))
    ev = events.where(F.col(key).isNotNull() & F.col(event_date).isNotNull())
    pr = probes.where(F.col(key).isNotNull() & F.col(probe_date).isNotNull())
    if labels is not None:
        return _count_prior_pairs_by_columns(ev, pr, key, event_date, probe_date, event_label, probe_label, alias, labels)

    # 1. collapse: events per (key, label, date); probes per (key, label, date)
    e = ev.groupBy(F.col(key).alias("_k"), F.col(event_label).alias("_el"), F.col(event_date).alias("_d")).agg(
        F.count(F.lit(1)).alias("_ne")
    )
    p = pr.groupBy(F.col(key).alias("_k"), F.col(probe_label).alias("_pl"), F.col(probe_date).alias("_d")).agg(
        F.count(F.lit(1)).alias("_np")
    )
    return _pairs_of(_collapsed_pairs(e, p, ["_k"], bucketed), event_label, probe_label, alias)


def _pairs_of(counted: DataFrame, event_label: str, probe_label: str, alias: str) -> DataFrame:
    return counted.select(F.col("_el").alias(event_label), F.col("_pl").alias(probe_label), F.col("_n").alias(alias))


def _collapsed_pairs(e: DataFrame, p: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """(_el, _pl, _n): pairs of equal ``keys`` with the event's ``_d`` not after the probe's, from
    the collapsed sides (keys, _el, _d, _ne) and (keys, _pl, _d, _np)."""
    # 2. both sides dealt by key once; every step below works on a key's own
    # rows, so none of them shuffles again before the pairs are summed
    if not dealt:
        e, p = e.repartition(*keys), p.repartition(*keys)
    # 3. each probe group once per event label present for its key.  A real
    # aggregate (a bare distinct would be rewritten into a second aggregation
    # of the source) over all columns: the sources are scanned once and their
    # exchange is reused
    labels = (
        e.groupBy(*keys, "_el")
        .agg(F.sum("_ne").alias("_x"), F.max("_d").alias("_last"))
        .where((F.col("_x") > 0) & F.col("_last").isNotNull())
        .drop("_x", "_last")
    )
    label_type = p.schema["_pl"].dataType
    u = e.select(
        *keys, "_el", "_d", F.lit(0).alias(_KIND), "_ne", F.lit(None).cast(label_type).alias("_pl"), F.lit(0).cast("bigint").alias("_np")
    ).unionByName(
        p.join(labels, keys).select(*keys, "_el", "_d", F.lit(1).alias(_KIND), F.lit(0).cast("bigint").alias("_ne"), "_pl", "_np")
    )
    # 4. running count of events per (key, event label) as of each probe group,
    # weighted by its probes and summed per label pair
    w = (
        Window.partitionBy(*keys, "_el")
        .orderBy("_d", _KIND)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        u.withColumn("_prior", F.sum("_ne").over(w))
        .where((F.col(_KIND) == 1) & (F.col("_prior") > 0))
        .groupBy("_el", "_pl")
        .agg(F.sum(F.col("_np") * F.col("_prior")).cast("bigint").alias("_n"))
    )


def _count_prior_pairs_by_columns(ev, pr, key, event_date, probe_date, event_label, probe_label, alias, labels):
    vs = list(labels)
    cols = [f"_c{i}" for i in range(len(vs))]
    label = F.col(event_label)
    refuse = F.raise_error(F.concat(F.lit("label outside the set: "), label.cast("string")))
    known = label.isNull() | label.isin(vs) | refuse.cast("boolean")
    ev = ev.where(known)
    # events per (key, date), one count column per label
    e = ev.groupBy(F.col(key).alias("_k"), F.col(event_date).alias("_d")).agg(
        *[F.count(F.when(F.col(event_label) == F.lit(v), 1)).alias(c) for v, c in zip(vs, cols)]
    )
    p = pr.groupBy(F.col(key).alias("_k"), F.col(probe_label).alias("_pl"), F.col(probe_date).alias("_d")).agg(
        F.count(F.lit(1)).alias("_np")
    )
    days = p.groupBy("_k", "_d").agg(F.sum("_np").alias("_x")).where(F.col("_x") > 0).drop("_x")
    zero = [F.lit(0).cast("bigint").alias(c) for c in cols]
    u = e.select("_k", "_d", F.lit(0).alias(_KIND), *cols).unionByName(days.select("_k", "_d", F.lit(1).alias(_KIND), *zero))
    w = Window.partitionBy("_k").orderBy("_d", _KIND).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = u.select("_k", "_d", _KIND, *[F.sum(c).over(w).alias(c) for c in cols]).where(F.col(_KIND) == 1)
    # one (label, count-so-far) row per label with events before the probe
    # date: explode, then a plain filter (both stay in generated code)
    per_label = F.array(*[F.struct(F.lit(v).alias("_el"), F.col(c).alias("_prior")) for v, c in zip(vs, cols)])
    prior_rows = (
        prior.select("_k", "_d", F.explode(per_label).alias("_x"))
        .where(F.col("_x._prior") > 0)
        .select("_k", "_d", "_x._el", "_x._prior")
    )
    return (
        p.join(prior_rows, ["_k", "_d"])
        .groupBy(F.col("_el").alias(event_label), F.col("_pl").alias(probe_label))
        .agg(F.sum(F.col("_np") * F.col("_prior")).cast("bigint").alias(alias))
    )


def latest_prior(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    event_date: str,
    probe_date: str,
    pick: Sequence[str],
    payload: Sequence[str],
    hit_date: str | None = None,
) -> DataFrame:
    """For each probe row, the latest event of the same key dated on or
    before the probe's date (an as-of join, inner: probes with no such event
    are dropped).  Among events on that latest date the smallest ``pick``
    tuple wins.  Returns the probe columns plus ``payload`` (and the event
    date as ``hit_date`` if given).

    Plan: events -> one row per (key, date) holding min(struct(pick,
    payload)); probe dates -> distinct (key, date); a running ``last`` over
    their union gives each probe date its hit; probes join back many-to-one
    on (key, date).
    """
    _require_dates(event_date=(events, event_date), probe_date=(probes, probe_date))
    ev = events.where(F.col(key).isNotNull() & F.col(event_date).isNotNull())
    fields = list(dict.fromkeys([*pick, *payload]))  # pick order first, each column once
    best = ev.groupBy(F.col(key).alias("_k"), F.col(event_date).alias("_d")).agg(
        F.min(F.struct(*[F.col(c) for c in fields], F.col(event_date).alias("_ed"))).alias("_best")
    )
    days = (
        probes.where(F.col(key).isNotNull() & F.col(probe_date).isNotNull())
        .select(F.col(key).alias("_k"), F.col(probe_date).alias("_d"))
        .distinct()
    )
    u = best.select("_k", "_d", F.lit(0).alias(_KIND), "_best").unionByName(
        days.select("_k", "_d", F.lit(1).alias(_KIND), F.lit(None).cast(best.schema["_best"].dataType).alias("_best"))
    )
    w = Window.partitionBy("_k").orderBy("_d", _KIND).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        u.withColumn("_hit", F.last("_best", ignorenulls=True).over(w))
        .where((F.col(_KIND) == 1) & F.col("_hit").isNotNull())
        .select("_k", "_d", "_hit")
    )
    out_cols = [F.col(c) for c in probes.columns] + [F.col("_hit")[c].alias(c) for c in payload]
    if hit_date:
        out_cols.append(F.col("_hit")["_ed"].alias(hit_date))
    joined = probes.join(hits, (probes[key] == hits["_k"]) & (probes[probe_date] == hits["_d"]))
    return joined.select(*out_cols)


def _block(df: DataFrame, column: str, seconds: int) -> Column:
    """The number of the block that a time lies in: never less for a later time."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        at = F.unix_seconds(c)
    elif isinstance(kind, T.TimestampNTZType):  # read off the clock, whatever the session's time zone
        day = F.unix_date(F.to_date(c)).cast("bigint")
        at = day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    elif isinstance(kind, T.DateType):
        at = F.unix_date(c).cast("bigint") * 86400
    else:
        raise TypeError(f"{column} must be a timestamp or date, not {kind.simpleString()}")
    return F.floor(at / F.lit(seconds)).cast("bigint")


def _same_kind(events: DataFrame, event_time: str, probes: DataFrame, probe_time: str, seconds: int) -> None:
    kinds = {events.schema[event_time].dataType, probes.schema[probe_time].dataType}
    if len(kinds) > 1:
        raise TypeError(f"event and probe time differ: {sorted(k.simpleString() for k in kinds)}")
    if seconds < 1:
        raise ValueError("a block lasts one second at least")


def count_prior_pairs_by_time(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    event_time: str,
    probe_time: str,
    event_label: str,
    probe_label: str,
    alias: str = "frequency",
    block_seconds: int = 86400,
) -> DataFrame:
    """``count_prior_pairs`` for timestamps: the same counts, with a key's history in blocks.

    Pairs within a block are counted by running counts over the block; pairs of
    different blocks by the same counting over whole blocks.  ``block_seconds``
    changes the spreading, never the counts: a task holds (labels x distinct
    times) of one key and block, and a key's (labels x blocks).  NULL keys and
    times match nothing.
    """
    _same_kind(events, event_time, probes, probe_time, block_seconds)
    ev = events.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
    pr = probes.where(F.col(key).isNotNull() & F.col(probe_time).isNotNull())
    e = ev.groupBy(
        F.col(key).alias("_k"), _block(ev, event_time, block_seconds).alias("_b"), F.col(event_label).alias("_el"), F.col(event_time).alias("_d")
    ).agg(F.count(F.lit(1)).alias("_ne"))
    p = pr.groupBy(
        F.col(key).alias("_k"), _block(pr, probe_time, block_seconds).alias("_b"), F.col(probe_label).alias("_pl"), F.col(probe_time).alias("_d")
    ).agg(F.count(F.lit(1)).alias("_np"))
    within = _collapsed_pairs(e, p, ["_k", "_b"])
    # an event counts for whole blocks from the one after its own
    later = e.groupBy("_k", "_el", (F.col("_b") + 1).alias("_d")).agg(F.sum("_ne").alias("_ne"))
    whole = p.groupBy("_k", "_pl", F.col("_b").alias("_d")).agg(F.sum("_np").alias("_np"))
    both = within.unionByName(_collapsed_pairs(later, whole, ["_k"]))
    return _pairs_of(both.groupBy("_el", "_pl").agg(F.sum("_n").alias("_n")), event_label, probe_label, alias)


def latest_prior_by_time(
    events: DataFrame,
    probes: DataFrame,
    key: str,
    event_time: str,
    probe_time: str,
    pick: Sequence[str],
    payload: Sequence[str],
    hit_time: str | None = None,
    block_seconds: int = 86400,
) -> DataFrame:
    """``latest_prior`` for timestamps: the same answers, with a key's history in blocks.

    A probe's event is the last one of its block up to its time, or else the
    last one that any earlier block ended with.
    """
    _same_kind(events, event_time, probes, probe_time, block_seconds)
    ev = events.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
    pr = probes.where(F.col(key).isNotNull() & F.col(probe_time).isNotNull())
    fields = list(dict.fromkeys([*pick, *payload]))
    best = ev.groupBy(F.col(key).alias("_k"), _block(ev, event_time, block_seconds).alias("_b"), F.col(event_time).alias("_d")).agg(
        F.min(F.struct(*[F.col(c) for c in fields], F.col(event_time).alias("_ed"))).alias("_best")
    )
    times = pr.select(F.col(key).alias("_k"), _block(pr, probe_time, block_seconds).alias("_b"), F.col(probe_time).alias("_d")).distinct()
    none = F.lit(None).cast(best.schema["_best"].dataType)
    u = best.withColumn(_KIND, F.lit(0)).unionByName(times.withColumns({_KIND: F.lit(1), "_best": none}))
    so_far = Window.partitionBy("_k", "_b").orderBy("_d", _KIND).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = u.withColumn("_own", F.last("_best", ignorenulls=True).over(so_far)).where(F.col(_KIND) == 1).select("_k", "_b", "_d", "_own")
    # one row per block: the event it ends with, and whether probes ask there
    blocks = u.groupBy("_k", "_b").agg(
        F.max_by("_best", F.when(F.col(_KIND) == 0, F.col("_d"))).alias("_end"), F.max(_KIND).alias("_asked")
    )
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
        .where((F.col("_asked") == 1) & F.col("_carried").isNotNull())
        .select("_k", "_b", "_carried")
    )
    hits = (
        within.join(carried, ["_k", "_b"], "left")
        .select("_k", "_d", F.coalesce("_own", "_carried").alias("_hit"))
        .where(F.col("_hit").isNotNull())
    )
    out = [probes[c] for c in probes.columns] + [F.col("_hit")[c].alias(c) for c in payload]
    if hit_time:
        out.append(F.col("_hit")["_ed"].alias(hit_time))
    return probes.join(hits, (probes[key] == hits["_k"]) & (probes[probe_time] == hits["_d"])).select(*out)
