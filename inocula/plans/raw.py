"""The reusable operators run directly on the raw testdata tables.

These carry the data volume (lineitem, orders, events) so each operator is
exercised, and timed, at bench scale -- not only on the small derived
campaign tables.  Every function takes ``(spark, sf_dir)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import age_band, age_years, iso_weekday, rate_words, round_half_even
from ..operators import (
    check_violations,
    count_prior_pairs,
    count_prior_pairs_by_time,
    count_rows,
    count_std,
    crosstab,
    duplicate_keys,
    first_n_wide,
    foreign_key_orphans,
    latest_per_key,
    latest_prior,
    latest_prior_by_time,
    one_per_key,
    orphans,
    pivot_fixed,
    prefix_sum,
    running_total,
    semi_on,
    share_of_group,
    top_n_per_group,
    with_scalar,
)
from ..schema import Check
from ..sources.derived import read_raw

# Fixed parameters of these runs
URGENT = "1-URGENT"
LOW = "5-LOW"
CUTOFF = "1998-06-01"
AS_OF = "2021-05-15"
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BALANCE_BANDS = ((0, "<=0"), (2500, "0-2500"), (5000, "2500-5000"), (7500, "5000-7500"))
BALANCE_LAST = "7500+"
URGENT_RATE_WORDS = ((0.3, "very common"), (0.15, "common"))


def _r(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_raw(spark, sf_dir, name)


def latest_shipment_per_part(spark, sf_dir) -> DataFrame:
    """Lines at each part's latest ship date (ties kept)."""
    li = _r(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    return latest_per_key(li, "l_partkey", "l_shipdate")


def first_event_per_user_type(spark, sf_dir) -> DataFrame:
    """First event per (user, type) by time, then event id."""
    ev = _r(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return one_per_key(ev, ["user_id", "event_type"], ["ts", "event_id"])


def first_two_orders_per_customer(spark, sf_dir) -> DataFrame:
    """Each customer's first two orders (date, priority) as columns."""
    o = _r(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return first_n_wide(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderpriority"], 2)


def top_event_types_per_user(spark, sf_dir) -> DataFrame:
    """Each user's two most frequent event types (ties: type name)."""
    ev = _r(spark, sf_dir, "events")
    c = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return top_n_per_group(c, "user_id", [F.desc("n"), F.asc("event_type")], 2).select(
        "user_id", "rank", "event_type", "n"
    )


def linestatus_share(spark, sf_dir) -> DataFrame:
    """Share of each line status within its return flag."""
    c = _r(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return share_of_group(c, "l_returnflag", "n", alias="share")


def daily_orders_running(spark, sf_dir) -> DataFrame:
    """Orders per day and their running total."""
    o = _r(spark, sf_dir, "orders")
    per_day = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    return running_total(per_day, "day", "orders", "cumulative")


def priority_status_crosstab(spark, sf_dir) -> DataFrame:
    """Orders by priority x status (absent cells 0)."""
    return crosstab(_r(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", STATUSES)


def priority_status_max_price(spark, sf_dir) -> DataFrame:
    """Largest order price by priority x status, long -> wide (absent NULL)."""
    o = _r(spark, sf_dir, "orders")
    long = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.max("o_totalprice").alias("max_price"))
    return pivot_fixed(long, "o_orderpriority", "o_orderstatus", STATUSES, "max_price")


def customers_without_recent_urgent(spark, sf_dir) -> DataFrame:
    """Customers with no urgent order after the cutoff (NOT EXISTS)."""
    c = _r(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = _r(spark, sf_dir, "orders").where(
        (F.col("o_orderpriority") == URGENT) & (F.col("o_orderdate") > F.lit(CUTOFF).cast("timestamp_ntz"))
    )
    return orphans(c, o.select("o_custkey"), [("c_custkey", "o_custkey")])


def lines_of_returned_pairs(spark, sf_dir) -> DataFrame:
    """Lines whose (part, supplier) pair also occurs among large returned lines."""
    li = _r(spark, sf_dir, "lineitem")
    keys = li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
    return semi_on(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), keys, ["l_partkey", "l_suppkey"])


def part_last_supplier(spark, sf_dir) -> DataFrame:
    """Each part's expected supplier (key = partkey mod #suppliers) vs. the
    supplier of its latest shipment; ties kept, de-duplicated."""
    li = _r(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    s = _r(spark, sf_dir, "supplier")
    n = count_rows(s, "_n")
    p = with_scalar(_r(spark, sf_dir, "part").select("p_partkey"), n).withColumn("_ek", F.col("p_partkey") % F.col("_n"))
    exp = s.select(F.col("s_suppkey").alias("_es"), F.col("s_name").alias("expected_supplier"))
    last = s.select(F.col("s_suppkey").alias("_ls"), F.col("s_name").alias("last_supplier"))
    lt = latest_per_key(li, "l_partkey", "l_shipdate")
    j = (
        p.join(exp, F.col("_ek") == F.col("_es"))
        .join(lt, F.col("p_partkey") == F.col("l_partkey"))
        .join(last, F.col("l_suppkey") == F.col("_ls"))
    )
    return j.select(
        "p_partkey",
        "expected_supplier",
        "last_supplier",
        (F.col("expected_supplier") != F.col("last_supplier")).alias("moved"),
    ).distinct()


def supplier_line_share_reserve(spark, sf_dir) -> DataFrame:
    """Each supplier's % of all lines, plus the sample std of that % over
    suppliers (the dose-reserve rule on supplier volume)."""
    li = _r(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("_c"))
    tot = count_rows(li, "_t")
    sd = count_std(per, "_c", "_sdc")

    def pct(c):
        return F.col(c).cast("double") * 100.0 / F.col("_t").cast("double")

    return with_scalar(with_scalar(per, tot), sd).select(
        "l_suppkey", pct("_c").alias("pct"), (pct("_c") + pct("_sdc")).alias("reserve")
    )


def customer_balance_band(spark, sf_dir) -> DataFrame:
    """Account balance banded by a chained CASE (NULL -> last band)."""
    c = _r(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_acctbal", age_band("c_acctbal", BALANCE_BANDS, BALANCE_LAST).alias("band"))


def customer_urgent_rate_words(spark, sf_dir) -> DataFrame:
    """Share of each customer's orders that are urgent, rounded half-even to
    2 digits, and in words."""
    o = _r(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(
        F.count(F.when(F.col("o_orderpriority") == URGENT, 1)).alias("_u"), F.count(F.lit(1)).alias("_n")
    )
    rate = round_half_even(F.col("_u").cast("double") / F.col("_n").cast("double"), 2)
    return per.select("o_custkey", rate.alias("rate")).withColumn("label", rate_words("rate", URGENT_RATE_WORDS))


def orders_per_weekday(spark, sf_dir) -> DataFrame:
    """Orders per ISO weekday (1 = Monday)."""
    o = _r(spark, sf_dir, "orders")
    return o.groupBy(iso_weekday("o_orderdate").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def order_age_years(spark, sf_dir) -> DataFrame:
    """Whole years from each order date to the as-of date."""
    o = _r(spark, sf_dir, "orders")
    return o.select("o_orderkey", age_years(F.col("o_orderdate").cast("date"), AS_OF).alias("years"))


def prior_order_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of one customer's orders (a, b) with a dated on or before b,
    counted per (a's priority, b's status) -- without forming the pairs."""
    o = _r(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderpriority", "o_orderstatus"
    )
    return count_prior_pairs(o, o, "o_custkey", "d", "d", "o_orderpriority", "o_orderstatus", alias="pairs", labels=PRIORITIES)


def latest_low_before_urgent(spark, sf_dir) -> DataFrame:
    """For each urgent order, the customer's latest low-priority order on or
    before it (same day: smallest order key); urgent orders without one are
    dropped."""
    o = _r(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderpriority")
    low = o.where(F.col("o_orderpriority") == LOW).select("o_custkey", "d", F.col("o_orderkey").alias("prior_orderkey"))
    urgent = o.where(F.col("o_orderpriority") == URGENT).select("o_orderkey", "o_custkey", "d")
    return latest_prior(low, urgent, "o_custkey", "d", "d", pick=["prior_orderkey"], payload=["prior_orderkey"], hit_date="prior_date")


def _busy_events(spark, sf_dir) -> DataFrame:
    """Events of which one key, 0, has a third."""
    busy = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))
    return _r(spark, sf_dir, "events").select("event_id", "ts", "event_type", busy.alias("user"))


def prior_event_pairs(spark, sf_dir) -> DataFrame:
    """Per two event types: pairs of a user's events of the first before or at one of
    the second, by time stamp; one user has a third of the events."""
    e = _busy_events(spark, sf_dir)
    first = e.select("user", "ts", F.col("event_type").alias("before"))
    return count_prior_pairs_by_time(first, e, "user", "ts", "ts", "before", "event_type", alias="pairs")


def latest_click_before_purchase(spark, sf_dir) -> DataFrame:
    """For each purchase the user's latest click up to that time (same time: smallest
    id); purchases without one are dropped."""
    e = _busy_events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("user", "ts", F.col("event_id").alias("click_id"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user", "ts")
    return latest_prior_by_time(clicks, bought, "user", "ts", "ts", ["click_id"], ["click_id"], hit_time="click_ts")


def audit_customer_nation(spark, sf_dir) -> DataFrame:
    """Customers whose nation key has no nation row (FK audit)."""
    c = _r(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return foreign_key_orphans(c, _r(spark, sf_dir, "nation"), ["c_nationkey"], ["n_nationkey"])


def audit_lineitem_key(spark, sf_dir) -> DataFrame:
    """(order, line number) keys occurring more than once (PK audit)."""
    return duplicate_keys(_r(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def audit_discount_range(spark, sf_dir) -> DataFrame:
    """Lines with a discount outside 0..0.1 (CHECK audit; -0.0 is in range)."""
    li = _r(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return check_violations(li, Check("l_discount", 0, 0.1))


def lineitem_running_quantity(spark, sf_dir) -> DataFrame:
    """Running total of the quantity over all lines in order: no window over the whole table."""
    li = _r(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(12,2)").alias("l_quantity")
    )
    return prefix_sum(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")


RUNS = {
    "raw_lineitem_running_quantity": lineitem_running_quantity,
    "raw_latest_shipment_per_part": latest_shipment_per_part,
    "raw_first_event_per_user_type": first_event_per_user_type,
    "raw_first_two_orders_per_customer": first_two_orders_per_customer,
    "raw_top_event_types_per_user": top_event_types_per_user,
    "raw_linestatus_share": linestatus_share,
    "raw_daily_orders_running": daily_orders_running,
    "raw_priority_status_crosstab": priority_status_crosstab,
    "raw_priority_status_max_price": priority_status_max_price,
    "raw_customers_without_recent_urgent": customers_without_recent_urgent,
    "raw_lines_of_returned_pairs": lines_of_returned_pairs,
    "raw_part_last_supplier": part_last_supplier,
    "raw_supplier_line_share_reserve": supplier_line_share_reserve,
    "raw_customer_balance_band": customer_balance_band,
    "raw_customer_urgent_rate_words": customer_urgent_rate_words,
    "raw_orders_per_weekday": orders_per_weekday,
    "raw_order_age_years": order_age_years,
    "raw_prior_order_pairs": prior_order_pairs,
    "raw_latest_low_before_urgent": latest_low_before_urgent,
    "raw_prior_event_pairs": prior_event_pairs,
    "raw_latest_click_before_purchase": latest_click_before_purchase,
    "raw_audit_customer_nation": audit_customer_nation,
    "raw_audit_lineitem_key": audit_lineitem_key,
    "raw_audit_discount_range": audit_discount_range,
}
