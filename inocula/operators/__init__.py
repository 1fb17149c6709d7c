"""Reusable DataFrame operators and data-quality audits."""

from .audit import (
    audit_summary,
    check_violations,
    duplicate_keys,
    foreign_key_orphans,
    length_violations,
    not_null_violations,
    null_keys,
    violations,
)
from .bloom import key_filter, possibly_in
from .core import (
    count_rows,
    count_std,
    crosstab,
    drop_null_keys,
    first_n_wide,
    group_size,
    latest_per_key,
    one_per_key,
    orphans,
    pivot_fixed,
    running_total,
    semi_on,
    share_of_group,
    top_n_per_group,
    union_all,
    with_scalar,
)
from .distinct import distinct_bitmaps, distinct_counts, number_values, roll_up
from .prefix import prefix_sum
from .temporal import count_prior_pairs, count_prior_pairs_by_time, latest_prior, latest_prior_by_time

__all__ = [
    "audit_summary",
    "check_violations",
    "count_prior_pairs",
    "count_prior_pairs_by_time",
    "count_rows",
    "count_std",
    "crosstab",
    "distinct_bitmaps",
    "distinct_counts",
    "drop_null_keys",
    "duplicate_keys",
    "first_n_wide",
    "foreign_key_orphans",
    "group_size",
    "key_filter",
    "latest_per_key",
    "latest_prior",
    "latest_prior_by_time",
    "length_violations",
    "not_null_violations",
    "null_keys",
    "number_values",
    "one_per_key",
    "orphans",
    "pivot_fixed",
    "possibly_in",
    "prefix_sum",
    "roll_up",
    "running_total",
    "semi_on",
    "share_of_group",
    "top_n_per_group",
    "union_all",
    "violations",
    "with_scalar",
]
