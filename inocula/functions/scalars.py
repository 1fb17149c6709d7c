"""Scalar column functions used by the reports.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.lit(d).cast("date")


# Age band upper bounds (inclusive) and labels; anything else,
# including an unknown age, is the last label.
AGE_BANDS: tuple[tuple[int, str], ...] = (
    (10, "0-10"),
    (20, "10-20"),
    (40, "20-40"),
    (60, "40-60"),
)
AGE_BAND_LAST = "60+"
AGE_BAND_LABELS: tuple[str, ...] = tuple(lbl for _, lbl in AGE_BANDS) + (AGE_BAND_LAST,)

# Weekday names and their shift numbers (Monday = 1).
WEEKDAY_NUMBERS: dict[str, int] = {
    "Monday": 1,
    "Tuesday": 2,
    "Wednesday": 3,
    "Thursday": 4,
    "Friday": 5,
    "Saturday": 6,
    "Sunday": 7,
}

# Rate words and their lower bounds, checked top to bottom;
# a rate above 0 that meets none is 'rare', zero or unknown is '-'.
RATE_WORDS: tuple[tuple[float, str], ...] = ((0.1, "very common"), (0.05, "common"))
RATE_POSITIVE = "rare"
RATE_NONE = "-"

# Criticality codes and labels.
CRITICALITY_LABELS: dict[int, str] = {1: "Critical", 0: "Non-Critical"}

# Fixed value: the repair date for unreadable diagnosis dates.
REPAIR_DATE = "2021-02-28"


def age_years(birthday: ColumnOrName, as_of) -> Column:
    """Whole years between ``birthday`` and ``as_of`` (a date or Column).

    Calendar arithmetic: year difference, minus one when the (month, day) of
    ``as_of`` comes before that of the birthday.  A 29 February birthday thus
    turns a year older on 1 March in non-leap years, as a calendar age does.
    NULL birthday -> NULL.
    """
    b, a = _c(birthday), _lit_date(as_of)
    before = (F.month(a) < F.month(b)) | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) < F.dayofmonth(b)))
    return F.year(a) - F.year(b) - F.when(before, 1).otherwise(0)


def age_band(age: ColumnOrName, bands=AGE_BANDS, last: str = AGE_BAND_LAST) -> Column:
    """Chained CASE on an age; NULL falls through to ``last`` like the SQL CASE."""
    a = _c(age)
    out = None
    for hi, label in bands:
        out = F.when(a <= hi, F.lit(label)) if out is None else out.when(a <= hi, F.lit(label))
    return out.otherwise(F.lit(last))


def iso_weekday(d: ColumnOrName) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(_c(d)) + 1


def same_weekday(workday: ColumnOrName, d: ColumnOrName) -> Column:
    """Shift number matches the weekday of ``d``.

    Stated as in the source rule: ``(workday - dow) mod 7 == 0`` with
    dow 0 = Sunday .. 6 = Saturday (Spark's ``dayofweek`` is 1 = Sunday, so
    subtract one).  For valid workdays 1..7 this equals
    ``workday == iso_weekday(d)``; out-of-range workdays keep the rule's
    behaviour (0 and 14 match Sunday, 8 matches Monday).
    """
    return ((_c(workday) - (F.dayofweek(_c(d)) - 1)) % 7) == 0


def weekday_number(name: ColumnOrName) -> Column:
    """Weekday name -> 1..7; unknown or NULL name -> NULL."""
    m = F.create_map(*[x for k, v in WEEKDAY_NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _c(name))


# The ways the workbook export writes a date.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")


def parse_date(text: ColumnOrName) -> Column:
    """Text -> calendar date in any of ``DATE_FORMATS``; NULL where unreadable."""
    s = F.trim(_c(text).cast("string"))
    return F.coalesce(*[F.try_to_date(s, f) for f in DATE_FORMATS])


def coerce_date(text: ColumnOrName, fill: str | None = REPAIR_DATE) -> Column:
    """``parse_date``; unreadable (or NULL) -> ``fill`` (NULL if None)."""
    parsed = parse_date(text)
    return parsed if fill is None else F.coalesce(parsed, F.lit(fill).cast("date"))


def format_day(d: ColumnOrName) -> Column:
    """A date as 'yyyy-MM-dd' text."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def month_name(d: ColumnOrName) -> Column:
    """English month name of a date."""
    return F.date_format(_c(d), "MMMM")


def criticality_label(c: ColumnOrName) -> Column:
    """1 -> 'Critical', 0 -> 'Non-Critical', anything else -> NULL."""
    x = _c(c)
    out = None
    for code, label in CRITICALITY_LABELS.items():
        out = F.when(x == code, F.lit(label)) if out is None else out.when(x == code, F.lit(label))
    return out


def round_half_even(x: ColumnOrName, digits: int = 2) -> Column:
    """Round like numpy on the binary value: ``rint(x * 10^d) / 10^d``.

    ``F.round`` rounds half up on the decimal representation (0.045 -> 0.05)
    and ``F.bround`` works on the decimal string (0.575 -> 0.58); numpy gives
    0.04 and 0.57.
    """
    k = float(10**digits)
    return F.rint(_c(x).cast("double") * k) / k


def rate_words(rate: ColumnOrName, words=RATE_WORDS, positive: str = RATE_POSITIVE, none: str = RATE_NONE) -> Column:
    """Frequency words by threshold; NULL/NaN/zero -> ``none``."""
    r = _c(rate)
    out = None
    for lo, label in words:
        cond = r >= lo
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    out = out.when(r > 0.0, F.lit(positive)) if out is not None else F.when(r > 0.0, F.lit(positive))
    # NaN compares greater than everything in Spark; treat it as unknown
    return F.when(F.isnan(r), F.lit(none)).otherwise(out.otherwise(F.lit(none)))


def sentence(items: ColumnOrName, sep: str = ", ", end: str = ".") -> Column:
    """Join an array of strings with ``sep`` and close with ``end``."""
    return F.concat(F.array_join(_c(items), sep), F.lit(end))
