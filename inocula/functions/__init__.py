"""Column -> Column helpers (all JVM-side built-ins, no Python UDFs)."""

from .scalars import (
    AGE_BANDS,
    WEEKDAY_NUMBERS,
    age_band,
    age_years,
    coerce_date,
    criticality_label,
    format_day,
    iso_weekday,
    month_name,
    rate_words,
    round_half_even,
    same_weekday,
    sentence,
    weekday_number,
)

__all__ = [
    "AGE_BANDS",
    "WEEKDAY_NUMBERS",
    "age_band",
    "age_years",
    "coerce_date",
    "criticality_label",
    "format_day",
    "iso_weekday",
    "month_name",
    "rate_words",
    "round_half_even",
    "same_weekday",
    "sentence",
    "weekday_number",
]
