"""Report parameters.

The reference hard-codes its constants (a date, two facilities, a doctor's
id, a weekday); here they are parameters.  ``TESTDATA`` holds the values used
with the tables derived from the driver's testdata.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    event_date: str = "1998-06-01"  # Q1: vaccination events on this date
    event_workday: int = 1  # Q1: shift weekday (a literal, not derived from the date)
    doctor_workday: int = 3  # Q2: Wednesday
    doctor_role: str = "doctor"  # Q2
    facilities: tuple[str, ...] = ("Supplier#000000000", "Supplier#000000002")  # Q2
    diagnosed_after: str = "1998-06-01"  # Q4: strictly after
    as_of: str = "2021-05-15"  # T4-T6: ages are whole years at this date
    ill_staff: str = "S0"  # T10: the ill staff member
    range_start: str = "1998-01-01"  # T10: exclusive
    range_end: str = "2000-01-01"  # T10: exclusive
    genders: tuple[str, ...] = ("F", "M")  # T3
    top_k: int = 3  # T3
    vaccines: tuple[str, ...] = ("V0", "V1", "V2", "V3", "V4")  # T7c-T7e: the wide tables' columns
    new_vaccine: str = "V9"  # T7e, finer words: a vaccine without doses
    fine_words: tuple[tuple[float, str], ...] = ((0.0085, "very common"), (0.0081, "common"))  # T7e, finer words


TESTDATA = Params()
