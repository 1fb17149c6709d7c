"""inocula: immunisation-campaign analytics as lazy Spark DataFrame plans.

Sub-packages
------------
sources    table schemas' readers/writers, workbook ingest, testdata derivation
functions  column -> column scalar helpers (banding, ages, weekdays, rounding)
operators  reusable DataFrame -> DataFrame building blocks and data-quality audits
plans      the report catalogue (Q*, T*, V*) and operator demos on raw tables
streaming  incremental (append) form of the sheet ingest
"""

__version__ = "0.1.0"
