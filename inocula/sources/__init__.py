"""Table sources and sinks: testdata derivation, workbook ingest, storage."""

from .derived import RAW_TABLES, derived_tables, read_raw

__all__ = ["RAW_TABLES", "derived_tables", "read_raw"]
