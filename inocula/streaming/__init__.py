"""Streaming: the incremental (append) form of the sheet ingest."""

from .ingest import APPENDABLE, sheet_stream

__all__ = ["APPENDABLE", "sheet_stream"]
