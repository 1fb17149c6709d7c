"""Incremental form of the sheet ingest: new export files are cleaned and
appended to their table as they arrive.

The batch ingest appends whole tables; on a live campaign new rows arrive as
new export files.  A file-source stream per sheet applies the same row-local
``clean_sheet`` and appends to the table's Parquet folder; the checkpoint
folder records which files are done, so a restart (or a lost executor)
neither skips nor duplicates a file.  The patient sheet is excluded: its
status column depends on all attendances (``patient_status``), which is a
batch recomputation, not an append.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import publish, write_folder
from ..sources.workbook import SHEET_TABLE, clean_sheet, sheet_path

APPENDABLE = tuple(s for s, t in SHEET_TABLE.items() if t != "patient")


def _stream_checkpoint(spark: SparkSession, table: str) -> str:
    """``<spark.checkpoint.dir>/streams/<table>``: a stable path, so a
    restarted application resumes where the last run stopped.  (The
    context's own checkpoint folder has a per-application suffix and would
    make a restart re-read every file.)"""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("pass checkpoint= or set spark.checkpoint.dir to a shared folder")
    return f"{base.rstrip('/')}/streams/{table}"


def sheet_stream(
    spark: SparkSession,
    export_root: str,
    sheet: str,
    header: list[str],
    table_root: str,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start appending cleaned rows of ``sheet`` exports to its table.

    Each micro-batch is a folder of the store named by its number, written
    whole (a retried batch replaces it) and then published once.

    ``header`` is the sheet's column list as exported (a file stream needs
    its schema up front; every column is read as text).  With
    ``available_now`` the query processes the files present and stops
    (scheduled runs); otherwise it keeps watching the folder.  The
    checkpoint defaults to ``<spark.checkpoint.dir>/streams/<table>``.
    """
    if sheet not in APPENDABLE:
        raise ValueError(f"{sheet}: not an append-only sheet")
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    src = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(sheet_path(export_root, sheet))
    )
    table = SHEET_TABLE[sheet]
    ckpt = checkpoint or _stream_checkpoint(spark, table)

    def append(batch, number: int) -> None:
        folder = f"{table_root.rstrip('/')}/_loads/stream-{table}-{number}"
        write_folder(batch, folder)

        def add(current):
            have = current.get(table, [])
            return current if folder in have else {**current, table: [*have, folder]}

        publish(batch.sparkSession, table_root, add)

    w = clean_sheet(sheet, src).writeStream.foreachBatch(append).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
