"""Helpers shared by the operators: reading, shared-folder tables, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# [A-Za-z0-9] and every byte of a non-ASCII character stay (A-Z lower-cased);
# all other ASCII characters become a space.  bytes.split() of the result are
# the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let the session's Python workers import this package from where it lies.

    On a cluster the package is shipped with --py-files, and this adds nothing.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts go to the Python workers in Arrow batches of ``BATCH_BYTES``, or one row.

    Spark's own limit, 10,000 rows and 64 MB, is held several times over, outside the
    heap: as the batch and the larger buffer it grows into, and in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(name, "64m")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(col: str) -> Column:
    """The bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: what is computed once here survives lost executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove ``stored`` tables that no later step reads.

    Only for tables whose readers are stored themselves: a step that is run again
    after a lost executor starts from those.
    """
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession, *broadcasts) -> None:
    """Give back what finished steps leave: their broadcasts, and their shuffle files.

    Spark removes the shuffle files of a query once the driver has collected the
    query as garbage, which may be long after; what is stored needs them no more.
    """
    for b in broadcasts:
        b.destroy()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside remove their shuffle files when they end.

    For queries that run once, their results stored or collected; a DataFrame
    that is run a second time would have to shuffle again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_held: dict = {}


def held(key, make):
    """The object that a Python worker keeps from task to task: the one asked for last.

    Workers outlive the step that filled them, and the next step has a cache of
    its own; asking for another key drops the one held and gives its memory back.
    """
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what an earlier step's tasks left ``held`` in this worker."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system (Arrow's pool, then malloc's)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library: nothing to trim
        pass


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def values(column) -> Iterator:
    """The Python values of an Arrow array, one at a time."""
    return (v.as_py() for v in column)


def batches_of(rows: Iterable, size: int) -> Iterator[list]:
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def map_texts(docs: DataFrame, text_col: str, fields: str, compute, drop: tuple[str, ...] = (), rows: int = 256) -> DataFrame:
    """``docs`` without ``drop``, with new columns computed from the text's bytes.

    ``compute`` gets the texts (null: empty) of ``rows`` documents and returns
    one Arrow array per new column of ``fields`` (a DDL string).  Output
    leaves in small batches, so a worker holds the results of few documents.
    """
    new = T.StructType.fromDDL(fields)
    names = [c for c in docs.columns if c not in (*drop, *new.fieldNames())]
    schema = T.StructType([docs.schema[c] for c in names] + list(new))

    # a text that stays in the rows is sent once, as it is
    kept = names.index(text_col) if text_col in names and isinstance(docs.schema[text_col].dataType, T.StringType) else None
    sent = names if kept is not None else [*names, "__inocula_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                column = part.column(len(sent) - 1 if kept is None else kept)
                texts = [x.to_pybytes() if (x := t.as_buffer()) is not None else b"" for t in column]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], *compute(texts)], names=[*names, *new.fieldNames()]
                )

    source = docs if kept is not None else docs.withColumn("__inocula_bytes", utf8(text_col))
    return source.select(*sent).mapInArrow(run, schema)


def sampled_rows(docs: DataFrame, ids: DataFrame, id_col: str, payload: Column, keep: list[str], most: int) -> list:
    """Rows of ``docs`` whose id is in ``ids`` (a bounded table), as a bounded list.

    ``payload`` is computed from the row's text and comes back as ``x``, with
    the columns ``keep``; identical rows count once, and of more than ``most``
    (ids that repeat) those with the least hash are returned.
    """
    return (
        docs.join(F.broadcast(ids), id_col)
        .withColumn("x", payload)
        .select("x", *keep, F.xxhash64("x", *keep).alias("h"))
        .dropDuplicates(["h"])
        .orderBy("h")
        .limit(most)
        .collect()
    )


def least_ids(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """``n`` ids of ``rows`` at most: those with the least hash (a top-n per task)."""
    return rows.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(n)
