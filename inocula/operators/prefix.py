"""Running totals of any length: a prefix sum over range partitions.

A window without a partition key puts all rows in one task.  Here rows are
sorted by range, so every task holds a stretch of the order; a task sums its own
stretch, and starts from what the stretches before it add up to.  Those are one
number per task, so they are brought together on the driver (as many rows as
there are partitions, whatever the rows) and go back as a table of that size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .core import literal_rows


def prefix_sum(df: DataFrame, order: Sequence[str], value: str, alias: str = "cumulative", partitions: int | None = None) -> DataFrame:
    """``df`` with ``SUM(value) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING)``.

    ``order`` has to be total (add a tie-break), nulls first; null values count
    as nothing, and the total is null until the first value, as the window's
    is.  Whole numbers stay exact (up to 38 digits where the sum is beyond a
    long: use a decimal); the sorted rows are written once in the shared
    folder, since both passes need the same stretches.
    """
    spark = df.sparkSession
    part, before, own = "_inocula_part", "_inocula_before", "_inocula_own"
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    path = f"{ensure_checkpoint_dir(spark)}/prefix-{uuid.uuid4().hex}"
    ranged.withColumn(part, F.spark_partition_id()).write.parquet(path)
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])).parquet(path)
    stretch = Window.partitionBy(part).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {r[part]: r["s"] for r in stored.groupBy(part).agg(F.sum(value).alias("s")).collect()}
    offsets, total = [], None
    for p in sorted(sums):
        offsets.append((p, total))
        total = sums[p] if total is None else total if sums[p] is None else total + sums[p]
    summed = stored.withColumn(own, F.sum(value).over(stretch))
    kind = summed.schema[own].dataType
    if not offsets:
        return summed.drop(part).withColumnRenamed(own, alias)
    table = literal_rows(spark, offsets, [part, before]).select(part, F.col(before).cast(kind))
    zero = F.lit(0).cast(kind)
    both = F.when(F.col(own).isNull() & F.col(before).isNull(), None).otherwise(F.coalesce(own, zero) + F.coalesce(before, zero))
    # one row per partition of the sort
    return summed.join(F.broadcast(table), part).select(*[F.col(f"`{c}`") for c in df.columns if c != alias], both.cast(kind).alias(alias))
