"""Exact distinct counts that add up: bitmaps of dense numbers.

``COUNT(DISTINCT x)`` per group says nothing about the union of two groups.  A
bitmap does: every distinct x gets a number from 0 without gaps, a group holds
the bits of its numbers, and the union of groups is the OR of their bitmaps.  A
bitmap is cut into words of 64 numbers; rows are (group, piece, bits), only of
words that hold a bit.  So small groups over many numbers take eight bytes a
value at most, a group of any size is spread over rows and tasks, and both steps
aggregate before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sum


def number_values(df: DataFrame, column: str, number: str = "number") -> DataFrame:
    """(column, number): the distinct non-null values, numbered from 0 in their order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    return prefix_sum(values, [column], "_one", number).select(column, (F.col(number) - 1).alias(number))


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], column: str, numbers: DataFrame, number: str = "number") -> DataFrame:
    """(keys, piece, bits) of the values in each group; ``numbers`` as of ``number_values``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number).bitwiseAND(F.lit(63)).cast("int"))
    return (
        df.select(*keys, column)
        .join(numbers, column)
        .groupBy(*keys, F.shiftright(number, 6).alias("piece"))
        .agg(F.bit_or(bit).alias("bits"))
    )


def roll_up(bitmaps: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Bitmaps of coarser groups: the OR of theirs."""
    return bitmaps.groupBy(*keys, "piece").agg(F.bit_or("bits").alias("bits"))


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str], alias: str = "distinct") -> DataFrame:
    """Distinct values per group."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias(alias))
