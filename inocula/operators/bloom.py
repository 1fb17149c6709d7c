"""A blocked Bloom filter of keys as a DataFrame: which rows of a large table may match.

The filter is a table (word number, 64 bits).  A key sets three bits of the one
word that its hash names; a row may match if its word has all three, which is one
lookup in a broadcast hash table and a comparison, in generated code.  Sixteen
bits a key let about one stranger in a hundred through; no match is lost.  The
table has a row per 64 bits, so its size follows from the number of keys, which
is counted first: beyond ``MOST_KEYS`` there is none, and the caller joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MOST_KEYS = 4_000_000  # a million words, some 40 MB as a broadcast hash table


def _word_and_bits(on: Sequence[str], words: int) -> tuple[Column, Column]:
    h = F.xxhash64(*on)
    bits = F.lit(0).cast("long")
    for at in (40, 46, 52):  # slices of the hash that the word number does not use
        place = F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63).cast("long")).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return h.bitwiseAND(F.lit(words - 1).cast("long")), bits


def key_filter(keys: DataFrame, on: Sequence[str], most: int = MOST_KEYS) -> tuple[DataFrame, int] | None:
    """(filter, number of words) of the keys, or None where they are more than ``most``.

    Keys with a null part match nothing and are left out.
    """
    keys = keys.select(*on).dropna()
    n = keys.limit(most + 1).count()
    if n > most:
        return None
    words = 1
    while words * 64 < n * BITS_PER_KEY:
        words *= 2
    word, bits = _word_and_bits(on, words)
    return keys.groupBy(word.alias("_word")).agg(F.bit_or(bits).alias("_bits")), words


def possibly_in(df: DataFrame, on: Sequence[str], bits: tuple[DataFrame, int]) -> DataFrame:
    """Rows of ``df`` whose key may be among those of the filter."""
    table, words = bits
    word, own = _word_and_bits(on, words)
    met = df.withColumns({"_word": word, "_own": own}).join(F.broadcast(table), "_word")
    return met.where(F.col("_bits").bitwiseAND(F.col("_own")) == F.col("_own")).select(*[F.col(f"`{c}`") for c in df.columns])
