"""Exact dedup against a minimal perfect hash of historical digests.

A text's digest is the SHA-256 of its bytes with A-Z lower-cased.  The index
holds the distinct digests of a history, dealt into buckets; a bucket is one
row: a minimal perfect hash (levels of bit arrays: a key sits at the first
level where no other remaining key shares its position, and its slot is its
rank among all set bits) whose slots hold the full digest, the winner's id
(largest) and the number of copies.  The hash itself gives any foreign key
some slot too, so every look-up compares all 32 bytes.

Incoming rows are first reduced to one row per digest (partial sums before
the shuffle, so a group of copies of any size costs one row a task), then
meet the index bucket by bucket: members update their slot, and the rest
group separately.  Buckets are of distinct digests, so they are even; their
number follows the distinct digests of both sides together.

Defined results: null text counts as empty; a null id never wins over another
and keep_id is null where all ids of a group are; rows with equal text and
equal id both count in the group and are both kept if that id wins; an empty
history makes all rows nonmembers; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, values

KEYS_PER_BUCKET = 50_000
GAMMA = 2.0  # bits per remaining key and level
MAX_LEVELS = 64

INDEX = "bucket int, levels array<binary>, digests binary, winners array<long>, copies array<long>"


def digest(text_col: str = "text") -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""

    @F.arrow_udf("binary")
    def compute(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([hashlib.sha256(t.lower()).digest() for t in values(a)], pa.binary())

    return compute(utf8(text_col))


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each key (n, 4) of 64-bit words stands at a level."""
    odd = np.uint64(2 * level + 1)
    h = (keys[:, level % 4] + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= keys[:, (level + 1) % 4] * odd
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the minimal perfect hash of distinct digests (n, 32)."""
    keys = digests.view(np.uint64).reshape(-1, 4)
    levels = []
    while len(keys):
        if len(levels) == MAX_LEVELS:
            raise ValueError("digests are not distinct")
        size = -(-max(64, int(GAMMA * len(keys))) // 8) * 8
        at = _position(keys, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where no level has a bit for it."""
    keys = digests.view(np.uint64).reshape(-1, 4)
    out = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        if not len(open_):
            break
        at = _position(keys[open_], k, len(bits))
        hit = bits[at]
        out[open_[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        open_ = open_[~hit]
        base += int(bits.sum())
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(values(column)), np.uint8).reshape(-1, 32)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket from (digest, winner, copies), digests distinct."""
    schema = pa.schema(
        [
            ("bucket", pa.int32()), ("levels", pa.list_(pa.binary())), ("digests", pa.binary()),
            ("winners", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())),
        ]
    )

    def build(t: pa.Table) -> pa.Table:
        d = _matrix(t.column("digest"))
        levels = build_levels(d)
        order = np.empty(len(d), np.int64)
        order[slots(levels, d)] = np.arange(len(d))
        row = {
            "bucket": [t.column("bucket")[0].as_py()],
            "levels": [[np.packbits(x).tobytes() for x in levels]],
            "digests": [d[order].tobytes()],
            "winners": [t.column("winner").take(order).to_pylist()],
            "copies": [t.column("copies").take(order).to_pylist()],
        }
        return pa.table(row, schema=schema)

    return (
        history.select(_bucket(buckets), "digest", F.col("winner").cast("long"), "copies")
        .groupBy("bucket")
        .applyInArrow(build, INDEX)
    )


def merge(index: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """(digest, keep_id, group_size, member) for history and incoming together.

    ``incoming`` has one row per digest: (digest, winner, copies).
    """
    out = "digest binary, keep_id long, group_size long, member boolean"
    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("member", pa.bool_())])

    def meet(ix: pa.Table, rows: pa.Table) -> pa.Table:
        ids, sizes, told, member = [], [], [], []
        if ix.num_rows:
            raw = ix.column("digests")[0].as_py()
            told = [raw[i : i + 32] for i in range(0, len(raw), 32)]
            ids, sizes = ix.column("winners")[0].as_py(), ix.column("copies")[0].as_py()
            member = [True] * len(told)
        if rows.num_rows:
            d = _matrix(rows.column("digest"))
            at = np.full(len(d), -1, np.int64)
            if ix.num_rows:
                levels = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in ix.column("levels")[0].as_py()]
                at = slots(levels, d)
                held = np.frombuffer(raw, np.uint8).reshape(-1, 32)
                at[(held[at] != d).any(axis=1)] = -1  # all 32 bytes, or it is foreign
            winners, copies = rows.column("winner").to_pylist(), rows.column("copies").to_pylist()
            for i, (slot, w, c) in enumerate(zip(at.tolist(), winners, copies, strict=True)):
                if slot >= 0:
                    ids[slot] = max((x for x in (ids[slot], w) if x is not None), default=None)
                    sizes[slot] += c
                else:
                    told.append(d[i].tobytes())
                    ids.append(w), sizes.append(c), member.append(False)
        return pa.table({"digest": told, "keep_id": ids, "group_size": sizes, "member": member}, schema=schema)

    rows = incoming.select(_bucket(buckets), "digest", F.col("winner").cast("long"), "copies")
    return index.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(meet, out)


def exact_duplicates(
    docs: DataFrame, is_history: Column, text_col: str = "text", id_col: str = "doc_id", keys_per_bucket: int = KEYS_PER_BUCKET
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, member, text_sha256.

    Rows where ``is_history`` holds make the index; all others are looked up.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(is_history, F.lit(False)).alias("old"),
            digest(text_col).alias("digest"),
        ),
        "digests",
    )
    per_digest = lambda part: part.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("copies"))
    distinct = rows.agg(F.approx_count_distinct("digest")).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), distinct // keys_per_bucket)
    index = build_index(per_digest(rows.filter("old")), buckets)
    groups = merge(index, per_digest(rows.filter("not old")), buckets)
    return rows.join(groups, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "member",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
