"""Embedding whitening by polarisation of exact variances.

Entries become whole numbers x = floor(scale * c) + shift, so that sums over
all rows can be exact.

1. Sums of x per dimension, and their range, by Spark.
2. Every entry is centred as y = n x - S, a whole number, and every task sums
   the squares of y_i for each dimension and of y_i + y_j for each pair of
   dimensions, exactly: a square is a sum of products of 21-bit limbs, and
   limb products are added as whole numbers.  Spark adds the tasks' sums as
   decimals of 38 digits.
3. Polarisation: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, in whole
   numbers, divided once by n**3.  The matrix goes to ``eigh``.
4. A vector's whitened components are its centred entries on the unit
   eigenvectors over the root of their eigenvalues.

What reaches the driver grows with the square of the dimensions, not with the
rows: sums of d + d (d - 1) / 2 numbers.

Defined results: a vector that is null or holds null, NaN or infinite entries
is left out, and so is one of another length than most (of equally many, the
longer); repeated rows count as often as they occur; with no rows, or none that
differ, there are no components.  Eigenvalues under 1e-12 of the largest are
zero and have no component.  Entries have to stay under 2**53 after scaling,
or fitting raises a ValueError.  Columns but those asked for stay as they are;
an existing column named as a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LIMB = 21  # bits
ROWS = 2048  # rows whose pair sums are formed at once


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # of x, per dimension
    values: tuple[float, ...]  # eigenvalues kept, falling
    axes: np.ndarray  # dimensions x components, unit columns
    trace: float
    widest: int  # no |n x - S| is larger
    scale: int = SCALE
    shift: int = SHIFT

    def explained(self) -> list[float]:
        return [v / self.trace for v in self.values]


def finite(col: str) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    plain = F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.col(col).isNotNull() & F.coalesce(plain, F.lit(False))


def lattice(col: str, scale: int, shift: int) -> Column:
    def whole(c: Column) -> Column:
        x = c * scale
        # what a long may not hold is far beyond the range that fitting accepts
        return F.when(F.abs(x) < float(1 << 60), F.floor(x).cast("long") + F.lit(shift).cast("long")).otherwise(F.lit(1 << 60).cast("long"))

    return F.transform(F.col(col).cast("array<double>"), whole)


def usable(vectors: DataFrame, vec_col: str, width: int) -> DataFrame:
    return vectors.filter(finite(vec_col) & (F.size(vec_col) == width))


def _matrix(column, width: int) -> np.ndarray:
    """Rows x width, from an Arrow column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def centred(x: np.ndarray, n: int, sums: np.ndarray, widest: int) -> np.ndarray:
    """n x - S in 64 bits, or in Python's whole numbers where those do not hold it."""
    if widest < 1 << 61 and max(map(abs, sums)) < 1 << 62:
        return x.astype(np.int64) * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums.astype(object)


def square_sums(s: np.ndarray) -> list[int]:
    """Exact sums of squares of each column of whole numbers under 2**62."""
    if s.dtype == object:
        return [int(v) for v in (s * s).sum(axis=0)]
    mask = (1 << LIMB) - 1
    low, mid, high = s & mask, (s >> LIMB) & mask, s >> (2 * LIMB)
    dot = lambda a, b: np.einsum("ij,ij->j", a, b)  # noqa: E731  (products under 2**42, ROWS of them)
    weighed = [
        (dot(low, low), 0), (2 * dot(low, mid), 1), (dot(mid, mid) + 2 * dot(low, high), 2),
        (2 * dot(mid, high), 3), (dot(high, high), 4),
    ]
    return [sum(int(part[j]) << (LIMB * k) for part, k in weighed) for j in range(s.shape[1])]


def pair_sums(vectors: DataFrame, lattice_col: str, n: int, sums: list[int], widest: int) -> DataFrame:
    """(i, j, part, q): sums of (y_i + y_j)**2, of y_i**2 where i = j, as digits to the base 2**62."""
    width, s = len(sums), np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (width - i) for i in range(width)]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = centred(_matrix(b.column(0).slice(at, ROWS), width), n, s, widest)
                for i in range(width):
                    added = y[:, i:] + y[:, i : i + 1]
                    added[:, 0] = y[:, i]
                    total[i] = [a + q for a, q in zip(total[i], square_sums(added), strict=True)]
        out = []
        for i in range(width):
            for k, q in enumerate(total[i]):
                part = 0
                while q:
                    out.append((i, i + k, part, q & ((1 << 62) - 1)))
                    q, part = q >> 62, part + 1
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "part", "q"])

    each = vectors.select(lattice_col).mapInArrow(run, "i int, j int, part int, q long")
    return each.groupBy("i", "j", "part").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q"))


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """Means, exact covariances and their leading eigenvectors over all usable rows."""
    lengths = vectors.filter(finite(vec_col)).groupBy(F.size(vec_col).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    nothing = Whitening(0, (), (), np.zeros((0, 0)), 0.0, 0, scale, shift)
    if lengths is None or not lengths["w"]:
        return nothing
    n, width = lengths["count"], lengths["w"]
    x = usable(vectors, vec_col, width).select(lattice(vec_col, scale, shift).alias("x"))
    per_dimension = (
        x.select(F.posexplode("x").alias("d", "v"))
        .groupBy("d")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    per_dimension.sort(key=lambda r: r["d"])
    if max(max(abs(r["lo"]), abs(r["hi"])) for r in per_dimension) >= 1 << 53:
        raise ValueError("entries of 2**53 and more after scaling")
    sums = [int(r["s"]) for r in per_dimension]
    widest = max(max(abs(n * r["lo"] - s), abs(n * r["hi"] - s)) for r, s in zip(per_dimension, sums, strict=True))
    squares: dict[tuple[int, int], int] = {}
    for r in pair_sums(x, "x", n, sums, widest).collect():
        squares[r["i"], r["j"]] = squares.get((r["i"], r["j"]), 0) + (int(r["q"]) << (62 * r["part"]))
    q = lambda i, j: squares.get((i, j), 0)
    cov = np.zeros((width, width))
    for i in range(width):
        cov[i, i] = q(i, i) / n**3
        for j in range(i + 1, width):
            cov[i, j] = cov[j, i] = (q(i, j) - q(i, i) - q(j, j)) / (2 * n**3)
    values, axes = np.linalg.eigh(cov)
    order = [k for k in range(width - 1, -1, -1) if values[k] > 1e-12 * values[-1]][:components]
    return Whitening(
        n, tuple(sums), tuple(float(values[k]) for k in order), axes[:, order], float(np.trace(cov)), widest, scale, shift
    )


def whiten(vectors: DataFrame, model: Whitening, vec_col: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The usable rows with array<double> ``out``, a value per component, and the
    exact sum of (n x - S)**2 as the decimal column ``deviation``."""
    kept = [c for c in vectors.columns if c not in (out, deviation)]
    new = T.StructType.fromDDL(f"`{out}` array<double>, `{deviation}` decimal(38,0)")
    schema = T.StructType([vectors.schema[c] for c in kept] + list(new))
    width, n, sums, widest = len(model.sums), model.n, np.array(model.sums, object), model.widest
    project = model.axes / np.sqrt(model.values) if model.values else model.axes
    plain = widest * widest * max(width, 1) < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = centred(_matrix(b.column(len(kept)), width), n, sums, widest)
            squares = (y * y if plain else y.astype(object) * y.astype(object)).sum(axis=1)
            z = (y.astype(np.float64) / n) @ project
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * z.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(z.reshape(-1)))
            far = pa.array([int(v) for v in squares.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists, far], names=[*kept, out, deviation])

    x = lattice(vec_col, model.scale, model.shift).alias("__inocula_lattice")
    return usable(vectors, vec_col, width if n else -1).select(*kept, x).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, out: str = "whitened", components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the covariance of ``out`` minus the identity.

    ``covar_pop`` keeps running means, so products are of centred values.
    """
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    w = lambda i: F.get(out, F.lit(i))
    row = whitened.agg(*[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    found = [abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if row[f"c{i}_{j}"] is not None]
    return max(found, default=None)
