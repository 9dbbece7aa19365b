"""What the operators on vectors share: rows that take part, exact integer parts, exact sums over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a block of rows that a Python worker works on at once.
BLOCK_NUMBERS = 1 << 18
#: Bits of a limb: sums of limbs fit 64 bits for 2 ** 22 partial sums.
LIMB = 40
#: Whole numbers up to this size, and the sums that follow from them, are kept in 64 bits; larger ones are Python's.
SAFE = 1 << 62


def whole_vectors(df: DataFrame, *names: str) -> DataFrame:
    """vec_id, vector (array of double), dim and the named columns of rows whose vector is not null and whose components are all finite; empty vectors have none to work on and go too."""
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), *[df[n] for n in names])
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(F.col("vector").isNotNull() & ~odd & (F.size("vector") > 0)).withColumn("dim", F.size("vector"))


def dimensions(vectors: DataFrame) -> dict[int, int]:
    """The number of vectors of each dimension (a table holds few)."""
    return {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()}


def blocks(batches: Iterator[pa.RecordBatch], column: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors of `dim` doubles as a matrix."""
    rows = max(4 * dim, BLOCK_NUMBERS // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            yield some, some.column(some.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scaled(values: np.ndarray, factor: int, shift: int = 0) -> np.ndarray:
    """floor(factor * value) + shift for a factor that is a power of two: 64-bit numbers where all fit, else Python's."""
    with np.errstate(over="ignore"):
        down = np.floor(values * factor)
    if not down.size or np.abs(down).max() < 1 << 61:
        return down.astype(np.int64) + shift
    # a double times a power of two is whole in Python however large it is
    exact = [int(v * factor) if abs(v) < 2.0**900 else int(v) * factor for v in values.ravel().tolist()]
    floors = [int(d) if abs(d) < 2.0**52 else e for d, e in zip(down.ravel().tolist(), exact, strict=True)]
    return np.array([v + shift for v in floors] + [None], object)[:-1].reshape(values.shape)


def largest(values: np.ndarray) -> int:
    return int(np.abs(values).max()) if values.size else 0


def wide(values: np.ndarray) -> np.ndarray:
    return values.astype(object)


def limbs(values) -> list[list[int]]:
    """Each whole number as limbs, the least first; all but the last are in [0, 2 ** LIMB)."""
    out = []
    for v in map(int, values):
        own = []
        while not -(1 << LIMB) < v < 1 << LIMB:
            own.append(v & ((1 << LIMB) - 1))
            v >>= LIMB
        out.append([*own, v])
    return out


def partial_sums(slots, sums, counts) -> pa.RecordBatch:
    """Partial sums of slots, by limbs; a slot's count stands with its least limb."""
    rows = [(int(s), k, v, int(c) if k == 0 else 0) for s, own, c in zip(slots, limbs(sums), counts, strict=True) for k, v in enumerate(own)]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["slot", "limb", "sum", "n"])


SUMS = "slot long, limb int, sum long, n long"


def totals(partial: DataFrame) -> dict[int, tuple[int, int]]:
    """Exact (sum, count) of each slot of partial sums; the caller bounds the number of slots."""
    out: dict[int, tuple[int, int]] = {}
    for r in partial.groupBy("slot", "limb").agg(F.sum("sum").alias("s"), F.sum("n").alias("n")).collect():
        s, n = out.get(r["slot"], (0, 0))
        out[r["slot"]] = (s + (r["s"] << (LIMB * r["limb"])), n + r["n"])
    return out


def as_long(values: np.ndarray) -> pa.Array:
    """64-bit numbers; null where one does not fit."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in map(int, values)], pa.int64())
