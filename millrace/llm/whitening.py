"""Whitening of vectors by TSQR: no covariance is ever formed.

Components become whole numbers, so their sums over all rows are exact and
rows are centred by whole numbers too. Each partition reduces its centred rows
block by block to one triangular factor R; the factors are merged in a tree,
FAN_IN at a time, and the singular value decomposition of the last one gives
the directions (its right vectors) and variances of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle
from .vectors import SAFE, SUMS, as_long, blocks, dimensions, largest, partial_sums, scaled, totals, whole_vectors, wide

#: Components are counted in units of 1 / SCALE, shifted to be positive where they are small.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Triangular factors that one task merges.
FAN_IN = 16


def exactly_centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums in whole numbers."""
    if n * (largest(x) + 1) + max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * wide(x) - np.array([*sums, None], object)[:-1]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n as doubles, rounded once."""
    return (exactly_centred(x, n, sums) / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """The sum over dimensions of (n * x - sums) ** 2, in whole numbers."""
    y = exactly_centred(x, n, sums)
    if y.dtype == object or largest(y) ** 2 * y.shape[1] >= SAFE:
        y = wide(y)
    return (y * y).sum(axis=1)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for _, rows in blocks(batches, "vector", dim):
            x = scaled(rows, SCALE, SHIFT)
            x = x if largest(x) * len(x) < SAFE else wide(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
            n += len(x)
        if n:
            yield partial_sums(range(dim), total, [n] * dim)

    return run


def _triangle(blocks_of_rows: Iterator[np.ndarray], dim: int) -> np.ndarray | None:
    """R of all rows, with as many rows as there are or dim."""
    r = None
    for block in blocks_of_rows:
        r = np.linalg.qr(block if r is None else np.concatenate((r, block)), mode="r")
    return r


def _packed(r: np.ndarray | None) -> pa.Array:
    return pa.array([] if r is None else [r.ravel()], pa.list_(pa.float64()))


def _reduced(dim: int, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _packed(_triangle((centred(scaled(rows, SCALE, SHIFT), n, sums) for _, rows in blocks(batches, "vector", dim)), dim))
        yield pa.RecordBatch.from_arrays([r], names=["r"])

    return run


def _merged(dim: int):
    def run(key, factors):
        own = (np.asarray(r.values).reshape(-1, dim) for c in factors.column("r").chunks for r in c)
        return pa.table({"node": pa.array([key[0].as_py() // FAN_IN]), "r": _packed(_triangle(own, dim))})

    return run


def _gram(dim: int, n: int, sums: list[int], onto: np.ndarray):
    """Of a partition's whitened rows: their sums and the sums of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = onto.shape[1]
        first, second = np.zeros(k), np.zeros((k, k))
        for _, rows in blocks(batches, "vector", dim):
            z = centred(scaled(rows, SCALE, SHIFT), n, sums) @ onto
            first += z.sum(axis=0)
            second += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate((first, second.ravel())))], names=["place", "value"])

    return run


@dataclass
class Whitening:
    """What whitens the vectors of one dimension.

    onto: a column for each component, its direction over the root of its
    variance; explained: its share of all variance. Components without
    variance are not here. error: the largest entry by which the covariance of
    the whitened vectors departs from the identity.
    """

    dim: int
    n: int
    sums: list[int]
    onto: np.ndarray
    explained: np.ndarray
    error: float


def fit(vectors: DataFrame, dim: int, n: int, components: int = COMPONENTS) -> Whitening:
    """Learn from all n vectors of `dim` components (whole_vectors)."""
    own = vectors.where(F.col("dim") == dim).select("vector")
    got = totals(own.mapInArrow(_sums(dim), SUMS))  # dim slots
    sums = [got[k][0] for k in range(dim)]
    # a row of dim * dim numbers at most for each partition; each level leaves one for FAN_IN of them
    node = (F.spark_partition_id() / FAN_IN).cast("long")
    factors = settle(own.mapInArrow(_reduced(dim, n, sums), "r array<double>").select(node.alias("node"), "r"), "factors")
    while factors.count() > FAN_IN:
        before, factors = factors, settle(factors.groupBy("node").applyInArrow(_merged(dim), "node long, r array<double>"), "factors")
        discard(before)
    r = np.concatenate([np.array(row["r"]).reshape(-1, dim) for row in factors.collect()])
    discard(factors)
    _, sigma, right = np.linalg.svd(np.linalg.qr(r, mode="r"), full_matrices=False)
    some = sigma > max(n, dim) * np.finfo(float).eps * sigma[0] if sigma.size else sigma > 0
    k = min(int(some.sum()), components)
    # sigma ** 2 / n is a component's variance
    onto = right[:k].T * (np.sqrt(n) / sigma[:k])
    explained = sigma[:k] ** 2 / (sigma**2).sum() if k else np.zeros(0)
    error = 0.0
    if k:
        sums_of = own.mapInArrow(_gram(dim, n, sums, onto), "place long, value double").groupBy("place").agg(F.sum("value").alias("v")).collect()  # k * k + k rows
        v = np.array([r["v"] for r in sorted(sums_of, key=lambda r: r["place"])]) / n
        error = float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max())
    return Whitening(dim, n, sums, onto, explained, error)


def _projected(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, rows in blocks(batches, "vector", w.dim):
            x = scaled(rows, SCALE, SHIFT)
            z = centred(x, w.n, w.sums) @ w.onto
            exact = deviations(x, w.n, w.sums)
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [some.column(0), as_long(exact), pa.array(map(str, exact.tolist()), pa.string()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))],
                names=["vec_id", "deviation", "deviation_text", "whitened"],
            )

    return run


def whiten(df: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, dict[int, Whitening]]:
    """Per vector: vec_id, dim, n, deviation, deviation_text, whitened (array); and what whitens each dimension.

    df: vec_id, embedding. Vectors that are null, empty, or hold a null or
    non-finite component take no part. Vectors of different dimensions are fit
    lists of their own. deviation is null where it doesn't fit 64 bits;
    deviation_text always has it. whitened has an entry for each component
    with variance, at most `components` of them, so vectors that are all equal
    (or a single one) have none. Repeated rows count and come back as often as
    they are there; null ids stay; other columns are left aside; an empty
    table gives an empty one.
    """
    vectors = whole_vectors(df)
    fitted = {dim: fit(vectors, dim, n, components) for dim, n in dimensions(vectors).items()}
    schema = "vec_id long, deviation long, deviation_text string, whitened array<double>"
    out = None
    for w in fitted.values():
        own = vectors.where(F.col("dim") == w.dim).select("vec_id", "vector").mapInArrow(_projected(w), schema)
        own = own.select("vec_id", F.lit(w.dim).alias("dim"), F.lit(w.n).cast("long").alias("n"), "deviation", "deviation_text", "whitened")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = vectors.limit(0).select("vec_id", "dim", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.lit("").alias("deviation_text"), F.col("vector").alias("whitened"))
    return out, fitted


def by_component(df: DataFrame) -> DataFrame:
    """A row for each vector and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error, dim, deviation_text."""
    rows, fitted = whiten(df)
    long = rows.select("*", F.posexplode("whitened").alias("at", "value"))
    explained, error = F.lit(None).cast("double"), F.lit(None).cast("double")
    for w in fitted.values():
        if len(w.explained):
            shares = F.array(*[F.lit(float(v)) for v in w.explained])
            explained = F.when(F.col("dim") == w.dim, F.get(shares, F.col("at"))).otherwise(explained)
        error = F.when(F.col("dim") == w.dim, F.lit(w.error)).otherwise(error)
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"), explained.alias("explained"), error.alias("identity_error"), "dim", "deviation_text"
    )
