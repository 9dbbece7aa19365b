"""Product codes of vectors, with codebooks searched by vantage-point trees.

Vectors of whole numbers are cut into PARTS equal parts, and every part
position has a codebook. An entry of it is found by branch and bound in a
vantage-point tree: the entries about a vantage entry are halved by distance,
and a half is left out when the triangle inequality shows that all of it is
further than the best so far. Bounds are whole numbers, rounded so that they
never claim too much; a half that could only tie is visited; the answer is
decided by whole squared distances, ties going to the lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, small
from .vectors import SUMS, as_long, blocks, dimensions, largest, partial_sums, scaled, totals, whole_vectors, wide

#: Components are counted in units of 1 / SCALE.
SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a leaf, which are all compared.
LEAF = 8


def root_below(squares: np.ndarray) -> np.ndarray:
    """A whole number that is at most the root."""
    if squares.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(squares)
    down = np.sqrt(squares.astype(float)).astype(np.int64)
    return np.maximum(down - 1, 0)


def root_above(squares: np.ndarray) -> np.ndarray:
    """A whole number that is at least the root."""
    if squares.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(squares) + 1
    return np.sqrt(squares.astype(float)).astype(np.int64) + 2


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    d = a - b
    return (d * d).sum(axis=-1)


class Tree:
    """A vantage-point tree over the rows of `entries` (whole numbers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray):
        """A leaf: indices. Else (vantage index, ((halves as (least, greatest) distance to it and node), twice))."""
        if len(own) <= LEAF:
            return own
        # the entry furthest from the first one splits the rest most unevenly in space
        vantage = own[int(np.argmax(squared(self.entries[own], self.entries[own[0]])))]
        rest = own[own != vantage]
        away = squared(self.entries[rest], self.entries[vantage])
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        sides = []
        for some in (order[:half], order[half:]):
            least, most = root_below(away[some[:1]])[0], root_above(away[some[-1:]])[0]
            sides.append((least, most, self._node(np.sort(rest[some]))))
        return vantage, sides

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry."""
        best = squared(queries, self.entries[0])
        index = np.zeros(len(queries), np.int64)
        self._descend(self.root, queries, np.arange(len(queries)), index, best)
        self._visit(self.root, queries, np.arange(len(queries)), index, best)
        return index, best

    def _take(self, candidate, away: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        better = (away < best[rows]) | ((away == best[rows]) & (candidate < index[rows]))
        hit = rows[better]
        best[hit] = away[better]
        index[hit] = candidate[better] if isinstance(candidate, np.ndarray) else candidate

    def _leaf(self, own: np.ndarray, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        away = squared(queries[rows][:, None, :], self.entries[own])
        at = away.argmin(axis=1)  # the first of equal ones, and the lowest index, as a leaf is in order
        self._take(own[at], away[np.arange(len(rows)), at], rows, index, best)

    def _descend(self, node, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        """A first bound: each query goes down to the nearer half only."""
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, queries, rows, index, best)
        vantage, ((_, most, inner), (least, _, outer)) = node
        away = squared(queries[rows], self.entries[vantage])
        self._take(vantage, away, rows, index, best)
        near = 2 * root_above(away) <= least + most
        self._descend(inner, queries, rows[near], index, best)
        self._descend(outer, queries, rows[~near], index, best)

    def _visit(self, node, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        """All halves that could hold an entry as near as the best."""
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, queries, rows, index, best)
        vantage, sides = node
        away = squared(queries[rows], self.entries[vantage])
        self._take(vantage, away, rows, index, best)
        low, high = root_below(away), root_above(away)
        for least, most, half in sides:
            # an entry of the half is at least this far from the query
            bound = np.maximum(low - most, least - high)
            self._visit(half, queries, rows[bound <= root_above(best[rows])], index, best)


def _whole(rows: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, with zeros to a multiple of PARTS, as (row, part, place)."""
    x = scaled(rows, SCALE)
    spare = -x.shape[1] % PARTS
    if spare:
        x = np.concatenate((x, np.zeros((len(x), spare), x.dtype)), axis=1)
    return x.reshape(len(x), PARTS, -1)


def _fitting(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits if no squared distance of them can leave these, else as Python's numbers."""
    far = largest(x) + largest(books)
    if far * far * x.shape[2] >= 1 << 52:  # within doubles, so that roots are safe
        return wide(x), wide(books)
    return x.astype(np.int64), books.astype(np.int64)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) by row and part; books: (part, entry, place)."""
    x, books = _fitting(x, books)
    found = [Tree(books[p]).nearest(x[:, p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(dim: int, books: np.ndarray):
    """Of a task's parts: their sums by entry and place, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, m, w = books.shape
        sums, counts = np.zeros(PARTS * m * w, object), np.zeros(PARTS * m, np.int64)
        for _, rows in blocks(batches, "vector", dim):
            x = _whole(rows)
            codes, _ = assign(x, books)
            places = codes + np.arange(PARTS) * m
            counts += np.bincount(places.ravel(), minlength=len(counts))
            x = x if largest(x) * len(x) < 1 << 53 else wide(x)
            for k in range(w):
                if x.dtype == object:
                    np.add.at(sums, places.ravel() * w + k, x[:, :, k].ravel())
                else:
                    sums[k::w] += np.rint(np.bincount(places.ravel(), x[:, :, k].ravel().astype(float), len(counts))).astype(np.int64).astype(object)
        used = np.flatnonzero(np.repeat(counts, w))
        yield partial_sums(used.tolist(), sums[used].tolist(), np.repeat(counts, w)[used].tolist())

    return run


def _coded(dim: int, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, rows in blocks(batches, "vector", dim):
            codes, away = assign(_whole(rows), books)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            error = away.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(text, pa.string()), as_long(error)], names=[*some.schema.names[:-1], "code", "error"])

    return run


def fit(vectors: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) of the vectors of `dim` components: at most 256 entries, as many as vectors where these are fewer."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits")
    own = vectors.where(F.col("dim") == dim)
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = _whole(np.array([r["vector"] for r in first], float)).transpose(1, 0, 2)
    for _ in range(rounds):
        # a slot for each place of each entry, entries * dim of them
        means = totals(own.select("vector").mapInArrow(_sums(dim, books), SUMS))
        flat = np.array([*books.ravel().tolist(), None], object)[:-1]
        for slot, (total, n) in means.items():
            flat[slot] = total // n
        flat = flat if largest(flat) >= 1 << 61 else flat.astype(np.int64)
        books = flat.reshape(books.shape)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, label, code, error, label_error, codebooks_sha256, dim.

    df: vec_id, embedding, label. Vectors that are null, empty, or hold a null
    or non-finite component take no part. Vectors of different dimensions have
    codebooks of their own; a dimension that PARTS does not divide is filled
    up with zeros. The first entries are those of the least vec_ids (nulls
    last, ties by the vector). Repeated rows count and come back as often as
    they are there. label_error sums the errors of equal labels, null ones
    together, whatever their dimension. Errors are exact; one that does not
    fit 64 bits is null, and so is a sum with it. Other columns are left
    aside; an empty table gives an empty one.
    """
    vectors = whole_vectors(df, "label")
    kind = vectors.schema["label"].dataType.simpleString()
    out = None
    for dim in dimensions(vectors):
        books = fit(vectors, dim, entries, rounds)
        own = vectors.where(F.col("dim") == dim).select("vec_id", "label", "vector").mapInArrow(_coded(dim, books), f"vec_id long, label {kind}, code string, error long")
        own = own.withColumn("codebooks_sha256", F.lit(digest(books))).withColumn("dim", F.lit(dim))
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"), "dim")
    coded = settle(out, "codes")
    exact = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    sums = settle(coded.groupBy(F.col("label").alias("_label")).agg(exact.alias("label_error")), "label-errors")
    joined = coded.join(small(sums), F.col("label").eqNullSafe(F.col("_label")))
    out = joined.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256", "dim")
    if coded.isEmpty():
        discard(sums)
        return coded.select("vec_id", "label", "code", "error", F.col("error").alias("label_error"), "codebooks_sha256", "dim")
    return out


#: Word for word what encode computes, in DuckDB's SQL: all entries against all parts.
ORACLE = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
x AS MATERIALIZED (
  SELECT r, vec_id, p, [CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT) FOR v IN embedding[p * (len(embedding) // 16) + 1 : (p + 1) * (len(embedding) // 16)]] AS part
  FROM kept, range(16) t(p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM kept QUALIFY e < 64),
b0 AS MATERIALIZED (SELECT p, e, part AS entry FROM x JOIN seeds USING (r)),
{rounds}
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
_ASSIGN = """a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, p, e, CAST(list_sum([(part[i] - entry[i]) * (part[i] - entry[i]) FOR i IN range(1, len(part) + 1)]) AS BIGINT) AS d FROM x JOIN b{k} USING (p)) GROUP BY r, p)"""
_MEAN = """m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS entry FROM (
    SELECT p, e, i, CAST(floor(sum(part[i])::DECIMAL(38, 0) / count(*)) AS BIGINT) AS m
    FROM x JOIN a{j} USING (r, p), range(1, len(part) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e),
b{k} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.entry, b{j}.entry) AS entry FROM b{j} LEFT JOIN m{k} USING (p, e))"""
ORACLE = ORACLE.format(rounds=",\n".join([_ASSIGN.format(k=0)] + [s for k in range(1, ROUNDS + 1) for s in (_MEAN.format(k=k, j=k - 1), _ASSIGN.format(k=k))]) + ",")
