"""Nearest neighbours by inner product, with collision-counting hashing.

Vectors are dealt to shards by a hash of their ids, and a shard's vectors to
parts by their length. A part keeps, for each of many random projections, an
array of its vectors sorted by the projected value, cut into at most 256 cells
of equally many vectors; a vector is a byte for each projection. A query opens
a window about its own value in every array, a run of cells, and a vector
collides where its cell is in the window: 64 bytes or so are compared at once.
All windows widen together (virtual rehashing). As windows only grow, the
vectors that have collided often enough at the last width are all that ever
did, so two widths are counted: at the first the vectors with the most
collisions are verified by their exact inner products, and the k-th best of
them says at which width a query may stop, as a vector nearer than that would
have collided often enough but for a chance of MISSED. All that have at that
width are verified. Parts too short to beat the best k are left out exactly.

Inner products become distances by one more coordinate that gives every
vector of a part the same length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bare, settle

K, QUERY_STEP = 20, 20
#: Vectors of a shard; queries that are sent to a shard's task at most, and those that are searched for together.
SHARD_ROWS, BLOCK_ROWS, TOGETHER = 16_384, 65_536, 256
#: Projections (a byte holds their number), and the share of them that a vector must collide in.
PROJECTIONS, COLLISIONS = 192, 0.65
#: Half of the first window, in lengths of the difference of two unrelated vectors, and the vectors verified then for each of the k.
FIRST_WIDTH, FIRST_SHARE = 0.5, 4
#: Cells of a sorted array, and vectors that are counted at once (their bytes fit a core's cache).
CELLS, COUNTED = 256, 2048
#: The chance that a vector as near as the k-th best has not collided often enough when a query stops.
MISSED = 0.2
#: Dimensions from which near and far differ so little that the chance must be this instead.
MANY, MISSED_OF_MANY = 200, 0.14
#: Squared lengths of a part's vectors are more than the largest divided by this.
PART_RATIO = 4.0
SEED = 7


def stop_width(d: int = 1) -> float:
    """The half window, in distances of the k-th best, at which a query stops.

    A vector at distance r is in a window of half width w with probability
    p = erf(w / (r sqrt 2)); of PROJECTIONS such trials fewer than are needed
    succeed with probability MISSED (MISSED_OF_MANY from MANY dimensions on).
    """
    need = math.ceil(COLLISIONS * PROJECTIONS)
    low, high = 0.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        p = math.erf(mid / math.sqrt(2))
        missed = sum(math.comb(PROJECTIONS, j) * p**j * (1 - p) ** (PROJECTIONS - j) for j in range(need))
        low, high = (mid, high) if missed > (MISSED if d < MANY else MISSED_OF_MANY) else (low, mid)
    return high


def projections(d: int) -> np.ndarray:
    """PROJECTIONS columns of d normal numbers; as many as fit are at right angles, so that their counts vary less."""
    rng = np.random.default_rng(SEED)
    columns = []
    for _ in range(-(-PROJECTIONS // d)):
        angles, _ = np.linalg.qr(rng.normal(size=(d, d)))
        columns.append(angles * np.sqrt(rng.chisquare(d, size=d)))
    return np.concatenate(columns, axis=1)[:, :PROJECTIONS]


class Shard:
    """An index over vectors: ids (ascending) and rows of doubles."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        d = rows.shape[1]
        squares = (rows * rows).sum(1)
        self.reach = float(squares.max())
        spare = np.sqrt(np.maximum(self.reach - squares, 0))
        self.draws = projections(d + 1)
        values = (rows @ self.draws[:d] + spare[:, None] * self.draws[d]).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        # edges[c] is the place in a sorted array where cell c begins
        n = len(rows)
        self.edges = np.arange(min(n, CELLS) + 1) * n // min(n, CELLS)
        of_place = np.repeat(np.arange(min(n, CELLS), dtype=np.uint8), np.diff(self.edges))
        cells = np.empty((PROJECTIONS, n), np.uint8)
        np.put_along_axis(cells, self.order, np.broadcast_to(of_place, cells.shape), axis=1)
        self.cells = [np.ascontiguousarray(cells[:, at : at + COUNTED]) for at in range(0, n, COUNTED)]

    def windows(self, centres: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every query (a row) and projection the first cell of its window and the one after the last, to the nearest edge.

        centres: queries' values by projection; width: each query's half window.
        """
        low, high = np.empty(centres.T.shape, np.int64), np.empty(centres.T.shape, np.int64)
        middles = (self.edges[1:] + self.edges[:-1]) / 2
        for j in range(PROJECTIONS):
            low[:, j] = np.searchsorted(middles, np.searchsorted(self.sorted[j], centres[j] - width, "left"))
            high[:, j] = np.searchsorted(middles, np.searchsorted(self.sorted[j], centres[j] + width, "right"))
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many windows [low, high) of one query each vector is."""
        open_ = high > low
        if not open_.all():
            # an empty window is that of no cell: all its vectors are taken off again
            return self.collisions(np.where(open_, low, 0), np.where(open_, high, CELLS)) - np.uint8(np.count_nonzero(~open_))
        first, span = low.astype(np.uint8)[:, None], (high - low - 1).astype(np.uint8)[:, None]
        return np.concatenate([np.add.reduce((block - first <= span).view(np.uint8), axis=0, dtype=np.uint8) for block in self.cells])

    def search(self, queries: np.ndarray, k: int, floors: np.ndarray) -> list[np.ndarray]:
        """For each query (a row) the positions of the verified vectors.

        floors: each query's k-th best inner product elsewhere, -inf where
        there are fewer; it is raised to the k-th best here and there.
        """
        n, d = self.rows.shape
        # the order of inner products does not depend on a query's length
        factor = math.sqrt(self.reach) / np.sqrt((queries * queries).sum(1))
        centres = ((queries * factor[:, None]) @ self.draws[:d]).T
        need = math.ceil(COLLISIONS * PROJECTIONS)
        stop = stop_width(d)
        found = [np.zeros(0, np.int64) for _ in queries]
        best = [np.full(k, floor) for floor in floors]
        # no inner product here is larger than that of the longest vector in the query's direction
        active = np.flatnonzero(floors <= self.reach / factor * (1 + 1e-9))

        def raised(i: int, fresh: np.ndarray) -> None:
            both = np.concatenate((best[i], self.rows[fresh] @ queries[i]))
            best[i] = np.partition(both, len(both) - k)[len(both) - k :]
            floors[i] = best[i].min()
            found[i] = np.concatenate((found[i], fresh))

        most = min(n, FIRST_SHARE * k)
        width = np.full(len(active), math.sqrt(2 * self.reach) * FIRST_WIDTH)
        for i, low, high in zip(active.tolist(), *self.windows(centres[:, active], width), strict=True):
            raised(i, np.argpartition(self.collisions(low, high), n - most)[n - most :])
        active = active[[len(found[i]) < n for i in active.tolist()]] if len(active) else active
        width = stop * np.sqrt(np.maximum(0.0, 2 * (self.reach - factor[active] * floors[active])))
        for i, low, high in zip(active.tolist(), *self.windows(centres[:, active], width), strict=True):
            known = np.zeros(n, bool)
            known[found[i]] = True
            raised(i, np.flatnonzero((self.collisions(low, high) >= need) & ~known))
        return found


def parts(rows: np.ndarray) -> list[np.ndarray]:
    """Positions of the rows of each part, the longest vectors first, ascending within a part."""
    squares = (rows * rows).sum(1)
    out, left = [], np.arange(len(rows))
    while len(left):
        near = squares[left] * PART_RATIO > squares[left].max()
        out.append(left[near])
        left = left[~near]
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles of a column of lists that are equally long."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).reshape(len(column), -1) if flat else np.zeros((0, 0))


def _index_and_search(k: int):
    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = np.concatenate([c.to_numpy() for c in vectors.column("vec_id").chunks]) if vectors.num_rows else np.zeros(0, np.int64)
        out_q, out_v, out_s = [], [], []
        if len(ids) and queries.num_rows:
            rows = _matrix(vectors.column("vector"))
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            asked = _matrix(queries.column("vector"))
            floors = np.full(len(asked), -np.inf)
            met: list[list[np.ndarray]] = [[] for _ in asked]
            for part in parts(rows):
                index = Shard(ids[part], rows[part])
                for at in range(0, len(asked), TOGETHER):
                    some = slice(at, at + TOGETHER)
                    for own, found in zip(met[some], index.search(asked[some], k + 1, floors[some]), strict=True):
                        own.append(part[found])
            for query_id, q, own in zip(queries.column("query_id").to_pylist(), asked, met, strict=True):
                found = np.concatenate(own)
                found = found[ids[found] != query_id]
                scores = rows[found] @ q
                if len(found) > k:
                    # a little more than k by the fast product; the exact one decides
                    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                    near = scores >= cut - 1e-9 * max(1.0, abs(cut))
                    found, scores = found[near], scores[near]
                exact = np.array([math.fsum(x) for x in (rows[found] * q).tolist()])
                best = np.lexsort((ids[found], -exact))[:k]
                out_q += [query_id] * len(best)
                out_v += ids[found[best]].tolist()
                out_s += exact[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of rows that take part, and the vector's dimension."""
    out = bare(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    out = out.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(~odd & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """The k nearest found of every vector whose id is divisible by `query_step`, among all but itself.

    vectors: vec_id (integer), embedding (array of float). Returns query_id,
    rank (from 1), vec_id, score: the inner product, largest first, ties to
    the smaller id. Vectors that are null, zero, or hold a null or non-finite
    component take no part; only vectors of the query's dimension are its
    candidates. Of rows that repeat an id one is kept, the least vector. Of
    equal vectors only the k + 1 smallest ids are indexed: no other can be
    among any query's k. An empty table gives an empty one; other columns are
    left aside; vectors may be of any length that a shard of them fits a task.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors).groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("r")).select("vec_id", "r.*"), "vectors")
    same = Window.partitionBy("dim", "vector").orderBy("vec_id")
    indexed = rows.withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= k + 1).drop("turn")
    indexed = settle(indexed, "indexed")
    shards = max(1, math.ceil(indexed.count() / SHARD_ROWS))
    queries = rows.where(F.col("vec_id") % query_step == 0)
    # a stated query set against all shards, block by block: every (shard, block) is a task's group, which indexes the
    # shard once; more blocks than memory asks for only where shards alone would leave cores idle
    idle = math.ceil(spark.sparkContext.defaultParallelism / shards)
    blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS), min(idle, 64))
    placed = indexed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    left = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("shard", "block", "dim", "vec_id", "vector")
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "block", "dim", F.col("vec_id").alias("query_id"), "vector")
    found = left.groupBy("shard", "block", "dim").cogroup(right.groupBy("shard", "block", "dim")).applyInArrow(_index_and_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
