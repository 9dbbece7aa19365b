"""Self-join of documents by the Jaccard similarity of their word n-grams.

Adaptive multi-match prefix filtering. Tokens (shingles) have one order for
the whole corpus: by frequency as a sketch of all documents estimates it, then
by value. Two sets of similarity t or more share at least l tokens among the
first n - ceil(t n) + l of each (the l-prefix). Each document chooses its own
l: the dearer the candidates that its prefix tokens promise, the longer its
prefix and the more shared tokens are required. A pair is held to the smaller
l of its two documents, so no link is lost, and verified on whole sets.

Sets that are equal are one class from the start. Classes that share a prefix
token are first compared with one centre of that token only; what these links
connect needs no further comparison, and only pairs of classes in different
components are counted token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, chunks, discard, flat_bytes, settle, small
from .components import connected_components
from .shingles import shingle_sets

WIDTH = 4
PERCENT = 85
#: Cells of the frequency sketch; its size is fixed, collisions cost candidates and never links.
CELLS = 1 << 22
BLOCKS = 64
#: Estimated candidates up to which a prefix asks for one shared token; each time as many again (x COST_STEP), one more.
COST_FREE, COST_STEP, LONGEST = 32, 8, 4
#: Bits of the parity map that bounds how much two sets differ.
PARITIES = 512


def _sketch_part(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for chunk in chunks(batches, "text"):
            sets = shingle_sets(*flat_bytes(chunk.column(0)), width)
            if sets:
                np.add.at(cells, (np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
        size = CELLS // BLOCKS
        codec = pa.Codec("zstd")
        for k in range(BLOCKS):
            block = cells[k * size : (k + 1) * size]
            if block.any():
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([k], pa.int32()), "cells": pa.array([codec.compress(block.tobytes(), asbytes=True)], pa.binary())}
                )

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of sketch blocks; a task holds one sketch at most."""
    total: dict[int, np.ndarray] = {}
    codec = pa.Codec("zstd")
    size = CELLS // BLOCKS
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block = np.frombuffer(codec.decompress(data.as_buffer(), size * 4), np.uint32)
            if k in total:
                total[k] += block
            else:
                total[k] = block.copy()
    for k, block in total.items():
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([k], pa.int32()), "cells": pa.array([codec.compress(block.tobytes(), asbytes=True)], pa.binary())}
        )


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle in each of CELLS cells; all documents count, the size is fixed (16 MB)."""
    parts = docs.select("text").mapInArrow(_sketch_part(width), "block int, cells binary")
    n = min(BLOCKS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = parts.repartition(n, "block").mapInArrow(_sum_blocks, "block int, cells binary")
    cells = np.zeros(CELLS, np.uint32)
    size = CELLS // BLOCKS
    codec = pa.Codec("zstd")
    for row in summed.toLocalIterator():
        cells[row.block * size : (row.block + 1) * size] += np.frombuffer(codec.decompress(bytes(row.cells), size * 4), np.uint32)
    return cells


def _prefixes(width: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cells = sketch.value
        load = float(cells.mean())
        common = load + 4 * load**0.5 + 1  # what chance alone puts into a cell
        for chunk in chunks(batches, "text"):
            sets = shingle_sets(*flat_bytes(chunk.column(1)), width)
            sizes, digests, demands, prefixes = [], [], [], []
            for s in sets:
                n = len(s)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if not n:
                    demands.append(0)
                    prefixes.append(s.view(np.int64))
                    continue
                weight = cells[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                order = np.argsort(weight, kind="stable")
                least = (percent * n + 99) // 100
                base = n - least + 1
                cost = np.cumsum(np.maximum(weight[order[: base + LONGEST - 1]] - common, 0.0))
                want, limit = 1, COST_FREE
                while want < min(LONGEST, least) and cost[min(base + want - 2, len(cost) - 1)] > limit:
                    want, limit = want + 1, limit * COST_STEP
                demands.append(want)
                prefixes.append(s[order[: base + want - 1]].view(np.int64))
            lengths = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(demands, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "digest", "demand", "prefix"],
            )

    return run


def _parities(tokens: np.ndarray) -> np.ndarray:
    """PARITIES bits, each the parity of the number of tokens that fall to it.

    Where two sets' bits differ, a token is in one of them only.
    """
    counts = np.bincount((tokens >> np.uint64(20) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            sets = shingle_sets(*flat_bytes(chunk.column(1)), width)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([chunk.column(0), tokens, pa.array([_parities(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "tokens", "bits"])

    return run


def _bound(percent: int, slack: str) -> str:
    """What a shared token at positions i, j still allows, with `slack` shared ones before it."""
    return f"({100 + percent}) * (least(a_n - a_pos, b_n - b_pos) + {slack}) >= {percent} * (a_n + b_n)"


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose whole sets are similar enough, settled.

    Sets are counted against each other in the join's own rows, one pair at a time.
    """
    pairs = settle(pairs, "pairs")
    firsts = settle(pairs.select(F.col("a").alias("doc_id")).distinct(), "firsts")
    one = sets.join(small(firsts), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")).join(small(pairs), "b")
    both = two.join(one, "a").withColumn("both", F.size(F.array_intersect("x", "y")))
    links = settle(both.where(f"100 * both >= {percent} * (size(x) + size(y) - both)").select("a", "b"), "links")
    discard(pairs, firsts)
    return links


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id.

    docs: doc_id (integer), text; other columns are left aside. Two documents
    link when 100 * |A and B| >= percent * |A or B| of their shingle sets.
    component_id is the least doc_id reachable by links. A null text counts as
    empty; empty sets link with nothing. Rows that repeat a doc_id are one
    node; a null doc_id is in no component (component_id null). An empty table
    gives an empty one. The length of a text is bounded by a row of Spark's only.
    """
    spark = docs.sparkSession
    docs = bare(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, width))  # 16 MB, whatever the input
    schema = "doc_id long, n_shingles long, digest binary, demand int, prefix array<long>"
    signed = settle(docs.mapInArrow(_prefixes(width, percent, sketch), schema), "signed")
    sketch.unpersist()

    # equal sets: one class, named by its least doc_id; partial aggregation takes hot classes
    solid = signed.where("n_shingles > 0 and doc_id is not null")
    classes = solid.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "demand", "prefix")).alias("r")).select("r.*")
    classes = settle(classes, "classes")
    # the tokens' exchanges are the largest: a row is the token, the document and one number of size, place and demand
    packed = F.shiftleft("n_shingles", 34) + F.shiftleft(F.col("pos").cast("long"), 4) + F.col("demand")
    posed = classes.select("doc_id", "n_shingles", "demand", F.posexplode("prefix").alias("pos", "token")).select("token", F.col("doc_id").alias("doc"), packed.alias("meta"))
    # tokens of several, by partial aggregation: no task takes all rows of a common one
    hubs = settle(posed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token"), "hubs")
    # by shuffle at every size: both sides grow with the corpus, and a common token's rows can be split
    tokens = posed.join(hubs.hint("merge"), "token")
    tokens = tokens.select("token", "doc", F.shiftright("meta", 34).alias("n"), F.shiftright("meta", 4).bitwiseAND((1 << 30) - 1).alias("pos"), F.col("meta").bitwiseAND(15).cast("int").alias("demand"))
    tokens = settle(tokens, "tokens")
    discard(classes, hubs)
    # a token's centre has it first, or is the least of those
    centres = tokens.groupBy("token").agg(F.min(F.struct("pos", "doc", "n")).alias("centre"))
    centres = settle(centres.select("token", F.col("centre.doc").alias("c_doc"), F.col("centre.n").alias("c_n"), F.col("centre.pos").alias("c_pos")), "centres")
    shared = settle(tokens.select(F.col("doc").alias("doc_id")).distinct(), "shared")
    sets = settle(docs.join(small(shared), "doc_id", "left_semi").mapInArrow(_set_rows(width), "doc_id long, tokens array<long>, bits array<long>"), "sets")

    # round 1: each token's centre against the others
    named = tokens.join(centres.hint("merge"), "token").select(
        F.col("c_doc").alias("a"), F.col("c_n").alias("a_n"), F.col("c_pos").alias("a_pos"),
        F.col("doc").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"),
    )
    pairs = named.where("a != b").where(_bound(percent, "0")).select("a", "b").distinct()
    stars = _links(pairs, sets, percent)
    labels = settle(connected_components(stars), "labels")

    # round 2: only what lies in different components, with as many shared tokens as the smaller demand
    known = labels.select(F.col("node").alias("doc"), "component")
    placed = settle(tokens.join(known, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "placed")
    split = placed.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("pos", "doc", "component")).alias("c")
    ).where("lo != hi").select("token", F.col("c.component").alias("main"))
    split = settle(split, "split")
    left = settle(placed.join(split, "token").select("token", "main", "doc", "n", "pos", "demand", "component"), "open")
    asked = settle(left.select("doc").distinct(), "asked")
    maps = settle(sets.select(F.col("doc_id").alias("doc"), "bits").join(small(asked), "doc", "left_semi").dropDuplicates(["doc"]), "maps")
    mapped = left.join(small(maps), "doc")
    sides = [
        mapped.select("token", "main", *[F.col(c).alias(f"{s}_{c}") for c in ("doc", "n", "pos", "demand", "component", "bits")]) for s in "ab"
    ]
    crossed = sides[0].where("a_component != main").join(sides[1].drop("main"), "token")
    crossed = crossed.where("a_component != b_component and (b_component = main or a_doc < b_doc)")
    crossed = crossed.withColumn("need", F.least("a_demand", "b_demand"))
    for s in "ab":  # the first of the token's l-prefixes that reaches its position, by this document's size
        base = F.expr(f"{s}_n - ({percent} * {s}_n + 99) div 100 + 1")
        crossed = crossed.where(F.col(f"{s}_pos") < base + F.col("need") - 1)
    crossed = crossed.where(_bound(percent, "need - 1"))
    # tokens in one set only are as many as the differing parities at least
    apart = " + ".join(f"bit_count(a_bits[{k}] ^ b_bits[{k}])" for k in range(PARITIES // 64))
    crossed = crossed.where(f"{100 - percent} * (a_n + b_n) >= {100 + percent} * ({apart})")
    counted = crossed.groupBy(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"), "need").agg(F.count(F.lit(1)).alias("shared"))
    rest = _links(counted.where("shared >= need").select("a", "b").distinct(), sets, percent)
    discard(labels, placed, split, left, asked, maps)

    final = settle(connected_components(stars.union(rest)), "components")
    discard(centres, stars, rest, tokens, sets, shared)
    roots = solid.groupBy("digest").agg(F.min("doc_id").alias("root")).join(final, F.col("root") == F.col("node"), "left")
    roots = settle(roots.select("digest", F.coalesce("component", "root").alias("component_id")), "roots")
    out = signed.join(roots, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


ORACLE = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {WIDTH} THEN list_distinct(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i : i + {WIDTH} - 1], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles FROM texts
),
tokens AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS t FROM sets),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met WHERE 100 * c >= {PERCENT} * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached(node, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT e.y, r.root FROM reached r JOIN edges e ON r.node = e.x)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN (SELECT node, min(root) AS component_id FROM reached GROUP BY node) r ON s.doc_id = r.node
"""
