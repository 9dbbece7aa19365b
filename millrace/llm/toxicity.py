"""Toxicity by a factorization machine over hashed terms.

Terms are words and the beginnings of words, hashed into buckets. The score
is the logistic of a bias, a weight for each term of the text and an
interaction of each pair of terms through learned factors, so that terms can
count together what neither counts alone.

All terms of the examples are let in, with a value each instead of 1: what a
term is worth alone grows with how far its share of toxic examples departs
from chance, and what it is worth in pairs with that or with how common it is,
so that thousands of rare neutral words can't be learned by heart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, chunks, crc_mod, discard, flat_bytes, mix64, settle
from .shingles import LOWER, distinct, spans, word_hashes

#: Labelled rows that a model is fitted on, at most: those whose ids hash lowest.
FIT_ROWS = 10_000
BITS = 20
PREFIXES = (4, 5, 6)
#: Standard deviations from chance at which a term has its full value, the power of its share of the documents that it is
#: worth in pairs at least, and the value from which a term can change a score at all.
FULL_Z, COMMON, NIL = 4.0, 1.5, 1e-3
#: Examples below which what is only common is worth less in pairs: few say little about pairs of neutral terms.
ENOUGH = 1_000
FACTORS, BATCH, RATE, DECAY = 8, 256, 0.2, 1e-3
#: Passes over the examples, and steps that they make at least.
EPOCHS, STEPS = 15, 600
#: What a toxic example weighs against another: single insults among thousands of words count.
TOXIC_WEIGHT = 4.0
THRESHOLD = 0.7

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the terms of rows end to end; a term that repeats in a row repeats here."""
    data = LOWER[data]
    starts, ends, first = spans(LETTER[data], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, found = [row], [word_hashes(data, starts, ends)]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        rows.append(row[long])
        found.append(mix64(word_hashes(data, starts[long], starts[long] + k) + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(found) & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    slots: np.ndarray  # bucket -> index of the weights, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def plain(self) -> tuple:
        """The parts alone, which executors can read without this package."""
        return self.slots, self.bias, self.weights, self.factors

    def scores(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Logistic scores of n rows, of their distinct (row, slot) pairs."""
        linear = np.bincount(rows, self.weights[slots], n)
        sums = np.zeros((n, self.factors.shape[1]))
        squares = np.zeros(n)
        for k in range(self.factors.shape[1]):
            v = self.factors[slots, k]
            sums[:, k] = np.bincount(rows, v, n)
            squares += np.bincount(rows, v * v, n)
        z = self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def pairs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, buckets = terms(data, offsets)
        slots = self.slots[buckets]
        known = slots >= 0
        both = distinct(rows[known] * np.int64(len(self.weights)) + slots[known])
        return both // len(self.weights), both % len(self.weights)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows: documents, and those labelled 1, for each bucket that has any."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for chunk in chunks(batches, "text"):
        rows, buckets = terms(*flat_bytes(chunk.column(1)))
        both = distinct(rows << BITS | buckets)
        toxic = chunk.column(0).to_numpy(zero_copy_only=False)[both >> BITS]
        np.add.at(counts[0], both & ((1 << BITS) - 1), 1)
        np.add.at(counts[1], (both & ((1 << BITS) - 1))[toxic == 1], 1)
    some = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bucket", "docs", "toxic"])


def _slot_lists(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(slots, 0.0, np.zeros(int(slots.max()) + 1), np.zeros((int(slots.max()) + 1, 0)))
        for chunk in chunks(batches, "text"):
            rows, found = model.pairs(*flat_bytes(chunk.column(1)))
            ends = np.searchsorted(rows, np.arange(chunk.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), chunk.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))], names=["toxic", "doc_id", "slots"]
            )

    return run


def values(docs: np.ndarray, toxic: np.ndarray, rows: int, marked: int) -> tuple[np.ndarray, np.ndarray]:
    """What each term is worth alone and in pairs, 0 to 1, of the examples that have it and the toxic ones of these, among `rows` of which `marked` are toxic."""
    share = marked / rows
    expected = docs * share
    # one document more or less is chance
    z = np.maximum(np.abs(toxic - expected) - 1, 0) / np.sqrt(expected * (1 - share) + 1)
    alone = np.minimum(1, (z / FULL_Z) ** 2)
    return alone, np.maximum(alone, (docs / rows) ** COMMON * min(1.0, rows / ENOUGH) ** 2)


def train(lists: list[np.ndarray], labels: np.ndarray, slots: np.ndarray, alone: np.ndarray, paired: np.ndarray, seed: int = 1) -> Model:
    """AdaGrad over shuffled batches; lists: the slots of each example; alone, paired: the slots' values."""
    n = len(alone)
    rng = np.random.default_rng(seed)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, weights, factors = float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.01, (FACTORS, n))
    grad_b, grad_w, grad_v = 1e-2, np.full(n, 1e-2), np.full((FACTORS, n), 1e-2)
    sizes = np.array([len(x) for x in lists])
    for _ in range(max(EPOCHS, -(-STEPS // max(1, -(-len(lists) // BATCH))))):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            some = some[sizes[some] > 0]
            if not len(some):
                continue
            each = sizes[some]
            cols = np.concatenate([lists[i] for i in some])
            begin = np.concatenate(([0], np.cumsum(each)[:-1]))
            z = bias + np.add.reduceat((weights * alone)[cols], begin)
            parts, sums = [], []
            for v in factors:
                part = (v * paired)[cols]
                total = np.add.reduceat(part, begin)
                z += 0.5 * (total * total - np.add.reduceat(part * part, begin))
                parts.append(part), sums.append(total)
            guess = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            error = (guess - labels[some]) * np.where(labels[some] > 0, TOXIC_WEIGHT, 1.0) / len(some)
            spread = np.repeat(error, each)
            met = np.bincount(cols, minlength=n) > 0
            gw = np.bincount(cols, spread, n) * alone + DECAY * weights * met
            grad_w += gw**2
            weights -= RATE * gw / np.sqrt(grad_w)
            for v, g, part, total in zip(factors, grad_v, parts, sums, strict=True):
                gv = np.bincount(cols, np.repeat(error * total, each) - spread * part, n) * paired + DECAY * v * met
                g += gv**2
                v -= RATE * gv / np.sqrt(g)
            gb = error.sum()
            grad_b += gb**2
            bias -= RATE * gb / grad_b**0.5
    return Model(slots, float(bias), (weights * alone).astype(np.float32), (factors * paired).T.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | float:
    """A model of labels.toxic, or the share of 1 where nothing tells them apart (0.0 without labels).

    Learns from `rows` labelled documents at most, none of them held out.
    """
    chosen = (
        bare(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null")
        .where(crc_mod(F.col("doc_id"), 3) != 1)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # the side has `rows` rows at most by its limit
    joined = bare(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    # one text for each id, the least, so that the bound holds whatever repeats; equal texts are one example, toxic if any of them is
    single = joined.where("text is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    once = single.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    sample = settle(once.select("toxic", "text", "doc_id"), "toxic-sample")
    counted = sample.mapInArrow(_bucket_counts, "bucket long, docs long, toxic long").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    total = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not total[0] or not 0 < total[1] < total[0]:
        discard(sample)
        return float(total[1] / total[0]) if total[0] else 0.0
    # buckets are 2 ** BITS at most
    seen = counted.toArrow().sort_by("bucket")
    alone, paired = values(*(seen.column(c).to_numpy().astype(float) for c in ("docs", "toxic")), *total)
    some = np.flatnonzero(np.maximum(alone, paired) >= NIL)
    if not len(some):
        discard(sample)
        return float(total[1] / total[0])
    slots = np.full(1 << BITS, -1, np.int32)
    slots[seen.column("bucket").to_numpy()[some]] = np.arange(len(some), dtype=np.int32)
    got = sample.mapInArrow(_slot_lists(slots), "toxic int, doc_id long, slots array<int>").toArrow().to_pandas().sort_values(["doc_id", "toxic"], kind="stable")
    discard(sample)
    return train(list(got["slots"]), got["toxic"].to_numpy(float), slots, alone[some], paired[some])


def _scored(shared):
    """Scores of a text column under a broadcast model: its plain parts, or a share."""
    value = shared.value
    model = None if isinstance(value, float) else Model(*value)

    def run(texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), value) if model is None else model.scores(*model.pairs(*flat_bytes(texts)), len(texts))

    return run


def _broadcast(docs: DataFrame, model: Model | float):
    return docs.sparkSession.sparkContext.broadcast(float(model) if not isinstance(model, Model) else model.plain())


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scored(shared)
        for chunk in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(scores(chunk.column(1)))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """Per row: doc_id, score in [0, 1]. Null and empty texts have no terms and get the bias alone."""
    base = bare(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(_score(_broadcast(docs, model)), "doc_id long, score double")


def _keep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scored(shared)
        for chunk in chunks(batches, "text"):
            yield chunk.filter(pa.array(scores(chunk.column(chunk.schema.get_field_index("text"))) < THRESHOLD))

    return run


def keep_clean(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below THRESHOLD."""
    return docs.mapInArrow(_keep(_broadcast(docs, model)), docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Repeated rows stay; a null doc_id is scored like any other; an empty table
    gives an empty one. Of labels that repeat a doc_id, and of equal texts, the
    largest counts. Long texts are scored whole.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
