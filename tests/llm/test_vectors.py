"""Codes and whitening of vectors against plain versions, and the defined results of odd inputs."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import codebooks, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def some_vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim))
    return [(k, [float(np.float32(v)) for v in rng.normal(size=dim) @ mix * spread], k % 5 if k % 7 else None) for k in range(n)]


def single(rows):
    """Rows whose components are what a float column keeps of them."""
    return [(i, [float(np.float32(v)) for v in x], label) for i, x, label in rows]


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("taken")).withColumn("dim", F.lit(3)).withColumn("n", F.lit(1))


ODD_VECTORS = [(5000, None, 1), (5001, [1.0, None, *[0.0] * 14], 1), (5002, [float("nan"), *[0.0] * 15], 1), (5003, [float("inf"), *[0.0] * 15], 2), (5004, [], 1)]


def plain_codes(rows, entries=64, rounds=2):
    """Every part against every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(Fraction(v) * 256) for v in x], label) for i, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    parts = [[x[p * w : p * w + w] for p in range(16)] for _, x, _ in kept]
    books = [[list(x[p]) for x in parts[:entries]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(16):
            groups = {}
            for x in parts:
                groups.setdefault(nearest(p, x[p])[1], []).append(x[p])
            for k, group in groups.items():
                books[p][k] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), x in zip(kept, parts, strict=True):
        found = [nearest(p, x[p]) for p in range(16)]
        error = sum(f[0] for f in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(by_label[label]), sha) for i, c, e, label in out), key=str)


def codes(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codebooks.encode(df).collect()), key=str)


@pytest.mark.parametrize("n, dim, spread", [(400, 16, 0.3), (300, 32, 0.02), (40, 64, 1.0), (150, 48, 5e4)])
def test_codes_equal_a_plain_search(spark, n, dim, spread):
    rows = some_vectors(n, n, dim, spread) + [(7000, [0.5] * dim, 3), (7000, [0.5] * dim, None), (7001, [0.5] * dim, None)] + ODD_VECTORS
    random.Random(1).shuffle(rows)
    assert codes(table(spark, rows)) == plain_codes(rows)


def test_codes_of_huge_components_are_exact(spark):
    rows = some_vectors(3, 90, 16) + [(100 + k, [3e38 * (-1) ** k, *[1e20 + k * 1e14] * 15], k % 2) for k in range(20)]
    rows = single(rows + [(200 + k, [4e6 + k, *[3e6] * 15], 9) for k in range(20)])
    assert codes(table(spark, rows)) == plain_codes(rows)


def test_codes_of_equal_vectors_and_of_nothing(spark):
    rows = [(k if k % 3 else None, [0.25] * 16, None) for k in range(100)]
    assert codes(table(spark, rows)) == plain_codes(rows)
    assert codes(table(spark, rows).limit(0)) == [] and codes(table(spark, ODD_VECTORS)) == []
    mixed = codebooks.encode(table(spark, some_vectors(1, 30, 16) + [(900 + k, [1.0 * k] * 17, 1) for k in range(5)])).collect()
    assert sorted({len(r.code) for r in mixed}) == [32] and len({r.codebooks_sha256 for r in mixed}) == 2 and len(mixed) == 35


def test_trees_find_the_first_of_the_nearest():
    rng = np.random.default_rng(4)
    for n, width, top in ((64, 4, 40), (64, 1, 6), (200, 3, 3), (9, 2, 1000), (1, 5, 9)):
        entries, asked = rng.integers(-top, top, (n, width)), rng.integers(-2 * top, 2 * top, (500, width))
        index, away = codebooks.Tree(entries).nearest(asked)
        every = ((asked[:, None] - entries) ** 2).sum(-1)
        assert (index == every.argmin(1)).all() and (away == every.min(1)).all()
        big = codebooks.Tree(entries.astype(object) * 10**30).nearest(asked.astype(object) * 10**30)
        assert (big[0] == index).all() and [int(v) for v in big[1]] == [int(v) * 10**60 for v in away]


def test_trees_leave_entries_out():
    class Counted(codebooks.Tree):
        compared = 0

        def _leaf(self, own, queries, rows, index, best):
            Counted.compared += len(own) * len(rows)
            return super()._leaf(own, queries, rows, index, best)

    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (8, 4))
    entries = np.concatenate([c + rng.integers(-90, 90, (8, 4)) for c in centres])
    asked = entries[rng.integers(0, 64, 4000)] + rng.integers(-40, 40, (4000, 4))
    Counted(entries).nearest(asked)
    assert Counted.compared < 0.6 * 64 * 4000


def plain_whitening(rows, dim):
    kept = [(i, x) for i, x, _ in rows if x and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    x = [[math.floor(Fraction(v) * 64) + 1_000_000 for v in r] for _, r in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * v - s for v, s in zip(r, sums, strict=True)] for r in x]
    exact = [sum(v * v for v in r) for r in y]
    z = np.array([[float(Fraction(v, n)) for v in r] for r in y])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)
    return [i for i, _ in kept], n, exact, z, values[order], vectors[:, order]


@pytest.mark.parametrize("n, dim, parts", [(500, 16, 3), (900, 40, 40), (60, 5, 2)])
def test_whitening_equals_eigenvectors(spark, n, dim, parts):
    rows = some_vectors(n, n, dim) + [(7000, [0.5] * dim, 3), (7000, [0.5] * dim, None), (None, [0.25] * dim, None)] + ODD_VECTORS
    got = whitening.by_component(table(spark, rows).repartition(parts)).collect()
    ids, total, exact, z, values, vectors = plain_whitening(rows, dim)
    k = min(32, dim)
    assert len(got) == k * len(ids) and {r.n for r in got} == {total}
    assert sorted({(r.component, r.explained) for r in got}) == sorted({(j + 1, next(r.explained for r in got if r.component == j + 1)) for j in range(k)})
    assert sorted(str((r.vec_id, r.deviation)) for r in got if r.component == 1) == sorted(str(p) for p in zip(ids, exact, strict=True))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    at = {i: j for j, i in enumerate(ids)}
    for j in range(k):
        want = z @ vectors[:, j] / np.sqrt(values[j])
        own = {r.vec_id: r.whitened for r in got if r.component == j + 1}
        sign = np.sign(sum(own[i] * want[at[i]] for i in own))
        assert max(abs(own[i] - sign * want[at[i]]) for i in own) < 1e-7
        assert next(r.explained for r in got if r.component == j + 1) == pytest.approx(values[j] / values.sum(), rel=1e-9)


def test_whitening_merges_many_factors(spark):
    rows = some_vectors(8, 700, 6)
    few, _ = whitening.whiten(table(spark, rows).coalesce(1))
    many, fitted = whitening.whiten(table(spark, rows).repartition(300))
    a, b = ({r.vec_id: r.whitened for r in df.collect()} for df in (few, many))
    assert all(abs(abs(u) - abs(v)) < 1e-9 for i in a for u, v in zip(a[i], b[i], strict=True)) and fitted[6].n == 700


def test_whitening_of_odd_tables(spark):
    same = [(k, [0.5] * 8, 1) for k in range(10)]
    assert whitening.by_component(table(spark, same)).collect() == []
    rows, fitted = whitening.whiten(table(spark, same))
    assert {(r.deviation, tuple(r.whitened)) for r in rows.collect()} == {(0, ())} and fitted[8].error == 0
    assert whitening.by_component(table(spark, same).limit(0)).collect() == [] and whitening.by_component(table(spark, ODD_VECTORS[:4])).collect() == []
    # one direction alone varies; two dimensions are fitted apart
    line = [(k, [0.0, k / 64, 2 * k / 64], 1) for k in range(50)] + [(100 + k, [k / 64.0], 1) for k in range(3)]
    got = whitening.by_component(table(spark, line)).collect()
    assert {(r.dim, r.component, r.n) for r in got} == {(3, 1, 50), (1, 1, 3)} and all(r.explained == pytest.approx(1) for r in got)
    huge = single([(k, [1e30 * (k % 3), float(k)], 1) for k in range(30)])
    out = whitening.by_component(table(spark, huge)).collect()
    _, _, exact, *_ = plain_whitening(huge, 2)
    assert {r.deviation for r in out} == {v if v < 1 << 63 else None for v in exact} and {int(r.deviation_text) for r in out} == set(exact)
