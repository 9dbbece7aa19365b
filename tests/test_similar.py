"""The index of q-grams against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.similarity import edit_score
from millrace.operators import matching, similar

WORDS = ["acme", "bolt", "north", "trade", "iron", "glass", "river", "stone", "paper", "metal", "union", "delta", "solar", "green", "prime", "coast"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b):
    n = max(len(a), len(b))
    return 100 * (n - distance(a, b)) // n if n else 0


def company(rnd):
    return f"{rnd.choice(WORDS)} {rnd.choice(WORDS)} {rnd.choice(['srl', 'spa', 'ltd', 'gmbh'])} {rnd.randint(0, 9999)}"


def edited(rnd, text, n):
    for _ in range(n):
        k = rnd.randrange(len(text) + 1)
        text = text[:k] + rnd.choice(["", "x", "z9"]) + text[k + rnd.randint(0, 1) :]
    return text


def test_the_best_of_a_large_block_is_that_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(matching, "FEW_CHOICES", 5)
    known = [(t, k * 2 + n, company(rnd)) for n, t in enumerate("ab") for k in range(150)] + [("c", 1, "only one"), ("a", 900, "!!"), ("b", 901, "aaaaaaaaaaaaaaaa"), ("a", 902, company(rnd).upper())]
    asked = [(t, edited(rnd, rnd.choice([n for u, _, n in known if u == t] * (n < 5) or [company(rnd)]), rnd.randint(0, 12))) for t in "abc" for n in range(12)]
    asked += [("a", known[0][2]), ("a", "qqqqqqqq"), ("b", "7"), ("a", "?"), ("b", " "), ("b", None), ("d", "none here"), ("b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), ("a", "e" * 300)]
    queries, choices = spark.createDataFrame(asked, "tenant string, name string"), spark.createDataFrame(known, "tenant string, id long, name string")
    plain = lambda v: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in v.lower()).split())
    for least in (None, 40, 90):
        got = {(r.tenant, r.name): (r.id, r.score) for r in matching.best_match(queries, choices, ["tenant"], least=least).collect()}
        want = {}
        for t, name in set(asked):
            own = [(score(plain(name), plain(n)), -i) for u, i, n in known if u == t] if name and name.strip() else []
            best = max(own, default=None)
            best = best if best and (least is None or best[0] >= least) else None
            want[t, name] = (-best[1], best[0]) if best else (None, 0)
        assert got == want


@pytest.mark.parametrize("least", [95, 90, 75, 67, 60, 51, 40, 10, 1])
def test_candidates_miss_no_pair(spark, least):
    rnd = random.Random(least)
    names = sorted({company(rnd) for _ in range(60)} | {"a", "ab", "aab", "aaaa", "aaab", "ba" * 9, "ab" * 9})
    near = sorted({edited(rnd, n, rnd.randint(0, 6)) for n in names} - {""})
    q = similar.steps(least)[-1][1]
    a, b = (spark.createDataFrame([("t", n) for n in side], "tenant string, s string") for side in (near, names))
    got = {(r.a, r.b) for r in similar.scored(similar.candidates(a, b, ["tenant"], least, q), least).collect()}
    assert got == {(x, y) for x in near for y in names if score(x, y) >= least}


def test_few_of_a_large_tenants_pairs_are_compared(spark):
    rnd = random.Random(7)
    known = sorted({company(rnd) for _ in range(20_500)})[:20_000]
    asked = sorted({edited(rnd, n, 1) for n in rnd.sample(known, 300)})
    a, b = (spark.createDataFrame([("t", n) for n in side], "tenant string, s string") for side in (asked, known))
    score_, q = similar.steps(1)[0]
    pairs = similar.candidates(a, b, ["tenant"], score_, q)
    assert pairs.count() < 0.05 * len(asked) * len(known)
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = similar.best_names(a, b.withColumn("id", F.xxhash64("s")), ["tenant"])
    assert found.count() == len(asked) and found.where("score < 60").count() < 20
    assert edit_score is matching.edit_score


def test_distances_of_texts_that_share_beginnings():
    rnd = random.Random(5)
    names = ["b", "supplier 000000001", "x" * 64, *[edited(rnd, "supplier 000012345", 4) for _ in range(30)]]
    for known in (names, [*names, "y" * 65, edited(rnd, "long name " * 20, 9)]):
        texts = sorted(["", "a", "x" * 70, "long name " * 19, *[edited(rnd, "suplier 000012354", 3) for _ in range(30)]])
        for text, far in zip(texts, similar.distances(texts, known), strict=True):
            assert far.tolist() == [distance(text, n) for n in known]


@pytest.mark.parametrize("few", [4096, 0])
def test_names_that_differ_in_a_few_characters_do_not_meet_by_grams(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_CHOICES", few)
    met = []
    plain = similar._met
    monkeypatch.setattr(similar, "_met", lambda *a: met.append(plain(*a).count()) or plain(*a))
    choices = spark.range(0, 4000, 7).selectExpr("'t' tenant", "id", "'Supplier#' || lpad(id, 9, '0') name")
    queries = spark.range(0, 9000, 29).selectExpr("'t' tenant", "'Suplier#' || lpad(id, 9, '0') name")
    got = {r.name: (r.id, r.score) for r in matching.best_match(queries, choices, ["tenant"]).collect()}
    names = {k: f"supplier {k:09d}" for k in range(0, 4000, 7)}
    want = {f"Suplier#{q:09d}": max((score(f"suplier {q:09d}", n), -k) for k, n in names.items()) for q in range(0, 9000, 290)}
    assert len(got) == 311 and all(got[n] == (-k, s) for n, (s, k) in want.items())
    assert sum(met) < 0.05 * 311 * len(names)


@pytest.mark.parametrize("whole, cost", [(10**9, 0), (10**9, 10**9), (50, 0)])
def test_near_pairs_of_all_pairs(spark, monkeypatch, whole, cost):
    rnd = random.Random(whole + cost)
    monkeypatch.setattr(similar, "WHOLE_PAIRS", whole)
    monkeypatch.setattr(similar, "BAG_COST", cost)
    known = sorted({company(rnd) for _ in range(25)} | {"a", "ab", "aab", "12345", "12346", "12354", "1111111111111"})
    near = sorted({edited(rnd, n, rnd.randint(0, 5)) for n in known} | {"12345", "11111111111112"} - {""})
    sides = [spark.createDataFrame([(t, n) for n in side for t in "tu"][: -1], "tenant string, s string") for side in (near, known)]
    for least in (50, 75):
        got = {(r.a, r.b, r.score) for r in similar.near_pairs(*sides, ["tenant"], least).where("tenant = 't'").collect()}
        assert got == {(x, y, score(x, y)) for x in near if x for y in known if score(x, y) >= least}
