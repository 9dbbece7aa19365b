"""Links within capacities, first in first out, pages, classes, running totals and the change feed, against plain versions."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import allocation, changes, reconcile, running

LINES = "line_id string, supplier string, article string, quantity decimal(28,10), ordinal long"


def lines(spark, rows):
    return spark.createDataFrame([(i, s, a, None if q is None else Decimal(q), k) for k, (i, s, a, q) in enumerate(rows)], LINES)


def greedy(edges, need, room):
    """Every edge in turn, from the best to the worst."""
    best = {}
    for d, i, s in edges:
        if s is not None and d in need and i in room:
            best[d, i] = max(s, best.get((d, i), s))
    linked, left, out = set(), dict(room), set()
    for (d, i), s in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if d not in linked and need[d] <= left[i]:
            linked.add(d), out.add((d, i, s))
            left[i] -= need[d]
    return out


@pytest.mark.parametrize("seed, hub", [(1, False), (2, False), (3, True)])
def test_links_are_those_of_a_greedy_choice(spark, seed, hub):
    rnd = random.Random(seed)
    need, room = {f"d{k}": rnd.randint(0, 9) for k in range(120)}, {f"i{k}": rnd.randint(1, 30) for k in range(40)}
    edges = [(rnd.choice([*need]), "i0" if hub and rnd.random() < 0.6 else rnd.choice([*room]), rnd.choice([70, 80, 90, 95, 100])) for _ in range(900)]
    edges += [(None, "i1", 90), ("d1", None, 90), ("gone", "i1", 90), ("d2", "i2", None)] + edges[:50]
    frame = lambda x: spark.createDataFrame([(k, Decimal(v)) for k, v in x.items()] + [(None, Decimal(1)), ("n", None), ("m", Decimal(-1))], "id string, quantity decimal(28,10)")
    got = allocation.capacity_links(spark.createDataFrame(edges, "delivery string, invoice string, score int"), frame(need), frame(room)).collect()
    assert {(r.delivery, r.invoice, r.score) for r in got} == greedy(edges, need, room) and len({r.delivery for r in got}) == len(got)


def test_links_of_nothing(spark):
    edges = spark.createDataFrame([], "delivery string, invoice string, score int")
    side = spark.createDataFrame([], "id string, quantity decimal(28,10)")
    assert allocation.capacity_links(edges, side, side).collect() == []


def test_edges_join_similar_articles_that_fit(spark):
    d = lines(spark, [("d1", "s", "Bolt M8x20", 3), ("d2", "s", "bolt m8-20", 9), ("d3", "t", "Bolt M8x20", 1), ("d4", "s", None, 1), (None, "s", "bolt", 1), ("d1", "s", "later", 1)])
    i = lines(spark, [("i1", "s", "BOLT M8X20", 5), ("i2", "s", "bolt m8x21", 2), ("i3", None, "Bolt M8x20", 9)])
    got = {tuple(r) for r in allocation.similar_edges(d, i, 80).collect()}
    assert got == {("d1", "i1", 100)} and {tuple(r)[:2] for r in allocation.similar_edges(d, i.withColumn("quantity", F.lit(50).cast("decimal(28,10)")), 80).collect()} == {("d1", "i1"), ("d1", "i2"), ("d2", "i1"), ("d2", "i2")}


def laid(rows):
    """Unit by unit: the line of each side at every place of a key."""
    out = defaultdict(list)
    for i, s, a, q in rows:
        out[s, a] += [i] * max(0, q or 0)
    return out


def test_quantities_go_first_in_first_out(spark):
    rnd = random.Random(4)
    make = lambda p, n: [(f"{p}{k}", rnd.choice(["s", "t", None]), rnd.choice(["x", "y", None]), rnd.choice([0, 1, 2, 7, 20, None, -3])) for k in range(n)]
    d, i = make("d", 150) + [("hot", "h", "h", 1)] * 0, make("i", 130)
    d += [(f"h{k}", "hot", "x", 2) for k in range(200)]
    i += [(f"k{k}", "hot", "x", 3) for k in range(100)] + [("alone", "u", "x", 4)]
    want = defaultdict(int)
    one, two = laid(d), laid(i)
    for key in {*one, *two}:
        for k in range(max(len(one[key]), len(two[key]))):
            want[(*key, one[key][k] if k < len(one[key]) else None, two[key][k] if k < len(two[key]) else None)] += 1
    got = {(r.supplier, r.article, r.delivery_id, r.invoice_id): r.quantity for r in allocation.allocate(lines(spark, d), lines(spark, i)).collect()}
    assert got == want
    assert allocation.allocate(lines(spark, []), lines(spark, [])).collect() == []


def test_running_totals_of_hot_and_null_keys(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "hot", None, "a"]), k, rnd.randint(0, 5), rnd.choice([None, k])) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, at long, v long, m long").repartition(7)
    got = {r.at: (r.before, r.last) for r in running.running(df, ["key"], ["at"], {"before": F.col("v")}, {"last": F.col("m")}).collect()}
    total, last = defaultdict(int), {}
    for key, at, v, m in rows:
        last[key] = m if m is not None else last.get(key)
        assert got[at] == (total[key], last[key])
        total[key] += v


def test_pages_keep_order_and_length(spark):
    d = lines(spark, [(f"d{k}", "hot", "x", k) for k in range(950)] + [("e", "other", None, 1), (None, "other", "y", 2), ("z", " ", "x", 1), ("z", None, "x", 1)])
    pages = reconcile.supplier_pages(d, lines(spark, [("i", "hot", "x", 1)]), 100).collect()
    hot = sorted((p.page, [x.id for x in p.lines]) for p in pages if p.supplier == "hot" and p.side == "delivery")
    assert [p for p, _ in hot] == list(range(10)) and [x for _, xs in hot for x in xs] == [f"d{k}" for k in range(950)] and {len(x) for _, x in hot[:9]} == {100}
    assert [[(x.id, x.article) for x in p.lines] for p in pages if p.supplier == "other"] == [[("e", ""), ("", "y")]] and {p.supplier for p in pages} == {"hot", "other"}


def test_classes_stand_for_all_pairs(spark):
    d = lines(spark, [("a", None, None, 1)] * 40 + [("b", "s", "x", 2), ("c", "s", "x", 2), ("d", "s", "x", None), ("e", "null", None, 1), ("f", "t", "x", 1)])
    i = lines(spark, [("p", None, None, 1)] * 30 + [("q", "s", "x", 2), ("r", "s", "x", None), ("s", None, "null", 1)])
    out = reconcile.match_classes(d, i)
    pairs = sorted((r.d_line_id, r.i_line_id) for r in reconcile.exact_matches(d, i).collect())
    assert sorted((r.d_line_id, r.i_line_id) for r in reconcile.expand(out["members"]).collect()) == pairs
    assert sum(r.links for r in out["classes"].collect()) == len(pairs) == 1202 and out["members"].count() == 73


def test_the_feed_tells_inserts_updates_and_deletes(spark):
    rnd = random.Random(6)
    old = {k: (rnd.choice(["x", None, ""]), rnd.randint(0, 3)) for k in range(500)}
    new = {k: v for k, v in old.items() if k % 50} | {k: (None, 9) for k in (3, 7)} | {1000: ("x", 1)}
    frame = lambda t: spark.createDataFrame([(k, *v) for k, v in t.items()], "id long, name string, v int")
    got = {(r.op, r.id, r.before and tuple(r.before), r.after and tuple(r.after)) for r in changes.feed(frame(old), frame(new)).collect()}
    want = {("delete", k, old[k], None) for k in old if k not in new} | {("insert", 1000, None, ("x", 1))} | {("update", k, old[k], new[k]) for k in (3, 7)}
    assert got == want and changes.unequal_buckets(frame(old), frame(old)).count() == 0
    assert changes.unequal_buckets(frame(old), frame(new)).count() <= len(want)
    assert changes.feed(frame({1: ("a", 1)}).limit(0), frame({1: ("a", 1)})).count() == 1


def test_lines_of_a_key_move_once(spark, monkeypatch):
    """Few lines of a key are allocated after one exchange, many by ranges, with equal results."""
    rows = [[(f"{side}{n}", None if n % 7 == 0 else str(n % 5), "a", Decimal(n % 4), n) for n in range(60)] for side in "di"]
    d, i = (spark.createDataFrame(r, "line_id string, supplier string, article string, quantity decimal(28,10), ordinal int") for r in rows)
    out = allocation.allocate(d, i)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("hashpartitioning(supplier") == 1
    monkeypatch.setattr(running, "GROUP_ROWS", 15)
    spread = allocation.allocate(d, i)
    assert spread._jdf.queryExecution().executedPlan().toString().count("Exchange") > 1
    key = lambda r: tuple(map(str, r))
    assert sorted(spread.collect(), key=key) == sorted(out.collect(), key=key)
