from decimal import Decimal

import pytest

from millrace.operators import mutations, reconcile

LINE = "line_id string, supplier string, article string, quantity decimal(28,10), ordinal int"


def lines(spark, *rows):
    return spark.createDataFrame([(a, b, c, Decimal(d), k) for k, (a, b, c, d) in enumerate(rows)], LINE)


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_null_keys_match_and_case_counts(spark):
    d = lines(spark, ("d1", None, None, "1"), ("d2", "s", "A", "1"), ("d3", "s", "b", "1.00"))
    i = lines(spark, ("i1", None, None, "1.0"), ("i2", "s", "a", "1"), ("i3", "s", "b", "1"), ("i4", "s", "b", "2"))
    assert ids(reconcile.exact_matches(d, i), "d_line_id", "i_line_id") == [("d1", "i1"), ("d3", "i3")]


def test_many_to_many_and_pairing_once(spark):
    d = lines(spark, ("d1", "s", "a", "1"), ("d2", "s", "a", "1"))
    i = lines(spark, ("i1", "s", "a", "1"), ("i2", "s", "a", "1"))
    found = reconcile.exact_matches(d, i)
    assert found.count() == 4
    assert ids(reconcile.paired_once(found), "d_line_id", "i_line_id") == [("d1", "i1"), ("d2", "i2")]


def test_unmatched_keeps_first_of_each_id(spark):
    d = lines(spark, ("x", "s", "a", "1"), ("x", "s", "b", "2"), (None, "s", "c", "3"), (None, "s", "d", "4"), ("m", "s", "e", "5"))
    out = reconcile.unmatched(d, spark.createDataFrame([("m",)], "id string"))
    assert {(r.line_id, r.article) for r in out.collect()} == {("x", "a"), (None, "c")}


@pytest.fixture
def sides(spark):
    d = lines(spark, ("d1", "s", "widget 100", "1"), ("d2", "s", "widget 2000000000", "2"), ("d3", "t", "zzz", "3"))
    i = lines(spark, ("i1", "s", "widget 100", "1"), ("i2", "s", "widget 2000000001", "2"), ("i3", "t", "other", "3"))
    return d, i


def test_reconcile_covers_every_line_once(sides):
    out = reconcile.reconcile(*sides)
    assert ids(out["matches"], "d_line_id", "i_line_id", "match_type") == [("d1", "i1", "exact"), ("d2", "i2", "similar")]
    assert ids(out["unmatched_deliveries"], "line_id") == [("d3",)]
    assert ids(out["unmatched_invoices"], "line_id") == [("i3",)]


def test_totals_states(spark):
    d = lines(spark, ("d1", "s", "a", "1"), ("d2", "s", "a", "1"))
    i = lines(spark, ("i1", "s", "a", "1"), ("i2", "s", "b", "1"))
    out = {r.line_id: (r.state, r.difference) for r in reconcile.totals(i, reconcile.exact_matches(d, i)).collect()}
    assert out == {"i1": ("partial", Decimal("-1")), "i2": ("unmatched", Decimal("1"))}


def test_work_list_drops_blank(spark):
    d = lines(spark, ("a", "s", "x", "1"), ("b", None, "x", "1"), ("c", "", "x", "1"))
    assert ids(reconcile.work_list(d, d), "supplier") == [("s",)]


def test_batches_keep_order_and_fill_null(spark):
    d = lines(spark, (None, "s", None, "2"), ("b", "s", "x", "1"))
    out = reconcile.supplier_batches(d, d.limit(0)).collect()
    assert [(x.id, x.article) for x in out[0].deliveries] == [("", ""), ("b", "x")] and out[0].invoices == []


SAVED = "id long, master_id string, line_id string, tenant string, created timestamp_ntz, code string, state string, note string, supplier_id string, doc_type int, quantity decimal(28,10), reconciled decimal(28,10), delta decimal(28,10), flag int, side string"


def test_saved_reconciliation_last_wins(spark):
    state = spark.createDataFrame(
        [(1, "", "k", "t", None, "old", "", "", "s", 3, Decimal(1), Decimal(0), Decimal(1), 0, "delivery"), (2, "", "k", "other", None, "keep", "", "", "s", 3, Decimal(1), Decimal(0), Decimal(1), 0, "delivery")], SAVED
    )

    def rows(code, side):
        raw = spark.createDataFrame([(None, "k", code, None, None, "s", "t", 0, Decimal(5), Decimal(2), True)], "master_id string, line_id string, code string, state string, note string, supplier_id string, tenant string, ordinal int, quantity decimal(28,10), reconciled decimal(28,10), selected boolean")
        return mutations.reconciled_rows(raw.selectExpr("*", "cast(null as timestamp_ntz) as created"), side)

    out = mutations.save_reconciliation(state, rows("d", "delivery"), rows("i", "invoice"))
    got = {(r.tenant, r.line_id): (r.code, r.delta, r.flag, r.id) for r in out.collect()}
    assert got == {("t", "k"): ("i", Decimal(3), 1, 3), ("other", "k"): ("keep", Decimal(1), 0, 2)}
    again = mutations.save_reconciliation(out, rows("d", "delivery"), rows("i", "invoice"))
    assert again.count() == 2
    assert mutations.delete_reconciled(out, "t", "k").count() == 1
