from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schemas
from millrace.operators import mutations, scans

AS_OF = datetime(2001, 8, 1)


def line(line_id, code="c"):
    return (line_id, "m", code, None, Decimal(1), "pz", Decimal(0), "22", Decimal(1))


def docs(spark, rows):
    content = lambda doc, lines: (None, "f", None, (doc, "1", "n", "2001-01-01", "s", lines, None, None, None, 1.0))
    data = [(k, "f", created, None if doc is None else content(doc, lines), bytearray(b"pdf"), tenant, state) for k, (doc, tenant, state, created, lines) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.TABLES["docs"][0])


def lines_of(df):
    return {r.id: [(x.line_id, x.code) for x in r.content.document.lines] for r in df.where("content is not null").collect()}


def edits(spark, *rows):
    schema = "tenant string, doc_id string, line " + schemas.LINE.simpleString()
    return spark.createDataFrame(rows, schema)


def test_line_edits_touch_the_first_match_only_and_keep_attachments(spark):
    d = docs(spark, [("a", "t", 0, AS_OF, [line("L1"), line("l1"), line("x")]), ("b", "t", 0, AS_OF, [line("q")]), (None, "t", 0, AS_OF, [])])
    out = mutations.replace_lines(d, edits(spark, ("t", "a", line("l1", "new")), ("t", "b", line("none", "new"))))
    assert lines_of(out) == {0: [("l1", "new"), ("l1", "c"), ("x", "c")], 1: [("q", "c")]}
    gone = mutations.remove_lines(d, edits(spark, ("t", "a", line("l1"))))
    assert lines_of(gone)[0] == [("l1", "c"), ("x", "c")]
    added = mutations.append_lines(d, edits(spark, ("t", "a", line("z"))))
    assert [x for x, _ in lines_of(added)[0]] == ["L1", "l1", "x", "z"]
    assert lines_of(mutations.remove_lines(added, edits(spark, ("t", "a", line("z"))))) == lines_of(d)
    assert all(r.attachment == bytearray(b"pdf") for r in out.collect())
    assert out.where("content is null").count() == 1


def test_state_and_type_of_one_document(spark):
    d = docs(spark, [("a", "t", 0, AS_OF, []), ("a", "u", 0, AS_OF, [])])
    assert [r.state for r in mutations.set_state(d, "t", "a", 1).orderBy("id").collect()] == [1, 0]
    assert [r.content.document.type for r in mutations.set_type(d, "t", "a", 4).orderBy("id").collect()] == ["4", "1"]


def test_retention_is_strict_and_idempotent(spark):
    edge = AS_OF - timedelta(days=90)
    d = docs(spark, [("a", "t", 1, edge, []), ("b", "t", 1, edge - timedelta(microseconds=1), []), ("c", "t", 0, edge - timedelta(days=500), [])])
    at = F.lit(AS_OF).cast("timestamp_ntz")
    kept = mutations.retain(d, at)
    assert sorted(r.id for r in kept.collect()) == [0, 2]
    assert mutations.retain(kept, at).count() == 2


def test_filters_ignore_blanks_and_defaults(spark):
    d = docs(spark, [("a", "t", 0, AS_OF, []), ("b", "t", 1, AS_OF, []), ("c", "u", 0, AS_OF, [])])
    ids = lambda **f: sorted(r.id for r in scans.documents(d, **f).collect())
    assert ids(tenant="t") == [0]
    assert ids(tenant="t", state=-1, sender=" ", number="", kind=0) == [0, 1]
    assert ids(tenant="t", state=1, kind=1) == [1]
    assert ids(tenant="t", state=-1, sender=" s") == []
    assert "attachment" not in scans.documents(d, tenant="t").columns
    assert [r.id for r in mutations.delete_first(d, tenant="t", state=-1).orderBy("id").collect()] == [1, 2]
    assert mutations.delete_first(d, tenant="none").count() == 3


STATE = "id long, tenant string, sender string, number string, date string, type string, state int, total double"
INCOMING = STATE.replace("id long, ", "") + ", arrival int"


def test_keyed_replace(spark):
    state = spark.createDataFrame(
        [(1, "t", "open", "1", "d", "4", 0, 1.0), (2, "t", "closed", "1", "d", "4", 1, 2.0), (3, "t", "twice", "1", "d", "4", 0, 3.0), (4, "t", "twice", "1", "d", "4", 0, 4.0)], STATE
    )
    incoming = spark.createDataFrame(
        [("t", "open", "1", "d", "4", 0, 10.0, 0), ("t", "open", "1", "d", "4", 0, 11.0, 1), ("t", "closed", "1", "d", "4", 0, 12.0, 2), ("t", "new", "1", "d", "4", 0, 13.0, 3), ("t", "x", " ", "d", "4", 0, 14.0, 4), ("t", "twice", "1", "d", "4", 0, 15.0, 5)],
        INCOMING,
    )
    out = mutations.keyed_replace(state, incoming)
    got = sorted((r.sender, r.total, r.id) for r in out.state.collect())
    assert got == [("closed", 2.0, 2), ("new", 13.0, 6), ("open", 11.0, 5), ("twice", 4.0, 4), ("twice", 15.0, 7)]
    assert [r.total for r in out.rejected.collect()] == [12.0]
    assert [r.total for r in out.quarantined.collect()] == [14.0]
    once = mutations.keyed_replace(state.limit(0), incoming).state
    again = mutations.keyed_replace(once, incoming).state
    assert sorted((r.sender, r.total) for r in again.collect()) == sorted((r.sender, r.total) for r in once.collect())
    assert mutations.keyed_replace(state, incoming, reject_closed=False).rejected.count() == 0


def test_ids_follow_in_order(spark):
    rows = spark.range(1000).selectExpr("999 - id as k")
    out = mutations.numbered(rows, ["k"], 10).collect()
    assert sorted((r.k, r.id) for r in out) == [(k, 11 + k) for k in range(1000)]
    assert mutations.numbered(rows.limit(0), ["k"], 10).count() == 0


def test_ids_of_wide_rows_under_adaptive_execution(spark):
    """Rows wide enough that ranges of all columns and of few are coalesced differently."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        rows = spark.range(100_000).selectExpr("cast(hash(id) as long) * 200000 + id as k", "repeat(sha2(cast(id as string), 256), 12) as wide")
        out = mutations.numbered(rows, ["k"], 5)
        top = out.agg(F.count("id"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(top) == (100_000, 100_000, 6, 100_005)
        ranked = out.select("id", F.rank().over(Window.orderBy("k")).alias("n"))
        assert ranked.where("id != n + 5").count() == 0
    finally:
        for name, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), before, strict=True):
            spark.conf.set(name, value)


def test_repeated_changes_count_once(spark):
    base = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "id long, description string, tenant string")
    twice = spark.createDataFrame([(1, "x", "t", 2), (1, "y", "t", 1)], "id long, description string, tenant string, ordinal int")
    assert sorted(r.description for r in mutations.update(base, twice).collect()) == ["b", "x"]
    assert sorted(r.description for r in mutations.update(base, twice.drop("ordinal")).collect()) == ["b", "y"]


def test_crud_with_tenant_guard(spark):
    base = spark.createDataFrame([(1, "a", "t"), (2, "b", "u")], "id long, description string, tenant string")
    change = spark.createDataFrame([(1, "x", "t"), (2, "y", "u")], base.schema)
    assert sorted(r.description for r in mutations.update(base, change, "t").collect()) == ["b", "x"]
    assert sorted(r.id for r in mutations.delete(base, change.select("id"), "u").collect()) == [1]
    assert [r.id for r in mutations.changed_rows(base, change).orderBy("id").collect()] == [1, 2]
    assert mutations.changed_rows(base, base).count() == 0


def test_unique_keys(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "a", None, None), (3, None, None, None), (4, None, None, None)], schemas.TABLES["users"][0])
    assert [(r.key, r.value, r.n) for r in schemas.violations(rows, "users").collect()] == [("email", "a", 2)]
    assert schemas.create_tables(spark, ["tenants"]) == ["tenants"] and schemas.create_tables(spark, ["tenants"]) == []
    spark.sql("DROP TABLE tenants")


def test_replaced_rows_are_found_by_what_is_settled(spark):
    """Neither the last of each key nor what it replaces is worked out again for the rows that stay."""
    columns = "tenant string, sender string, number string, date string, type string, state int"
    state = spark.createDataFrame([(1, "t", "s", "1", "d", "4", 0), (2, "t", "s", "2", "d", "4", 0)], "id long, " + columns)
    incoming = spark.createDataFrame([("t", "s", "1", "d", "4", 0, 7), ("t", "s", "3", "d", "4", 0, 8)], columns + ", arrival long")
    kept = mutations.keyed_replace(state, incoming).state
    saved = spark.createDataFrame([(1, "t", "a", 1), (2, "t", "b", 2)], "id long, tenant string, line_id string, n int")
    lines = spark.createDataFrame([("t", "a", 5, 1), ("t", "c", 6, 2)], "tenant string, line_id string, n int, ordinal int")
    again = mutations.save_reconciliation(saved, lines, lines.limit(0))
    assert sorted((r.id, r.number) for r in kept.collect()) == [(2, "2"), (3, "1"), (4, "3")]
    assert sorted((r.id, r.line_id, r.n) for r in again.collect()) == [(2, "b", 2), (3, "a", 5), (4, "c", 6)]
    assert not any("row_number" in df._jdf.queryExecution().executedPlan().toString() for df in (kept, again))
