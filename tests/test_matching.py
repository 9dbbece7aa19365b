import pytest
from pyspark.sql import functions as F

from millrace.functions import similarity, text
from millrace.operators import housekeeping, matching, scans


def test_scores_and_bands(spark):
    rows = [("a" * 10, "a" * 10), ("a" * 10, "a" * 9 + "b"), ("a" * 100, "a" * 89 + "b" * 11), ("", ""), ("!!", "?"), ("ACME, Inc.", "acme inc")]
    df = spark.createDataFrame(rows, "a string, b string").select(matching.score_of(F.col("a"), F.col("b")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got == [100, 90, 89, 0, 0, 100]
    bands = spark.createDataFrame([(100,), (99,), (90,), (89,)], "s int").select(similarity.band(F.col("s")).alias("b"))
    assert [r.b for r in bands.collect()] == ["exact", "high", "high", "new"]


def test_best_match_ties_tenants_and_blanks(spark):
    choices = spark.createDataFrame([("t", 5, "alpha beta"), ("t", 3, "alpha beta"), ("t", 4, "alpha zeta"), ("u", 1, "gamma")], "tenant string, id long, name string")
    names = spark.createDataFrame([("t", "ALPHA-BETA"), ("t", "gamma"), ("t", " "), ("v", "alpha")], "tenant string, name string")
    got = {(r.tenant, r.name): (r.id, r.score, r.band) for r in matching.best_match(names, choices, ["tenant"]).collect()}
    assert got[("t", "ALPHA-BETA")] == (3, 100, "exact")
    assert got[("t", "gamma")][2] == "new" and got[("t", "gamma")][0] in (3, 4)
    assert got[("t", " ")] == (None, 0, "new") and got[("v", "alpha")] == (None, 0, "new")
    near = {r.name: r.id for r in matching.best_match(names, choices, ["tenant"], least=90).collect()}
    assert near["ALPHA-BETA"] == 3 and near["gamma"] is None


def test_supplier_and_article_entries(spark):
    suppliers = spark.createDataFrame([("t", 1, "Acme Corporation Ltd"), ("t", 2, "Other")], "tenant string, id long, description string")
    names = spark.createDataFrame([("t", "ACME corporation ltd"), ("t", "Acme Corporation Lt"), ("t", "Zed"), ("n", "First"), ("t", "")], "tenant string, name string")
    got = {r.name: (r.action, r.reference) for r in matching.supplier_entries(names, suppliers).collect()}
    assert got == {"ACME corporation ltd": ("known", None), "Acme Corporation Lt": ("refer", "Acme Corporation Ltd"), "Zed": ("new", None), "First": ("new", None)}
    assert "First" not in {r.name for r in matching.supplier_entries(names, suppliers, suppress_first=True).collect()}
    articles = spark.createDataFrame([("t", 1, 7, "ABCDEFGHIJ", "red widget")], "tenant string, supplier_id long, id long, code string, description string")
    lines = spark.createDataFrame([("t", 1, "ABCDEFGHIJ", "x"), ("t", 1, "ABCDEFGHIK", "blue"), ("t", 1, "zz", "zz"), ("t", 0, "q", "q"), ("t", None, "q", "q")], "tenant string, supplier_id long, code string, description string")
    got = {r.code: (r.action, r.ref_code, r.code_score) for r in matching.article_entries(lines, articles).collect()}
    assert got["ABCDEFGHIK"] == ("refer", "ABCDEFGHIJ", 90) and got["zz"][0] == "new" and set(got) == {"ABCDEFGHIK", "zz"}


def test_lines_of_known_articles_are_entries_where_asked_for(spark, tmp_path):
    from millrace.plans import services

    articles = spark.createDataFrame([("t", 1, 7, "10", "ring"), ("t", 1, 8, "100", "bolt")], "tenant string, supplier_id long, id long, code string, description string")
    lines = spark.createDataFrame([("t", 1, "100", "old ring"), ("t", 1, "1000", "old bolt")], "tenant string, supplier_id long, code string, description string")
    assert {r.code for r in matching.article_entries(lines, articles).collect()} == {"1000"}
    got = {r.code: (r.action, r.ref_code, r.code_score, r.description_score) for r in matching.article_entries(lines, articles, with_known=True).collect()}
    assert got == {"100": ("known", "100", 100, 50), "1000": ("new", None, 75, 50)}
    # part 200's line has the code of part 2000, which is of the same tenant and supplier
    spark.range(0, 2001).selectExpr("id p_partkey", "'part ' || id p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(600).selectExpr("id s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    known = services.article_master_entries(spark, str(tmp_path)).where("action = 'known'").collect()
    assert [(r.code, r.ref_code, r.code_score) for r in known] == [("2000", "2000", 100)]


def test_mail_routing_and_log(spark):
    tenants = spark.createDataFrame([(2, "B", "X@y"), (1, "A", "x@Y"), (3, "C", None)], "id long, code string, mail_from string")
    mail = spark.createDataFrame([("x@y",), ("who@y",), (None,)], "sender string")
    assert sorted(((r.sender or ""), r.tenant or "") for r in matching.route_mail(mail, tenants).collect()) == [("", ""), ("who@y", ""), ("x@y", "A")]
    calls = spark.createDataFrame([("t", 1, 2, 0.5, None, None, 1999), ("t", 1, 2, 0.5, "provider", "m", 10), ("t", 1, 2, 0.5, "other", "m", 10)], "tenant string, tokens_in int, tokens_out int, cost double, error string, message string, milliseconds long")
    rows = housekeeping.log_rows(calls.withColumn("created", F.lit("2001-01-01").cast("timestamp_ntz")))
    assert sorted((r.state, r.duration, r.tokens) for r in rows.collect()) == [(-2, 0, 3), (-1, 0, 3), (1, 1, 3)]


def test_recent_log_breaks_ties_by_id(spark):
    log = spark.range(1001).select("id", F.lit("2001-01-01").cast("timestamp_ntz").alias("created"), F.lit("t").alias("tenant"))
    got = [r.id for r in scans.recent_log(log, "t").collect()]
    assert len(got) == 1000 and got[0] == 1000 and got[-1] == 1


def test_lookups_that_must_find_one(spark):
    users = spark.createDataFrame([(1, "a@b")], "id long, email string")
    assert scans.user_by_email(users, "A@B")["id"] == 1
    with pytest.raises(LookupError):
        scans.user_by_email(users, "no")
    with pytest.raises(LookupError):
        scans.exactly_one(users.union(users))
    assert scans.exactly_one(users)["id"] == 1


def test_text_functions(spark):
    row = spark.createDataFrame([(" \t", "/a/b.X.PDF", "Basic YTpiOmM=", "a b/é", "7", "x")], "blank string, path string, auth string, url string, n string, bad string")
    got = row.select(
        text.is_blank(F.col("blank")).alias("blank"), text.extension(F.col("path")).alias("ext"), text.credentials(F.col("auth")).alias("c"), text.url_escape(F.col("url")).alias("u"),
        text.to_int(F.col("n")).alias("n"), text.to_int(F.col("bad"), strict=False).alias("bad"), text.whole_seconds(F.lit(1999)).alias("s"),
    ).first()
    assert (got.blank, got.ext, tuple(got.c), got.u, got.n, got.bad, got.s) == (True, ".pdf", ("a", "b:c"), "a%20b%2F%C3%A9", 7, None, 1)
    with pytest.raises(Exception):
        row.select(text.to_int(F.col("bad"))).collect()
