"""The queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as docfn
from ..functions import text as textfn
from ..operators import housekeeping, matching, mutations, reconcile, scans
from ..sources import invoices as xml
from ..sources import star
from ..sources.tables import read, shared_dir
from ..streaming.ingest import ingest, keyed_versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = COMMON + sql if sql.lstrip().startswith("SELECT") else "WITH " + COMMON.removeprefix("WITH ").rstrip() + ",\n" + sql.lstrip().removeprefix("WITH ")
        return f

    return add


TENANT = "7"
AS_OF = "2001-08-01 00:00:00"
ORDINAL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate"
COMMON = f"""WITH li AS (SELECT l_orderkey || '-' || l_linenumber AS line_id, l_suppkey::VARCHAR AS supplier, l_partkey::VARCHAR AS article, l_quantity AS quantity, * FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY {ORDINAL}) AS nth FROM li WHERE l_linestatus = 'F'),
i AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY {ORDINAL}) AS nth FROM li WHERE l_linestatus = 'O'),
pairs AS (SELECT d.line_id AS d_line_id, i.line_id AS i_line_id, d.supplier, d.article, d.quantity FROM d JOIN i ON d.supplier = i.supplier AND d.article = i.article AND d.quantity = i.quantity),
rest_d AS (SELECT row_number() OVER (PARTITION BY line_id ORDER BY {ORDINAL}) AS again, * FROM d WHERE line_id NOT IN (SELECT d_line_id FROM pairs)),
rest_i AS (SELECT row_number() OVER (PARTITION BY line_id ORDER BY {ORDINAL}) AS again, * FROM i WHERE line_id NOT IN (SELECT i_line_id FROM pairs)),
docs AS (SELECT o_orderkey AS id, (o_custkey % 25)::VARCHAR AS tenant, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS state, o_orderdate AS created, o_custkey::VARCHAR AS sender, o_orderkey::VARCHAR AS number, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority[1:1] AS type, o_totalprice AS total FROM orders),
nested AS (SELECT l_orderkey AS id, line_id, l_partkey::VARCHAR AS code, l_quantity AS quantity, l_extendedprice AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) AS pos FROM li),
sup AS (SELECT s_suppkey AS id, s_name AS description, s_nationkey::VARCHAR AS tenant FROM supplier),
art AS (SELECT p_partkey AS id, p_partkey::VARCHAR AS code, p_name AS description, (p_partkey % 25)::VARCHAR AS tenant, p_partkey % (SELECT count(*) FROM supplier) AS supplier_id FROM part),
lg AS (SELECT event_id AS id, ts AS created, (user_id % 25)::VARCHAR AS tenant, value AS cost, json_extract_string(props, '$.k')::INT AS tokens, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS state FROM events)
"""


def _suppliers_count(spark: SparkSession, folder: str) -> int:
    return read(spark, folder, "supplier").count()


def _flat(docs: DataFrame) -> DataFrame:
    doc = F.col("content.document")
    return docs.select("id", "tenant", "state", doc["sender"].alias("sender"), doc["number"].alias("number"), doc["date"].alias("date"), doc["type"].alias("type"), doc["total"].alias("total"))


def _lines_of(docs: DataFrame) -> DataFrame:
    lines = docs.select("id", F.posexplode("content.document.lines").alias("position", "x"))
    return lines.select("id", F.col("position").cast("bigint").alias("position"), F.col("x.line_id").alias("line_id"), F.col("x.code").alias("code"), F.col("x.quantity").cast("double").alias("quantity"))


# reconciliation


@query("SELECT d_line_id, i_line_id, supplier, article, quantity FROM pairs")
def exact_reconcile(spark, folder):
    found = reconcile.exact_matches(star.deliveries(spark, folder), star.invoices(spark, folder))
    return found.select("d_line_id", "i_line_id", F.col("d_supplier").alias("supplier"), F.col("d_article").alias("article"), F.col("d_quantity").cast("double").alias("quantity"))


def _rest(spark, folder, side):
    d, i = star.deliveries(spark, folder), star.invoices(spark, folder)
    found = reconcile.exact_matches(d, i)
    out = reconcile.unmatched(d if side == "d" else i, found.select(f"{side}_line_id"))
    return out.select("line_id", "supplier", "article", F.col("quantity").cast("double").alias("quantity"))


@query("SELECT line_id, supplier, article, quantity FROM rest_d WHERE again = 1")
def unmatched_deliveries(spark, folder):
    return _rest(spark, folder, "d")


@query("SELECT line_id, supplier, article, quantity FROM rest_i WHERE again = 1")
def unmatched_invoices(spark, folder):
    return _rest(spark, folder, "i")


@query(
    """SELECT supplier, sum(n_lines)::BIGINT AS n_lines, sum(n_matched)::BIGINT AS n_matched, sum(open_quantity) AS open_quantity FROM (
  SELECT supplier, 1 AS n_lines, CASE WHEN line_id IN (SELECT d_line_id FROM pairs) THEN 1 ELSE 0 END AS n_matched, CASE WHEN line_id IN (SELECT d_line_id FROM pairs) THEN 0.0::DOUBLE ELSE quantity END AS open_quantity FROM d
) GROUP BY supplier"""
)
def reconcile_report(spark, folder):
    d, i = star.deliveries(spark, folder), star.invoices(spark, folder)
    marked = reconcile.flag_matched(d, reconcile.exact_matches(d, i).select("d_line_id"))
    return marked.groupBy("supplier").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("matched").alias("n_matched"), F.sum(F.when(F.col("matched"), 0.0).otherwise(F.col("quantity").cast("double"))).alias("open_quantity")
    )


@query(
    """WITH linked AS (SELECT i_line_id, sum(quantity) AS delivered FROM pairs GROUP BY 1)
SELECT line_id, quantity, coalesce(delivered, 0)::DOUBLE AS delivered, quantity - coalesce(delivered, 0) AS difference, CASE WHEN delivered IS NULL THEN 'unmatched' WHEN quantity = delivered THEN 'matched' ELSE 'partial' END AS state
FROM i LEFT JOIN linked ON line_id = i_line_id WHERE nth = 1"""
)
def reconcile_totals(spark, folder):
    d, i = star.deliveries(spark, folder), star.invoices(spark, folder)
    out = reconcile.totals(i, reconcile.exact_matches(d, i))
    return out.select("line_id", *[F.col(c).cast("double").alias(c) for c in ("quantity", "delivered", "difference")], "state")


@query(
    f"""WITH ranked AS (SELECT d.line_id AS d_line_id, i.line_id AS i_line_id,
  dense_rank() OVER (PARTITION BY d.supplier, d.article, d.quantity ORDER BY {', '.join('d.' + c for c in ORDINAL.split(', '))}) AS a,
  dense_rank() OVER (PARTITION BY d.supplier, d.article, d.quantity ORDER BY {', '.join('i.' + c for c in ORDINAL.split(', '))}) AS b
  FROM d JOIN i ON d.supplier = i.supplier AND d.article = i.article AND d.quantity = i.quantity)
SELECT d_line_id, i_line_id FROM ranked WHERE a = b"""
)
def reconcile_one_to_one(spark, folder):
    found = reconcile.exact_matches(star.deliveries(spark, folder), star.invoices(spark, folder))
    return reconcile.paired_once(found).select("d_line_id", "i_line_id")


@query("SELECT DISTINCT supplier FROM li WHERE supplier != ''")
def supplier_worklist(spark, folder):
    return reconcile.work_list(star.deliveries(spark, folder), star.invoices(spark, folder))


@query(
    """SELECT supplier, count(*) FILTER (l_linestatus = 'F') AS n_deliveries, count(*) FILTER (l_linestatus = 'O') AS n_invoices,
coalesce(sum(quantity) FILTER (l_linestatus = 'F'), 0)::DOUBLE AS delivered, coalesce(sum(quantity) FILTER (l_linestatus = 'O'), 0)::DOUBLE AS invoiced FROM li WHERE l_linestatus IN ('F', 'O') GROUP BY supplier"""
)
def supplier_batches(spark, folder):
    out = reconcile.supplier_batches(star.deliveries(spark, folder), star.invoices(spark, folder))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["quantity"].cast("double"))
    return out.select(
        "supplier", F.size("deliveries").cast("bigint").alias("n_deliveries"), F.size("invoices").cast("bigint").alias("n_invoices"), total("deliveries").alias("delivered"), total("invoices").alias("invoiced")
    )


@query(
    """WITH ids AS (SELECT DISTINCT d_line_id, i_line_id FROM pairs)
SELECT d_line_id, i_line_id, d.supplier AS d_supplier, i.supplier AS i_supplier, d.quantity AS d_quantity, i.quantity AS i_quantity FROM ids JOIN d ON d.line_id = d_line_id AND d.nth = 1 JOIN i ON i.line_id = i_line_id AND i.nth = 1"""
)
def resolve_match_ids(spark, folder):
    d, i = star.deliveries(spark, folder), star.invoices(spark, folder)
    found = reconcile.exact_matches(d, i).select(F.col("d_line_id").alias("delivery_id"), F.col("i_line_id").alias("invoice_id")).distinct()
    out = reconcile.resolve_pairs(found, d, i)
    return out.select("d_line_id", "i_line_id", "d_supplier", "i_supplier", F.col("d_quantity").cast("double").alias("d_quantity"), F.col("i_quantity").cast("double").alias("i_quantity"))


# documents


@query(f"SELECT id, tenant, state, sender, number, date, type, total FROM docs WHERE tenant = '{TENANT}' AND state = 0")
def docs_open_default(spark, folder):
    return _flat(scans.documents(star.documents(spark, folder, False), tenant=TENANT))


@query("SELECT id, tenant, state, sender, number, date, type, total FROM docs WHERE tenant = '7' AND sender = '32' AND date >= '1990' AND date IN (SELECT date FROM docs WHERE sender = '32' ORDER BY id LIMIT 1)")
def docs_by_sender_number_date(spark, folder):
    docs = star.documents(spark, folder, False)
    first = docs.where("content.document.sender = '32'").orderBy("id").select("content.document.date").first()
    return _flat(scans.documents(docs, tenant="7", state=-1, sender="32", number=" ", date=first[0] if first else "none"))


@query(f"SELECT id, tenant, state, sender, number, date, type, total FROM docs WHERE tenant = '{TENANT}' AND type = '4'")
def docs_by_type(spark, folder):
    return _flat(scans.documents(star.documents(spark, folder, False), tenant=TENANT, state=-1, kind=4))


@query("SELECT id, date, total FROM docs WHERE lower(sender) = '32' AND number = (SELECT min(number) FROM docs WHERE sender = '32')")
def legacy_doc_lookup(spark, folder):
    docs = star.documents(spark, folder, False)
    first = _flat(docs).where("sender = '32'").orderBy("number").first()
    found = scans.legacy_one(docs, "32", first["number"], first["date"]) if first else docs.limit(0)
    return _flat(found).select("id", "date", "total")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_path_filter(spark, folder):
    k = docfn.path(F.col("props"), "k")
    return read(spark, folder, "events").where(k == "42").select("event_id", k.alias("k"))


@query("SELECT id, (pos - 1)::BIGINT AS position, line_id, code, quantity FROM nested")
def doc_lines_flatten(spark, folder):
    return _lines_of(star.documents(spark, folder))


@query("SELECT id, sender, number, type::INT AS type, total, (SELECT count(*) FROM nested n WHERE n.id = docs.id) AS n_lines FROM docs")
def shred_headers(spark, folder):
    header, lines = mutations.shred(star.documents(spark, folder))
    counts = lines.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return header.join(counts, "id", "left").select("id", "sender", "number", "type", "total", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("SELECT id, id::VARCHAR AS doc_id, sender, type, total, (SELECT count(*) FROM nested n WHERE n.id = docs.id) AS n_lines FROM docs")
def json_round_trip(spark, folder):
    back = star.documents(spark, folder).select("id", docfn.parse(docfn.render(F.col("content"))).alias("c"))
    doc = F.col("c.document")
    return back.select("id", doc["id"].alias("doc_id"), doc["sender"].alias("sender"), doc["type"].alias("type"), doc["total"].alias("total"), F.size(doc["lines"]).cast("bigint").alias("n_lines"))


# mutations


@query("SELECT id, tenant, CASE WHEN tenant = '7' AND number = '32' THEN 1 ELSE state END AS state FROM docs")
def set_state(spark, folder):
    return mutations.set_state(star.documents(spark, folder, False), "7", "32", 1).select("id", "tenant", "state")


@query("SELECT id, tenant, CASE WHEN tenant = (SELECT tenant FROM docs WHERE number = '5') AND number = '5' THEN '2' ELSE type END AS type FROM docs")
def set_type(spark, folder):
    docs = star.documents(spark, folder, False)
    row = docs.where("id = 5").select("tenant").first()
    return mutations.set_type(docs, row[0] if row else "", "5", 2).select("id", "tenant", F.col("content.document.type").alias("type"))


def _edits(spark, folder, line_id) -> DataFrame:
    """An edit of every third order: a line of quantity 99."""
    amount = "decimal(28,10)"
    line = F.struct(
        line_id.alias("line_id"), F.col("number").alias("master_id"), F.lit("new").alias("code"), F.lit(None).cast("string").alias("description"), F.lit(99).cast(amount).alias("quantity"),
        F.lit("pz").alias("unit"), F.lit(0).cast(amount).alias("taxable"), F.lit("0").alias("vat"), F.lit(1).cast(amount).alias("total"),
    )
    return star.headers(spark, folder).where("id % 3 = 0").select("tenant", F.col("number").alias("doc_id"), line.alias("line"))


@query(
    """WITH n AS (SELECT id, count(*) AS n FROM nested GROUP BY id)
SELECT id, (pos - 1)::BIGINT AS position, line_id, code, quantity FROM nested UNION ALL
SELECT docs.id, coalesce(n.n, 0), docs.number || '-x', 'new', 99.0::DOUBLE FROM docs LEFT JOIN n USING (id) WHERE docs.id % 3 = 0"""
)
def line_append(spark, folder):
    return _lines_of(mutations.append_lines(star.documents(spark, folder), _edits(spark, folder, F.concat(F.col("number"), F.lit("-x")))))


_FIRST = "(SELECT min(pos) FROM nested m WHERE m.id = nested.id AND m.line_id = nested.id || '-1')"


@query(
    f"""SELECT id, (pos - 1)::BIGINT AS position, line_id, CASE WHEN hit THEN 'new' ELSE code END AS code, CASE WHEN hit THEN 99.0::DOUBLE ELSE quantity END AS quantity
FROM (SELECT *, coalesce(id % 3 = 0 AND pos = {_FIRST}, false) AS hit FROM nested)"""
)
def line_replace(spark, folder):
    return _lines_of(mutations.replace_lines(star.documents(spark, folder), _edits(spark, folder, F.concat(F.col("number"), F.lit("-1")))))


@query(
    f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS position, line_id, code, quantity
FROM (SELECT *, coalesce(id % 3 = 0 AND pos = {_FIRST}, false) AS hit FROM nested) WHERE NOT hit"""
)
def line_remove(spark, folder):
    return _lines_of(mutations.remove_lines(star.documents(spark, folder), _edits(spark, folder, F.concat(F.col("number"), F.lit("-1")))))


def _keyed(spark, folder):
    """The earlier half of the orders' ids is the state, the later arrives; the key leaves the number out."""
    rows = star.headers(spark, folder).withColumn("number", F.lit("0"))
    half = rows.agg(F.max("id")).first()[0] // 2
    columns = ["id", *mutations.KEY, "state", "total"]
    return rows.where(F.col("id") <= half).select(columns), rows.where(F.col("id") > half).withColumn("arrival", F.col("id")).select(*columns[1:], "arrival")


_KEYED = """WITH half AS (SELECT max(id) // 2 AS h FROM docs), st AS (SELECT * FROM docs, half WHERE id <= h), inc AS (SELECT * FROM docs, half WHERE id > h),
met AS (SELECT tenant, sender, date, type, min(id) AS met, arg_min(state, id) AS met_state FROM st GROUP BY ALL),
marked AS (SELECT inc.*, met, met_state FROM inc LEFT JOIN met USING (tenant, sender, date, type)),
acc AS (SELECT *, row_number() OVER (PARTITION BY tenant, sender, date, type ORDER BY id DESC) AS k FROM marked WHERE met_state IS DISTINCT FROM 1)
"""


@query(
    _KEYED
    + """SELECT id, tenant, sender, date, type, state, total FROM st WHERE id NOT IN (SELECT met FROM acc WHERE k = 1 AND met IS NOT NULL)
UNION ALL SELECT (SELECT max(id) FROM st) + row_number() OVER (ORDER BY id), tenant, sender, date, type, state, total FROM acc WHERE k = 1"""
)
def keyed_replace_state(spark, folder):
    return mutations.keyed_replace(*_keyed(spark, folder)).state.select("id", "tenant", "sender", "date", "type", "state", "total")


@query(_KEYED + "SELECT id AS arrival, tenant, sender, date, type, total FROM marked WHERE met_state = 1")
def keyed_replace_rejects(spark, folder):
    return mutations.keyed_replace(*_keyed(spark, folder)).rejected.select("arrival", "tenant", "sender", "date", "type", "total")


@query(
    f"""WITH both_ AS (SELECT 0 AS side, * FROM d UNION ALL SELECT 1, * FROM i),
last AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey % 25, line_id ORDER BY side DESC, {', '.join(c + ' DESC' for c in ORDINAL.split(', '))}) AS k FROM both_)
SELECT (l_suppkey % 25)::VARCHAR AS tenant, line_id, CASE WHEN side = 0 THEN 'delivery' ELSE 'invoice' END AS side, article, quantity, quantity AS delta, 3 AS doc_type, 0 AS flag FROM last WHERE k = 1"""
)
def save_reconciliation_latest(spark, folder):
    def rows(df, side):
        more = df.select(
            "line_id", F.lit(None).cast("string").alias("master_id"), F.col("article").alias("code"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("note"),
            F.col("supplier").alias("supplier_id"), (F.col("supplier").cast("bigint") % 25).cast("string").alias("tenant"), F.lit(None).cast("timestamp_ntz").alias("created"), "ordinal", "quantity",
            F.lit(0).cast("decimal(28,10)").alias("reconciled"), F.lit(False).alias("selected"),
        )
        return mutations.reconciled_rows(more, side)

    d, i = rows(star.deliveries(spark, folder), "delivery"), rows(star.invoices(spark, folder), "invoice")
    empty = d.withColumn("id", F.lit(0).cast("long")).drop("ordinal").limit(0)
    out = mutations.save_reconciliation(empty, d, i)
    return out.select("tenant", "line_id", "side", F.col("code").alias("article"), F.col("quantity").cast("double").alias("quantity"), F.col("delta").cast("double").alias("delta"), "doc_type", "flag")


@query(f"SELECT id, tenant, state, date FROM docs WHERE NOT (state = 1 AND created < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)")
def retention_keep(spark, folder):
    kept = mutations.retain(star.documents(spark, folder, False), F.lit(AS_OF).cast("timestamp_ntz"))
    return kept.select("id", "tenant", "state", F.col("content.document.date").alias("date"))


@query("SELECT id, tenant, date FROM docs WHERE id != (SELECT min(id) FROM docs WHERE tenant = '7' AND state = 0)")
def delete_first_document(spark, folder):
    return mutations.delete_first(star.documents(spark, folder, False), tenant="7").select("id", "tenant", F.col("content.document.date").alias("date"))


@query("SELECT id, description, tenant FROM sup UNION ALL SELECT (SELECT max(id) FROM sup) + row_number() OVER (ORDER BY c_name, c_custkey), c_name, '3' FROM customer")
def insert_suppliers(spark, folder):
    rows = read(spark, folder, "customer").select(F.col("c_name").alias("description"), "c_custkey")
    return mutations.guarded_insert(star.suppliers(spark, folder).withColumn("c_custkey", F.lit(None).cast("long")), rows, "3", ["description", "c_custkey"]).drop("c_custkey")


@query("SELECT id, CASE WHEN id % 4 = 0 AND tenant = '7' THEN 'changed' ELSE description END AS description, tenant FROM sup")
def update_suppliers(spark, folder):
    state = star.suppliers(spark, folder)
    return mutations.update(state, state.where("id % 4 = 0").withColumn("description", F.lit("changed")), "7")


@query("SELECT id, description, tenant FROM sup WHERE NOT (id % 4 = 0 AND tenant = '7')")
def delete_suppliers(spark, folder):
    state = star.suppliers(spark, folder)
    return mutations.delete(state, state.where("id % 4 = 0").select("id"), "7")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN upper(description) ELSE description END AS description, tenant FROM sup WHERE id > 0 AND id % 2 = 0")
def changed_suppliers(spark, folder):
    state = star.suppliers(spark, folder)
    return mutations.changed_rows(state, state.withColumn("description", F.when(F.col("id") % 2 == 0, F.upper("description")).otherwise(F.col("description"))))


# scans and master data


@query("SELECT id, description FROM sup WHERE tenant = '7'")
def tenant_scan(spark, folder):
    return scans.of_tenant(star.suppliers(spark, folder), TENANT).select("id", "description")


@query("SELECT id, description, tenant FROM sup WHERE id = 5")
def point_lookup(spark, folder):
    return scans.by_id(star.suppliers(spark, folder), 5)


@query("SELECT id, code, description FROM art WHERE tenant = '7' AND supplier_id = 7")
def articles_of_supplier(spark, folder):
    return scans.articles_of(star.articles(spark, folder, _suppliers_count(spark, folder)), TENANT, 7).select("id", "code", "description")


@query(
    """WITH one AS (SELECT * FROM sup WHERE (id % 25)::VARCHAR = tenant ORDER BY id LIMIT 1)
SELECT a.id, a.code, a.description FROM art a JOIN one ON a.tenant = one.tenant AND a.supplier_id = one.id"""
)
def articles_of_named_supplier(spark, folder):
    suppliers = star.suppliers(spark, folder)
    one = suppliers.where("cast(id % 25 as string) = tenant").orderBy("id").first()
    found = scans.articles_of_named(star.articles(spark, folder, _suppliers_count(spark, folder)), suppliers, *((one["tenant"], one["description"].upper()) if one else ("", "")))
    return found.select("id", "code", "description")


@query("SELECT c.c_nationkey::VARCHAR AS tenant, upper(replace(c.c_name, 'Customer', 'Supplier')) AS name, (SELECT min(id) FROM sup s WHERE s.tenant = c.c_nationkey::VARCHAR AND lower(s.description) = lower(replace(c.c_name, 'Customer', 'Supplier'))) AS supplier_id FROM customer c")
def supplier_resolve_exact(spark, folder):
    names = read(spark, folder, "customer").select(F.col("c_nationkey").cast("string").alias("tenant"), F.upper(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("name"))
    return matching.resolve_supplier(names, star.suppliers(spark, folder)).select("tenant", "name", "supplier_id")


@query("SELECT line_id, code, (SELECT min(a.id) FROM art a WHERE a.tenant = (l.l_partkey % 25)::VARCHAR AND a.supplier_id = l.l_suppkey AND a.code = l.article) AS article_id FROM (SELECT *, article AS code FROM d) l")
def article_lookup(spark, folder):
    lines = read(spark, folder, "lineitem").where("l_linestatus = 'F'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"), (F.col("l_partkey") % 25).cast("string").alias("tenant"), F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").cast("string").alias("code")
    )
    return matching.find_articles(lines, star.articles(spark, folder, _suppliers_count(spark, folder))).select("line_id", "code", "article_id")


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_MATCH = f"""WITH q AS (SELECT DISTINCT c_nationkey::VARCHAR AS tenant, replace(c_name, 'Customer', 'Suplier') AS name FROM customer),
scored AS (SELECT q.tenant, q.name, s.id, CASE WHEN a = b THEN 100 ELSE (100 * (greatest(length(a), length(b)) - levenshtein(a, b))) // greatest(length(a), length(b)) END AS score
  FROM (SELECT *, {_NORM.format('name')} AS a FROM q) q JOIN (SELECT *, {_NORM.format('description')} AS b FROM sup) s ON q.tenant = s.tenant),
best AS (SELECT q.tenant, q.name, arg_max(id, score * 1000000000 - id) AS id, coalesce(max(score), 0) AS score FROM q LEFT JOIN scored USING (tenant, name) GROUP BY ALL)
"""


def _names(spark, folder):
    return read(spark, folder, "customer").select(F.col("c_nationkey").cast("string").alias("tenant"), F.replace("c_name", F.lit("Customer"), F.lit("Suplier")).alias("name"))


def _choices(spark, folder):
    return star.suppliers(spark, folder).select("tenant", "id", F.col("description").alias("name"))


@query(_MATCH + "SELECT tenant, name, id, CAST(score AS INT) AS score FROM best")
def best_fuzzy_match(spark, folder):
    return matching.best_match(_names(spark, folder), _choices(spark, folder), ["tenant"]).select("tenant", "name", "id", "score")


@query(_MATCH + "SELECT tenant, CASE WHEN score >= 100 THEN 'exact' WHEN score >= 90 THEN 'high' ELSE 'new' END AS band, count(*) AS n FROM best GROUP BY ALL")
def match_band(spark, folder):
    return matching.best_match(_names(spark, folder), _choices(spark, folder), ["tenant"]).groupBy("tenant", "band").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT e.event_id, e.user_id::VARCHAR || '@MAIL.test' AS sender, t.n_name AS tenant FROM events e LEFT JOIN nation t ON e.user_id = t.n_nationkey"""
)
def mail_routing(spark, folder):
    tenants = read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"), F.concat(F.col("n_nationkey").cast("string"), F.lit("@mail.test")).alias("mail_from"))
    mail = read(spark, folder, "events").select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("@MAIL.test")).alias("sender"))
    return matching.route_mail(mail, tenants).select("event_id", "sender", "tenant")


# log, files, streams


@query("SELECT id, created, tenant, cost, state FROM lg ORDER BY created DESC, id DESC LIMIT 1000")
def recent_log_1000(spark, folder):
    return scans.recent_log(star.log(spark, folder)).select("id", "created", "tenant", "cost", "state")


@query("SELECT tenant, count(*) AS calls, count(*) FILTER (state < 0) AS failures, sum(tokens)::BIGINT AS tokens FROM lg GROUP BY tenant")
def usage_by_tenant(spark, folder):
    log = star.log(spark, folder)
    tokens = log.groupBy("tenant").agg(F.sum("tokens").cast("bigint").alias("tokens"))
    return housekeeping.usage(log).join(tokens, "tenant").select("tenant", "calls", "failures", "tokens")


@query("SELECT event_id, lower('/drop/' || event_type || '.XML')[-4:] AS ext, user_id::VARCHAR || ' ' AS padded, event_type = '' AS blank, event_id * 1237 // 1000 AS seconds FROM events")
def scalar_functions(spark, folder):
    return read(spark, folder, "events").select(
        "event_id", textfn.extension(F.concat(F.lit("/drop/"), F.col("event_type"), F.lit(".XML"))).alias("ext"), F.concat(F.col("user_id").cast("string"), F.lit(" ")).alias("padded"),
        textfn.is_blank(F.col("event_type")).alias("blank"), textfn.whole_seconds(F.col("event_id") * 1237).alias("seconds"),
    )


@query("SELECT number, date, line_id, code, quantity, sender, total FROM (SELECT docs.number, docs.date, nested.pos::VARCHAR AS line_id, nested.code, nested.quantity, docs.sender, docs.total FROM nested JOIN docs USING (id))")
def xml_invoice_lines(spark, folder):
    """Orders written as XML invoices, and the lines that the parser reads of them."""
    docs = star.documents(spark, folder)
    doc = F.col("content.document")
    line = lambda x, i: F.concat(
        F.lit("<DettaglioLinee><NumeroLinea>"), (i + 1).cast("string"), F.lit("</NumeroLinea><CodiceArticolo><CodiceTipo>T</CodiceTipo><CodiceValore>"), x["code"],
        F.lit("</CodiceValore></CodiceArticolo><Descrizione>d</Descrizione><Quantita>"), x["quantity"].cast("string"), F.lit("</Quantita><PrezzoTotale>"), x["total"].cast("string"),
        F.lit("</PrezzoTotale><AliquotaIVA>22.00</AliquotaIVA></DettaglioLinee>"),
    )
    text = F.concat(
        F.lit('<p:FatturaElettronica xmlns:p="urn:i"><FatturaElettronicaHeader><CedentePrestatore><DatiAnagrafici><Anagrafica><Denominazione>'), doc["sender"],
        F.lit("</Denominazione></Anagrafica></DatiAnagrafici></CedentePrestatore></FatturaElettronicaHeader><FatturaElettronicaBody><DatiGenerali><DatiGeneraliDocumento><Data>"), doc["date"],
        F.lit("</Data><Numero>"), doc["number"], F.lit("</Numero><ImportoTotaleDocumento>"), doc["total"].cast("decimal(28,2)").cast("string"), F.lit("</ImportoTotaleDocumento></DatiGeneraliDocumento></DatiGenerali><DatiBeniServizi>"), F.array_join(F.transform(doc["lines"], line), ""),
        F.lit("</DatiBeniServizi></FatturaElettronicaBody></p:FatturaElettronica>"),
    )
    out = xml.documents(docs.select(F.col("file_name").alias("source"), text.alias("xml")))
    # explode would first count the lines of each list, and make the list twice
    out = out.select("number", "date", "sender", "total", F.explode_outer("lines").alias("x")).where("x is not null")
    return out.select("number", "date", F.col("x.line_id").alias("line_id"), F.col("x.code").alias("code"), F.col("x.quantity").cast("double").alias("quantity"), "sender", "total")


@query(
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY tenant, sender, date, type ORDER BY id DESC) AS n FROM docs)
SELECT tenant, sender, date, type, total FROM k WHERE n = 1"""
)
def stream_ingest_state(spark, folder):
    """Orders as a dropped file, merged by a stream into a state that is empty at first."""
    home = f"{shared_dir(spark)}/millrace/ingest-{uuid.uuid4().hex}"
    schema = read(spark, folder, "orders").schema

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.select(
            (F.col("o_custkey") % 25).cast("string").alias("tenant"), F.col("o_custkey").cast("string").alias("sender"), F.lit("0").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.substring("o_orderpriority", 1, 1).alias("type"), F.lit(0).alias("state"), F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("arrival"),
        )

    empty = spark.createDataFrame([], "id long, tenant string, sender string, number string, date string, type string, state int, total double")
    # a pattern, so that one file and a folder of files serve alike
    ingest(spark, f"{folder}/orders.parque[t]", schema, prepare, empty, f"{home}/state", f"{home}/checkpoint", every=None).awaitTermination()
    versions = keyed_versions(spark, f"{home}/state")
    return versions.read(versions.latest()).select("tenant", "sender", "date", "type", "total")
