"""Queries over quantities, classes, pages, similar names and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocation, changes, matching, reconcile
from ..sources import star
from ..sources.tables import read
from .catalog import ORDINAL, query

_LAID = f"""WITH ds AS (SELECT supplier, article, line_id, quantity, sum(quantity) OVER w - quantity AS b, sum(quantity) OVER w AS e FROM d WHERE quantity > 0 WINDOW w AS (PARTITION BY supplier, article ORDER BY {ORDINAL})),
iv AS (SELECT supplier, article, line_id, quantity, sum(quantity) OVER w - quantity AS b, sum(quantity) OVER w AS e FROM i WHERE quantity > 0 WINDOW w AS (PARTITION BY supplier, article ORDER BY {ORDINAL})),
met AS (SELECT ds.supplier, ds.article, ds.line_id AS delivery_id, iv.line_id AS invoice_id, least(ds.e, iv.e) - greatest(ds.b, iv.b) AS quantity FROM ds JOIN iv ON ds.supplier = iv.supplier AND ds.article = iv.article AND ds.b < iv.e AND iv.b < ds.e),
dt AS (SELECT supplier, article, max(e) AS t FROM ds GROUP BY ALL), it AS (SELECT supplier, article, max(e) AS t FROM iv GROUP BY ALL)
"""


@query(
    _LAID
    + """SELECT supplier, article, delivery_id, invoice_id, quantity FROM met
UNION ALL SELECT ds.supplier, ds.article, line_id, NULL, e - greatest(b, coalesce(t, 0)) FROM ds LEFT JOIN it ON ds.supplier = it.supplier AND ds.article = it.article WHERE e > coalesce(t, 0)
UNION ALL SELECT iv.supplier, iv.article, NULL, line_id, e - greatest(b, coalesce(t, 0)) FROM iv LEFT JOIN dt ON iv.supplier = dt.supplier AND iv.article = dt.article WHERE e > coalesce(t, 0)"""
)
def allocated_deliveries(spark, folder):
    """A4: what each delivery line gives to each invoice line, first in, first out, and what stays open."""
    out = allocation.allocate(star.deliveries(spark, folder), star.invoices(spark, folder))
    return out.select("supplier", "article", "delivery_id", "invoice_id", F.col("quantity").cast("double").alias("quantity"))


@query()
def capacity_links(spark, folder):
    """Similar articles of a supplier, each delivery linked once, each invoice line within its quantity."""
    d, i = star.deliveries(spark, folder), star.invoices(spark, folder)
    edges = allocation.similar_edges(d, i, 75)
    lines = [df.select(F.col("line_id").alias("id"), "quantity", "ordinal") for df in (d, i)]
    return allocation.capacity_links(edges, *[reconcile.first_per(df, ["id"], [F.col("ordinal")]).drop("ordinal") for df in lines])


@query(
    """SELECT d.supplier, d.article, d.quantity, count(DISTINCT d.rowid_) AS deliveries, count(DISTINCT i.rowid_) AS invoices, count(*) AS links
FROM (SELECT row_number() OVER () AS rowid_, * FROM d) d JOIN (SELECT row_number() OVER () AS rowid_, * FROM i) i ON d.supplier = i.supplier AND d.article = i.article AND d.quantity = i.quantity GROUP BY ALL"""
)
def exact_match_classes(spark, folder):
    """J1 as classes: how many lines of either side a class has, and how many pairs."""
    classes = reconcile.match_classes(star.deliveries(spark, folder), star.invoices(spark, folder))["classes"]
    return classes.select("supplier", "article", F.col("quantity").cast("double").alias("quantity"), "deliveries", "invoices", F.col("links").cast("long").alias("links"))


@query("SELECT d_line_id, i_line_id FROM pairs")
def exact_match_members(spark, folder):
    """The members of all classes, expanded into their pairs."""
    return reconcile.expand(reconcile.match_classes(star.deliveries(spark, folder), star.invoices(spark, folder))["members"]).select("d_line_id", "i_line_id")


@query(
    f"""WITH both_ AS (SELECT 'delivery' AS side, * FROM d UNION ALL SELECT 'invoice', * FROM i),
n AS (SELECT supplier, side, line_id, article, quantity, row_number() OVER (PARTITION BY supplier, side ORDER BY {ORDINAL}) - 1 AS place FROM both_)
SELECT supplier, side, place // 100 AS page, place % 100 AS at, line_id AS id, article, quantity FROM n"""
)
def supplier_pages(spark, folder):
    """A2: every supplier's two lists as pages of 100 lines, in order."""
    pages = reconcile.supplier_pages(star.deliveries(spark, folder), star.invoices(spark, folder), 100)
    lines = pages.select("supplier", "side", "page", F.posexplode("lines").alias("at", "x"))
    return lines.select("supplier", "side", "page", F.col("at").cast("bigint").alias("at"), F.col("x.id").alias("id"), F.col("x.article").alias("article"), F.col("x.quantity").cast("double").alias("quantity"))


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH q AS (SELECT DISTINCT {_NORM.format("replace(p_name, 'e', '') || ' ' || p_partkey % 7")} AS a, replace(p_name, 'e', '') || ' ' || p_partkey % 7 AS name FROM part),
c AS (SELECT {_NORM.format('p_name')} AS b, min(p_partkey) AS id FROM part GROUP BY 1),
scored AS (SELECT name, id, CASE WHEN a = b THEN 100 ELSE (100 * (greatest(length(a), length(b)) - levenshtein(a, b))) // greatest(length(a), length(b)) END AS score FROM q, c)
SELECT name, arg_max(id, score * 1000000000 - id) AS id, max(score)::INT AS score FROM scored GROUP BY name"""
)
def best_similar_article(spark, folder):
    """J6 in one block of all articles, by the index of q-grams: names that lost their e's and got a number."""
    parts = read(spark, folder, "part")
    asked = parts.select(F.lit("all").alias("tenant"), F.concat(F.replace("p_name", F.lit("e"), F.lit("")), F.lit(" "), (F.col("p_partkey") % 7).cast("string")).alias("name"))
    known = parts.select(F.lit("all").alias("tenant"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return matching.best_match(asked, known, ["tenant"]).select("name", "id", "score")


def _versions(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Orders' headers, and a version in which some changed, some went and some are new."""
    old = star.headers(spark, folder).select("id", "tenant", "state", "sender", "date", "total")
    new = old.where("id % 97 != 0").withColumn("state", F.when(F.col("id") % 89 == 0, 2).otherwise(F.col("state")))
    more = old.where("id % 83 = 0").withColumn("id", -F.col("id"))
    return old, new.unionByName(more)


@query(
    """WITH a AS (SELECT id, state, total FROM docs), b AS (SELECT id, CASE WHEN id % 89 = 0 THEN 2 ELSE state END AS state, total FROM docs WHERE id % 97 != 0 UNION ALL SELECT -id, state, total FROM docs WHERE id % 83 = 0)
SELECT CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(a.id, b.id) AS id, a.state AS before_state, b.state AS after_state, coalesce(a.total, b.total) AS total
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.state IS DISTINCT FROM b.state"""
)
def change_feed(spark, folder):
    """CH1: inserts, updates and deletes between two versions, before and after."""
    out = changes.feed(*_versions(spark, folder))
    return out.select("op", "id", F.col("before.state").alias("before_state"), F.col("after.state").alias("after_state"), F.coalesce("before.total", "after.total").alias("total"))
