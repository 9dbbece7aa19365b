"""Adapters: the star-schema tables as domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

TENANTS = 25
AMOUNT = "decimal(28,10)"


def lines(spark: SparkSession, folder: str, status: str) -> DataFrame:
    """Delivery lines (status F) or invoice lines (O) of lineitem; whole rows are distinct, so `ordinal` is total."""
    raw = read(spark, folder, "lineitem").where(F.col("l_linestatus") == status)
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    return raw.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"), F.col("l_suppkey").cast("string").alias("supplier"),
        F.col("l_partkey").cast("string").alias("article"), F.col("l_quantity").cast(AMOUNT).alias("quantity"), F.struct(*order).alias("ordinal"),
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder, "F")


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder, "O")


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of orders, flat: id, tenant, state, created and the key fields."""
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % TENANTS).cast("string").alias("tenant"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("state"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created"), F.col("o_custkey").cast("string").alias("sender"), F.col("o_orderkey").cast("string").alias("number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.substring("o_orderpriority", 1, 1).alias("type"), F.col("o_totalprice").alias("total"),
    )


def nested_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(order, lines): each order's lines in order, as the documents nest them.

    Rows move and are sorted as the table has them; what a document's line is
    made of is worked out afterwards, as most of it says the same thing again.
    """
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    # dealt before they are grouped, so that no task sorts lists of single lines for the shuffle
    rows = read(spark, folder, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(order)).alias("lines"))
    line = lambda x: F.struct(
        F.concat_ws("-", "id", x["l_linenumber"]).alias("line_id"), F.col("id").cast("string").alias("master_id"), x["l_partkey"].cast("string").alias("code"),
        F.lit(None).cast("string").alias("description"), x["l_quantity"].cast(AMOUNT).alias("quantity"), F.lit("pz").alias("unit"), F.lit(0).cast(AMOUNT).alias("taxable"),
        x["l_tax"].cast("string").alias("vat"), x["l_extendedprice"].cast(AMOUNT).alias("total"),
    )
    return rows.withColumn("lines", F.transform("lines", line))


def documents(spark: SparkSession, folder: str, with_lines: bool = True) -> DataFrame:
    """docs with their nested content; orders without lines have an empty list."""
    base = headers(spark, folder)
    base = base.join(nested_lines(spark, folder), "id", "left") if with_lines else base.withColumn("lines", F.lit(None))
    empty = "array<struct<line_id: string, master_id: string, code: string, description: string, quantity: decimal(28,10), unit: string, taxable: decimal(28,10), vat: string, total: decimal(28,10)>>"
    doc = F.struct(
        F.col("id").cast("string").alias("id"), "type", "number", "date", "sender", F.coalesce(F.col("lines").cast(empty), F.array().cast(empty)).alias("lines"),
        F.lit(None).cast("double").alias("taxable"), F.lit(None).cast("string").alias("discount"), F.lit(None).cast("string").alias("vat"), "total",
    )
    content = F.struct(F.lit("star").alias("model_name"), F.concat(F.col("number"), F.lit(".pdf")).alias("file_name"), doc.alias("document"))
    return base.select("id", F.concat(F.col("number"), F.lit(".pdf")).alias("file_name"), "created", content.alias("content"), F.col("number").cast("binary").alias("attachment"), "tenant", "state")


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("description"), F.col("s_nationkey").cast("string").alias("tenant"))


def articles(spark: SparkSession, folder: str, n_suppliers: int) -> DataFrame:
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("description"),
        (F.col("p_partkey") % TENANTS).cast("string").alias("tenant"), (F.col("p_partkey") % n_suppliers).alias("supplier_id"),
    )


def log(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("created"), (F.col("user_id") % TENANTS).cast("string").alias("tenant"), F.col("value").alias("cost"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("state"), F.col("props").alias("message"),
    )
