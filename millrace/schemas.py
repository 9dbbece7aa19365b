"""Schemas of the domain tables, code lists and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(28, 10)
_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(),
    "timestamp_ntz": T.TimestampNTZType(), "amount": AMOUNT,
}


def _struct(text: str) -> T.StructType:
    """A schema of "name type, ..."; a type that ends in ! is not null."""
    pairs = [x.split() for x in text.split(", ")]
    return T.StructType([T.StructField(n, _TYPES[t.rstrip("!")], not t.endswith("!")) for n, t in pairs])


LINE = _struct(
    "line_id string, master_id string, code string, description string, quantity amount, unit string, "
    "taxable amount, vat string, total amount"
)
DOCUMENT = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "type", "number", "date", "sender")],
        T.StructField("lines", T.ArrayType(LINE)),
        T.StructField("taxable", T.DoubleType()),
        T.StructField("discount", T.StringType()),
        T.StructField("vat", T.StringType()),
        T.StructField("total", T.DoubleType()),
    ]
)
COSTS = _struct("id string, prompt_tokens int, output_tokens int, total_tokens int, total_cost double")
CONTENT = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("costs", COSTS),
        T.StructField("document", DOCUMENT),
    ]
)

#: Table name -> (schema, unique keys). A key holds for rows where it is not null.
TABLES: dict[str, tuple[T.StructType, list[list[str]]]] = {
    "docs": (
        T.StructType(
            [
                T.StructField("id", T.LongType(), False),
                T.StructField("file_name", T.StringType()),
                T.StructField("created", T.TimestampNTZType()),
                T.StructField("content", CONTENT),
                T.StructField("attachment", T.BinaryType()),
                T.StructField("tenant", T.StringType()),
                T.StructField("state", T.IntegerType()),
            ]
        ),
        [["id"]],
    ),
    "suppliers": (_struct("id long!, description string, reference string, tenant string, score int, created timestamp_ntz"), [["id"]]),
    "articles": (
        _struct(
            "id long!, code string, description string, created timestamp_ntz, ref_code string, ref_description string, "
            "code_score int, description_score int, tenant string, supplier_id long"
        ),
        [["id"]],
    ),
    "reconciled_lines": (
        _struct(
            "id long!, master_id string, line_id string, tenant string, created timestamp_ntz, code string, state string, note string, "
            "supplier_id string, doc_type int, quantity amount, reconciled amount, delta amount, flag int, side string"
        ),
        [["id"], ["tenant", "line_id"]],
    ),
    "log": (
        _struct(
            "id long!, created timestamp_ntz, tenant string, tokens_in int, tokens_out int, tokens int, cost double, state int, message string, duration long"
        ),
        [["id"]],
    ),
    "tenants": (_struct("id long!, code string, description string, created timestamp_ntz, mail_from string"), [["id"], ["mail_from"]]),
    "users": (_struct("id long!, email string, created timestamp_ntz, tenant string"), [["id"], ["email"]]),
}

#: What decides a row's bucket, the tenant first where there is one: nothing that a change alters.
BUCKET_KEYS: dict[str, list[str]] = {
    "docs": ["tenant", "content.document.sender", "content.document.number"], "suppliers": ["tenant", "id"], "articles": ["tenant", "id"], "reconciled_lines": ["tenant", "line_id"],
    "log": ["tenant", "id"], "tenants": ["id"], "users": ["id"],
}
#: Columns that lookups ask for and buckets don't tell apart: Parquet keeps a Bloom filter of them.
BLOOM_COLUMNS: dict[str, tuple[str, ...]] = {"docs": ("content.document.id",), "users": ("email",), "tenants": ("mail_from",), "articles": ("code",)}

#: Codes of documents, their states and logged outcomes.
DOC_TYPES = {0: "All", 1: "Order", 2: "Delivery note", 3: "Accompanying invoice", 4: "Invoice", 5: "Credit note"}
DOC_STATES = {0: "Open", 1: "Closed"}
LOG_STATES = {1: "success", -1: "provider error", -2: "server error"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name][0])


def create_tables(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Create the tables that the catalog lacks; existing ones are left alone. Returns the names created."""
    made = []
    for name in names or list(TABLES):
        if not spark.catalog.tableExists(name):
            empty(spark, name).write.saveAsTable(name)
            made.append(name)
    return made


def violations(df: DataFrame, name: str) -> DataFrame:
    """(key, value, n) of a table's unique keys that more than one row has."""
    out = None
    for key in TABLES[name][1]:
        solid = df
        for c in key:
            solid = solid.where(F.col(c).isNotNull())
        one = solid.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        one = one.select(F.lit(",".join(key)).alias("key"), F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("value"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: Values that are asked for one by one, so that files and Bloom filters can rule them out; more are joined.
FEW_VALUES = 1000


def refused(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """P11, M18 on write: (key, value, id) of the rows to write whose unique key another row has, of these or of the table.

    Rows replace those of their id. Of the table only the key columns are
    read, and where few values are written only the files that may have them.
    """
    out = rows.sparkSession.createDataFrame([], "key string, value string, id long")
    for key in TABLES[name][1]:
        if key == ["id"]:
            continue
        solid = " and ".join(f"{c} is not null" for c in key)
        new = rows.where(solid).select("id", *key)
        old = table.where(solid).select(F.col("id").alias("_id"), *key)
        values = [r[0] for r in new.select(key[0]).distinct().limit(FEW_VALUES + 1).collect()]
        if len(values) <= FEW_VALUES:
            old = old.where(F.col(key[0]).isin(values))
        # what is written anew is not what stands against it
        old = old.join(rows.select(F.col("id").alias("_id")), "_id", "left_anti")
        both = new.unionByName(old.select(F.col("_id").alias("id"), *key))
        again = both.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        one = new.join(again, key, "left_semi").select(F.lit(",".join(key)).alias("key"), F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("value"), F.col("id").cast("long").alias("id"))
        out = out.unionByName(one)
    return out
