"""CH1: what differs between two versions of a table, found through digests of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of ids whose digests are compared first.
BUCKETS = 4096


def _bucket(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, a, b): how many rows a bucket of ids has, and two sums of 64-bit hashes of them, in any order of rows and columns."""
    whole = F.struct(*[F.col(c) for c in sorted(df.columns)])
    text = F.to_json(whole, {"ignoreNullFields": "false"})
    rows = df.select(_bucket(buckets).alias("bucket"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), wide("a").alias("a"), wide("b").alias("b"))


def unequal_buckets(old: DataFrame, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The buckets whose digests differ, `buckets` rows at most."""
    a, b = digests(old, buckets), digests(new, buckets)
    joined = a.select("bucket", F.struct("n", "a", "b").alias("x")).join(b.select("bucket", F.struct("n", "a", "b").alias("y")), "bucket", "full")
    return joined.where("not (x <=> y)").select("bucket")


def feed(old: DataFrame, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(op, id, before, after): insert, update or delete for each id whose row differs; ids are unique and not null.

    Only rows of buckets with unequal digests are joined. before and after are
    structs of the columns, null on the side that has no row.
    """
    columns = [c for c in new.columns if c != "id"]
    differ = F.broadcast(unequal_buckets(old, new, buckets))  # BUCKETS numbers at most
    sides = [df.withColumn("bucket", _bucket(buckets)).join(differ, "bucket", "left_semi").select("id", F.struct(*columns).alias(name)) for df, name in ((old, "before"), (new, "after"))]
    joined = sides[0].join(sides[1], "id", "full").where("not (before <=> after)")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return joined.select(op.alias("op"), "id", "before", "after")
