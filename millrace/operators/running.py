"""Running totals within keys of any size: a key's rows are spread over tasks by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settle


#: Groups that a hash of the keys makes, and rows of one beyond which its keys are spread over tasks.
GROUPS, GROUP_ROWS = 1 << 16, 1_000_000


def crowded(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """df without the keys that may have too many rows for a task, and the rows of those, None if there are none.

    Rows are counted by a hash of their keys, GROUPS numbers in all, so that
    no row need move for it; groups of more than GROUP_ROWS rows are few.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS))
    counted = df.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    full = [r["g"] for r in counted.where(F.col("n") > GROUP_ROWS).select("g").collect()]
    return (df.where(~group.isin(full)), df.where(group.isin(full))) if full else (df, None)


def in_task(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """What `running` gives, of keys whose rows all fit a task: plain windows, for which a key's rows move once at most."""
    here = Window.partitionBy(*keys).orderBy(*order)
    earlier, sofar = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    found = {name: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for name, c in (sums or {}).items()} | {name: F.max(c).over(sofar) for name, c in (lasts or {}).items()}
    return df.select(*df.columns, *[c.alias(name) for name, c in found.items()])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with running values of each key (nulls are equal) in a total order.

    sums: a column for the sum of an expression over the key's earlier rows
    (0 for its first). lasts: a column for the largest value of an expression
    up to and with the row, nulls left out; of values that grow in the order it
    is the last one.

    Rows are dealt by range of key and order and settled, so a row's place is
    data. Each range adds up for itself; of a key only one row for each range
    that it touches meets the others, so no task holds a whole key.
    """
    sums, lasts = sums or {}, lasts or {}
    m = F.monotonically_increasing_id()
    inputs = {**{f"_s{k}": c for k, c in enumerate(sums.values())}, **{f"_l{k}": c for k, c in enumerate(lasts.values())}}
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", m)
    spread = settle(spread.withColumns(inputs).withColumn("_part", F.shiftright("_m", 33)), "ranges")
    here = Window.partitionBy("_part", *keys).orderBy("_m")
    earlier, sofar = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    own = {**{f"_s{k}": F.coalesce(F.sum(f"_s{k}").over(earlier), F.lit(0)) for k in range(len(sums))}, **{f"_l{k}": F.max(f"_l{k}").over(sofar) for k in range(len(lasts))}}
    # a row for each key and range that it touches
    part = spread.groupBy("_part", *keys).agg(*[F.sum(f"_s{k}").alias(f"_t{k}") for k in range(len(sums))], *[F.max(f"_l{k}").alias(f"_u{k}") for k in range(len(lasts))])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{j}") for j, c in enumerate(keys)], *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_t{k}") for k in range(len(sums))],
        *[F.max(f"_u{k}").over(before).alias(f"_u{k}") for k in range(len(lasts))],
    )
    same = F.col("_part") == F.col("_p")
    for j, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{j}"))
    out = spread.withColumns(own).join(base, same)
    found = {name: F.col(f"_s{k}") + F.col(f"_t{k}") for k, name in enumerate(sums)} | {name: F.greatest(f"_l{k}", f"_u{k}") for k, name in enumerate(lasts)}
    return out.select(*df.columns, *[c.alias(name) for name, c in found.items()])


def places(df: DataFrame, keys: list[str], order: list[str], column: str = "place") -> DataFrame:
    """df with each row's place (from 0) in its key."""
    return running(df, keys, order, {column: F.lit(1).cast("long")})
