"""Mixing of sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson number says whose mean is its
source's repetition rate. The number is the inverse of the distribution at a
point that a seeded hash of the document's id gives, so a run can be repeated
row by row on any cluster. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from .common import settle

#: Of the counts, when no weights are given: a source's weight is its size to this power.
TEMPERATURE = 0.5
SEED = "mix-1"
#: Above this rate a document's number is the sum of independent ones of smaller equal rates, so a table has some 200 entries at most.
PART_RATE = 64
#: Sources up to which their rates are sent to every executor, so that texts need not meet by source.
FEW_SOURCES = 10_000
#: Places where a source's rows meet its rate beyond that.
SALTS = 32


def unit_hash(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits of the MD5 of the seed and the parts."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source: str = "source") -> tuple[DataFrame, bool]:
    """A row for each source: n, weight, rate, `parts` that the rate is cut into, and `cdf`, the distribution function of a part from 0 on; and whether they are few enough to be sent whole (2 kB each).

    The rate is weight / sum(weights) * total / n. `total`: rows wanted, as many
    as there are if None. `weights`: by source; a source that it does not name
    gets 0. Without it, n ** TEMPERATURE. Weights and totals that are negative,
    infinite or no numbers are a ValueError.
    """
    if any(not 0 <= float(v) < float("inf") for v in [*(weights or {}).values(), *([] if total is None else [total])]):
        raise ValueError("weights and total are finite numbers of 0 or more")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = settle(sizes.withColumn("weight", weight), "source-sizes")
    whole = sizes.agg(F.sum("n"), F.sum("weight"), F.count(F.lit(1))).first()  # three numbers
    all_n, all_w = whole[0] or 0, whole[1] or 0.0
    wanted = float(all_n if total is None else total)
    rate = F.col("weight") / F.lit(all_w) * F.lit(wanted) / F.col("n") if all_w > 0 else F.lit(0.0)
    parts = F.greatest(F.lit(1), F.ceil(rate / PART_RATE)).cast("long")
    out = sizes.withColumn("rate", rate).withColumn("parts", parts)
    # a row for each count that has a chance to speak of; sums run along the counts, by logarithms
    steps = (F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    along = Window.partitionBy("source").orderBy("k")
    counts = out.select("source", (F.col("rate") / F.col("parts")).alias("rate")).select("source", "rate", F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    factor = F.when(F.col("k") == 0, 0.0).otherwise(F.ln("rate") - F.ln(F.greatest("k", F.lit(1))))
    counts = counts.withColumn("p", F.exp(F.sum(factor).over(along) - F.col("rate"))).withColumn("c", F.sum("p").over(along))
    cdfs = counts.where("rate > 0").groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    out = out.join(cdfs.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    out = out.withColumn("cdf", F.coalesce("cdf", F.array(F.lit(1.0))))
    sent = whole[2] <= FEW_SOURCES
    return (F.broadcast(out) if sent else out), sent


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: str = SEED,
    doc_id: str = "doc_id",
    source: str = "source",
    extra: bool = True,
) -> DataFrame:
    """Repeat each row by its Poisson count and shuffle all of them.

    Returns the columns of `docs` and, with `extra`, copy_no (from 1) and
    shuffle_key, by which the rows are ordered over the whole result; rows that
    repeat an id follow each other by a hash of their plain columns. A null
    source is a source of its own; a null id counts as the empty text; repeated
    rows get the same count; texts may be of any length; an empty table gives
    no rows. `docs` must not have columns copy_no or shuffle_key with `extra`,
    nor any that begins with _mix_ (ValueError).
    """
    taken = {c for c in docs.columns if c.startswith("_mix_") or (extra and c in ("copy_no", "shuffle_key"))}
    if taken:
        raise ValueError(f"columns are taken: {sorted(taken)}")
    table, sent = rates(docs, weights, total, source)
    table = table.select(F.col("source").alias("_mix_source"), F.col("cdf").alias("_mix_cdf"), F.col("parts").alias("_mix_parts"))
    point = unit_hash(seed, F.col(doc_id))
    # where rates are not sent whole, a source's rows meet them in SALTS places
    salted = table.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int")
    few = docs.join(table, F.col(source).eqNullSafe(F.col("_mix_source")), "inner")
    many = docs.withColumn("_mix_salted", salt).join(salted, F.col(source).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_salted") == F.col("_mix_salt")), "inner")
    joined = few if sent else many
    below = lambda u: F.size(F.filter("_mix_cdf", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_mix_parts") - 1), F.lit(0), lambda n, j: n + below(unit_hash(seed + "-part", F.col(doc_id), j)))
    count = below(point) + F.when(F.col("_mix_parts") > 1, more).otherwise(0)
    repeated = joined.withColumn("_mix_n", count).where("_mix_n > 0")
    repeated = repeated.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
    key = F.concat_ws(":", F.lit(seed + "-order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("_mix_copy").cast("string"))
    repeated = repeated.withColumn("_mix_key", F.md5(key.cast("binary")))
    plain = [F.col(f.name) for f in docs.schema if isinstance(f.dataType, AtomicType)]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal ranges of a hash's first digits hold equally many rows, so no sampling pass over the texts is needed
    part = F.floor(F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("double") * n / float(2**32)).cast("int")
    out = repeated.withColumn("_mix_part", part).repartitionById(n, F.col("_mix_part")).sortWithinPartitions("_mix_key", "_mix_copy", F.xxhash64(*plain))
    return out.select(*[F.col(c) for c in docs.columns], *([F.col("_mix_copy").alias("copy_no"), F.col("_mix_key").alias("shuffle_key")] if extra else []))


ORACLE = f"""
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM documents GROUP BY source),
whole AS (SELECT sum(n)::DOUBLE AS all_n, sum(weight) AS all_w FROM sizes),
rates AS (SELECT source, weight / all_w * all_n / n AS rate FROM sizes, whole),
terms AS (
  SELECT source, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p
  FROM rates, (SELECT unnest(range(0, 400)) AS k) WHERE k <= CAST(floor(rate + 12 * sqrt(rate) + 30) AS INT)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
points AS (
  SELECT doc_id, source, text, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
),
counts AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS copies FROM points d
),
copies AS (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy_no FROM counts)
SELECT doc_id, source, CAST(copy_no AS INT) AS copy_no, md5('{SEED}-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no::VARCHAR) AS shuffle_key, text FROM copies
"""
