"""Reconciliation of delivery lines with invoice lines.

Lines: line_id, supplier, article (nullable texts), quantity (decimal) and an
`ordinal` that orders each list totally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import Scorer, edit_score, normalised
from ..functions.text import is_blank
from ..sources.tables import settle
from . import similar
from .running import places
from .scans import first_per


def _sides(deliveries: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for df, s in ((deliveries, "d"), (invoices, "i")))


def exact_matches(deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """Pairs of equal supplier and article (null equals null) and quantity, many to many.

    The columns of both sides, prefixed d_ and i_. Every line of a key meets
    every other, so lines without supplier and article make n * m pairs of
    equal quantity, as the definition wants; a join's skew handling splits them.
    """
    d, i = _sides(deliveries, invoices)
    same = F.col("d_supplier").eqNullSafe(F.col("i_supplier")) & F.col("d_article").eqNullSafe(F.col("i_article"))
    return d.join(i, same & (F.col("d_quantity") == F.col("i_quantity")), "inner")


def match_classes(deliveries: DataFrame, invoices: DataFrame) -> dict[str, DataFrame]:
    """J1 without its n * m pairs: what matches exactly, as classes and their members.

    classes: a row for each supplier, article (nulls are values) and quantity
    that both sides have: class_id, the three, deliveries, invoices and links,
    the number of pairs that it stands for. members: class_id, side (d or i)
    and line_id of every line of a class.
    """
    key = ["supplier", "article", "quantity"]
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in key]), {"ignoreNullFields": "false"}), 256)
    sides = [df.where("quantity is not null").select(digest.alias("class_id"), *key, F.lit(s).alias("side"), "line_id") for df, s in ((deliveries, "d"), (invoices, "i"))]
    lines = sides[0].unionByName(sides[1])
    counted = lines.groupBy("class_id").agg(*[F.first(c).alias(c) for c in key], F.count_if(F.col("side") == "d").alias("deliveries"), F.count_if(F.col("side") == "i").alias("invoices"))
    classes = counted.where("deliveries > 0 and invoices > 0").withColumn("links", F.col("deliveries").cast("decimal(38,0)") * F.col("invoices"))
    return {"classes": classes, "members": lines.join(classes.select("class_id"), "class_id", "left_semi").select("class_id", "side", "line_id")}


def expand(members: DataFrame) -> DataFrame:
    """(class_id, d_line_id, i_line_id): the pairs of classes, for those who want them (choose the classes first)."""
    d, i = (members.where(F.col("side") == s).select("class_id", F.col("line_id").alias(f"{s}_line_id")) for s in "di")
    return d.join(i, "class_id")


def paired_once(matches: DataFrame) -> DataFrame:
    """One-to-one pairing of many-to-many matches: the n-th delivery of a key with its n-th invoice line."""
    key = ["d_supplier", "d_article", "d_quantity"]
    ranks = [F.dense_rank().over(Window.partitionBy(*key).orderBy(c)) for c in ("d_ordinal", "i_ordinal")]
    return matches.withColumn("_d", ranks[0]).withColumn("_i", ranks[1]).where("_d = _i").drop("_d", "_i")


def unmatched(lines: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """Lines whose id (null equals null) is not matched, and of those of one id the first."""
    ids = matched_ids.select(F.col(matched_ids.columns[0]).alias("_id")).distinct()
    rest = lines.join(ids, lines["line_id"].eqNullSafe(ids["_id"]), "left_anti")
    return first_per(rest, ["line_id"], [F.col("ordinal")])


def resolve_pairs(found: DataFrame, deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """Of (delivery_id, invoice_id) both first lines of those ids; a pair without either goes."""
    d, i = _sides(*(first_per(df, ["line_id"], [F.col("ordinal")]) for df in (deliveries, invoices)))
    return found.join(d, found["delivery_id"] == d["d_line_id"]).join(i, found["invoice_id"] == i["i_line_id"])


def similar_matches(deliveries: DataFrame, invoices: DataFrame, least: int = 90, scorer: Scorer = edit_score) -> DataFrame:
    """J8, natively: lines of one supplier and quantity whose articles score `least` or more; each delivery's best.

    Distinct articles of (supplier, quantity) meet where they are, those of very
    large groups through the index of q-grams (similar.near_pairs); another scorer than the edit score compares all whose lengths allow the
    score. (delivery_id, invoice_id, confidence).
    """
    d = deliveries.withColumn("_n", normalised(F.col("article")))
    i = invoices.withColumn("_n", normalised(F.col("article")))
    if scorer is edit_score:
        names = [df.select("supplier", "quantity", F.col("_n").alias("s")) for df in (d, i)]
        pairs = similar.near_pairs(*names, ["supplier", "quantity"], least).withColumnsRenamed({"a": "dn", "b": "inn"})
    else:
        left = d.select("supplier", "quantity", F.col("_n").alias("dn")).distinct()
        right = i.select("supplier", "quantity", F.col("_n").alias("inn")).distinct()
        pairs = left.join(right, ["supplier", "quantity"])
        short, long = F.least(F.length("dn"), F.length("inn")), F.greatest(F.length("dn"), F.length("inn"))
        pairs = pairs.where(short * 100 >= long * least).withColumn("score", scorer(F.col("dn"), F.col("inn"))).where(F.col("score") >= least)
    best = pairs.groupBy("supplier", "quantity", "dn").agg(F.max(F.struct("score", F.col("inn"))).alias("b"))
    best = best.select("supplier", "quantity", F.col("dn").alias("_n"), F.col("b.score").alias("score"), F.col("b.inn").alias("inn"))
    firsts = i.groupBy("supplier", "quantity", F.col("_n").alias("inn")).agg(F.min(F.struct("ordinal", "line_id"))["line_id"].alias("invoice_id"))
    out = d.join(best, ["supplier", "quantity", "_n"]).join(firsts, ["supplier", "quantity", "inn"])
    return out.select(F.col("line_id").alias("delivery_id"), "invoice_id", (F.col("score") / 100).alias("confidence"))


def reconcile(deliveries: DataFrame, invoices: DataFrame, least: int = 90) -> dict[str, DataFrame]:
    """Exact matches, then similar ones among what is left.

    matches has match_type and the ids; the similar step finds nothing where
    either remainder is empty.
    """
    exact = settle(exact_matches(deliveries, invoices).select("d_line_id", "i_line_id"), "exact")
    rest_d = settle(unmatched(deliveries, exact.select("d_line_id")), "rest")
    rest_i = settle(unmatched(invoices, exact.select("i_line_id")), "rest")
    # the remainders have a line of each id, so ids say which lines are meant; a null id says nothing
    near = similar_matches(rest_d, rest_i, least).where("delivery_id is not null and invoice_id is not null")
    near = settle(near.select(F.col("delivery_id").alias("d_line_id"), F.col("invoice_id").alias("i_line_id")), "near")
    ids = lambda df, kind: df.select("d_line_id", "i_line_id", F.lit(kind).alias("match_type"))
    return {
        "matches": ids(exact, "exact").unionByName(ids(near, "similar")),
        "unmatched_deliveries": rest_d.join(near.select(F.col("d_line_id").alias("line_id")), "line_id", "left_anti"),
        "unmatched_invoices": rest_i.join(near.select(F.col("i_line_id").alias("line_id")), "line_id", "left_anti"),
    }


def totals(invoices: DataFrame, matches: DataFrame) -> DataFrame:
    """A4: for each invoice line id its quantity, what matched deliveries carry, the difference and the state.

    The difference is invoiced less delivered; matched if 0, partial if any
    delivery is linked, else unmatched. These meanings are our own.
    """
    first = first_per(invoices, ["line_id"], [F.col("ordinal")])
    linked = matches.groupBy("i_line_id").agg(F.sum("d_quantity").alias("delivered"))
    joined = first.join(linked, first["line_id"] == linked["i_line_id"], "left")
    delivered = F.coalesce("delivered", F.lit(0)).cast("decimal(28,10)")
    gap = (F.col("quantity") - delivered).cast("decimal(28,10)")
    state = F.when(F.col("delivered").isNull(), "unmatched").when(gap == 0, "matched").otherwise("partial")
    return joined.select("line_id", "supplier", "article", "quantity", delivered.alias("delivered"), gap.alias("difference"), state.alias("state"))


def work_list(deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """The suppliers of either side, without null and empty names."""
    return deliveries.select("supplier").union(invoices.select("supplier")).where(~is_blank(F.col("supplier"))).distinct()


def supplier_batches(deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """A2, PJ2: for each supplier both its lists, in order; null ids and articles become ''.

    One exchange by supplier for both sides; a supplier's rows are sorted once,
    as they are, and only a number goes into the lists to keep their order. A
    supplier's lists are one row by definition; where that is too much,
    `supplier_pages` gives the same in bounded rows.
    """
    both = None
    for df, side in ((deliveries, 0), (invoices, 1)):
        rows = df.where(~is_blank(F.col("supplier"))).select("supplier", F.lit(side).alias("side"), "ordinal", F.coalesce("line_id", F.lit("")).alias("id"), F.coalesce("article", F.lit("")).alias("article"), "quantity")
        both = rows if both is None else both.unionByName(rows)
    numbered = both.withColumn("n", F.row_number().over(Window.partitionBy("supplier").orderBy("side", "ordinal")))
    item = F.struct("n", "id", "article", "quantity")
    of = lambda side: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, item))), lambda x: x.dropFields("n"))
    return numbered.groupBy("supplier").agg(of(0).alias("deliveries"), of(1).alias("invoices"))


#: Lines of a page.
PAGE = 1000


def supplier_pages(deliveries: DataFrame, invoices: DataFrame, page: int = PAGE) -> DataFrame:
    """A2 for suppliers of any size: (supplier, side, page, lines), each side's lines in order, `page` of them a row.

    Lines are (id, article, quantity); null ids and articles become ''. Pages
    are numbered from 0. A supplier's lines are numbered over all tasks, and
    only a page's lines come together.
    """
    both = None
    for df, side in ((deliveries, "delivery"), (invoices, "invoice")):
        rows = df.where(~is_blank(F.col("supplier"))).select("supplier", F.lit(side).alias("side"), "ordinal", F.struct(F.coalesce("line_id", F.lit("")).alias("id"), F.coalesce("article", F.lit("")).alias("article"), "quantity").alias("line"))
        both = rows if both is None else both.unionByName(rows)
    placed = places(both, ["supplier", "side"], ["ordinal"])
    paged = placed.withColumn("page", F.floor(F.col("place") / page).cast("long"))
    items = F.sort_array(F.collect_list(F.struct("place", "line")))
    return paged.groupBy("supplier", "side", "page").agg(F.transform(items, lambda x: x["line"]).alias("lines"))


def flag_matched(lines: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """Each line with `matched`; null ids count as equal."""
    ids = matched_ids.select(F.col(matched_ids.columns[0]).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    joined = lines.join(ids, lines["line_id"].eqNullSafe(ids["_id"]), "left")
    return joined.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_id", "_hit")
