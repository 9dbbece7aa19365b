"""Which delivery fills which invoice line: links within capacities, and quantities first in, first out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import normalised
from ..sources.tables import discard, settle
from . import similar
from .running import crowded, in_task, running
from .scans import first_per

AMOUNT = "decimal(38,10)"


def similar_edges(deliveries: DataFrame, invoices: DataFrame, least: int = 90) -> DataFrame:
    """(delivery, invoice, score) of lines of one supplier whose articles score `least` or more and where the delivery's quantity fits.

    A supplier's articles meet where they are, those of very large suppliers
    through the index of q-grams (similar.near_pairs).
    """
    sides = [first_per(df, ["line_id"], [F.col("ordinal")]).withColumn("s", normalised(F.col("article"))).where("line_id is not null and supplier is not null and s is not null") for df in (deliveries, invoices)]
    sides = [settle(df.select("supplier", "s", "line_id", "quantity"), "lines") for df in sides]
    pairs = similar.near_pairs(*[df.select("supplier", "s") for df in sides], ["supplier"], least)
    left = sides[0].select("supplier", F.col("s").alias("a"), F.col("line_id").alias("delivery"), F.col("quantity").alias("need"))
    right = sides[1].select("supplier", F.col("s").alias("b"), F.col("line_id").alias("invoice"), F.col("quantity").alias("room"))
    return left.join(pairs, ["supplier", "a"]).join(right, ["supplier", "b"]).where("need <= room").select("delivery", "invoice", "score")


def capacity_links(edges: DataFrame, deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """Of scored edges those that a greedy choice takes: (delivery, invoice, score).

    edges: delivery, invoice, score; deliveries, invoices: id, quantity, one
    row for each id. Edges are taken from the best to the worst (score, then
    the lesser delivery, then the lesser invoice), if the delivery has no link
    yet and its quantity fits in what is left of the invoice line's. Edges
    without an end, or with a null or negative quantity, are never taken.

    An edge that is the best left of its delivery is decided together with all
    better edges of its invoice that are so too: quantities add up until one
    doesn't fit. What a line can't hold any more goes at once. So a round
    decides many edges of a line, and every round decides the best edge left.
    """
    sides = [df.where("id is not null and quantity >= 0").select(F.col("id").alias(n), F.col("quantity").cast(AMOUNT).alias(q)) for df, n, q in ((deliveries, "delivery", "need"), (invoices, "invoice", "room"))]
    left = edges.select("delivery", "invoice", "score").where("score is not null").groupBy("delivery", "invoice").agg(F.max("score").alias("score")).join(sides[0], "delivery").join(sides[1], "invoice")
    left = settle(left.where("need <= room"), "edges")
    taken = []
    order = [F.desc("score"), F.col("delivery"), F.col("invoice")]
    while not left.isEmpty():
        ranked = left.withColumn("_top", F.row_number().over(Window.partitionBy("delivery").orderBy(*order)) == 1)
        sofar = Window.partitionBy("invoice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ready = ranked.withColumn("_ready", F.min("_top").over(sofar)).withColumn("_sum", F.sum("need").over(sofar))
        links = settle(ready.where("_ready and _sum <= room").select("delivery", "invoice", "score", "need"), "links")
        taken.append(links)
        used = links.groupBy("invoice").agg(F.sum("need").alias("_used"))
        # of a line without a link the first edge waits for a better line of its delivery, or the line is full
        rest = left.join(links.select("delivery"), "delivery", "left_anti").join(used, "invoice", "left")
        rest = rest.withColumn("room", (F.col("room") - F.coalesce("_used", F.lit(0))).cast(AMOUNT)).where("need <= room")
        before, left = left, settle(rest.select(*left.columns), "edges")
        discard(before)
    discard(left)
    out = edges.limit(0).select("delivery", "invoice", "score")
    for links in taken:
        out = out.unionByName(links.select("delivery", "invoice", "score"))
    return out


def allocate(deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """A4: deliveries fill the invoice lines of their supplier and article (null equals null), first in, first out.

    Lines: line_id, supplier, article, quantity, ordinal. A row for each
    delivery and invoice line that meet, with the quantity that both share,
    and for what is left open on either side, with the other side null:
    (supplier, article, delivery_id, invoice_id, quantity). Lines without a
    positive quantity take no part.

    Both sides are laid end to end within a key; every place where a line
    begins or ends starts a stretch that belongs to one line of each side at
    most. So a key of n and m lines makes n + m stretches, never n * m pairs.
    A key's lines move to one task, once; only keys that may have too many for
    one are spread over tasks by range.
    """
    key = ["supplier", "article"]
    sides = [df.where("quantity > 0").select(*key, F.lit(side).alias("side"), "line_id", F.col("quantity").cast(AMOUNT).alias("quantity"), "ordinal") for df, side in ((deliveries, "d"), (invoices, "i"))]
    most, spread = crowded(sides[0].unionByName(sides[1]), key)
    out = _stretches(most.repartition(*key), key, in_task)
    return out if spread is None else out.unionByName(_stretches(spread, key, running))


def _stretches(lines: DataFrame, key: list[str], run: Callable) -> DataFrame:
    """Of lines of both sides (side 'd' or 'i') what `allocate` gives; run: what makes running values within keys."""
    laid = run(lines, [*key, "side"], ["ordinal"], {"begin": F.col("quantity")})
    laid = laid.select(*key, "side", F.col("begin").cast(AMOUNT).alias("begin"), (F.col("begin") + F.col("quantity")).cast(AMOUNT).alias("end"), F.col("line_id").alias("id"))
    line = F.struct("begin", "end", "id")
    # a row for each place: with the line that begins there, or none where one ends
    places = F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(True).alias("begins")), F.struct(F.col("end").alias("at"), F.lit(False).alias("begins"))))
    events = laid.select(*key, "side", line.alias("line"), places.alias("p"))
    events = events.select(*key, F.col("p.at").alias("at"), *[F.when(F.col("p.begins") & (F.col("side") == s), F.col("line")).alias(s) for s in "di"])
    events = events.groupBy(*key, "at").agg(F.max("d").alias("d"), F.max("i").alias("i"))
    now = run(events, key, ["at"], lasts={"delivery": F.col("d"), "invoice": F.col("i")})
    open_ = lambda c: F.when(F.col(f"{c}.end") > F.col("at"), F.col(c))
    now = now.select(*key, "at", open_("delivery").alias("d"), open_("invoice").alias("i")).where("d is not null or i is not null")
    share = (F.least("d.end", "i.end") - F.col("at")).cast("decimal(28,10)")
    return now.select(*key, F.col("d.id").alias("delivery_id"), F.col("i.id").alias("invoice_id"), share.alias("quantity"))
