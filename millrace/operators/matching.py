"""Master data matching: exact first, then the best similar name within a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import LOW, Scorer, band, edit_score, normalised
from ..functions.text import is_blank
from ..sources.tables import settle
from .scans import first_per
from .similar import best_names


def resolve_supplier(names: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(tenant, name) with the id of the tenant's first supplier of that name, whatever its case; null if none."""
    keyed = suppliers.select("tenant", F.lower("description").alias("_k"), F.col("id").alias("supplier_id"))
    first = keyed.groupBy("tenant", "_k").agg(F.min("supplier_id").alias("supplier_id"))
    return names.withColumn("_k", F.lower("name")).join(first, ["tenant", "_k"], "left").drop("_k")


def find_articles(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Document lines (tenant, supplier_id, code) with the id of the supplier's first article of that code; null if none."""
    first = articles.groupBy("tenant", "supplier_id", "code").agg(F.min("id").alias("article_id"))
    return lines.join(first, ["tenant", "supplier_id", "code"], "left")


#: Choices of a block up to which each of its names simply meets all of them: an exchange by grams would cost more.
FEW_CHOICES = 4096


def best_match(queries: DataFrame, choices: DataFrame, block: list[str], scorer: Scorer = edit_score, least: int | None = None) -> DataFrame:
    """For each (block, name) of queries the choice (id, name) of the largest score in its block.

    Distinct normalised names are compared, so a name that many rows share
    costs one comparison. Ties go to the least id. Without `least` the best is
    of the whole block, however low; with it a name without such a choice
    scores 0. No choice, or a blank name: id null, score 0, band new.

    The edit score's best is found by similar.best_names: in blocks of up to
    FEW_CHOICES choices among all of them, in larger ones by an index of
    q-grams. Another scorer gives no bound to search by and meets the whole
    block.
    """
    asked = queries.select(*block, "name").distinct().withColumn("_q", normalised(F.col("name")))
    forms = asked.where(~is_blank(F.col("name"))).select(*block, "_q").distinct()
    known = choices.select(*block, "id", normalised(F.col("name")).alias("_c")).groupBy(*block, "_c").agg(F.min("id").alias("id"))
    if scorer is edit_score:
        known, forms = settle(known, "choices"), settle(forms, "forms")
        firsts = known.groupBy(*block).agg(F.min("id").alias("_first"))
        some, entries = forms.withColumnRenamed("_q", "s").join(firsts, block, "left_semi"), known.withColumnRenamed("_c", "s")
        best = best_names(some, entries, block, max(1, least or 1), FEW_CHOICES).withColumnRenamed("a", "_q")
        if not least:
            # what scores with no name has the block's first
            rest = forms.join(best, [*block, "_q"], "left_anti").join(firsts, block)
            best = best.unionByName(rest.select(*block, "_q", F.col("_first").alias("id"), F.lit(0).alias("score")))
    else:
        met = forms.join(known, block)
        if least is not None:
            short, long = F.least(F.length("_q"), F.length("_c")), F.greatest(F.length("_q"), F.length("_c"))
            met = met.where(short * 100 >= long * least)
        scored = met.withColumn("score", F.when(F.col("_q") == F.col("_c"), F.when(F.col("_q") == "", 0).otherwise(100)).otherwise(scorer(F.col("_q"), F.col("_c"))))
        if least is not None:
            scored = scored.where(F.col("score") >= least)
        best = scored.groupBy(*block, "_q").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("b"))
        best = best.select(*block, "_q", (-F.col("b.neg")).alias("id"), F.col("b.score").alias("score"))
    out = asked.join(best, [*block, "_q"], "left")
    score = F.coalesce("score", F.lit(0)).cast("int")
    return out.select(*block, "name", "id", score.alias("score"), band(score).alias("band"))


def supplier_entries(names: DataFrame, suppliers: DataFrame, suppress_first: bool = False) -> DataFrame:
    """Master data of (tenant, name): known suppliers keep their id, others get an entry to add.

    A score of 100 adds nothing, 90 to 99 adds an entry that refers to the
    match, less adds one of its own. A tenant without suppliers gets an entry
    with score 0, none if `suppress_first`. Columns: tenant, name,
    supplier_id, reference, score, action (known, refer, new).
    """
    exact = resolve_supplier(names.distinct().where(~is_blank(F.col("name"))), suppliers)
    open_ = exact.where("supplier_id is null").drop("supplier_id")
    choices = suppliers.select("tenant", "id", F.col("description").alias("name"))
    best = best_match(open_, choices, ["tenant"])
    texts = suppliers.select("tenant", F.col("id"), F.col("description").alias("reference"))
    found = best.join(texts, ["tenant", "id"], "left")
    if suppress_first:
        found = found.where("id is not null")
    known = exact.where("supplier_id is not null").select("tenant", "name", "supplier_id", F.lit(None).cast("string").alias("reference"), F.lit(100).alias("score"), F.lit("known").alias("action"))
    action = F.when(F.col("score") >= 100, "known").when(F.col("band") == LOW, "new").otherwise("refer")
    added = found.select("tenant", "name", F.when(F.col("score") >= 100, F.col("id")).alias("supplier_id"), F.when(F.col("band") != LOW, F.col("reference")).alias("reference"), "score", action.alias("action"))
    return known.unionByName(added)


def article_entries(lines: DataFrame, articles: DataFrame, with_known: bool = False) -> DataFrame:
    """Articles of document lines (tenant, supplier_id, code, description) that are unknown, with their best matches.

    Lines without a supplier are skipped. For each distinct line: code_score
    and description_score of the supplier's nearest article by code and by
    description, the texts they refer to where 90 or more, and the action.
    Lines whose code the supplier has need no entry and are left out;
    `with_known` gives them too, with action known.
    """
    missing = lines.where("supplier_id is not null and supplier_id != 0").distinct()
    if not with_known:
        missing = find_articles(missing, articles).where("article_id is null").drop("article_id")
    block = ["tenant", "supplier_id"]
    out = missing
    for c in ("code", "description"):
        choices = articles.select(*block, "id", F.col(c).alias("name"))
        best = best_match(missing.select(*block, F.col(c).alias("name")), choices, block)
        texts = articles.select(*block, "id", F.col(c).alias("_text"))
        best = best.join(texts, [*block, "id"], "left").select(
            *[F.col(k).alias(f"_{k}") for k in block], F.col("name").alias("_name"), F.when(F.col("band") != LOW, F.col("_text")).alias(f"ref_{c}"), F.col("score").alias(f"{c}_score")
        )
        keys = F.col(c).eqNullSafe(F.col("_name"))
        for k in block:
            keys = keys & (F.col(k) == F.col(f"_{k}"))
        out = out.join(best, keys, "left").drop("_name", *[f"_{k}" for k in block])
    top = F.greatest("code_score", "description_score")
    return out.withColumn("action", F.when(F.col("code_score") >= 100, "known").when(top >= 90, "refer").otherwise("new"))


def route_mail(messages: DataFrame, tenants: DataFrame) -> DataFrame:
    """J7, ST3: messages (sender) with the first tenant of that address, whatever its case; null goes to quarantine.

    Tenants are few but not bounded here: Spark broadcasts them by measured size.
    """
    keyed = first_per(tenants.where("mail_from is not null").withColumn("_k", F.lower("mail_from")), ["_k"], [F.col("id")])
    side = keyed.select("_k", F.col("code").alias("tenant"))
    return messages.withColumn("_k", F.lower("sender")).join(side, "_k", "left").drop("_k")


def score_of(a: Column, b: Column) -> Column:
    """The edit score of two names as they are."""
    return edit_score(normalised(a), normalised(b))
