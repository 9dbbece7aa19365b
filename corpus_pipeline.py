"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all the rows that the
stage before it kept; all but the last return the columns of documents, and
leave other columns of docs aside. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, jaccard, linededup, mixing, toxicity
from millrace.llm.common import discard, settle, small, table
from millrace.llm.queries import bpe_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores as toxic go.

    Every row is judged by its text alone, so repeated rows and ids, and rows
    without an id, are judged alike; a null or empty text has the score of no
    words. Without labels nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fuzzy duplicates among the lines of all documents one stays.

    A document all of whose lines with a word went is no longer there; n_chars
    is of the text that is left. A null text stays null (n_chars null), an
    empty one empty. Lines are told apart by (doc_id, text): different texts
    under one id, or under none, are documents of their own, and rows that
    repeat both lose the same lines. Ties go to the first (doc_id, text, line).
    """
    out = linededup.dedup(docs.select(*COLUMNS))
    lost = (F.col("n_removed") > 0) & (F.regexp_replace("text", "[\\x20\\x09-\\x0D]", "") == "")
    return out.where(~F.coalesce(lost, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicate documents the one with the least doc_id stays.

    Documents are told apart by a 64-bit hash of (doc_id, text), so two texts
    under one id are decided apart; a null id comes after all others, ties go
    to the least hash. Of rows that repeat id and text one stays, with the
    least other columns. Texts without a word are in no component and stay.
    """
    rows = docs.select(*COLUMNS).withColumn("_node", F.xxhash64("doc_id", "text"))
    groups = settle(jaccard.near_duplicates(rows.select(F.col("_node").alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("_node"), "component_id"), "groups")
    many = groups.groupBy("component_id").agg(F.min("_node").alias("lo"), F.max("_node").alias("hi")).where("lo != hi").select("component_id")
    members = settle(groups.join(many, "component_id").distinct(), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_node")
    placed = settle(rows.select("doc_id", "_node").join(small(members), "_node").select("component_id", order.alias("place")), "placed")
    first = settle(placed.groupBy("component_id").agg(F.min("place").alias("first")), "first")
    gone = settle(placed.join(small(first), "component_id").where("place != first").select("place._node").distinct(), "gone")
    again = settle(groups.groupBy("_node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_node"), "again")
    out = rows.join(small(gone), "_node", "left_anti")
    if not again.isEmpty():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        twice = out.join(small(again), "_node", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "text", "r.*")
        out = out.join(small(again), "_node", "left_anti").select(*COLUMNS).unionByName(twice)
    discard(groups, members, placed, first)
    return out.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights and all rows shuffled.

    A null source is a source of its own, a null id counts as the empty text
    and rows that repeat an id get the same count. Texts are carried as they
    are.
    """
    return mixing.mix(docs.select(*COLUMNS), extra=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and of their decoding.

    A row for each row of docs, repeated ones too; a null text has no tokens,
    as an empty one; a null id stays null.
    """
    return bpe.digests(docs, *bpe_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}")
    return docs


#: Learned models and components are beyond SQL; a test holds run() against a plain version of all five stages.
ORACLE_SQL = None
