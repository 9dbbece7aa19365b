"""SC16, ST6: what a provider reads from files, asked once for each distinct content and again only when it failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import extract, with_retry
from .tables import Versions, discard, settle

#: A provider gets (path, content) rows, the path being the content's digest, and returns this; answer null: it failed.
ASKED = "path string, answer string, error string"
ANSWERS = "digest string, answer string, error string, attempts int, next_try timestamp_ntz"


def answers_table(spark: SparkSession, folder: str, buckets: int = 16) -> Versions:
    """The answers that are kept, in buckets by digest."""
    versions = Versions(spark, folder, ["digest"], (buckets, 1))
    if versions.latest() is None:
        versions.append(spark.createDataFrame([], ANSWERS), None)
    return versions


def asking(call: Callable[[bytes], str], retries: int = 3, first_delay: float = 2.0, transient: tuple = (OSError,), **more) -> Callable:
    """A provider that asks `call` for each content: transient failures are repeated at once, with delays; what fails still gives an error."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        patient = with_retry(call, retries, first_delay, transient, **more)
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, patient(bytes(content)), None))
                except Exception as error:  # noqa: BLE001 (whatever the service raises is this file's failure alone)
                    rows.append((path, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "answer", "error"])

    return run


def to_ask(files: DataFrame, known: DataFrame, now: datetime, attempts: int) -> DataFrame:
    """(digest, content, before) of the contents without an answer whose turn has come; before: attempts made so far."""
    closed = (F.col("answer").isNotNull()) | (F.col("attempts") >= attempts) | (F.col("next_try") > F.lit(now).cast("timestamp_ntz"))
    keyed = files.where("content is not null").select(F.sha2("content", 256).alias("digest"), "content")
    open_ = keyed.join(known.where(closed).select("digest"), "digest", "left_anti")
    # equal contents are one: partial results leave each task once
    once = open_.groupBy("digest").agg(F.first("content").alias("content"))
    return once.join(known.select("digest", F.col("attempts").alias("before")), "digest", "left").select("digest", "content", F.coalesce("before", F.lit(0)).alias("before"))


def ask(files: DataFrame, provider: Callable, versions: Versions, now: datetime, attempts: int = 4, first_delay: float = 600.0) -> DataFrame:
    """The files (path, content) with their answers (path, digest, answer, error, attempts); new answers join the kept ones.

    A content that failed is asked again in a later run, `attempts` times at
    most, after a time that doubles with each (from `first_delay` seconds).
    Nothing is asked, and no version written, where every answer is there.
    """
    base = versions.latest()
    # what a content's digest takes of its bytes is taken once, and contents that are answered go no further
    open_ = settle(to_ask(files, versions.read(base), now, attempts), "to-ask")
    asked = open_.select(F.col("digest").alias("path"), "content")
    if not asked.limit(1).isEmpty():
        got = extract(asked, provider, ASKED).withColumnRenamed("path", "digest").join(open_.select("digest", "before"), "digest")
        made = (F.col("before") + 1).cast("int")
        wait = F.make_dt_interval(secs=(F.lit(first_delay) * F.pow(F.lit(2.0), F.col("before"))).cast("decimal(18,6)"))
        later = F.when(F.col("answer").isNull(), F.lit(now).cast("timestamp_ntz") + wait)
        fresh = got.select("digest", "answer", "error", made.alias("attempts"), later.alias("next_try"))
        # the provider's answers become data before anything is done with them
        side = Versions(versions.spark, f"{versions.folder}/answered")
        n = side.append(fresh, side.latest())
        fresh = side.read(n)
        touched = versions.buckets_of(fresh)
        kept = versions.read(base, touched).join(fresh.select("digest"), "digest", "left_anti")
        base = versions.append(kept.unionByName(fresh), base, "extraction", touched)
    discard(open_)
    keyed = files.select("path", F.sha2("content", 256).alias("digest"))
    return keyed.join(versions.read(base).select("digest", "answer", "error", "attempts"), "digest", "left").select("path", "digest", "answer", "error", "attempts")
