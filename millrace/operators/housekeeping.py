"""Usage log: rows, costs and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import whole_seconds


#: The order in which calls get their ids; equal rows are interchangeable.
ORDER = ["created", "tenant", "tokens_in", "tokens_out", "cost", "state", "message", "duration"]


def log_rows(calls: DataFrame) -> DataFrame:
    """One row for each call (tenant, created, tokens_in, tokens_out, cost, error, message, milliseconds).

    error: null for success, 'provider' or another text for a failure; a call
    is logged once. Durations are whole seconds.
    """
    state = F.when(F.col("error").isNull(), 1).when(F.col("error") == "provider", -1).otherwise(-2)
    return calls.select(
        "created", "tenant", "tokens_in", "tokens_out", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), "cost",
        state.alias("state"), "message", whole_seconds(F.col("milliseconds")).alias("duration"),
    )


def usage(log: DataFrame) -> DataFrame:
    """Calls, failures and cost by tenant."""
    return log.groupBy("tenant").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("state") < 0).alias("failures"), F.sum("cost").alias("cost"))
