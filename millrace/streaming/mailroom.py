"""ST3: messages of unknown senders wait, and are delivered once when a tenant has their address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import route_mail
from ..operators.scans import first_per
from ..sources.tables import Versions

#: What a mailroom adds to messages of (message_id, sender, ...): the tenant, and the version that delivered it; null while it waits.
ADDED = ("tenant", "delivered_in")


def mailroom(spark: SparkSession, folder: str, buckets: int = 16) -> Versions:
    """A table of all messages that came, in buckets by their ids."""
    return Versions(spark, folder, ["message_id"], (buckets, 1))


def receive(versions: Versions, messages: DataFrame, tenants: DataFrame, number: int, stream: str = "mail") -> int | None:
    """Batch `number` of a stream: its messages join the table, those of known senders delivered at once.

    A batch that comes again, and a message whose id is there already, changes
    nothing. Returns the version, None if there is none to write.
    """
    latest = versions.latest()
    if latest is not None and number <= versions.manifest(latest)["streams"].get(stream, -1):
        return None
    own = first_per(messages, ["message_id"], [F.col("sender")])
    if latest is not None:
        there = versions.read(latest, versions.buckets_of(own)).select("message_id")
        own = own.join(there, "message_id", "left_anti")
    number_of = 0 if latest is None else latest + 1
    routed = route_mail(own, tenants).withColumn("delivered_in", F.when(F.col("tenant").isNotNull(), F.lit(number_of)).cast("long"))
    return versions.append(routed, latest, f"{stream} batch {number}", add=latest is not None, batch=(stream, number))


def reroute(versions: Versions, tenants: DataFrame) -> int | None:
    """Deliver what waits and has a tenant now. Only the buckets of those messages are written; None if there are none."""
    latest = versions.latest()
    waiting = versions.read(latest).where("tenant is null").drop(*ADDED)
    found = route_mail(waiting, tenants).where("tenant is not null").select("message_id", F.col("tenant").alias("_tenant"))
    touched = versions.buckets_of(found)
    if not touched:
        return None
    rows = versions.read(latest, touched)
    hit = F.col("tenant").isNull() & F.col("_tenant").isNotNull()
    rows = rows.join(found, "message_id", "left").select(
        *[c for c in rows.columns if c not in ADDED], F.coalesce("tenant", "_tenant").alias("tenant"), F.when(hit, F.lit(latest + 1).cast("long")).otherwise(F.col("delivered_in")).alias("delivered_in")
    )
    return versions.append(rows, latest, f"rerouted after {latest}", touched)


def delivered(versions: Versions, after: int = -1) -> DataFrame:
    """The messages that versions after `after` delivered, each in one version only."""
    return versions.read(versions.latest()).where(F.col("delivered_in") > after)
