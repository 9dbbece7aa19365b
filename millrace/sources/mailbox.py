"""Messages dropped as .eml files: their attachments, routed to tenants.

A file is read once by a stream's checkpoint; a message whose sender no tenant
has goes to the quarantine sink instead of being read at every poll.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import route_mail
from .files import BINARY_FILE

ATTACHMENTS = "path string, sender string, file_name string, content binary"


def _parse(frames: Iterator) -> Iterator:
    """Built-ins can't take MIME apart; a message that is none has no attachment."""
    import email
    import email.policy
    import email.utils

    import pandas as pd

    for frame in frames:
        rows = []
        for path, data in zip(frame["path"], frame["content"], strict=True):
            message = email.message_from_bytes(bytes(data or b""), policy=email.policy.default)
            sender = email.utils.parseaddr(str(message.get("From", "")))[1] or None
            for part in message.iter_attachments() if message.is_multipart() else ():
                rows.append((path, sender, part.get_filename(), part.get_payload(decode=True)))
        yield pd.DataFrame(rows, columns=["path", "sender", "file_name", "content"])


def attachments(messages: DataFrame) -> DataFrame:
    """SC15: a row for each attachment of (path, content) messages."""
    return messages.select("path", "content").mapInPandas(_parse, ATTACHMENTS)


def poll(
    spark: SparkSession, folder: str, tenants: DataFrame, deliver: Callable[[DataFrame], None], quarantine: Callable[[DataFrame], None], checkpoint: str, every: str | None = "10 minutes",
    names: str = "*.eml",
) -> StreamingQuery:
    """ST1-ST4, J7: new messages' attachments of known senders to `deliver`, the others' to `quarantine`.

    A batch that failed comes again whole, so `deliver` should absorb repeats
    (a keyed replacement does). names: which files are messages. every=None takes what is there and ends.
    """

    def batch(df: DataFrame, _: int) -> None:
        routed = route_mail(attachments(df), tenants).persist()
        try:
            deliver(routed.where("tenant is not null"))
            quarantine(routed.where("tenant is null"))
        finally:
            routed.unpersist()

    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", names).load(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
