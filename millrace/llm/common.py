"""What the operators of this subpackage share: inputs, settled tables, Arrow chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, settle, shared_dir  # noqa: F401 (the operators take them from here)

#: Bytes of text that a Python worker works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of numbers up to which a join's side is sent whole to every executor; beyond it both sides are shuffled.
SMALL_ROWS = 500_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A settled table of a few numbers a row, with a broadcast hint only where its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of a few numbers that make a file of their own in an intermediate table.
ROWS_A_FILE = 2_000_000


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as about `rows` rows of a few numbers need, one for each core at least.

    Small tables that are read again and again then cost a few tasks a step,
    whatever the number of shuffle partitions is.
    """
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_FILE))


#: Rows, and bytes, that pass to a Python worker at once: texts are long, and a batch is held on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def modest_batches(spark: SparkSession) -> None:
    """Smaller batches for the session, where it has not set its own."""
    for name, (usual, ours) in BATCHES.items():
        if str(spark.conf.get(name, usual)).removesuffix("b") == usual:
            spark.conf.set(name, ours)


def bare(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with an operator's own."""
    modest_batches(df.sparkSession)
    return df.select(*[df[n] for n in names])


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes in `column`, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes end to end, and each row's offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
