"""Uploaded files: bytes, kinds and what reads them."""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import parse
from ..functions.text import extension
from .tables import _file_system, discard, settle

KINDS = {".pdf": "pdf", ".xml": "xml"}
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


#: What an opened file costs besides its bytes, as bytes; content that a task hands over at once.
_OPEN, _BATCH = 16_384, 4_000_000


def _store(uri: str):
    """(file system, path) of a folder that Python opens."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).strip("/")
    return fs.FileSystem.from_uri(uri)


def _hidden(name: str) -> bool:
    """What Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(system, folder: str) -> Iterator[tuple[str, int | None]]:
    """(name, length) of a folder's files and, without a length, its folders; a local folder's one after another."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir():
                    yield e.name, None
                elif e.is_file():
                    yield e.name, e.stat().st_size
        return
    for e in system.get_file_info(fs.FileSelector(folder)):
        if e.type in (fs.FileType.Directory, fs.FileType.File):
            yield e.base_name, e.size if e.type == fs.FileType.File else None


def _listing(uri: str) -> Callable:
    """For mapInArrow: what lies in folders below `uri`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(uri)
        made = lambda rows: pa.RecordBatch.from_pylist(rows, schema=pa.schema([("place", pa.string()), ("length", pa.int64())]))
        for batch in batches:
            rows = []
            for place in batch.column(0).to_pylist():
                for name, length in _entries(system, f"{base}/{place}".rstrip("/")):
                    # an empty file is no upload, to Spark's reader either
                    if not _hidden(name) and length != 0:
                        rows.append({"place": f"{place}/{name}".lstrip("/"), "length": length})
                    if len(rows) == 10_000:
                        yield made(rows)
                        rows = []
            yield made(rows)

    return run


def _opening(uri: str, root: str) -> Callable:
    """For mapInArrow: files below `uri` with their bytes, few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(uri)

        def made(places: list[str], held: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([f"{root}/{p}" for p in places], pa.string()), pa.array([len(c) for c in held], pa.int64()), pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "length", "content"])

        for batch in batches:
            places, held, size = [], [], 0
            for place in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{place}") as file:
                    held.append(file.read())
                places.append(place)
                size += len(held[-1])
                if size >= _BATCH:
                    yield made(places, held)
                    places, held, size = [], [], 0
            yield made(places, held)

    return run


def _by_tasks(spark: SparkSession, uri: str, root: str) -> DataFrame:
    """(path, length, content) of the files below a folder, which tasks list, level by level, and open.

    The driver holds neither names nor a part for every few files: their list is a table.
    """
    parts = max(spark.sparkContext.defaultParallelism, 1)
    level, found = spark.createDataFrame([("",)], "place string"), []
    while True:
        listed = settle(level.mapInArrow(_listing(uri), "place string, length long"), "listed-files")
        found.append(listed)
        folders = listed.where("length is null").select("place")
        if folders.limit(1).isEmpty():
            break
        level = folders.repartition(parts)
    every = found[0]
    for listed in found[1:]:
        every = every.unionByName(listed)
    every = settle(every.where("length is not null"), "files")
    discard(*found)
    n, total = every.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    share = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return every.select("place").repartition(max(parts, -(-(total + n * _OPEN) // share))).mapInArrow(_opening(uri, root), "path string, length long, content binary")


def _folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """A folder as a URI and as Spark writes it in paths; None for a file, a pattern and what only Spark opens."""
    if any(c in path for c in "*?[]{}\\"):
        return None
    fs, at = _file_system(spark, path)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    at = fs.makeQualified(at)
    uri = at.toUri().toASCIIString()
    try:
        _store(uri)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return uri, at.toString().rstrip("/")


def uploads(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """SC13: path, content and kind (pdf, xml, or null for what is refused).

    name: what has the extension, the path unless given (as where Spark named
    the files and their folders say what they are). The files are those there
    at the call. A folder's are listed and opened by tasks; Spark's own reader,
    for other paths, holds every file's name and state in the driver.
    """
    folder = _folder(spark, path)
    if folder:
        files = _by_tasks(spark, *folder)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.col("path") if name is None else name
    kind = F.lit(None).cast("string")
    for ext, of in KINDS.items():
        kind = F.when(extension(name) == ext, of).otherwise(kind)
    return files.select("path", "length", "content", kind.alias("kind"))


def extract(files: DataFrame, provider: Callable, schema: str) -> DataFrame:
    """SC16: documents that a provider reads from files.

    provider: a function for mapInPandas over (path, content); what it is,
    a service or recorded answers, is the caller's.
    """
    return files.select("path", "content").mapInPandas(provider, schema)


#: What a provider returns: a file's path and its document as JSON text.
EXTRACTED = "path string, answer string"


def recorded(answers: dict[str, str]) -> Callable:
    """A provider that answers from what was recorded, by file name; a file without an answer gives no document."""

    def run(frames):
        for frame in frames:
            names = frame["path"].str.rsplit("/", n=1).str[-1]
            found = frame.assign(answer=names.map(answers))
            yield found.loc[found["answer"].notna(), ["path", "answer"]]

    return run


def contents(extracted: DataFrame) -> DataFrame:
    """(path, content) of a provider's answers."""
    return extracted.select("path", parse(F.col("answer")).alias("content"))


def with_retry(call: Callable, retries: int = 3, first_delay: float = 2.0, transient: tuple = (OSError,), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """ST6: the call with `retries` repeats of transient failures, after delays that double, with jitter."""

    def run(*args, **kwargs):
        for attempt in range(retries + 1):
            try:
                return call(*args, **kwargs)
            except transient:
                if attempt == retries:
                    raise
                sleep(first_delay * 2**attempt * random.uniform(0.8, 1.2))

    return run
