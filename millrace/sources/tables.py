"""Tables in Parquet, versions of a table that changes, and intermediate tables in the shared folder."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SC1."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as a full URI, by the session's default file system."""
    fs, path = _file_system(spark, folder)
    return fs.makeQualified(path).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: the session's spark.checkpoint.dir.

    Without one a session of a single machine takes its temporary folder; on a
    cluster that would be each machine's own, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return qualified(spark, base)


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Settled tables that are made within are deleted at its end: for whoever takes what a DataFrame gives before that."""
    own: list[DataFrame] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        discard(*own)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs no recomputation of what is
    behind it, and what is read is the same at every reading.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in frames:
        fs, path = _file_system(df.sparkSession, df._settled_path)
        fs.delete(path, True)


class Conflict(RuntimeError):
    """Another writer took the version."""


class Versions:
    """A table's versions below one folder, its rows dealt to buckets of which a change writes only those it touches.

    A version is a small file, _versions/<number>, that names the folders of
    each bucket, the schema, the writer, the largest id and the last batch of
    each stream. A writer puts its rows in a folder of its own and then makes
    the version visible by one exclusive step, which fails if the number is
    taken (Conflict). Nothing is locked, so a writer that dies leaves nothing
    behind but a folder that `vacuum` removes, and one that comes back late
    can't undo what others wrote since.

    key: columns (dotted paths too) whose hash is a row's bucket; the first
    alone picks one of buckets[0] groups, so a tenant's rows are in buckets[1]
    buckets. Without a key there is one bucket. A row's key must not change,
    and of a table that has a version the key and the buckets are that one's.
    The step is exclusive on HDFS and on shared or local file systems; stores
    whose rename replaces its target need a writer at a time.
    """

    #: Folders of a bucket up to which added rows only join it; then it is written anew as one.
    PIECES = 8

    def __init__(self, spark: SparkSession, folder: str, key: list[str] | None = None, buckets: tuple[int, int] = (4, 4), bloom: tuple[str, ...] = ()):
        self.spark, self.folder, self.bloom = spark, folder.rstrip("/"), bloom
        self._known: dict[int, dict] = {}
        # the first version decides for all
        latest = self.latest()
        self.key, self.buckets = (key, buckets) if latest is None else (self.manifest(latest)["key"], tuple(self.manifest(latest)["layout"]))

    def _fs(self):
        return _file_system(self.spark, self.folder)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    # what there is

    def latest(self) -> int | None:
        """The largest version."""
        fs, _ = self._fs()
        folder = self._path("_versions")
        if not fs.exists(folder):
            return None
        return max((int(n) for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit()), default=None)

    def manifest(self, version: int) -> dict:
        """What a version's file says; it never changes."""
        if version not in self._known:
            stream = self._fs()[0].open(self._path(f"_versions/{version}"))
            try:
                self._known[version] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return self._known[version]

    def owner(self, version: int) -> str:
        return self.manifest(version)["owner"]

    def top(self, version: int | None) -> int:
        """The largest id that any version up to this one had."""
        return 0 if version is None else self.manifest(version)["top"]

    def read(self, version: int, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or those of some of its buckets."""
        told = self.manifest(version)
        schema = T.StructType.fromJson(told["schema"])
        paths = [f"{self.folder}/data/{p}" for b, own in sorted(told["buckets"].items()) if only is None or int(b) in only for p in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # buckets

    def bucket(self, columns: dict[str, Column] | None = None) -> Column:
        """A row's bucket; `columns` gives the key's parts where they are named otherwise."""
        if not self.key:
            return F.lit(0)
        parts = [(columns or {}).get(k, F.col(k)) for k in self.key]
        group, within = self.buckets
        inner = F.pmod(F.xxhash64(*parts[1:]), F.lit(within)) if len(parts) > 1 else F.lit(0)
        return (F.pmod(F.xxhash64(parts[0]), F.lit(group)) * within + inner).cast("int")

    def buckets_of(self, df: DataFrame, columns: dict[str, Column] | None = None) -> list[int]:
        """The buckets that rows fall in, of which there are few by definition."""
        return sorted(r[0] for r in df.select(self.bucket(columns).alias("b")).distinct().collect())

    def group_of(self, value: str) -> list[int] | None:
        """The buckets that rows whose first key part has this value can be in."""
        if not self.key:
            return None
        group, within = self.buckets
        at = self.spark.sql("SELECT pmod(xxhash64(:v), :n)", {"v": value, "n": group}).first()[0] * within
        return list(range(at, at + within))

    # writing

    def append(self, df: DataFrame, base: int | None, owner: str | None = None, touched: list[int] | None = None, add: bool = False, batch: tuple[str, int] | None = None, in_place: bool = False) -> int:
        """Write the version after `base`, the one that df was made of (None: the first); returns its number.

        df is all rows of the table, or with `touched` all rows of those
        buckets, the others staying as they are, or with `add` rows that join
        what is there. batch: a stream and its batch that the version holds.
        in_place: df reads the rows of the touched buckets and changes or drops
        some, no more; they are written by the tasks that read them.
        """
        told = {"buckets": {}, "streams": {}, "top": 0} if base is None else self.manifest(base)
        kept = {} if touched is None and not add else {b: p for b, p in told["buckets"].items() if add or int(b) not in touched}
        if add and (full := [int(b) for b, p in kept.items() if len(p) >= self.PIECES]):
            df = df.unionByName(self.read(base, full).select(*df.columns))
            kept = {b: p for b, p in kept.items() if int(b) not in full}
        name = uuid.uuid4().hex
        target = f"{self.folder}/data/{name}"
        dealt = df.withColumn("_bucket", self.bucket())
        # a bucket's rows meet in a task, unless they are too many for one; those that were read from its files are together
        writer = (dealt if in_place else dealt.hint("rebalance", "_bucket")).write.partitionBy("_bucket")
        for column in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        try:
            writer.parquet(target)
            fs, _ = self._fs()
            written = {n.removeprefix("_bucket="): f"{name}/{n}" for s in fs.listStatus(self._path(f"data/{name}")) if (n := s.getPath().getName()).startswith("_bucket=")}
            found = dict(kept)
            for b, path in written.items():
                found[b] = [*kept.get(b, []), path]
            top = told["top"]
            if "id" in df.columns and written:
                top = max(top, self.spark.read.schema(df.schema).parquet(*[f"{self.folder}/data/{p}" for p in written.values()]).agg(F.max("id")).first()[0] or 0)
            number = 0 if base is None else base + 1
            streams = told["streams"] | ({batch[0]: batch[1]} if batch else {})
            self._publish(number, {"owner": owner or f"writer {name}", "schema": df.schema.jsonValue(), "top": top, "streams": streams, "key": self.key, "layout": self.buckets, "buckets": found})
        except BaseException:
            self._fs()[0].delete(self._path(f"data/{name}"), True)
            raise
        return number

    def _publish(self, number: int, told: dict) -> None:
        """Make a version visible, all of it at once; Conflict if there is one of this number."""
        fs, _ = self._fs()
        temporary, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{number}")
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                # a rename would replace what is there; a link never does
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
            elif fs.exists(final) or not fs.rename(temporary, final):
                raise FileExistsError(str(final))
        except FileExistsError as error:
            raise Conflict(f"version {number} of {self.folder} is {self.owner(number)}'s") from error
        finally:
            fs.delete(temporary, False)

    def vacuum(self, keep: int = 2, idle_seconds: float = 86_400) -> list[str]:
        """Remove versions before the last `keep`, and folders that none of these names; what was written less than `idle_seconds` ago stays.

        A reader of an older version, and a writer that has not published yet,
        have so much time. Returns the folders removed.
        """
        fs, _ = self._fs()
        latest = self.latest()
        if latest is None:
            return []
        names = {s.getPath().getName(): s for s in fs.listStatus(self._path("_versions"))}
        numbers = sorted(int(n) for n in names if n.isdigit())
        used = {p.split("/")[0] for n in numbers[-keep:] for own in self.manifest(n)["buckets"].values() for p in own}
        now = time.time()
        old = lambda s: now - s.getModificationTime() / 1000 >= idle_seconds
        for name, s in names.items():
            if old(s) and (name.startswith(".") or (name.isdigit() and int(name) in numbers[:-keep])):
                fs.delete(s.getPath(), False)
        gone = []
        data = self._path("data")
        for s in fs.listStatus(data) if fs.exists(data) else ():
            if s.getPath().getName() not in used and old(s):
                fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return gone
