"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle ends
with a seek table in a skippable frame (the layout of the Zstandard seekable
format), and every record's place is its bundle, frame and offset within the
frame, so one record costs one frame. Payloads that occur again become revisit
records that name the response they repeat.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import qualified
from .common import bare, settle, shared_dir

#: Payloads of fewer bytes are always written whole.
MIN_REVISIT = 1000
#: Uncompressed bytes after which a frame, and after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 256_000, 64_000_000
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

PLACES = "page_id long, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: which record is a response (refers_to null), which a revisit.

    Of equal payloads of MIN_REVISIT bytes at least, those of the largest
    page_id are responses and the others refer to it. Rows that repeat that
    page_id are responses too. A null page_id is never referred to, unless no
    other has the payload, and then all are responses. A null html is empty.
    """
    base = bare(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    base = base.withColumn("digest", F.sha1("payload"))
    seen = base.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # settled, so that both sides of the join are plain and a hot payload's side can be split
    again = settle(seen.where("n > 1 and last is not null").select(F.col("digest").alias("d"), "last"), "revisits")
    out = base.join(again, base["digest"] == again["d"], "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def _id(page_id, digest: str) -> str:
    """Different payloads of one page_id have different ids; only records that repeat both share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(value: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id, digest)}",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {_id(refers_to, digest)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's headers, its HTTP headers and its payload; the payload's digest is checked."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    http, payload = block.split(b"\r\n\r\n", 1)
    if headers["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if headers["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError("payload does not have its digest")
    return headers, http, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle, of (compressed, uncompressed) bytes of its frames."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, uncompressed) bytes of each frame, of the last bytes of a bundle."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    body = tail[-9 - n * width : -9]
    return [struct.unpack_from("<II", body, k * width) for k in range(n)]


class Bundle:
    """A bundle in the making, in memory: BUNDLE_BYTES and one record at most."""

    def __init__(self) -> None:
        import zstandard

        self.codec = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.frames, self.buffer, self.places = bytearray(), [], bytearray(), []
        self.total = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.places.append((page_id, len(self.frames), len(self.out), len(self.buffer), len(data)))
        self.buffer += data
        self.total += len(data)
        if len(self.buffer) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.buffer:
            data = self.codec.compress(bytes(self.buffer))
            self.out += data
            self.frames.append((len(data), len(self.buffer)))
            self.buffer = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        return bytes(self.out) + seek_table(self.frames)


def _filesystem(folder: str):
    """The file system and the path of a full URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("file:///", "file:/").replace("file:/", "file:///"))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _filesystem(folder)
        task = TaskContext.get()
        bundle, count = Bundle(), 0

        def close() -> pa.RecordBatch:
            # an attempt's own name: a lost task's bundles are in no place that is read
            name = f"part-{task.partitionId():06d}-{count:04d}-{task.taskAttemptId()}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(bundle.finish())
            rows = [(p, name, k, at, bundle.frames[k][0], off, n) for p, k, at, off, n in bundle.places]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4], strict=True)],
                names=[x.split()[0] for x in PLACES.split(", ")],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in batch.columns)
                bundle.add(page_id, record(page_id, url, payload, digest, refers_to))
                if bundle.total >= BUNDLE_BYTES:
                    yield close()
                    bundle, count = Bundle(), count + 1
        if bundle.places:
            yield close()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page's record to bundles in `folder`, which executors share; return the index, settled.

    A row for each record: page_id, bundle (file name), frame, frame_offset
    and frame_bytes (compressed, in the bundle), record_offset (in the
    frame's content) and record_bytes. The index names only bundles of the
    attempts that were committed.
    """
    folder = qualified(pages.sparkSession, folder)
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    return settle(plan(pages).mapInArrow(_write(folder), PLACES), "warc-index")


def fetch(folder: str, places: list[tuple]) -> Iterator[tuple[int, bytes]]:
    """(page_id, record) of places in the order of bundles and frames; a frame is read once in a row."""
    import zstandard

    files, root = _filesystem(folder)
    codec = zstandard.ZstdDecompressor()
    name, source, table, starts, frame, content = None, None, [], [], None, b""
    for page_id, bundle, k, at, n, off, size in places:
        if bundle != name:
            if source is not None:
                source.close()
            source = files.open_input_file(f"{root}/{bundle}")
            end = source.size()
            tail = source.read_at(min(end, 9), max(0, end - 9))
            frames = struct.unpack("<IBI", tail)[0]
            take = min(end, frames * 12 + 9)
            table = read_seek_table(source.read_at(take, end - take))
            starts, name, frame = [sum(x[0] for x in table[:i]) for i in range(len(table))], bundle, None
        if k != frame:
            if (starts[k], table[k][0]) != (at, n):
                raise ValueError(f"{bundle}: the seek table and the index differ")
            content, frame = codec.decompress(source.read_at(table[k][0], starts[k]), max_output_size=table[k][1]), k
        yield page_id, content[off : off + size]
    if source is not None:
        source.close()


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, digests, kinds, refers = [], [], [], [], []
            for page_id, data in fetch(folder, list(zip(*[c.to_pylist() for c in batch.columns], strict=True))):
                headers, http, payload = parse(data)
                given = headers["X-Page-ID"]
                if given != ("" if page_id is None else str(page_id)):
                    raise ValueError(f"the index leads to page {given}, not {page_id}")
                kinds.append(headers["WARC-Type"])
                full = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                ids.append(page_id)
                sizes.append(full if kinds[-1] == "revisit" else len(payload))
                digests.append(base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex())
                refers.append(int(headers["X-Refers-To-Page-ID"]) if kinds[-1] == "revisit" else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.int64())],
                names=[x.split()[0] for x in RECORDS.split(", ")],
            )

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every record that the index names, read through its bundle's seek table: RECORDS.

    payload_bytes and payload_digest are of the full payload; a revisit has
    them from the headers that it keeps of the response.
    """
    folder = qualified(index.sparkSession, folder)
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = index.repartition(n, "bundle", F.expr("frame div 16")).sortWithinPartitions("bundle", "frame", "record_offset")
    return ordered.mapInArrow(_read(folder), RECORDS)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to a new shared folder and read them back: RECORDS for each row.

    A null html is an empty payload, a null url an empty one; repeated rows
    stay, each with its record; a payload is held whole in memory, however
    long; an empty table gives an empty one; other columns are left aside.
    """
    folder = new_folder(pages.sparkSession)
    return read(write(pages, folder), folder)


ORACLE = f"""
WITH base AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM base),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN last END AS refers_to
FROM marked
"""
