"""Token counts of whole texts, however long, by overlap resynchronisation.

A text of one chunk is encoded as it is. A longer one is cut into chunks that
overlap, which are dealt to tasks by text and chunk and encoded apart, with the
places where their pieces start. A piece is what the tokenizer's pattern splits
off before merges: no token crosses its ends. Where a chunk and the next have a
start of a piece in common, far enough from the chunk's end that what follows
can't change it, everything from there on is the same in both; so they are
spliced at the first such place. Where an overlap has none (a long run of one
kind of characters), it is widened to the whole next chunk, and so on until
every splice is proven.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, chunks, discard, settle, small

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 9
LIMIT = 512
#: Pieces whose token counts a task remembers at once.
REMEMBERED = 1 << 18
#: Characters that every version of Unicode which knows them at all classes alike: pieces of a text made of these alone
#: are the pattern's here, and those of other texts are left to the tokenizer.
PLAIN = (
    r"[^\u0000-ԯ֑-״؀-ۿऀ-ॿḀ-῿ -⁯₠-₿℀-⅏←-⏿─-➿"
    r"　-ヿㄅ-ㄭ一-龥가-힣！-ﾾ\U0001f300-\U0001f6ff]"
)


class Counts:
    """Pieces and token counts by a byte-level BPE tokenizer, given as the JSON text of its file.

    Counts are the library's own, special strings included. Pieces that the
    pattern finds are encoded once each; the library encodes a text whole that
    holds a special string or characters beyond PLAIN.
    """

    def __init__(self, source: str, pattern: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(source)
        self.tool.no_truncation()
        self.tool.no_padding()
        told = json.loads(source)
        added = told["added_tokens"]
        self.special = [t["content"] for t in added]
        #: How far behind a place a special string that begins before it may end.
        self.margin = max([1, *map(len, self.special)])
        split = told["pre_tokenizer"] or {}
        #: Whether pieces are the pattern's alone, so that a text may be cut.
        self.cuttable = (
            told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        )
        self.pieces, self.odd = regex.compile(pattern), regex.compile(PLAIN)
        self.known: dict[str, int] = {}

    def _plain(self, text: str) -> bool:
        return self.cuttable and not self.odd.search(text) and not any(s in text for s in self.special)

    def _learn(self, pieces) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        for p, e in zip(new, self.tool.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[p] = len(e)

    def totals(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        counted = [Counter(self.pieces.findall(t)) if self._plain(t) else None for t in texts]
        self._learn(set().union(*[c for c in counted if c is not None]))
        return [len(self.tool.encode(t, add_special_tokens=False)) if c is None else sum(n * self.known[p] for p, n in c.items()) for t, c in zip(texts, counted, strict=True)]

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece starts, and the tokens before it; the last entry is the text's end and all its tokens."""
        if self._plain(text):
            found = list(self.pieces.finditer(text))
            self._learn({m[0] for m in found})
            at = [m.start() for m in found]
            sizes = [self.known[m[0]] for m in found]
            return np.array([*at, len(text)], np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        encoded = self.tool.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in encoded.word_ids], np.int64)
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        return np.concatenate((offsets[first, 0], [len(text)])), np.concatenate((first, [len(words)]))


def _whole(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for chunk in chunks(batches, "text"):
            tool = tool or Counts(*shared.value)
            n = tool.totals([t or "" for t in chunk.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(overlap: int):
    """(key, text, cuts): each chunk from a cut to the next and `overlap` beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, cuts, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = [*cuts[1:], len(text)]
                own = [k for k in range(len(cuts)) if wanted is None or cuts[k] in wanted]
                for k in own:
                    last = k == len(cuts) - 1
                    piece = text[cuts[k] : ends[k] + (0 if last else overlap)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([cuts[k]], pa.int64()), pa.array([None if last else ends[k]], pa.int64()), pa.array([piece], pa.string())],
                        names=["key", "start", "next", "piece"],
                    )

    return run


_REPORT = "key string, start long, next long, total long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _encoded(shared, overlap: int):
    """What a chunk tells of its two overlaps: starts of pieces there and the chunk's tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for chunk in chunks(batches, "piece"):
            tool = tool or Counts(*shared.value)
            out = []
            for key, start, following, text in zip(*(c.to_pylist() for c in chunk.columns), strict=True):
                at, n = tool.starts(text)
                at, total = at + start, int(n[-1])
                sure = at <= start + len(text) - tool.margin  # what lies beyond the chunk can't change these
                left = (at >= start) & (at < start + overlap) & sure
                right = (at >= following) & sure if following is not None else np.zeros(len(at), bool)
                out.append((key, start, following, total, at[left].tolist(), n[left].tolist(), at[right].tolist(), n[right].tolist()))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "start", "next", "total", "left_at", "left_n", "right_at", "right_n"])

    return run


def _spliced(reports: DataFrame) -> DataFrame:
    """For each cut between chunks: key, cut, at (where they are spliced, null if nowhere) and the tokens to leave out there."""
    ends = reports.where("next is not null").select("key", F.col("next").alias("cut"), F.col("right_at").alias("a"), F.col("right_n").alias("n"), F.lit(0).alias("side"))
    begins = reports.where("start > 0").select("key", F.col("start").alias("cut"), F.col("left_at").alias("a"), F.col("left_n").alias("n"), F.lit(1).alias("side"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = ends.union(begins).groupBy("key", "cut").agg(of(0, "a").alias("a0"), of(0, "n").alias("n0"), of(1, "a").alias("a1"), of(1, "n").alias("n1"))
    both = both.withColumn("at", F.array_min(F.array_intersect("a0", "a1")))
    place = lambda a, n: F.get(F.col(n), (F.array_position(F.col(a), F.col("at")) - 1).cast("int"))
    # what the chunk counts from the splice on and what the next counts before it is not the text's
    return both.select("key", "cut", "at", place("a0", "n0").alias("before"), place("a1", "n1").alias("twice"))


def _cuts(chunk: int, overlap: int):
    """Where the chunks of a text begin; the last is longer than an overlap."""
    return F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - overlap - 1, F.lit(chunk).cast("long"))


def _reports(asked: DataFrame, shared, overlap: int) -> DataFrame:
    """Reports of the wanted chunks of (key, text, cuts, wanted); chunks of equal texts meet and are encoded once."""
    pieces = asked.mapInArrow(_cut(overlap), "key string, start long, next long, piece string")
    once = pieces.groupBy("key", "start", "next").agg(F.min("piece").alias("piece"))
    return once.select("key", "start", "next", "piece").mapInArrow(_encoded(shared, overlap), _REPORT)


def _long(texts: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of each key of (key, text), chunk by chunk; a key's texts are equal."""
    reports = settle(_reports(texts.select("key", "text", _cuts(chunk, overlap).alias("cuts"), F.lit(None).cast("array<long>").alias("wanted")), shared, overlap), "reports")
    while True:
        spliced = settle(_spliced(reports), "splices")
        if spliced.where("at is null").isEmpty():
            break
        # the chunks on both sides of an unproven cut become one, which begins at the last cut that stays
        unproven = spliced.where("at is null").groupBy("key").agg(F.collect_list("cut").alias("dropped"))
        cuts = reports.groupBy("key").agg(F.collect_list("start").alias("starts")).join(unproven, "key")
        stays = F.sort_array(F.array_except("starts", "dropped"))
        wanted = F.transform("dropped", lambda d: F.array_max(F.filter(F.array_except("starts", "dropped"), lambda c: c < d)))
        redo = settle(cuts.select("key", stays.alias("cuts"), F.array_distinct(wanted).alias("wanted"), "dropped"), "redo")
        fresh = _reports(texts.join(small(redo), "key").select("key", "text", "cuts", "wanted"), shared, overlap)
        kept = reports.join(small(redo.select("key", "wanted", "dropped")), "key", "left").where("wanted is null or not (array_contains(wanted, start) or array_contains(dropped, start))")
        old, reports = reports, settle(fresh.unionByName(kept.select(*reports.columns)), "reports")
        discard(old, spliced, redo)
    parts = reports.select("key", F.when(F.col("next").isNull(), F.col("total")).otherwise(0).alias("n")).union(spliced.select("key", F.col("before") - F.col("twice")))
    out = settle(parts.groupBy("key").agg(F.sum("n").alias("n_tokens")), "long-counts")
    discard(reports, spliced)
    return out


def count(docs: DataFrame, source: str, pattern: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    source: the JSON text of a tokenizer's file; pattern: what its byte-level
    split is documented to use. Null and empty texts have no tokens. Repeated
    rows stay, null ids too; texts that are equal and longer than a chunk are
    encoded once. A tokenizer that normalises texts, or splits them otherwise,
    gives no proof of a splice: its texts are encoded whole. An empty table
    gives an empty one; other columns are left aside.
    """
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    spark = docs.sparkSession
    tool = Counts(source, pattern)
    shared = spark.sparkContext.broadcast((source, pattern))  # one tokenizer file
    base = bare(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = "doc_id long, n_bytes long, n_tokens long"
    # fewer bytes than characters there cannot be
    split = (F.col("n_bytes") > chunk) & (F.length("text") > chunk + overlap) if tool.cuttable and overlap > 2 * tool.margin else F.lit(False)
    short = base.where(~F.coalesce(split, F.lit(False))).mapInArrow(_whole(shared), schema)
    keyed = base.where(split).withColumn("key", F.sha2("text", 256))
    if keyed.limit(1).isEmpty():
        out = short
    else:
        places = settle(keyed.select("doc_id", "n_bytes", "key"), "long-texts")
        found = _long(keyed.select("key", "text"), shared, chunk, overlap)
        out = short.unionByName(places.join(small(found), "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
