"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

A task takes the distinct pieces of many texts at once. An inverted index
leads from each token pair to the places in the pieces where it stands; merges
are applied in rank order, each to all its places, and only the pairs that the
merged token makes with its neighbours enter the index anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, chunks
from .shingles import distinct

#: Bytes of text whose distinct pieces are replayed together, and pieces that a task remembers.
REPLAY_BYTES, REMEMBERED = 3_000_000, 250_000


def load_ranks(path: str) -> list[bytes]:
    """The tokens by rank, of lines of base64 and rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 to n - 1")
    return [ranks[k] for k in range(len(ranks))]


class Merges:
    """The pairs of tokens that make a token, in sorted arrays, and which merges keep to rank order."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.single = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs, made = [], []
        #: A token whose pair with a neighbour can have a lower rank than its own.
        self.early = np.zeros(len(tokens), bool)
        for k, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(k)
                    for part in (a, b):
                        if part > k:
                            self.early[part] = True
        order = np.argsort(pairs)
        self.pairs, self.made = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or -1."""
        if not len(self.pairs):
            return np.full(len(a), -1)
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.made[at], -1)

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Each piece's token ids, as merging its lowest pair first, leftmost of equals, gives them."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        token = self.single.astype(np.int32)[data]
        if (token < 0).any():
            raise ValueError("a byte has no token")
        n = len(token)
        ends = np.cumsum(lengths)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        some = lengths > 0
        after[ends[some] - 1] = -1
        before[(ends - lengths)[some]] = -1
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Put the pairs that begin at places into the index."""
            ranks = self.ranks_of(token[places], token[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(places, cuts), ranks[np.concatenate(([0], cuts))].tolist(), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(waiting, rank)

        enter(np.flatnonzero(after >= 0))
        while waiting:
            rank = heapq.heappop(waiting)
            found = index.pop(rank)
            places = distinct(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            # entries of pairs that are gone by now
            places = places[token[places] >= 0]
            places = places[after[places] >= 0]
            places = places[self.ranks_of(token[places], token[after[places]]) == rank]
            if not len(places):
                continue
            if self.early[rank] and len(places) > 1:
                # the merged token may come first with its neighbour: one place of a piece at a time
                first = np.concatenate(([True], np.diff(piece[places]) > 0))
                if not first.all():
                    index[rank] = [places[~first]]
                    heapq.heappush(waiting, rank)
                    places = places[first]
            elif len(places) > 1:
                # of places that overlap in a run, every other one, from the left
                touch = np.concatenate(([False], after[places[:-1]] == places[1:]))
                if touch.any():
                    starts = np.flatnonzero(~touch)
                    run = np.repeat(starts, np.diff(np.append(starts, len(places))))
                    places = places[(np.arange(len(places)) - run) % 2 == 0]
            gone = after[places]
            token[places] = rank
            token[gone] = -1
            after[places] = after[gone]
            follow = after[places]
            before[follow[follow >= 0]] = places[follow >= 0]
            left = before[places]
            touched = np.concatenate((left[left >= 0], places[follow >= 0]))
            enter(distinct(touched))
        alive = token >= 0
        flat = token[alive]
        counts = np.bincount(piece[alive], minlength=len(pieces))
        return np.split(flat, np.cumsum(counts)[:-1]) if len(pieces) else []


class Encoder:
    """Encodes texts in batches and remembers the pieces of earlier ones."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.merges = Merges(tokens)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        # one object for each id, however many pieces have it
        self.numbers = list(range(len(tokens)))

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        split = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = [p for p in set(chain.from_iterable(split)) if p not in self.known]
        rank = self.merges.rank
        todo: list[str] = []
        for p in fresh:
            whole = rank.get(p.encode())
            if whole is None:
                todo.append(p)
            else:
                self.known[p] = (whole,)
        number = self.numbers.__getitem__
        for p, ids in zip(todo, self.merges.replay([p.encode() for p in todo]), strict=True):
            self.known[p] = tuple(map(number, ids.tolist()))
        get = self.known.__getitem__
        for pieces in split:
            yield list(chain.from_iterable(map(get, pieces)))


class Decoder:
    def __init__(self, tokens: list[bytes]):
        self.get = tokens.__getitem__

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.get, ids))


def _texts(chunk: pa.RecordBatch, k: int) -> list[str]:
    return ["" if t is None else t for t in chunk.column(k).to_pylist()]


def _encode(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for chunk in chunks(batches, "text", REPLAY_BYTES):
            ids = pa.array(list(encoder.encode(_texts(chunk, 1))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk.column(0), ids], names=["doc_id", "ids"])

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            out = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return run


def _digests(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        encoder, decoder = Encoder(tokens, pattern), Decoder(tokens)
        decimal = [str(k) for k in range(len(tokens))].__getitem__
        for chunk in chunks(batches, "text", REPLAY_BYTES):
            counts, named, decoded = [], [], []
            for ids in encoder.encode(_texts(chunk, 1)):
                counts.append(len(ids))
                named.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(counts, pa.int64()), pa.array(named, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _base(docs: DataFrame) -> DataFrame:
    return bare(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """Per row: doc_id, ids (array of int). A null text has no ids, as an empty one; repeated rows stay."""
    return _base(docs).mapInArrow(_encode(docs.sparkSession.sparkContext.broadcast(tokens), pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, decoded (binary). Null ids decode to null."""
    return bare(encoded, "doc_id", "ids").mapInArrow(_decode(encoded.sparkSession.sparkContext.broadcast(tokens)), "doc_id long, decoded binary")


def digests(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """encode, then decode, in one pass; per row doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    return _base(docs).mapInArrow(_digests(shared, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
