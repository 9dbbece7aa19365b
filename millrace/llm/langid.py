"""Language identification by compression.

Each language has a dictionary: raw text of documents of that language. A text
is compressed with every dictionary in turn, piece by piece, each with nothing
but the dictionary behind it, so that every part of a long text says as much
about its language as the first; the language whose dictionary makes the sum
smallest is its language. Where the second smallest is hardly larger, the
answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bare, chunks, crc_mod, discard, settle

#: Documents of a language that go into its dictionary, at most (those whose texts hash lowest), and bytes of them.
FIT_DOCS, DICT_BYTES = 150, 96_000
#: Characters of one text in a dictionary, at most: its last ones, so that no single long text makes up a language.
FIT_SHARE = DICT_BYTES // 8
#: Texts of so many characters come first as examples; then longer ones, then shorter ones.
FIT_CHARS = (100, 3_000)
#: Parts of a language that are ranked apart first, and languages up to which their dictionaries are sent to every executor.
FIT_PARTS, MAX_LANGUAGES = 16, 1_000
LEVEL, MIN_MATCH = 1, 4
#: Bytes that are compressed at once, at most: a text's own history would soon say more than the dictionary.
PIECE = 2048
#: Bytes by which the second smallest must exceed the smallest, per byte of the smallest, for an answer to be accepted.
MARGIN = 0.01
#: Bytes of difference that change the odds by a factor of e.
TEMPER = 4.0
UNKNOWN = "und"
#: Follows each text, so that a block is never stored as it is and short texts show small differences.
PAD = b" " * 64


def fit(docs: DataFrame, held_out: int | None = 2) -> dict[str, bytes]:
    """A dictionary for each language of (doc_id, text, lang), in the order of the languages' names.

    Equal texts count once. Rows whose crc32 modulo 4 is `held_out` are left
    aside. A language of short texts only is learned from these. More than
    MAX_LANGUAGES languages are an error: so many dictionaries are no bounded
    model.
    """
    rows = bare(docs, "doc_id", "text", "lang").where("text is not null and lang is not null")
    if held_out is not None:
        rows = rows.where(crc_mod(F.col("doc_id"), 4) != held_out)
    length = F.length("text")
    order = F.when(length.between(*FIT_CHARS), 0).when(length > FIT_CHARS[1], 1).otherwise(2)
    keyed = rows.select("lang", order.alias("order"), F.xxhash64("text").alias("h")).distinct()
    # the first of each part of a language, then the first of the language: no task ranks a whole one
    part = Window.partitionBy("lang", F.pmod("h", F.lit(FIT_PARTS))).orderBy("order", "h")
    some = keyed.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= FIT_DOCS)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "h"))).where(F.col("rank") <= FIT_DOCS)
    ranked = settle(ranked.select(F.col("lang").alias("l"), F.col("h").alias("ranked"), "rank"), "examples")
    if ranked.select("l").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # FIT_DOCS rows for each language at most
    chosen = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(ranked), (F.col("h") == F.col("ranked")) & (F.col("lang") == F.col("l")))
    chosen = chosen.groupBy("lang", "rank").agg(F.min(F.expr(f"right(text, {FIT_SHARE})")).alias("t"))
    texts: dict[str, dict[int, bytes]] = {}
    for r in chosen.toLocalIterator():
        texts.setdefault(r.lang, {})[r["rank"]] = _plain(r.t)
    discard(ranked)
    kept = {lang: [t for _, t in sorted(texts[lang].items())] for lang in sorted(texts)}
    # examples that read as another language by the dictionaries of the other half are mislabelled or mixed
    halves = [Compressors(_dictionaries({lang: t[k::2] for lang, t in kept.items()})) for k in (0, 1)]
    agreed = {lang: [x for i, x in enumerate(t) if halves[1 - i % 2].best(x) == lang] for lang, t in kept.items()}
    return _dictionaries({lang: agreed[lang] or t for lang, t in kept.items()})


def _dictionaries(texts: dict[str, list[bytes]]) -> dict[str, bytes]:
    # what stands last in a dictionary is the cheapest to refer to
    return {lang: b"\n".join(reversed(t))[-DICT_BYTES:] for lang, t in texts.items()}


def _plain(text: str) -> bytes:
    """Case tells languages apart less than it hides what they share with their dictionary."""
    return text.lower().encode()


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = list(dictionaries)
        self.made = []
        for raw in dictionaries.values():
            params = z.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(raw), min_match=MIN_MATCH, strategy=z.STRATEGY_LAZY, window_log=20, hash_log=16, chain_log=16,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.made.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, data: bytes) -> list[int]:
        """The compressed bytes of all pieces, which are about equally long, by each dictionary."""
        step = -(-len(data) // max(1, -(-len(data) // PIECE))) or 1
        pieces = [data[at : at + step] + PAD for at in range(0, len(data), step)] or [PAD]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.made]

    def best(self, data: bytes) -> str:
        sizes = self.sizes(data)
        return self.langs[sizes.index(min(sizes))]


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        tools = Compressors(shared.value)
        for chunk in chunks(batches, "text"):
            langs, scores, margins, accepted = [], [], [], []
            for text in chunk.column(1).to_pylist():
                if not text or not tools.langs or not letter.search(text):
                    langs.append(UNKNOWN), scores.append(0.0), margins.append(0.0), accepted.append(False)
                    continue
                sizes = np.array(tools.sizes(_plain(text)))
                k = int(sizes.argmin())
                low = int(sizes[k])
                second = int(np.partition(sizes, 1)[1]) if len(sizes) > 1 else 2 * low
                langs.append(tools.langs[k])
                scores.append(float(1 / np.exp(-np.minimum((sizes - low) / TEMPER, 700)).sum()))
                margins.append((second - low) / low)
                accepted.append(second - low >= MARGIN * low)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1), margin, accepted.

    A text that is null or has no letter is `und`, with score 0 and not
    accepted. lang_pred names the smallest even where the margin is too narrow
    to accept it; of equal sizes the first name. Of a text in two languages
    the one with more of it wins, wherever it stands. Repeated rows stay; all
    of a text is compressed, however long; other columns are left aside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES for each language
    base = bare(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def classify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")
