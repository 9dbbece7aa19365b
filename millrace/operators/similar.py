"""The best similar name by an inverted index of q-grams, searched from high scores to low.

Names of a score t or more differ by d = (1 - t) L edits at most, L being the
longer length, so their lengths differ by d at most and they share at least
L + q - 1 - q d of their q-grams. By the prefix principle two such names then
share one of their rarest few grams. A step finds all pairs of a score of t or
more that way; a name that has one is settled, as no pair that the step left
out can be better; the others go on to a lower t, and at last to single
characters, of which names that score at all share some.
"""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import edit_score
from ..sources.tables import discard, settle

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (score, q) of the steps; q-grams need a score over 100 - 100 / q.
STEPS = ((90, 3), (80, 3), (70, 3), (60, 2), (40, 1), (20, 1), (1, 1))
PAD = "\x01"


def gram_size(score: int) -> int:
    """The longest grams of which names of this score share some."""
    return 3 if score > 66 else 2 if score > 50 else 1


def steps(least: int) -> list[tuple[int, int]]:
    """The steps down to a least score."""
    return [s for s in STEPS if s[0] > least] + [(least, gram_size(least))]


def shared_grams(length: Column, score: int, q: int) -> Column:
    """How many q-grams a name of this length shares at least with any of `score` or more, whatever the other's length."""
    longest = F.floor(length * 100 / score).cast("int")
    need = lambda n: n + (q - 1) - q * F.floor((100 - score) * n / 100).cast("int")
    return F.greatest(F.lit(1), F.array_min(F.transform(F.sequence(length, longest), need)))


def grams(names: DataFrame, keys: list[str], q: int) -> DataFrame:
    """(keys, s, gram) of distinct names s; a gram that comes again has a number, so that sets can be compared as bags."""
    padded = F.concat(F.lit(PAD * (q - 1)), F.col("s"), F.lit(PAD * (q - 1)))
    every = F.transform(F.sequence(F.lit(1), F.length("s") + (q - 1)), lambda k: F.substring(padded, k, F.lit(q)))
    rows = names.where(F.length("s") > 0).select(*keys, "s", F.posexplode(every).alias("at", "g"))
    turn = F.row_number().over(Window.partitionBy(*keys, "s", "g").orderBy("at"))
    return rows.select(*keys, "s", F.concat("g", turn.cast("string")).alias("gram"))


def prefixes(rows: DataFrame, often: DataFrame, keys: list[str], score: int, q: int) -> DataFrame:
    """The rarest grams of each name, as many as one of `score` must share one of."""
    ranked = rows.join(often, [*keys, "gram"], "left")
    place = F.row_number().over(Window.partitionBy(*keys, "s").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    room = F.length("s") + (q - 1) - shared_grams(F.length("s"), score, q) + 1
    return ranked.withColumn("place", place).where(F.col("place") <= room).select(*keys, "s", "gram")


def _indexed(asked: DataFrame, known: DataFrame, keys: list[str], score: int, q: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes (keys, s, gram) of both sides."""
    left, right = grams(asked, keys, q), grams(known, keys, q)
    often = right.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    return prefixes(left, often, keys, score, q), prefixes(right, often, keys, score, q)


def _met(left: DataFrame, right: DataFrame, keys: list[str], score: int) -> DataFrame:
    met = left.withColumnRenamed("s", "a").join(right.withColumnRenamed("s", "b"), [*keys, "gram"])
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    return met.where(short * 100 >= long * score).select(*keys, "a", "b").distinct()


def candidates(asked: DataFrame, known: DataFrame, keys: list[str], score: int, q: int) -> DataFrame:
    """(keys, a, b): the pairs of names that may score `score` or more; (keys, s) on both sides, distinct."""
    return _met(*_indexed(asked, known, keys, score, q), keys, score)


def scored(pairs: DataFrame, score: int) -> DataFrame:
    """The candidates that do score so much, with their scores; a distance beyond the limit is not worked out."""
    longest = F.greatest(F.length("a"), F.length("b"))
    limit = math.ceil(100 - score)
    near = pairs.where(F.levenshtein("a", "b") * 100 <= longest * limit)
    return near.withColumn("score", edit_score(F.col("a"), F.col("b")))


#: Characters in groups; how many of each a name has is kept in a byte of two numbers, up to eight.
GROUPS = (*"0123456789", "etq", "aoj", "inx", "srz", "lhdcv", "umpgbfywk ")
#: Pairs of a block up to which they all meet where they are; grams would send more rows about.
WHOLE_PAIRS = 4_000_000
#: Pairs for each name from which bags of names are made to compare them by.
BAG_COST = 16


def bags(side: str) -> list[Column]:
    """The counts of a name's characters by group, as two numbers of eight bytes, so many bits of each being set."""
    out, c = [], F.col(side)
    for half in (0, 1):
        value = F.lit(0).cast("long")
        for k, group in enumerate(GROUPS[half * 8 : half * 8 + 8]):
            n = F.least(F.length(c) - F.length(F.translate(c, group, "")), F.lit(8))
            ones = F.call_function("shiftleft", F.lit(1).cast("long"), n) - F.lit(1).cast("long")
            value = value.bitwiseOR(F.shiftleft(ones, 8 * k))
        out.append(value.alias(f"{side}_bag{half}"))
    return out


def may_score(score: int) -> Column:
    """What lengths and bags of a and b leave possible: an edit changes the number of one character, or those of two where the length stays."""
    gap = F.abs(F.length("a") - F.length("b"))
    limit = F.floor((100 - score) * F.greatest(F.length("a"), F.length("b")) / 100)
    unlike = F.bit_count(F.col("a_bag0").bitwiseXOR(F.col("b_bag0"))) + F.bit_count(F.col("a_bag1").bitwiseXOR(F.col("b_bag1")))
    return (gap <= limit) & (unlike <= 2 * limit - gap)


def near_pairs(asked: DataFrame, known: DataFrame, keys: list[str], score: int) -> DataFrame:
    """(keys, a, b, score): the pairs of names that score `score` or more; (keys, s) on both sides, repeated or not.

    Both sides are dealt by their keys once and meet there, but for blocks of
    more than WHOLE_PAIRS pairs, which meet by the index of q-grams.
    """
    asked, known = (settle(df.select(*keys, "s").repartition(*keys).distinct(), "names") for df in (asked, known))
    count = F.count(F.lit(1))
    sizes = asked.groupBy(*keys).agg(count.alias("n")).join(known.groupBy(*keys).agg(count.alias("m")), keys)
    total = sizes.agg(F.max(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") + F.col("m"))).first()
    some, bagged = (total[0] or 0) > WHOLE_PAIRS, (total[1] or 0) > BAG_COST * (total[2] or 0)
    large = settle(sizes.where(F.col("n") * F.col("m") > WHOLE_PAIRS).select(*keys), "large-blocks") if some else None
    left, right = (df.join(large, keys, "left_anti") if some else df for df in (asked, known))
    left, right = (df.where(F.length("s") > 0).select(*keys, F.col("s").alias(side)).repartition(*keys) for df, side in ((left, "a"), (right, "b")))
    if bagged:
        met = left.select("*", *bags("a")).join(right.select("*", *bags("b")), keys).where(may_score(score)).select(*keys, "a", "b")
    else:
        short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
        met = left.join(right, keys).where(short * 100 >= long * score)
    pairs = scored(met, score)
    if some:
        names = [df.join(large, keys, "left_semi") for df in (asked, known)]
        pairs = pairs.unionByName(scored(candidates(*names, keys, score, gram_size(score)), score))
    return pairs


#: Pairs of a block up to which they are rows of a join; beyond that its names are compared in tasks, so many pairs and names known at a time.
JOINED_PAIRS, PART_PAIRS, PIECE = 20_000, 4_000_000, 16_384
#: A meeting by a gram is a row of an exchange, which costs as much as so many pairs that are compared in place.
GRAM_COST = 16
#: Characters of a name whose distances are worked out in the bits of one number.
WORD = 64


def distances(texts: list[str], names: list[str]) -> Iterator[np.ndarray]:
    """Of each text its edit distances to all names, of which none is empty; texts are sorted, so that what two begin with is worked out once.

    By columns of the table of distances: its differences as bits where names
    have WORD characters at most (Myers), the numbers themselves otherwise.
    """
    size, lengths = len(names), np.array([len(n) for n in names], np.int64)
    bits = lengths.max() <= WORD
    places = np.arange(lengths.max() + 1, dtype=np.int32)
    marks: dict[str, np.ndarray] = {}
    for j, name in enumerate(names):
        for k, c in enumerate(name):
            if c not in marks:
                marks[c] = np.zeros(size, np.uint64) if bits else np.zeros((size, len(places) - 1), bool)
            if bits:
                marks[c][j] |= np.uint64(1 << k)
            else:
                marks[c][j, k] = True
    none = np.zeros(size, np.uint64) if bits else np.zeros((size, len(places) - 1), bool)
    last, one = np.maximum(lengths - 1, 0).astype(np.uint64), np.uint64(1)
    path = [(~np.zeros(size, np.uint64), np.zeros(size, np.uint64), lengths) if bits else (np.tile(places, (size, 1)),)]
    before = ""
    for text in texts:
        shared = len(os.path.commonprefix((before, text)))
        del path[shared + 1 :]
        for c in text[shared:]:
            equal = marks.get(c, none)
            if bits:
                more, less, far = path[-1]
                x = (((equal & more) + more) ^ more) | equal
                up, down = less | ~(x | more), more & x
                far = far + ((up >> last) & one).astype(np.int64) - ((down >> last) & one).astype(np.int64)
                up, down, either = (up << one) | one, down << one, equal | less
                path.append((down | ~(either | up), up & either, far))
            else:
                (row,) = path[-1]
                new = np.empty_like(row)
                new[:, 0] = row[:, 0] + 1
                np.minimum(row[:, 1:] + 1, row[:, :-1] + ~equal, out=new[:, 1:])
                path.append((np.minimum.accumulate(new - places, axis=1) + places,))
        before = text
        yield path[-1][2] if bits else path[-1][0][np.arange(size), lengths]


def _compare(keys: list[str], least: int):
    def run(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["id"].to_numpy(), kind="stable") if known.num_rows else []
        ids, names = known["id"].take(order).to_numpy() if known.num_rows else np.zeros(0, np.int64), known["b"].take(order).to_pylist() if known.num_rows else []
        asked = asked.sort_by("a") if known.num_rows else asked.slice(0, 0)
        texts = sorted(asked["a"].to_pylist())
        places = {t: k for k, t in enumerate(asked["a"].to_pylist())}
        points, at = np.full(len(texts), -1), np.zeros(len(texts), np.int64)
        lengths = np.array([len(n) for n in names], np.int64)
        for group in (np.flatnonzero(lengths <= WORD), np.flatnonzero(lengths > WORD)):
            # of long names fewer at a time, as a number for each of their characters is kept
            step = 4096 if len(group) and lengths[group[0]] <= WORD else 64
            for some in (group[k : k + step] for k in range(0, len(group), step)):
                for k, far in enumerate(distances(texts, [names[j] for j in some])):
                    longest = np.maximum(lengths[some], len(texts[k]))
                    score = 100 * (longest - far) // longest
                    best = int(np.argmax(score))  # the first, which has the least id
                    if score[best] > points[k] or (score[best] == points[k] and ids[some[best]] < ids[at[k]]):
                        points[k], at[k] = score[best], some[best]
        good = np.flatnonzero(points >= least)
        rows = asked.take(pa.array([places[texts[k]] for k in good], pa.int64()))
        return pa.table({**{k: rows[k] for k in keys}, "a": rows["a"], "id": pa.array(ids[at[good]] if len(good) else [], pa.int64()), "score": pa.array(points[good], pa.int32())})

    return run


def _whole(asked: DataFrame, known: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The best of blocks whose names all meet all, settled; a large block is cut into parts on both sides, which are dealt over tasks."""
    count = F.count(F.lit(1))
    sizes = asked.groupBy(*keys).agg(count.alias("n")).join(known.groupBy(*keys).agg(count.alias("m")), keys)
    pieces = F.ceil(F.col("m") / PIECE)
    parts = F.ceil(F.col("n") / F.greatest(F.lit(256), F.lit(PART_PAIRS) / F.least("m", F.lit(PIECE))))
    sizes = settle(sizes.select(*keys, (F.col("n") * F.col("m")).alias("pairs"), pieces.cast("int").alias("pieces"), parts.cast("int").alias("parts")), "block-sizes")
    small, large = sizes.where(F.col("pairs") <= JOINED_PAIRS), sizes.where(F.col("pairs") > JOINED_PAIRS)
    # pairs that are rows: score and name in one number, so that the largest is kept without sorting them
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "s")).cast("long")
    few = known.join(small, keys, "left_semi").withColumn("place", place)
    rank = F.shiftleft(edit_score(F.col("a"), F.col("b")).cast("long"), 32) + (F.lit(2**32 - 1) - F.col("place"))
    met = asked.withColumnRenamed("s", "a").join(few.withColumnRenamed("s", "b").drop("id"), keys)
    best = met.groupBy(*keys, "a").agg(F.max(rank).alias("rank")).where(F.col("rank") >= least * 2**32)
    best = best.select(*keys, "a", (F.lit(2**32 - 1) - F.col("rank").bitwiseAND(F.lit(2**32 - 1))).alias("place"), F.shiftright("rank", 32).cast("int").alias("score"))
    done = best.join(few.select(*keys, "place", "id"), [*keys, "place"]).select(*keys, "a", "id", "score")
    if not large.isEmpty():
        numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = asked.join(large, keys).select(*keys, F.col("s").alias("a"), F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part"), numbers("pieces").alias("piece"))
        right = known.join(large, keys).select(*keys, F.col("s").alias("b"), F.col("id").cast("long").alias("id"), F.pmod(F.xxhash64("s"), F.col("pieces")).cast("int").alias("piece"), numbers("parts").alias("part"))
        at = [*keys, "part", "piece"]
        types = asked.select(*keys).schema.add("a", "string").add("id", "long").add("score", "integer")
        # few bytes are much work here, so a number of tasks is asked for
        spark = asked.sparkSession
        left, right = (x.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *at) for x in (left, right))
        found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_compare(keys, least), types)
        found = found.groupBy(*keys, "a").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("m"))
        done = done.unionByName(found.select(*keys, "a", (-F.col("m.neg")).alias("id"), F.col("m.score").alias("score")))
    done = settle(done, "best-of-all")
    discard(sizes)
    return done


def best_names(asked: DataFrame, known: DataFrame, keys: list[str], least: int = 1, few: int = 0) -> DataFrame:
    """(keys, a, id, score) of each name of asked (keys, s) that has one of score `least` or more in known (keys, s, id).

    The largest score, then the least id. Equal names score 100. Blocks of
    `few` known names at most meet whole; so do those of which the index would
    make about as many meetings as there are pairs, as where all names are
    alike but for some characters.
    """
    known = known.where(F.length("s") > 0)
    equal = asked.join(known, [*keys, "s"]).where(F.length("s") > 0).select(*keys, F.col("s").alias("a"), "id", F.lit(100).alias("score"))
    ids = known.withColumnRenamed("s", "b")
    found = settle(equal, "equal-names")
    open_ = settle(asked.where(F.length("s") > 0).join(found.withColumnRenamed("a", "s"), [*keys, "s"], "left_anti"), "open-names")
    done = found
    sizes = settle(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), "block-sizes")

    def meet(blocks: DataFrame) -> None:
        nonlocal done, open_
        if blocks.isEmpty() or open_.isEmpty():
            return
        done = done.unionByName(_whole(open_.join(blocks, keys, "left_semi"), known.join(blocks, keys, "left_semi"), keys, least))
        before, open_ = open_, settle(open_.join(blocks, keys, "left_anti"), "open-names")
        discard(before)

    meet(sizes.where(F.col("m") <= few).select(*keys))
    for score, q in steps(least):
        if open_.isEmpty():
            break
        left, right = (settle(x, "prefixes") for x in _indexed(open_, known.select(*keys, "s").join(open_.select(*keys).distinct(), keys, "left_semi"), keys, score, q))
        counts = [x.groupBy(*keys, "gram").agg(F.count(F.lit(1)).cast("double").alias(c)) for x, c in ((left, "l"), (right, "r"))]
        met = counts[0].join(counts[1], [*keys, "gram"]).groupBy(*keys).agg(F.sum(F.col("l") * F.col("r")).alias("met"))
        pairs = open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(sizes, keys)
        alike = settle(met.join(pairs, keys).where(F.col("met") * GRAM_COST > F.col("n").cast("double") * F.col("m")).where("n * m > 10000").select(*keys), "alike")
        meet(alike)
        left, right = (x.join(alike, keys, "left_anti") for x in (left, right))
        pairs = scored(_met(left, right, keys, score), score).join(ids, [*keys, "b"])
        best = pairs.groupBy(*keys, "a").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("m"))
        found = settle(best.select(*keys, "a", (-F.col("m.neg")).alias("id"), F.col("m.score").alias("score")), "similar-names")
        done = done.unionByName(found)
        before, open_ = open_, settle(open_.join(found.withColumnRenamed("a", "s"), [*keys, "s"], "left_anti"), "open-names")
        discard(before)
    discard(open_, sizes)
    return done
