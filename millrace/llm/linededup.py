"""Fuzzy deduplication of lines over a whole corpus by MinHash.

Lines (lower case, stripped) that are equal are one class, however short.
Classes of SHINGLE characters or more get one-permutation MinHash signatures
of their character shingles, and bands of the signatures meet in groups. A
group's lines are first compared with one centre by exact Jaccard similarity,
groups that this leaves in many pieces with further centres; then all pairs of
a group that are still in different components are compared, but for those
that the sizes and parity maps of their sets rule out. Connected
components of the links keep the line that comes first by (doc_id, text,
line number). All other lines of a component go.

A line's class is a 64-bit hash; a second one tells apart different lines that
share it, of which only the class of the least second hash is compared: the
others stay, as no line goes that exact comparison would keep. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, bare, chunks, discard, in_files, mix64, settle, small
from .components import connected_components
from .shingles import BASE, distinct

#: Characters of a shingle (a power of two), a shorter line being one of its own; lines of fewer characters than MIN_CHARS (blank ones) are left alone.
SHINGLE, MIN_CHARS = 8, 1
PERCENT = 80
#: Bands of rows of a signature: a pair of similarity 0.8 shares one with probability 0.985, of 0.9 with 0.9999.
BINS, BANDS, ROWS = 32, 8, 4
#: Bits of the parity map that bounds how much two shingle sets differ, in columns of 64; fewer would say little of lines of 500 characters.
PARITIES = 1024
MAPS = [f"p{k}" for k in range(PARITIES // 64)]
#: Pairs for each line of a group up to which all are compared at once, and the share of them that a round of centres must not leave to be worth another.
PAIRS_A_LINE, ROUND_LEAVES = 4, 0.75
#: Lines of a group's largest component that a round compares the others with.
PROBES = 8
#: Characters of lines whose shingles are worked out at once.
PART = 1 << 14
#: Bytes of text whose equal lines are signed once.
SIGN_BYTES = 1_000_000


def _lines(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").lower().split("\n")]


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines end to end, the places of those that reach from one line into the next, and where lines end; lines have SHINGLE characters at least."""
    hashes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes += np.uint64(1)
    work = np.empty_like(hashes)
    # a polynomial over SHINGLE characters, by doubling
    step = 1
    while step < SHINGLE:
        n = len(hashes) - step
        np.multiply(hashes[step:], np.uint64(pow(int(BASE), step, 2**64)), out=work[:n])
        hashes = hashes[:n]
        hashes += work[:n]
        step *= 2
    _mix_in_place(hashes, work[: len(hashes)])
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    return hashes, (ends[:-1, None] - np.arange(1, SHINGLE)).ravel(), ends


def _mix_in_place(x: np.ndarray, work: np.ndarray) -> None:
    """mix64 without new arrays, of which a chunk would need a dozen."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=work)
        x ^= work
        if factor is not None:
            x *= np.uint64(factor)


def _parts(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Lines, and the first one's place, of PART characters or so, whose arrays stay in a core's cache."""
    start = size = 0
    for k, line in enumerate(lines):
        size += len(line)
        if size >= PART:
            yield start, lines[start : k + 1]
            start, size = k + 1, 0
    if start < len(lines):
        yield start, lines[start:]


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys (BANDS 64-bit numbers) of each line."""
    none = np.uint64(2**64 - 1)
    least = np.full((len(lines), BINS), none)
    for start, part in _parts(lines):
        hashes, across, ends = _shingles(part)
        bins = np.repeat(np.arange(0, len(part) * BINS, BINS), np.diff(ends, prepend=0))[: len(hashes)]
        bins += (hashes & np.uint64(BINS - 1)).view(np.int64)
        hashes >>= np.uint64(5)
        hashes[across] = none  # the least of a bin is what it was
        np.minimum.at(least[start : start + len(part)].reshape(-1), bins, hashes)
    # an empty bin takes what the last full bin before it has, going round
    twice = np.concatenate((least, least), axis=1)
    last = np.maximum.accumulate(np.where(twice != none, np.arange(2 * BINS), -1), axis=1)[:, BINS:]
    away = (np.arange(BINS, 2 * BINS) - last).astype(np.uint64)
    filled = mix64(np.take_along_axis(twice, last, axis=1) + away * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + filled[:, band * ROWS + row])
        keys[:, band] = key
    return keys


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Each line's sorted distinct shingles."""
    if not lines:
        return []
    hashes, _, ends = _shingles(lines)
    return [distinct(hashes[a : b - SHINGLE + 1]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def set_sizes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of different shingles of each line, and its parity map.

    A bit is the parity of the number of shingles that fall to it: where two
    lines' bits differ, a shingle is in one of them only.
    """
    sizes = np.zeros(len(lines), np.int64)
    maps = np.zeros((len(lines), PARITIES // 64), np.int64)
    for start, part in _parts(lines):
        sets = shingle_sets(part)
        own = slice(start, start + len(part))
        sizes[own] = [len(s) for s in sets]
        bits = (np.concatenate(sets) >> np.uint64(20) & np.uint64(PARITIES - 1)).astype(np.int64)
        bits += np.repeat(np.arange(0, len(part) * PARITIES, PARITIES), sizes[own])
        odd = (np.bincount(bits, minlength=len(part) * PARITIES) & 1).astype(np.uint8)
        maps[own] = np.packbits(odd.reshape(len(part), PARITIES), axis=1).view(np.int64)
    return sizes, maps


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `percent` hundredths or more."""
    both = np.sort(np.concatenate((a, b)))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _hashes(lines: list[str]) -> np.ndarray:
    """Two signed 64-bit hashes of each line: of its class, and what tells different lines of one class apart."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(line.encode()) for line in lines]), "<i8").reshape(-1, 2)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text", SIGN_BYTES):
        names: dict[str, int] = {}
        which, rows, numbers, fresh, fresh_at = [], [], [], [], []
        for row, text in enumerate(chunk.column(1).to_pylist()):
            for number, line in enumerate(_lines(text)):
                if len(line) < MIN_CHARS:
                    continue
                name = names.get(line)
                if name is None:
                    name = names[line] = len(names)
                    if len(line) >= SHINGLE:
                        fresh.append(line)
                        fresh_at.append(len(which))
                which.append(name)
                rows.append(row)
                numbers.append(number)
        both = _hashes(list(names))[np.array(which, np.int64)]
        bands = signatures(fresh).view(np.int64).ravel() if fresh else np.zeros(0, np.int64)
        counts = np.zeros(len(which), np.int64)
        counts[fresh_at] = BANDS
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), chunk.column(0).take(rows), chunk.column(2).take(rows), pa.array(numbers, pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(bands)),
            ],
            names=["key", "check", "doc_id", "text_key", "line", "bands"],
        )


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text", SIGN_BYTES):
        lines = list(dict.fromkeys(line for text in chunk.column(0).to_pylist() for line in _lines(text) if len(line) >= SHINGLE))
        both = _hashes(lines)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(lines, pa.string())], names=["key", "check", "content"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "content"):
        sizes, maps = set_sizes(chunk.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(sizes, pa.int64()), *[pa.array(maps[:, k].copy()) for k in range(len(MAPS))]], names=["key", "check", "content", "n", *MAPS])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for once in chunks([whole], "a_content"):
            for chunk in chunks([once], "b_content"):
                ones, twos = chunk.column(2).to_pylist(), chunk.column(3).to_pylist()
                lines = list(dict.fromkeys(ones + twos))
                sets = dict(zip(lines, shingle_sets(lines), strict=True))
                keep = [similar(sets[x], sets[y]) for x, y in zip(ones, twos, strict=True)]
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _side(texts: DataFrame, side: str, *columns: str) -> DataFrame:
    """The named columns and those of `_may_link` under names of this side."""
    return texts.select(*[F.col(c).alias(f"{side}_{c}") for c in ("key", *columns, "n", *MAPS)])


def _may_link() -> str:
    """What sizes and parity maps leave possible; no pair that is similar enough fails it."""
    apart = " + ".join(f"bit_count(a_{p} ^ b_{p})" for p in MAPS)
    return f"100 * least(a_n, b_n) >= {PERCENT} * greatest(a_n, b_n) and {100 - PERCENT} * (a_n + b_n) >= {100 + PERCENT} * ({apart})"


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) those that are similar enough, settled."""
    one = _side(texts, "a", "content")
    two = _side(texts, "b", "content")
    both = pairs.join(one, F.col("a") == F.col("a_key")).join(two, F.col("b") == F.col("b_key")).where(_may_link())
    return settle(both.select("a", "b", "a_content", "b_content").mapInArrow(_verify, "a long, b long"), "line-links")


def _open(placed: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The groups whose lines are in several components, each with its largest (main), settled; and how many pairs those leave."""
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"))
    # the largest component of a group is on one side only, so that the lines of a large one don't meet each other
    found = parts.groupBy("band").agg(F.max(F.struct("size", "component")).alias("c"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size")).where("parts > 1")
    found = found.select("band", F.col("c.component").alias("main"), ((F.col("size") - F.col("c.size")) * F.col("size")).alias("cost"))
    found = settle(in_files(found, rows), "open")
    return found, found.agg(F.sum("cost")).first()[0] or 0


def _open_lines(placed: DataFrame, open_: DataFrame, texts: DataFrame) -> DataFrame:
    """The lines of the open groups with their group's main component, sizes and parity maps, settled."""
    return settle(placed.join(small(open_.select("band", "main")), "band").join(texts.select("key", "n", *MAPS), "key"), "left")


def _centre_pairs(placed: DataFrame, open_: DataFrame, texts: DataFrame, turn: int, rows: int) -> DataFrame:
    """Of each open group: its lines outside the main component with PROBES lines of it, and one of the former with all of other components, where they may link."""
    left = _open_lines(placed, open_, texts)
    h = F.xxhash64("key", F.lit(turn))
    line = F.struct(h.alias("h"), "key", "component", "n", *MAPS)
    other = left.where("component != main")
    probes = left.where("component = main").groupBy("band", F.pmod(h, F.lit(PROBES)).alias("slot")).agg(F.min(line).alias("c"))
    centre = other.groupBy("band").agg(F.min(line).alias("c"))
    probes, centre = [_side(df.select("band", "c.*"), "b", "component", "band") for df in (probes, centre)]
    same = F.col("a_band") == F.col("b_band")
    met = _side(other, "a", "band").join(probes, same).where(_may_link()).select("a_key", "b_key")
    met = met.union(_side(left, "a", "component", "band").join(centre, same).where("a_component != b_component").where(_may_link()).select("a_key", "b_key"))
    pairs = met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()
    pairs = settle(in_files(pairs, rows * (PROBES + 1)), "pairs")
    discard(left)
    return pairs


def _other_pairs(placed: DataFrame, open_: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs of a group that are in different components and may link."""
    left = _open_lines(placed, open_, texts)
    one = _side(left.where("component != main"), "a", "component", "band", "main")
    two = _side(left, "b", "component", "band")
    met = one.join(two, F.col("a_band") == F.col("b_band"))
    met = met.where("a_component != b_component and (b_component = a_main or a_key < b_key)").where(_may_link())
    pairs = settle(met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct(), "pairs")
    discard(left)
    return pairs


def _merged(placed: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """`placed` with the components that links join made one; their ends are components, few as they are."""
    named = settle(in_files(placed.select("key", "component").distinct(), rows), "named")
    ends = links.join(named.select(F.col("key").alias("a"), F.col("component").alias("ca")), "a").join(named.select(F.col("key").alias("b"), F.col("component").alias("cb")), "b")
    roots = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select("node", F.col("component").alias("root"))
    roots = settle(in_files(roots, rows), "roots")
    out = placed.join(small(roots), F.col("component") == F.col("node"), "left").select("band", "key", F.coalesce("root", "component").alias("component"))
    out = settle(in_files(out, rows), "placed")
    discard(named, roots, placed)
    return out


def _classes(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, check, root) of the lines that are similar to others, settled; root is the least key of their component."""
    banded = signed.where(F.size("bands") > 0).select("key", F.explode("bands").alias("band"))
    # a line that many chunks repeat is one partial row a task here; no task takes a group
    shared = settle(banded.groupBy("band").agg(F.min("key").alias("centre"), F.max("key").alias("last")).where("centre != last").select("band", "centre"), "shared")
    grouped = settle(banded.join(small(shared), "band").select("band", "key", "centre").distinct(), "groups")
    rows = grouped.count()
    first = settle(in_files(grouped.where("key != centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct(), rows), "pairs")
    wanted = settle(in_files(grouped.select("key").distinct(), rows), "wanted")
    texts = docs.select("text").mapInArrow(_line_texts, "key long, check long, content string").join(small(wanted), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.min(F.struct("check", "content")).alias("r")).select("key", "r.*")
    texts = settle(texts.mapInArrow(_measure, "key long, check long, content string, n long, " + ", ".join(f"{p} long" for p in MAPS)), "texts")
    links = _links(first, texts)
    labels = settle(in_files(connected_components(links), rows), "labels")
    placed = grouped.join(small(labels), F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    placed = settle(in_files(placed, rows), "placed")
    # further centres while what they leave is many times the lines and each round leaves less
    before, turn = None, 0
    open_, cost = _open(placed, rows)
    while cost > PAIRS_A_LINE * rows and (before is None or cost <= ROUND_LEAVES * before):
        pairs = _centre_pairs(placed, open_, texts, turn, rows)
        more = _links(pairs, texts)
        discard(open_, pairs)
        placed = _merged(placed, more, rows)
        discard(more)
        before, turn = cost, turn + 1
        open_, cost = _open(placed, rows)
    # the rest is compared pair by pair
    others = _other_pairs(placed, open_, texts)
    more = _links(others, texts)
    placed = _merged(placed, more, rows)
    joined = placed.select("key", F.col("component").alias("root")).distinct()
    # a line alone in its component is in no class
    classes = joined.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("root")
    out = settle(in_files(joined.join(classes, "root").join(texts.select("key", "check"), "key").select("key", "check", "root"), rows), "classes")
    discard(shared, grouped, first, wanted, texts, links, labels, placed, open_, others, more)
    return out


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, lines): the numbers of the lines to remove, for each id and text that has any.

    text_key is Spark's xxhash64 of the text, so that different texts under
    one id, or under none, keep their own lines.
    """
    docs = bare(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    signed = settle(docs.mapInArrow(_sign, "key long, check long, doc_id long, text_key long, line int, bands array<long>"), "lines")
    classes = _classes(signed, docs)
    repeated = signed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("first")).where("n > 1")
    involved = repeated.join(classes, "key", "full_outer").select("key", F.coalesce("check", "first").alias("check"), F.coalesce("root", "key").alias("root"))
    involved = settle(involved, "involved")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line")
    places = signed.drop("bands").join(small(involved), ["key", "check"]).select("root", place.alias("place"))
    places = settle(places, "places")
    winners = settle(places.groupBy("root").agg(F.min("place").alias("winner")).where("root is not null"), "winners")
    gone = places.join(small(winners), "root").where("place != winner")
    out = gone.groupBy("place.doc_id", "place.text_key").agg(F.sort_array(F.collect_set("place.line")).alias("lines"))
    out = settle(out, "removed")
    discard(signed, classes, involved, places, winners)
    return out


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        t, g = names.index("text"), names.index("_removed")
        texts, counts, totals = [], [], []
        for text, lines in zip(batch.column(t).to_pylist(), batch.column(g).to_pylist(), strict=True):
            split = [] if text is None else text.split("\n")
            gone = set(lines or ())
            texts.append("\n".join(x for k, x in enumerate(split) if k not in gone) if gone else text)
            counts.append(len(gone))
            totals.append(len(split))
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names) if n != "_removed"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(counts, pa.int64())], names=[*[n for n in names if n != "_removed"], "n_lines", "n_removed"])


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with the duplicate lines taken out of text, and n_lines, n_removed.

    Lines are what "\\n" parts; those blank after stripping are never removed,
    those of fewer than SHINGLE characters only as equals of another. One
    changed character costs a line of n characters up to 2 * SHINGLE of its
    n + 1 or so shingles, so a fuzzy copy of under 80 characters is found only
    where it differs at an end. A null text stays null, with no lines; an empty
    one has one line. Of rows that repeat a doc_id each text is a document of
    its own; rows that repeat both are one document, and each of them loses
    the same lines. A null doc_id comes after all others. An empty table gives
    an empty one. All columns are kept; docs must not have columns n_lines,
    n_removed, or any that begins with _removed (ValueError).
    """
    taken = {c for c in docs.columns if c in ("n_lines", "n_removed") or c.startswith("_removed")}
    if taken:
        raise ValueError(f"columns are taken: {sorted(taken)}")
    removed = duplicate_lines(docs).select(F.col("doc_id").alias("_removed_id"), F.col("text_key").alias("_removed_key"), F.col("lines").alias("_removed"))
    # few numbers in all go to every executor, so that texts stay where they are; beyond that both sides are shuffled
    if (removed.agg(F.sum(F.size("_removed") + 2)).first()[0] or 0) <= 2 * SMALL_ROWS:
        removed = F.broadcast(removed)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_removed_id")) & (F.xxhash64(docs["text"]) == F.col("_removed_key"))
    joined = docs.join(removed, same, "left").drop("_removed_id", "_removed_key")
    schema = docs.schema.add("n_lines", "long").add("n_removed", "long")
    return joined.mapInArrow(_drop, schema)
