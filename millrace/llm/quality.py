"""Quality rules: base statistics of a text, and a decision list learned from labels.

Sequential covering grows conjunctions of thresholds that pick low-quality
rows, prunes them on rows set aside and keeps them in order. The list becomes
one conditional Spark expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, chunks, flat_bytes, mix64, settle
from .shingles import SPACE, word_hashes, word_spans

#: Labelled rows that a list is fitted on, at most: those whose ids hash lowest.
FIT_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A rule must be right on this share of what it covers among the rows set aside, and cover this many to be grown.
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_CONDITIONS = 0.9, 8, 16, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines"]
#: What the rules look at: name, and the expression over COUNTS (one or more words are in the text).
RATIOS = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_lines_per_line": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "marks_per_word": "n_marks / n_words",
    "digit_share": "n_digits / word_chars",
}


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


SYMBOL, MARK, DIGIT = _lut(b"#*$%&|<>"), _lut(b"!?"), _lut(b"0123456789")
UPPER = _lut(bytes(range(65, 91)))
POINT = ((np.arange(256) & 0xC0) != 0x80) & ~SPACE  # the first byte of a character in a word
LINE = [("doc_id", None), *[(c, pa.int64()) for c in COUNTS]]


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(words: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = mix64(words[:-2] * np.uint64(3) + mix64(words[1:-1] * np.uint64(5) + mix64(words[2:])))
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= hit
    return int(covered.sum())


def _dup_lines(text: str) -> tuple[int, int]:
    seen: set[str] = set()
    n = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            n += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return dup, n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "text"):
        data, offsets = flat_bytes(chunk.column(1))
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        lines = [_dup_lines(t or "") for t in chunk.column(1).to_pylist()]
        columns = [
            np.diff(first),
            _row_sums(POINT[data], offsets),
            _row_sums(SYMBOL[data], offsets),
            [x[0] for x in lines],
            [_repeated(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)],
            _row_sums(UPPER[data], offsets),
            _row_sums(MARK[data], offsets),
            _row_sums(DIGIT[data], offsets),
            [x[1] for x in lines],
        ]
        yield pa.RecordBatch.from_arrays([chunk.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS (long) of each whole text; a null text counts as empty."""
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS]])
    return bare(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_counts, schema)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    wrong: int

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions)) + f"  ({self.covered} covered, {self.wrong} wrong)"


def _covers(conditions, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.name)]
        out &= v > c.value if c.above else v <= c.value
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The threshold with the largest FOIL gain over the rows."""
    p, n = bad.sum(), len(bad)
    best, found = 1e-9, None
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, hits = x[order, k], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        for above in (False, True):
            got = p - hits[cut] if above else hits[cut]
            all_ = n - cut - 1 if above else cut + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(got > 0, got * (np.log2(got / all_) - np.log2(p / n)), 0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best, found


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], aside: np.ndarray) -> list[Rule]:
    """An ordered list of rules for `bad` rows by sequential covering.

    x: a row of numbers named by `names` for each example; aside: the rows
    that rules are pruned and judged on.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (bad & left & ~aside).sum() >= MIN_COVER:
        rows, conditions = left & ~aside, []
        while len(conditions) < MAX_CONDITIONS and bad[rows].any() and not bad[rows].all():
            _, c = _best_condition(x[rows], bad[rows], names)
            if c is None:
                break
            conditions.append(c)
            rows &= _covers([c], x, names)
        def worth(cs) -> tuple[float, int]:
            hit = _covers(cs, x, names) & left & aside
            p = int((bad & hit).sum())
            return (2 * p - int(hit.sum())) / max(1, int(hit.sum())), p
        while len(conditions) > 1 and worth(conditions[:-1])[0] >= worth(conditions)[0]:
            conditions.pop()
        hit = _covers(conditions, x, names) & left
        judged = hit & aside
        if not conditions or not judged.any() or bad[judged].mean() < MIN_PRECISION:
            break
        rules.append(Rule(tuple(conditions), int(hit.sum()), int((~bad & hit).sum())))
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from `rows` labelled documents at most (labels: doc_id, quality 0 or 1); no labels, no rules."""
    chosen = (
        bare(labels, "doc_id", "quality").where("quality is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # the side has `rows` rows at most by its limit
    sample = stats.where("n_words > 0").join(F.broadcast(chosen), "doc_id").select("doc_id",
        F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(3)).alias("fold"), "quality", *[F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()]
    )
    # of an id that repeats with other texts the least row counts, so that the bound holds
    columns = [c for c in sample.columns if c != "doc_id"]
    got = sample.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toPandas()
    if got.empty:
        return []
    names = list(RATIOS)
    return learn(got[names].to_numpy(float), got["quality"].to_numpy() == 0, names, got["fold"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: one ordered conditional expression over COUNTS."""
    out = F.when(F.col("n_words") == 0, F.lit(False))
    for rule in rules:
        test = F.lit(True)
        for c in rule.conditions:
            value = F.expr(RATIOS[c.name]).cast("double")
            test = test & ((value > c.value) if c.above else (value <= c.value))
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per row: doc_id, COUNTS, base_failed, kept.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT
    of the words in repeated windows. kept: false if base_failed, else the
    list's verdict. Texts that are null, empty or white space fail. Repeated
    rows stay and get equal results; a null doc_id is scored like any other;
    an empty table gives an empty one. Of labels that repeat a doc_id the
    least counts. Other columns are left aside.
    """
    stats = settle(statistics(docs), "statistics")
    rules = fit(stats, labels) if rules is None else rules
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
