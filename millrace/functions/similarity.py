"""The similarity score of names, 0 to 100, and its bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[Column, Column], Column]

EXACT, HIGH, LOW = "exact", "high", "new"


def normalised(c: Column) -> Column:
    """Lower case; what is no ASCII letter or digit becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def edit_score(a: Column, b: Column) -> Column:
    """floor(100 * (L - edit distance) / L) of normalised texts, L the longer length; two empty texts score 0."""
    longest = F.greatest(F.length(a), F.length(b))
    points = F.floor((100 * (longest - F.levenshtein(a, b))) / F.when(longest > 0, longest))
    return F.coalesce(points, F.lit(0)).cast("int")


def band(score: Column) -> Column:
    """exact: 100; high: 90 to 99; new: below."""
    return F.when(score >= 100, EXACT).when(score >= 90, HIGH).otherwise(LOW)
