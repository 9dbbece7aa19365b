"""Text, conversion and date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Null, empty or white space of any kind."""
    return c.isNull() | (F.regexp_replace(c, r"\s+", "") == "")


def same_text(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)


def extension(path: Column) -> Column:
    """A path's last extension with its dot, in lower case; '' if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def credentials(header: Column) -> Column:
    """struct(user, secret) of a Basic header's Base64 part; the secret may hold colons."""
    text = F.unbase64(F.regexp_replace(header, r"^(?i:basic)\s+", "")).cast("string")
    parts = F.split(text, ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("user"), F.get(parts, F.lit(1)).alias("secret"))


def url_escape(c: Column) -> Column:
    """Percent-encoding in which a space is %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def to_int(c: Column, strict: bool = True) -> Column:
    """Text to int; text that is none raises, or is null if not strict."""
    return c.cast("int") if strict else c.try_cast("int")


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def whole_seconds(milliseconds: Column) -> Column:
    """Whole seconds of whole milliseconds, without a detour by doubles."""
    ms = milliseconds.cast("long")
    return F.call_function("div", ms - F.pmod(ms, F.lit(1000)), F.lit(1000))


def older_than(created: Column, as_of: Column, days: int) -> Column:
    return created < as_of - F.expr(f"interval {int(days)} days")
