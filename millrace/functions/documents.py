"""Functions over JSON documents and their nested lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CONTENT


def _names(kind: T.DataType) -> list[str]:
    """All field names of a nested type."""
    if isinstance(kind, T.ArrayType):
        return _names(kind.elementType)
    return [n for f in kind.fields for n in (f.name, *_names(f.dataType))] if isinstance(kind, T.StructType) else []


def canonical_names(text: Column, kind: T.DataType = CONTENT) -> Column:
    """JSON text whose keys that differ from the type's names in case alone are these names.

    A quote within a JSON string is escaped, so a name between bare quotes
    before a colon is a key wherever it stands.
    """
    for name in dict.fromkeys(_names(kind)):
        text = F.regexp_replace(text, f'"(?i:{name})"(\\s*:)', f'"{name}"$1')
    return text


def parse(text: Column, any_case: bool = False) -> Column:
    """Document content of JSON text; unknown keys go, a malformed text is null. any_case: names match whatever their case."""
    return F.from_json(canonical_names(text) if any_case else text, CONTENT, {"mode": "PERMISSIVE"})


def render(content: Column) -> Column:
    return F.to_json(content)


def path(text: Column, *keys: str) -> Column:
    """The value at a path of JSON text, as text; JSON null is null."""
    return F.get_json_object(text, "$." + ".".join(keys))


def set_path(content: Column, name: str, value: Column) -> Column:
    """content with one field replaced; name may be a dotted path."""
    return content.withField(name, value)


def first_line(lines: Column, line_id: Column) -> Column:
    """The position (from 1) of the first line of this id without regard to case; 0 if none."""
    ids = F.transform(lines, lambda x: F.lower(x["line_id"]))
    return F.coalesce(F.array_position(ids, F.lower(line_id)), F.lit(0))


def append_line(lines: Column, line: Column) -> Column:
    return F.when(lines.isNull(), F.array(line)).otherwise(F.array_append(lines, line))


def replace_line(lines: Column, line_id: Column, line: Column) -> Column:
    at = first_line(lines, line_id)
    return F.transform(lines, lambda x, i: F.when(i + 1 == at, line).otherwise(x))


def remove_line(lines: Column, line_id: Column) -> Column:
    at = first_line(lines, line_id)
    return F.filter(lines, lambda x, i: i + 1 != at)
