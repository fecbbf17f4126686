"""String column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from legajo.fixed_values import NO_NAME

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def literal_map(entries: Mapping[str, object]) -> Column:
    """A small dictionary as one literal map column."""
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def lookup(entries: Mapping[str, object], key: ColumnLike, default=None) -> Column:
    """Value of a small dictionary, or the default when the key is unknown."""
    found = literal_map(entries)[as_column(key)]
    return found if default is None else F.coalesce(found, F.lit(default))


# fixed values: the characters Unicode calls white space, and the four separators
WHITE_SPACE = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: ColumnLike, characters: str = WHITE_SPACE) -> Column:
    """Trim every kind of white space, or the given characters (no regex: hot path)."""
    return F.btrim(as_column(value), F.lit(characters))


def squeeze(value: ColumnLike) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(as_column(value), r"(?U)\s+", " "))


def is_blank(value: ColumnLike) -> Column:
    column = as_column(value)
    return column.isNull() | (column == "")


def contains_any(text: ColumnLike, terms: Iterable[str]) -> Column:
    column = as_column(text)
    hit = F.lit(False)
    for term in terms:
        hit = hit | column.contains(term)
    return hit


def count_hits(columns: Iterable[ColumnLike], terms: Iterable[str]) -> Column:
    """Number of terms found in at least one of the columns."""
    texts = [as_column(c) for c in columns]
    total = F.lit(0)
    for term in terms:
        hit = F.lit(False)
        for text in texts:
            hit = hit | text.contains(term)
        total = total + hit.cast("int")
    return total


def safe_name(value: ColumnLike) -> Column:
    """Name usable in a path: other characters become one underscore."""
    column = as_column(value)
    cleaned = F.btrim(F.regexp_replace(column, r"[^a-zA-Z0-9_.\-]+", "_"), F.lit("_"))
    return F.when(is_blank(column), F.lit(NO_NAME)).otherwise(cleaned)


def file_name(path: ColumnLike) -> Column:
    return F.regexp_extract(as_column(path), r"([^/]*)$", 1)


def extension(name: ColumnLike) -> Column:
    """Lower-cased suffix with its dot; empty for dot files and bare names."""
    return F.lower(F.regexp_extract(as_column(name), r"[^/](\.[^./]+)$", 1))


def stem(name: ColumnLike) -> Column:
    return F.regexp_replace(file_name(name), r"(?<=.)\.[^./]+$", "")


def about(field: str):
    """Predicate for array elements whose ``field`` is the given one."""
    return lambda element: element["field"] == field
