"""Small building blocks of Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` computed once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def array_of(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def contains_any(haystack: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring."""
    return haystack.rlike("|".join(w.replace(".", r"\.") for w in words))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def slug_tail(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def number(c: Column) -> Column:
    """A text as a finite double, null if it is none."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def half_up(c: Column) -> Column:
    """Rounded to the nearest integer, halves towards plus infinity."""
    return F.floor(c + 0.5)
