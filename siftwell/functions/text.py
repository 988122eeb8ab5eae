"""Text and number expressions shared by the cleaners: built-in functions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all kinds, as a general-purpose language strips it.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def is_missing(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def two_decimals(number: Column) -> Column:
    """A double as text with two decimals, rounded half to even on its exact binary value, without grouping."""
    return F.call_function("format_number", number, F.lit("0.00"))


def lookup(table: dict, key: Column) -> Column:
    """A constant table as a map expression; null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date from texts of digits; null where there is no such day."""
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")


def first_held(text: Column, table: Column, part: str) -> Column:
    """The first element of an array of structs whose field the text contains; null if there is none."""
    return F.get(F.filter(table, lambda x: F.contains(text, x[part])), F.lit(0))


def contains_any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
