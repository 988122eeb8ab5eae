"""Quantities: a number with a currency, a magnitude or a unit around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import HIGH, MEDIUM, UNPARSEABLE, Cleaner, Parts, details
from ..functions.text import lookup, strip, two_decimals

AGENT = "QuantityAgent"
# Currency symbols and codes, magnitudes and units.
SYMBOLS = {"$": "USD", "€": "EUR", "₺": "TRY", "₹": "INR", "£": "GBP"}
MAGNITUDES = {"k": 1e3, "l": 1e5, "lac": 1e5, "lacs": 1e5, "lakh": 1e5, "lakhs": 1e5, "cr": 1e7, "crore": 1e7, "m": 1e6, "mn": 1e6}
UNITS = {"sq.ft": "sqft", "sqft": "sqft", "sq ft": "sqft", "%": "percent"}


# Fixed value: the grammar of a quantity: currency, number, magnitude, unit.
GRAMMAR = r"(?i)^\s*([$€₺₹£]|USD|EUR|TRY|INR|GBP)?\s*(\d[\d,.]*)\s*(lakhs|crore|lakh|lacs|lac|cr|mn|k|l|m)?\s*(?:/\s*)?(sq\.ft|sq ft|sqft|%)?\s*$"
METHOD = "quantity_normalized"
#: Parts the groups of a match; no quantity holds it.
_BAR = "\x01"


def groups(value: Column) -> Column:
    """The grammar's four groups, empty where one is missing; an array of one element if the value is no quantity."""
    return F.split(F.regexp_replace(value, GRAMMAR, _BAR.join(f"${i}" for i in range(1, 5))), _BAR)


def _shape(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), "plain").when(text.rlike(r"^\d+,\d{1,2}$"), "comma").when(text.rlike(r"^\d{1,3}(\.\d{3})+$"), "dots").otherwise("ambiguous")


def _literal(text: Column, shape: Column) -> Column:
    """The number as a computer reads it; of ambiguous separators the last is the decimal one."""
    drop = lambda c, what: F.replace(c, F.lit(what), F.lit(""))
    point = lambda c: F.replace(c, F.lit(","), F.lit("."))
    comma_last = text.contains(",") & text.contains(".") & (F.length(F.substring_index(text, ",", -1)) < F.length(F.substring_index(text, ".", -1)))
    best_effort = F.when(comma_last, point(drop(text, "."))).otherwise(drop(text, ","))
    return F.when(shape == "plain", text).when(shape == "comma", point(text)).when(shape == "dots", drop(text, ".")).otherwise(best_effort)


def _named(found: Column) -> dict[str, Column]:
    """currency_code, magnitude (as typed), factor and unit of the groups."""
    currency, magnitude, unit = [F.nullif(F.get(found, F.lit(i)), F.lit("")) for i in (0, 2, 3)]
    return {"currency_code": F.coalesce(lookup(SYMBOLS, currency), F.upper(currency)), "magnitude": magnitude, "factor": F.coalesce(lookup(MAGNITUDES, F.lower(magnitude)), F.lit(1.0)), "unit": lookup(UNITS, F.lower(unit))}


def looks_like(value: Column) -> Column:
    """Parses, and has a currency, a magnitude or a unit."""
    found = groups(strip(value))
    number = F.get(found, F.lit(1))
    marked = F.concat(F.get(found, F.lit(0)), F.get(found, F.lit(2)), F.get(found, F.lit(3))) != ""
    return F.coalesce((F.size(found) == 4) & marked & _literal(number, _shape(number)).try_cast("double").isNotNull(), F.lit(False))


def cleaner() -> Cleaner:
    def parse(p: Parts) -> dict[str, Column]:
        return {"groups": groups(p("value"))}

    def name(p: Parts) -> dict[str, Column]:
        return {"number": F.when(F.size(p("groups")) == 4, F.get(p("groups"), F.lit(1)))} | _named(p("groups"))

    def shape(p: Parts) -> dict[str, Column]:
        return {"shape": _shape(p("number"))}

    def amount(p: Parts) -> dict[str, Column]:
        return {"amount": _literal(p("number"), p("shape")).try_cast("double") * p("factor")}

    def judge(p: Parts) -> dict[str, Column]:
        return {"method": F.when(p("amount").isNotNull(), METHOD).otherwise(UNPARSEABLE), "cleaned": two_decimals(p("amount")), "confidence": F.when(p("amount").isNull(), 0.0).when(p("shape") == "ambiguous", MEDIUM).otherwise(HIGH)}

    info = lambda p: {METHOD: details(currency_code=p("currency_code"), magnitude=p("magnitude"), unit=p("unit"))}
    return Cleaner(AGENT, (parse, name, shape, amount, judge), {}, details=info, own_confidence=True)
