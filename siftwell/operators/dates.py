"""Dates: four shapes to ISO, with the column's own day-first evidence for ambiguous ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import FAILED, HIGH, LOW, MEDIUM, UNPARSEABLE, Cleaner, Parts, cells_of, details
from ..functions.text import calendar_date, is_missing, lookup, strip

AGENT = "DateAgent"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
TEXTUAL = r"^[A-Za-z]+ \d{1,2},?\s*\d{4}$"
NUMERIC = r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"
#: A majority needs so many rows that tell day from month.
LEAST_EVIDENCE = 3
# Names of the months and their short forms.
MONTHS = {
    **{m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())},
    **{m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())},
    "sept": 9,
}
# Methods.
ISO_PARSE, MONTH_PARSE, SURE, MAJORITY, GUESS, INVALID = "iso_parse", "textual_month_parse", "unambiguous_day_gt_12", "majority_pattern_inference", "ambiguous_guessed_low_confidence", "invalid_date_components"


def votes(value: Column) -> list[Column]:
    """Aggregates: rows whose first part must be the day, and rows whose second must."""
    parts = F.split(F.when(strip(value).rlike(NUMERIC), strip(value)), "[/-]")
    a, b = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return [F.count_if((a > 12) & (b <= 12)).alias("first_day"), F.count_if((b > 12) & (a <= 12)).alias("second_day")]


def day_first_evidence(df: DataFrame, column: str) -> DataFrame:
    """One row: first_day, second_day, day_first (null without evidence; a tie counts as day first), evidence."""
    counted = df.agg(*votes(F.col(column)))
    total = F.col("first_day") + F.col("second_day")
    return counted.withColumns({"day_first": F.when(total > 0, F.col("first_day") >= F.col("second_day")), "evidence": total})


def cleaner(day_first: Column, evidence: Column) -> Cleaner:
    """day_first and evidence: the column's, see day_first_evidence."""

    def shape(p: Parts) -> dict[str, Column]:
        v = p("value")
        return {"shape": F.when(v.rlike(ISO), "iso").when(v.rlike(TEXTUAL), "textual").when(v.rlike(NUMERIC), "numeric")}

    def split(p: Parts) -> dict[str, Column]:
        return {"parts": F.when(p("shape").isNotNull(), F.split(p("value"), r"[\s,/-]+"))}

    def name(p: Parts) -> dict[str, Column]:
        a, b, c = [F.get(p("parts"), F.lit(i)) for i in range(3)]
        of = lambda iso, textual, numeric: F.when(p("shape") == "iso", iso).when(p("shape") == "textual", textual).otherwise(numeric)
        end = F.concat(b, F.coalesce(c, F.lit("")))  # day and year may stand without anything in between
        month = lookup(MONTHS, F.lower(a)).cast("string")
        return {"year": of(a, F.right(end, F.lit(4)), c), "month": of(b, month, b), "day": of(c, F.left(end, F.length(end) - 4), a)}

    def read(p: Parts) -> dict[str, Column]:
        y, m, d = p("year"), p("month"), p("day")
        numeric = p("shape") == "numeric"
        day, month = d.try_cast("int") > 12, m.try_cast("int") > 12
        decided = day_first.isNotNull() & (evidence >= LEAST_EVIDENCE)
        kind = F.when(p("shape") == "iso", ISO_PARSE).when(p("shape") == "textual", MONTH_PARSE).when(day & month, INVALID).when(day | month, SURE).when(decided, MAJORITY).otherwise(GUESS)
        # The first part is the day unless only the second can be, or the column says so.
        swapped = numeric & ~day & (month | (decided & ~day_first))
        return {"kind": F.when(p("shape").isNotNull(), kind), "date": calendar_date(y, F.when(swapped, d).otherwise(m), F.when(swapped, m).otherwise(d))}

    def judge(p: Parts) -> dict[str, Column]:
        kind, date = p("kind"), p("date")
        method = F.when(kind.isNull(), UNPARSEABLE).when((kind == INVALID) | ((kind == GUESS) & date.isNull()), INVALID).when(date.isNull(), FAILED).otherwise(kind)
        return {"method": method, "cleaned": F.when(kind != INVALID, date.cast("string"))}

    return Cleaner(
        AGENT,
        (shape, split, name, read, judge),
        {ISO_PARSE: HIGH, MONTH_PARSE: HIGH, SURE: HIGH, MAJORITY: MEDIUM, GUESS: LOW},
        frozenset({GUESS, INVALID}),
        lambda p: {MAJORITY: details(column_dayfirst_evidence_count=evidence)},
    )


def clean_column(df: DataFrame, column: str, out: str, correction: Column | None = None) -> DataFrame:
    """Adds the cells of a date column; its evidence is one aggregate over the column, used as a scalar subquery."""
    found = day_first_evidence(df.where(~is_missing(F.col(column))), column).select(F.struct("day_first", "evidence")).scalar()
    return cells_of(df, F.col(column), cleaner(found["day_first"], found["evidence"]), out, correction)
