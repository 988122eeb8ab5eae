"""The cell: what a cleaner makes of one value.

``STRUCT<original_value, cleaned_value, confidence, method, agent_type, flagged, details>``; details is JSON text so
that the cells of all columns have one type and can be unpivoted together.

A cleaner works in steps. Each step is one projection that names columns made of those of the steps before, so whatever
the cell uses more than once is computed once a row; the optimiser keeps such projections apart. Cells of several
columns share the projections. The last step of a cleaner yields ``method``, which decides everything else in the cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Confidences of results.
HIGH, MEDIUM, LOW, NONE = 95.0, 75.0, 35.0, 0.0
TEXT_NUMBER, HUMAN, RESOLVED_PLACE, RESOLVED_ABROAD = 98.0, 100.0, 80.0, 70.0

CELL_TYPE = "struct<original_value:string,cleaned_value:string,confidence:double,method:string,agent_type:string,flagged:boolean,details:string>"
# Methods that every cleaner may come to.
MISSING, REUSED, UNPARSEABLE, FAILED = "missing_value", "reused_prior_feedback", "unparseable", "error_unprocessed"

Parts = Callable[[str], Column]
Step = Callable[[Parts], dict[str, Column]]


@dataclass(frozen=True)
class Cleaner:
    """steps: the first may use ``raw`` and ``value`` (stripped); among them they yield method and cleaned (null where there is no
    result). confidence: by method, 0 for others; with own_confidence a column of that name says it. flagged: methods
    whose cells need a look, besides the common ones. details: by method, JSON text."""

    agent: str
    steps: tuple[Step, ...]
    confidence: dict[str, float]
    flagged: frozenset[str] = frozenset()
    details: Callable[[Parts], dict[str, Column]] = field(default=lambda p: {})
    own_confidence: bool = False


@dataclass(frozen=True)
class Source:
    """Where a cell comes from: its cleaner, the raw text, and a prior human correction if there may be one."""

    cleaner: Cleaner
    raw: Column
    correction: Column | None = None


def details(**values: Column) -> Column:
    """JSON text of the values, nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


_OUTSIDE = "_outside"


def outside(condition: Column) -> Column:
    """The condition as an array function has it, which Spark evaluates outside of generated code, and its projection with it."""
    return F.exists(F.array(condition), lambda x: x)


def with_cells(df: DataFrame, sources: dict[str, Source]) -> DataFrame:
    """df with a cell column for each of sources, in common projections."""
    if not sources:
        return df
    parts = {out: (lambda name, out=out: F.col(f"`_{out}_{name}`")) for out in sources}
    name = lambda out, columns: {f"_{out}_{k}": c for k, c in columns.items()}
    # The steps of several cleaners side by side make a generated method too large for the JVM to compile, and many times slower.
    # Beside an array function a step is projected outside of it, by methods of moderate size: each step hands on such a column.
    made = df.withColumns({k: c for out, s in sources.items() for k, c in name(out, {"raw": s.raw.cast("string")} | ({} if s.correction is None else {"fix": s.correction})).items()} | {_OUTSIDE: outside(F.spark_partition_id() >= 0)})
    on = {_OUTSIDE: outside(F.col(_OUTSIDE))}
    made = made.withColumns({k: c for out in sources for k, c in name(out, {"value": strip(parts[out]("raw"))}).items()} | on)
    for level in range(max((len(s.cleaner.steps) for s in sources.values()), default=0)):
        made = made.withColumns({k: c for out, s in sources.items() if level < len(s.cleaner.steps) for k, c in name(out, s.cleaner.steps[level](parts[out])).items()} | on)
    made = made.withColumns({k: c for out, s in sources.items() for k, c in name(out, {"how": _method(parts[out], s)}).items()} | on)
    # Inlined from an array of one, the cells are what a later filter starts from: it is not taken apart into the steps.
    cells = F.struct(*[_cell(parts[out], s).alias(out) for out, s in sources.items()])
    made = made.select(*[F.col(f"`{c}`") for c in df.columns], F.array(cells).alias(_OUTSIDE + "cells"), outside(F.col(_OUTSIDE)).alias(_OUTSIDE))
    return made.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.when(F.col(_OUTSIDE), F.col(_OUTSIDE + "cells"))))


def _method(p: Parts, source: Source) -> Column:
    """Missing values come first, then a prior correction, then what the cleaner found."""
    out = F.when(p("value").isNull() | (p("value") == ""), MISSING)
    if source.correction is not None:
        out = out.when(p("fix").isNotNull(), REUSED)
    return out.otherwise(p("method"))


def _cell(p: Parts, source: Source) -> Column:
    c, how = source.cleaner, p("how")
    by_confidence: dict[float, list[str]] = {}
    for method, x in c.confidence.items():
        by_confidence.setdefault(x, []).append(method)
    by_confidence.setdefault(HIGH, []).append(REUSED)
    confidence = F.when(how == MISSING, NONE)
    for x, methods in by_confidence.items():
        confidence = confidence.when(how.isin(methods), x)
    confidence = confidence.otherwise(p("confidence") if c.own_confidence else F.lit(NONE))
    cleaned, original = F.when(how == MISSING, None), F.when(how.isin(MISSING, REUSED, FAILED), p("raw")).otherwise(p("value"))
    if source.correction is not None:
        cleaned = cleaned.when(how == REUSED, p("fix"))
    info = F.when(how == FAILED, '{"error":"unhandled_exception_during_cleaning"}')
    if source.correction is not None:
        info = info.when(how == REUSED, '{"influenced_by_prior_feedback":true}')
    for method, text in c.details(p).items():
        info = info.when(how == method, text)
    return F.struct(
        original.alias("original_value"),
        cleaned.otherwise(p("cleaned")).cast("string").alias("cleaned_value"),
        confidence.alias("confidence"),
        how.alias("method"),
        F.lit(c.agent).alias("agent_type"),
        how.isin(MISSING, UNPARSEABLE, FAILED, *sorted(c.flagged)).alias("flagged"),
        info.otherwise("{}").alias("details"),
    )


def cells_of(df: DataFrame, raw: Column, cleaner: Cleaner, out: str = "cell", correction: Column | None = None) -> DataFrame:
    """df with one cell column."""
    return with_cells(df, {out: Source(cleaner, raw, correction)})
