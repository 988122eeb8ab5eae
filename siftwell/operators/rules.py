"""User-defined rules over cleaned values: six operators, as column expressions without any evaluated code."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import rule_index

OPERATORS = ("gte", "lte", "eq", "in", "regex_match", "not_null")
NUMERIC = ("gte", "lte")
#: Rules up to which each is an expression of the plan.
FEW_RULES = 64
DETECTED_TYPES = ("address", "categorical", "currency", "date", "email", "numeric_age", "phone", "quantity")
#: Constructs that only one of the two pattern languages has.
_FOREIGN_PATTERN = re.compile(r"\(\?\(|\\[phRXGQEHN]|&&|\(\?[aLu]|\(\?-?[imsx]*[aLu]")
#: A pair of characters that stands for one, a named group, and a reference to one.
_SPELLED_OTHERWISE = re.compile(r"\\(.)|\(\?P<(\w+)>|\(\?P=(\w+)\)", re.S)


@dataclass
class Rule:
    rule_id: int
    upload_id: int | None
    name: str
    target_kind: str  # column_name or detected_type
    target_value: str
    condition_operator: str
    condition_value: Any = None  # decoded
    action: str = "flag"
    severity: str = "medium"
    is_active: bool = True
    created_at: Any = None

    def row(self) -> dict:
        return asdict(self) | {"condition_value": None if self.condition_value is None else json.dumps(self.condition_value)}


def satisfied(value: Column, operator: str, condition: Any) -> Column:
    """Whether a cleaned value fulfils the condition; null if it cannot be judged."""
    if operator in NUMERIC:
        number, bound = value.try_cast("double"), F.lit(float(condition))
        return F.when(~F.isnan(number), number >= bound if operator == "gte" else number <= bound)
    if operator == "not_null":
        return F.coalesce(strip(value) != "", F.lit(False))
    text = F.coalesce(value, F.lit("None"))  # a null stands as this text in the three text operators
    if operator == "eq":
        return text == F.lit(str(condition))
    if operator == "in":
        return text.isin([str(x) for x in condition]) if condition else F.lit(False)
    if operator == "regex_match":  # anchored at the start only
        return text.rlike(f"^(?dU:{_translated(condition)})")
    raise ValueError(f"unknown operator {operator!r}")


def violates(value: Column, operator: str, condition: Any) -> Column:
    if operator == "regex_match" and not _pattern_compiles(condition):
        return F.lit(True)
    return ~F.coalesce(satisfied(value, operator, condition), F.lit(False))


def _pattern_compiles(pattern: Any) -> bool:
    try:
        re.compile(pattern)
        return not _FOREIGN_PATTERN.search(pattern)
    except (re.error, TypeError):
        return False


def _translated(pattern: str) -> str:
    """A pattern in the spelling of the engine that runs it: named groups, references to them and the end of the text. Classes of
    characters mean all of Unicode there, and only the line feed ends a line."""
    names = {n: f"g{i}" for i, n in enumerate(re.compile(pattern).groupindex)}

    def spell(m: re.Match) -> str:
        if m[2]:
            return f"(?<{names[m[2]]}>"
        if m[3]:
            return f"\\k<{names[m[3]]}>"
        return r"\z" if m[1] == "Z" else m[0]

    return _SPELLED_OTHERWISE.sub(spell, pattern)


def applies_to(rule: Rule, column: Column, detected_type: Column) -> Column:
    target = column if rule.target_kind == "column_name" else detected_type
    return F.coalesce(target == F.lit(rule.target_value), F.lit(False))


#: What the condition of each operator has to be, and how it is asked for.
_WANTED = {
    "gte": (lambda v: isinstance(v, (int, float)), "a number as its lower bound"),
    "lte": (lambda v: isinstance(v, (int, float)), "a number as its upper bound"),
    "eq": (lambda v: True, "any value"),
    "in": (lambda v: isinstance(v, list), "the values to choose from, as a list"),
    "regex_match": (lambda v: isinstance(v, str) and _pattern_compiles(v), "a pattern that can be run"),
    "not_null": (lambda v: v is None, "no value at all"),
}


def validate(rule: Rule, known_columns: set[str] | None = None, existing: list[Rule] = ()) -> list[str]:
    """Messages on what is wrong with a definition; none if it is sound. Clashes with other rules are looked for in sound ones only."""
    errors = []
    targets = {"detected_type": DETECTED_TYPES, "column_name": known_columns}.get(rule.target_kind)
    if targets is not None and rule.target_value not in targets:
        errors.append(f"There is no {rule.target_kind.replace('_', ' ')} {rule.target_value!r} to check.")
    fits, wanted = _WANTED.get(rule.condition_operator, (None, ""))
    if fits is None:
        errors.append(f"{rule.condition_operator!r} is no operator; there are {', '.join(OPERATORS)}.")
    elif not fits(rule.condition_value):
        errors.append(f"{rule.condition_operator} takes {wanted}, not {rule.condition_value!r}.")
    return errors or _clashes(rule, existing)


def _clashes(rule: Rule, existing: list[Rule]) -> list[str]:
    """Bounds on one target that no value can meet together."""
    out = []
    for other in existing:
        bounds = {r.condition_operator: r.condition_value for r in (rule, other)}
        same = other.is_active and (other.target_kind, other.target_value) == (rule.target_kind, rule.target_value)
        if same and set(bounds) == set(NUMERIC) and bounds["gte"] > bounds["lte"]:
            out.append(f"No value is both at least {bounds['gte']} and at most {bounds['lte']}: this clashes with the rule {other.name!r}.")
    return out


def hits(rules: list[Rule]) -> Column:
    """The active rules that a cell violates, as an array; over the columns column_name, column_type and cleaned_value. Rules
    are constants of the plan."""
    kind = "array<struct<rule_id:bigint,severity:string,action:string>>"
    each = [
        F.when(applies_to(r, F.col("column_name"), F.col("column_type")) & violates(F.col("cleaned_value"), r.condition_operator, r.condition_value), F.struct(F.lit(r.rule_id).cast("bigint").alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action")))
        for r in rules
        if r.is_active
    ]
    return F.array_compact(F.array(*each)) if each else F.array().cast(kind)


def violations(cells: DataFrame, rules: list[Rule]) -> DataFrame:
    """cells: record_id, column_name, column_type, row_index, cleaned_value. One row for each violated rule of a cell, in one
    pass without a join: by an expression a rule for a few rules, by an index of each target for many."""
    if len(rules) > FEW_RULES:
        return rule_index.violations(cells, rules, _pattern_compiles)
    found = cells.select("record_id", "column_name", "row_index", "cleaned_value", hits(rules).alias("hits"))
    return found.select("record_id", "column_name", "row_index", "cleaned_value", F.explode("hits").alias("hit")).select("hit.rule_id", "record_id", "column_name", "row_index", "cleaned_value", "hit.severity", "hit.action")


def violations_of_table(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """As violations, for rules in a table (rule_index.RULE_COLUMNS), of any number: those that can be broadcast are, more stay a table."""
    some = rules.limit(rule_index.MOST + 1).collect()
    if len(some) > rule_index.MOST:
        return rule_index.violations_of_table(cells, rules, _pattern_compiles)
    return violations(cells, [Rule(upload_id=None, name="", **(r.asDict() | {"condition_value": None if r["condition_value"] is None else json.loads(r["condition_value"])})) for r in some])


def counts(found: DataFrame) -> DataFrame:
    """Violations of each rule: rule_id, severity, n."""
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def applied_difference(existing: DataFrame, desired: DataFrame, key: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    """What is to be added and what is to be removed."""
    return desired.join(existing, key, "left_anti"), existing.join(desired, key, "left_anti")
