"""The truth table of the operators, validation and violations."""

import random

import pytest

from siftwell.operators import rule_index, rules
from siftwell.operators.rules import Rule, validate, violations


def rule(op, value=None, kind="column_name", target="v", i=1, **more):
    return Rule(i, 1, f"r{i}", kind, target, op, value, **more)


def broken(spark, rules, values, column_type=None):
    cells = spark.createDataFrame([(i, "v", column_type, i, v) for i, v in enumerate(values)], "record_id bigint, column_name string, column_type string, row_index bigint, cleaned_value string")
    return sorted((r["rule_id"], r["row_index"]) for r in violations(cells, rules).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_many_rules_are_judged_as_a_few(spark, monkeypatch, seed):
    """The index against an expression a rule: all operators, two kinds of targets, odd values."""
    r = random.Random(seed)
    made = []
    for i in range(120):
        op = r.choice(["gte", "lte", "eq", "in", "regex_match", "not_null"])
        value = {"gte": r.choice([r.randint(-5, 30), 7.5]), "lte": r.randint(-5, 30), "eq": r.choice([5, "a", "None", 5.0, True]), "in": r.choice([[], ["a", 5], ["", "None"], ["7"]]), "regex_match": r.choice(["a", "[0-9]+$", "(", "(?P<x>a)(?P=x)", "", "N", "(?i)A", r"\\d{2}"]), "not_null": None}[op]
        made.append(rule(op, value, *r.choice([("column_name", "v"), ("column_name", "w"), ("detected_type", "currency"), ("detected_type", "date")]), i=i, is_active=r.random() < 0.9, severity=r.choice(["low", "high"])))
    values = ["10", "7", "7.5", "5", "5.0", "a", "aa", "A", "abc", None, "", "  ", "NaN", "-3", "1e1", "None", "True", "inf", "29", "٣٣"]
    cells = spark.createDataFrame([(i, c, t, i, v) for i, v in enumerate(values) for c, t in (("v", "currency"), ("w", None), ("x", "date"), ("x", None))], "record_id bigint, column_name string, column_type string, row_index bigint, cleaned_value string")
    found = lambda: sorted(map(repr, violations(cells, made).collect()))
    many = found()
    monkeypatch.setattr(rules, "FEW_RULES", 1000)
    assert many == found() and len(many) > 1000
    monkeypatch.setattr(rules, "FEW_RULES", 1)
    monkeypatch.setattr(rule_index, "PIECE", 10)
    assert many == found()


def rows(found):
    return [r for _, r in found]


@pytest.mark.parametrize(
    "op, value, values, wrong",
    [
        ("gte", 10, ["10", "9.5", "abc", None, "NaN"], [1, 2, 3, 4]),
        ("lte", 10, ["10", "10.5", "", "-3"], [1, 2]),
        ("eq", 5, ["5", "5.0", None], [1, 2]),
        ("eq", 5.0, ["5", "5.0"], [0]),
        ("in", ["active", "archived", ""], ["active", "gone", ""], [1]),
        ("in", [], ["a"], [0]),
        ("regex_match", "ab", ["abc", "xab", None], [1, 2]),
        ("regex_match", ".*", [None, ""], []),
        ("regex_match", "(", ["a"], [0]),
        ("regex_match", r"(?P<first_one>a)b(?P=first_one)\Z", ["aba", "abab", "abb"], [1, 2]),
        ("regex_match", r"\w\d$", ["é٣", "é٣\n", "é٣x"], [2]),
        ("regex_match", "a.b", ["a\rb", "a\nb"], [1]),
        ("not_null", None, ["x", "", "  ", None], [1, 2, 3]),
    ],
)
def test_operators(spark, op, value, values, wrong):
    assert rows(broken(spark, [rule(op, value)], values)) == wrong


def test_two_rules_over_three_cells(spark):
    both = [rule("in", ["active", "archived"], i=1), rule("not_null", i=2)]
    assert broken(spark, both, ["active", "archived", ""]) == [(1, 2), (2, 2)]


def test_targets(spark):
    assert broken(spark, [rule("gte", 5, "detected_type", "currency")], ["1"], "currency") == [(1, 0)]
    assert broken(spark, [rule("gte", 5, "detected_type", "currency")], ["1"]) == []
    assert broken(spark, [rule("gte", 5, target="other")], ["1"]) == []
    assert broken(spark, [rule("gte", 5, is_active=False)], ["1"]) == []
    assert broken(spark, [], ["1"]) == []


def test_validation():
    assert validate(rule("gte", 5)) == []
    assert validate(rule("gte", "5")) and validate(rule("in", "a")) and validate(rule("regex_match", "(")) and validate(rule("not_null", 1))
    assert validate(rule("gte", 5, target="w"), {"v"}) and not validate(rule("gte", 5), {"v"})
    assert validate(rule("gte", 5, "detected_type", "colour"))
    assert "clashes" in validate(rule("gte", 10), None, [rule("lte", 5, i=2)])[0]
    assert validate(rule("gte", 5), None, [rule("lte", 5, i=2), rule("lte", 1, target="w", i=3)]) == []
    assert "clashes" in validate(rule("lte", 1), None, [rule("gte", 5, i=2)])[0]


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    """Blocks of a table of rules and shares of the cells: what single rules say, null cells and numbers included."""
    made = [rules.Rule(i, None, "", *target, op, value) for i, (target, (op, value)) in enumerate(((t, c) for t in (("column_name", "v"), ("detected_type", "currency")) for c in [("gte", 2.5), ("lte", 3), ("eq", "7"), ("in", ["1", "x"]), ("regex_match", "[0-9]"), ("not_null", None)]), 1)]
    made[4].is_active = False
    cells = spark.createDataFrame([(i, "v" if i % 2 else "w", "currency" if i % 3 else None, i, v) for i, v in enumerate(["1", "2.5", None, "x", "7", " ", "9.25", "3", "12", "NaN"] * 3)], "record_id long, column_name string, column_type string, row_index long, cleaned_value string")
    want = sorted(map(tuple, rules.violations(cells, made).select("rule_id", "record_id", "cleaned_value", "severity").collect()), key=str)
    rows = spark.createDataFrame([tuple(r.row()[c] for c in rule_index.RULE_COLUMNS) for r in made], "rule_id long, target_kind string, target_value string, condition_operator string, condition_value string, action string, severity string, is_active boolean")
    same = lambda found: sorted(map(tuple, found.select("rule_id", "record_id", "cleaned_value", "severity").collect()), key=str) == want
    assert same(rules.violations_of_table(cells, rows)) and same(rule_index.violations_of_table(cells, rows, rules._pattern_compiles, 4, 7))
    monkeypatch.setattr(rule_index, "MOST", 5)
    assert same(rules.violations_of_table(cells, rows))


def test_what_python_gives_does_not_grow_with_the_pairs(monkeypatch):
    """2,000 cells by 3,000 rules that most of them break: tiles hold each pair once, and cells and rules by far fewer times than pairs.
    A pattern that many rules share is one."""
    import numpy as np
    import pyarrow as pa

    made = [rule(*[("gte", i % 700), ("lte", 900 - i % 700), ("regex_match", "[13]"), ("in", [str(i % 50), "x"]), ("not_null",)][i % 5], i=i) for i in range(3000)]
    texts = [[str(i % 1000), None, " ", "NaN"][max(0, i % 40 - 36)] for i in range(2000)]
    numbers = np.array([float(t) if t and t.strip() else np.nan for t in texts])
    blanks = np.array([not (t or "").strip() for t in texts])
    cells = pa.RecordBatch.from_pydict({"record_id": pa.array(range(2000)), "column_name": ["v"] * 2000, "column_type": pa.array([None] * 2000, pa.string()), "row_index": pa.array(range(2000)), "cleaned_value": pa.array(texts), "number": numbers, "blank": blanks})
    index = rule_index.RuleIndex(made, rules._pattern_compiles)
    assert len(index.targets["column_name", "v"].patterns) == 1
    want = set()
    for cell, (text, number, blank) in enumerate(zip(texts, numbers, blanks)):
        for r in made:
            text_or_none, v = "None" if text is None else text, r.condition_value
            met = {"gte": lambda: number >= v, "lte": lambda: number <= v, "regex_match": lambda: text_or_none[:1] in ("1", "3"), "in": lambda: text_or_none in v, "not_null": lambda: not blank}[r.condition_operator]()
            if not met:
                want.add((r.rule_id, cell))
    for piece in (rule_index.PIECE, 700):
        monkeypatch.setattr(rule_index, "PIECE", piece)
        pairs, given = [], 0
        for b in rule_index._judge(index, cells):
            for tile in b.to_pylist():
                assert len(tile["record_id"]) <= rule_index.TILE_CELLS and len(tile["rule_id"]) <= rule_index.TILE_RULES
                given += len(tile["record_id"]) + len(tile["rule_id"])
                pairs += [(r, c) for r in tile["rule_id"] for c in tile["record_id"]]
        assert len(pairs) == len(want) > 2_000_000 and set(pairs) == want
        assert piece == 700 or given < len(pairs) / 4


def test_rows_of_violations_are_made_outside_of_python(spark):
    cells = spark.createDataFrame([(i, "v", None, i, str(i)) for i in range(500)], "record_id bigint, column_name string, column_type string, row_index bigint, cleaned_value string")
    found = violations(cells, [rule("eq", -i, i=i, severity="high") for i in range(400)])
    assert found.count() == 500 * 400 - 1 and found.select("severity", "action").distinct().collect() == [("high", "flag")]
    plan = found.select("rule_id", "record_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 2
