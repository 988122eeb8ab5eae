"""Correlations, trends, anomalies, charts and narratives."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siftwell.operators import narratives, statistics
from siftwell.plans import insights


def numbers(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_correlations(spark):
    r = random.Random(1)
    rows = [(x := float(r.randint(18, 75)), 5 * x + r.gauss(0, 20), -x, r.random(), 7.0, None) for _ in range(200)]
    df = numbers(spark, rows, "age double, amount double, down double, noise double, flat double, gone double")
    got = [tuple(x) for x in statistics.correlations(df, df.columns).collect()]
    assert got[0][:2] == ("age", "down") and got[0][2:] == (-1.0, "strong", "negative")
    assert {x[:2] for x in got} == {("age", "amount"), ("age", "down"), ("amount", "down")}
    assert statistics.correlations(df, ["age"]).count() == 0
    m = {(x["row"], x["column"]): x["r"] for x in statistics.correlation_matrix(df, ["age", "amount", "flat"]).collect()}
    assert m["age", "age"] == 1.0 and m["flat", "flat"] is None and m["age", "flat"] is None and m["age", "amount"] == m["amount", "age"]


def test_correlation_is_pairwise_complete(spark):
    df = numbers(spark, [(1.0, 2.0), (2.0, None), (3.0, 6.0), (4.0, 8.0)], "a double, b double")
    assert statistics.pairwise(df, ["a", "b"]).first()["r"] > 0.999999


def test_anomalies(spark):
    values = [10.0, 11.0, 12.0, 10.0, 11.0, 13.0, 12.0, 11.0, 10.0, 5000.0]
    df = numbers(spark, list(enumerate(values)), "row_index long, amount double")
    (one,) = statistics.anomalies(df, ["amount"]).collect()
    assert (one["row_index"], one["value"], one["direction"]) == (9, 5000.0, "above") and one["z_score"] == 2.8
    assert statistics.anomalies(df.limit(3), ["amount"]).count() == 0
    assert statistics.anomalies(numbers(spark, [(i, 1.0) for i in range(9)] + [(9, 2.0)], "row_index long, amount double"), ["amount"]).count() == 0  # no spread


def test_monthly_trends(spark):
    rows = [("2024-01-05", 10.0)] * 3 + [("2024-02-05", 20.0)] * 3 + [("2024-03-05", 900.0)] + [("2024-04-01", None)] * 3 + [(None, 5.0)]
    df = numbers(spark, rows, "d string, v double").selectExpr("cast(d as date) d", "v")
    (one,) = statistics.numeric_trends(df, "d", ["v"]).collect()
    assert (one["period"], one["baseline"], one["period_value"], one["change_pct"], one["direction"]) == ("2024-02", 30.0, 60.0, 100.0, "increase")
    assert [tuple(x) for x in statistics.trend_line(df, "d", "v").orderBy("period").collect()] == [("2024-01", 30.0), ("2024-02", 60.0), ("2024-03", 900.0)]


def test_category_trends(spark):
    counts = {"2024-01": 10, "2024-02": 10, "2024-03": 40, "2024-04": 1}
    df = numbers(spark, [(f"{m}-01", "a") for m, n in counts.items() for _ in range(n)] + [("2024-01-01", "b")] * 9, "d string, c string").selectExpr("cast(d as date) d", "c")
    got = [(x["label"], x["period"], x["direction"]) for x in statistics.category_trends(df, "d", "c").collect()]
    assert got == [("a", "2024-03", "increase")]  # the nearly empty month is no decrease


def test_chart_points(spark):
    df = spark.range(1000).selectExpr("id as row_index", "cast(id as double) x", "cast(2 * id + 1 as double) y")
    a, b = ([r[0] for r in statistics.chosen_points(d).select("row_index").collect()] for d in (df, df.repartition(7)))
    assert len(a) == 300 and a == b
    line = statistics.trendline(df, "x", "y").first()
    assert (line["x_min"], round(line["y_at_min"], 6), line["x_max"], round(line["y_at_max"], 6)) == (0.0, 1.0, 999.0, 1999.0)
    assert statistics.trendline(df.where("x = 1"), "x", "y").first() is None


def test_narratives():
    assert not narratives.only_known_numbers("up 71% in 2025-12", {"r": 0.71, "year": 2025}) and narratives.only_known_numbers("up 71% in 2025-12", {"r": 0.71, "year": 2025, "month": -12})
    assert narratives.only_known_numbers("about 71%", {"r": 0.71}) and narratives.only_known_numbers("0.7", {"r": 0.71})
    assert not narratives.only_known_numbers("0.95", {"r": 0.71})

    class Writer:
        def __init__(self, text):
            self.text = text

        def extract_structured(self, **_):
            return None if self.text is None else {"text": self.text}

    assert narratives.narrate({"r": 0.71}, "t", None) == ("t", "template_fallback_no_llm")
    assert narratives.narrate({"r": 0.71}, "t", Writer(None)) == ("t", "template_fallback_llm_unavailable")
    assert narratives.narrate({"r": 0.71}, "t", Writer("it is 3")) == ("t", "template_fallback_hallucination_guard")
    assert narratives.narrate({"r": 0.71}, "t", Writer("it is 71%")) == ("it is 71%", "llm_generated")


def test_cards(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        age = r.randint(18, 75)
        rows.append((i, float(age), 5.0 * age + r.gauss(0, 10) + (9000 if i == 7 else 0), f"2024-{i % 12 + 1:02d}-03", "ab"[i % 2]))
    df = numbers(spark, rows, "row_index long, c0 double, c1 double, d string, c3 string").selectExpr("row_index", "c0", "c1", "cast(d as date) c2", "c3")
    cards = insights.cards(df, date="c2", category="c3", numbers=["c0", "c1"], sums=["c1"], names={"c0": "age", "c1": "amount", "c2": "day", "c3": "kind"})
    assert cards["anomaly_count"] >= 1 and cards["anomalies"][0]["row_index"] == 7 and cards["warnings"] == []
    assert all(c["narrative"].endswith(narratives.DISCLAIMER) for c in cards["correlations"])
    assert set(cards["charts"]) >= {"correlation_matrix", "trend_line", "category_bar", "anomaly_scatter"} and len(cards["trends"]) <= 8
    none = insights.cards(df.select("row_index", "c3"), date=None, category=None, numbers=[])
    assert len(none["warnings"]) == 2 and none["correlations"] == none["trends"] == none["anomalies"] == []


def test_quantiles_by_brackets_equal_the_built_in_ones(spark):
    r = random.Random(9)
    rows = [(0, r.gauss(0, 1)) for _ in range(3000)] + [(1, float(r.randint(0, 3))) for _ in range(2001)] + [(2, 5.0)] * 50 + [(3, 1e300), (3, -1e300), (3, 0.5), (3, 0.25)]
    cells = numbers(spark, rows, "ordinal int, value double")
    exact = {x["ordinal"]: x["q"] for x in statistics.quantiles(cells).collect()}
    for few in (10, 500):
        got = {x["ordinal"]: x["q"] for x in statistics.quantiles(cells, in_memory=1, bins=16, few=few).collect()}
        assert got.keys() == exact.keys() and all(abs(a - b) <= 1e-9 * max(1, abs(a)) for k in exact for a, b in zip(got[k], exact[k]))


def test_quantiles_of_many_columns_take_few_jobs(spark, monkeypatch):
    """200 columns, two shares: equal to the exact percentile, in four jobs at most."""
    df = spark.range(4000).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10 ** (1 + i % 6))) / F.lit(1.0 + i)).alias(f"v{i}") for i in range(200)])
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"v{i}").alias("value")) for i in range(200)])))
    exact = {x["ordinal"]: x["q"] for x in statistics.quantiles(cells).collect()}
    kind, actions = type(cells), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: actions.append(1) or collect(self))
    got = {x["ordinal"]: x["q"] for x in statistics.quantiles(cells, in_memory=1, few=500).collect()}
    assert got.keys() == exact.keys() and all(abs(a - b) <= 1e-12 * max(1, abs(b)) for o in exact for a, b in zip(got[o], exact[o]))
    assert len(actions) <= 4  # the one of the result is among them


def test_correlations_of_many_columns(spark):
    """70 columns with gaps, copies and constants, far from zero: as an expression a pair has them."""
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 70)) + 0.7 * r.normal(size=(900, 1)) * (np.arange(70) % 3 == 0) + 1e6
    x[:, 5] = 3.25
    x[:, 7] = -2 * x[:, 6]
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 9] = np.nan
    x[:, 11] = np.where(np.isnan(x[:, 10]), r.normal(size=900), 8.5)  # constant wherever column 10 is there
    columns = [f"c.{i}" for i in range(70)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns)).repartition(5)
    got = {(p["col1"], p["col2"]): p["r"] for p in statistics.pairwise(df, columns).collect()}
    assert len(got) == 70 * 69 // 2 and [p["place"] for p in statistics.pairwise(df, columns).orderBy("place").limit(80).collect()] == list(range(80))
    for i in range(70):
        for j in range(i + 1, 70):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = None if len(a) < 2 or a.min() == a.max() or b.min() == b.max() else np.corrcoef(a, b)[0, 1]
            have = got[columns[i], columns[j]]
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9), (i, j)


def test_many_computed_columns_are_read_once_and_outside_of_one_method(spark):
    """64 computed columns: no join with itself computes them twice, and their projection lies outside the generated method, which
    would be too large to be compiled."""
    df = spark.range(300).selectExpr(*[f"case when id % 7 <> {i % 7} then id * {i + 1} % 11 + id / {i + 1} end as x{i}" for i in range(64)])
    found = statistics.pairwise(df, df.columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    at = plan.index("CASE WHEN")
    assert plan.count("Range (0, 300") == 1 and not re.match(r".*\*\(\d+\) Project", plan[plan.rindex("\n", 0, at) : at])
    assert found.count() == 64 * 63 // 2


def test_narratives_by_what_the_model_said():
    class Fixed:
        def __init__(self, answer):
            self.answer = answer

        def extract_structured(self, **_):
            return self.answer

    answers = [None, Fixed(None), Fixed({"text": "It rose by 90%."}), Fixed({"text": "It rose by 71%."})]
    said = [narratives.narrate({"metric": "trend", "r": 0.71}, "template", a) for a in answers]
    assert [tuple(x) for x in said] == [("template", "template_fallback_no_llm"), ("template", "template_fallback_llm_unavailable"), ("template", "template_fallback_hallucination_guard"), ("It rose by 71%.", "llm_generated")]
