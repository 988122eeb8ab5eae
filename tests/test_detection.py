"""Samples, scores, winners, profiles and routing."""

from siftwell.operators import profiling
from siftwell.plans import cleaning
from siftwell.sources.decisions import DecisionLog


def frame(spark, columns: dict):
    n = max(map(len, columns.values()))
    rows = [(i, *[v[i] if i < len(v) else None for v in columns.values()]) for i in range(n)]
    schema = "row_index bigint, " + ", ".join(f"c{i} string" for i in range(len(columns)))
    return spark.createDataFrame(rows, schema), list(columns)


def types(spark, columns: dict):
    df, names = frame(spark, columns)
    return {t.column: t for t in cleaning.route(df, names).types}


def test_types_come_from_values(spark):
    found = types(
        spark,
        {
            "contact": ["a@b.co"] * 20,
            "x": ["+90 532 123 45 67"] * 20,
            "order_date": ["2024-01-02", "03/04/2024", "March 5, 2024", "05-06-2024"] * 5,
            "order_amount": ["$120.50", "1.500 TL", "₺2000", "85,50"] * 5,
            "Flat_Price": ["₹8.5 Cr", "₹65 L", "₹95 Lacs", "₹20 K"] * 5,
            "Total_Sq.ft": [str(600 + i) for i in range(20)],
            "place": ["Kadıköy - İstanbul - Türkiye", "Türkiye, Ankara, Çankaya"] * 10,
            "customer_age": [str(20 + i) for i in range(20)],
            "category": ["a", "b", "a", "b"] * 5,
            "notes": [f"remark {i}" for i in range(20)],
            "hour_date": [f"free text {i}" for i in range(20)],
            "none": [None] * 20,
        },
    )
    kinds = {k: (t.detected_type, t.agent) for k, t in found.items()}
    assert kinds == {
        "contact": ("email", "ContactAgent"), "x": ("phone", "ContactAgent"), "order_date": ("date", "DateAgent"), "order_amount": ("currency", "CurrencyAgent"), "Flat_Price": ("quantity", "QuantityAgent"),
        "Total_Sq.ft": ("quantity", "QuantityAgent"), "place": ("address", "AddressAgent"), "customer_age": ("numeric_age", "NumericAgent"), "category": ("categorical", "unclassified"), "notes": (None, "unclassified"),
        "hour_date": (None, "unclassified"), "none": (None, "unclassified"),
    }
    assert found["none"].sample_size == 0 and found["category"].confidence == 0.9
    assert found["notes"].profile["unique_count"] == 20 and found["none"].profile["null_pct"] == 100.0


def test_the_sample_is_the_first_fifty_filled_values(spark):
    df, names = frame(spark, {"v": [" ", None] * 5 + ["a@b.co"] * 50 + ["junk"] * 50})
    t = cleaning.route(df, names).types[0]
    assert (t.detected_type, t.sample_size, t.confidence) == ("email", 50, 1.0)


def test_a_header_alone_decides_nothing():
    rates = dict.fromkeys(profiling.HEADER_WORDS, 0.0) | {"plain": 1.0, "date": 0.29}
    assert profiling.score("order_date", rates) == {}
    assert profiling.score("order_date", rates | {"date": 0.4}) == {"date": 0.55}
    assert profiling.score("width", rates | {"date": 0.4}) == {"date": 0.55}  # header words are substrings
    assert profiling.score("area", rates) == {"quantity": 1.0}


def test_profiles(spark):
    df = spark.createDataFrame([("1", "1.5", "True", "x"), ("2", None, "False", "y"), ("30", "2", "True", None)], "a string, b string, c string, d string")
    p = profiling.profiles(df, ["a", "b", "c", "d"])
    assert [x["inferred_dtype"] for x in p] == ["int64", "float64", "bool", "object"]
    assert (p[0]["min_value"], p[0]["max_value"], p[1]["null_pct"], p[3]["unique_count"]) == ("1", "30", 33.33, 2)
    empty = profiling.profiles(df.limit(0), ["a"])
    assert empty[0]["null_pct"] == 0.0 and empty[0]["min_value"] is None


def test_choices(spark):
    assert profiling.currency_hint_column(["a", "Currency_Hint", "currency"]) == "Currency_Hint"
    assert profiling.currency_hint_column(["a"]) is None
    df = spark.createDataFrame([("2024-01-01", "2020-01-01", None), ("2024-01-09", "2024-01-01", None)], "near string, far string, no string").selectExpr("cast(near as date) near", "cast(far as date) far", "cast(no as date) no")
    assert profiling.event_date_column(df, ["far", "no", "near"]) == "near"
    assert profiling.event_date_column(df, []) is None
    cats = spark.range(100).selectExpr("cast(id % 2 as string) || 'x' two", "cast(id % 5 as string) || 'y' five", "cast(id as string) || 'z' many", "cast(id % 5 as string) digits")
    assert profiling.category_column(cats, ["two", "five", "many", "digits"]) == "five"


def test_the_classifier_is_asked_for_open_columns_only(spark):
    class Client:
        asked = []

        def extract_structured(self, *, system_prompt, data, response_model=None):
            self.asked.append((data["column_name"], len(data["sample_values"])))
            return {"agent_type": "QuantityAgent", "confidence": 80} if data["column_name"] == "v" else {"agent_type": "unknown", "confidence": 250}

    df, names = frame(spark, {"v": [f"about {i}" for i in range(30)], "w": [f"free {i}" for i in range(30)], "mail": ["a@b.co"] * 30})
    said = []
    log = DecisionLog([type("S", (), {"write": lambda self, d: said.append(d)})()])
    plan = cleaning.route(df, names, Client(), log)
    assert Client.asked == [("v", 20), ("w", 20)]
    assert (plan.types[0].agent, plan.types[0].detected_type, plan.types[0].confidence) == ("QuantityAgent", None, 0.8)
    assert plan.types[1].agent == "unclassified" and plan.types[1].profile["llm_attempted"] and plan.types[1].profile["llm_agent_guess"] is None
    assert {d["action"] for d in said} == {"llm_assisted_classification", "detect_column_type"}
