"""Literal values for every cleaner: (raw, cleaned, confidence, method, flagged)."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions.cells import Source, cells_of, with_cells
from siftwell.operators import addresses, ages, contacts, currencies, dates, quantities


def cleaned(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    rows = cells_of(df, F.col("raw"), build, "c").orderBy("i").collect()
    return [r["c"] for r in rows]


def check(spark, table, build):
    got = cleaned(spark, [t[0] for t in table], build)
    for want, c in zip(table, got):
        assert (c.cleaned_value, c.confidence, c.method, c.flagged) == want[1:], want[0]
    return got


def test_dates_without_evidence(spark):
    table = [
        ("2024-03-05", "2024-03-05", 95, "iso_parse", False),
        (" 2024-3-5 ", "2024-03-05", 95, "iso_parse", False),
        ("March 5, 2024", "2024-03-05", 95, "textual_month_parse", False),
        ("Sept 5 2024", "2024-09-05", 95, "textual_month_parse", False),
        ("25/03/2024", "2024-03-25", 95, "unambiguous_day_gt_12", False),
        ("03-25-2024", "2024-03-25", 95, "unambiguous_day_gt_12", False),
        ("03/04/2024", "2024-04-03", 35, "ambiguous_guessed_low_confidence", True),
        ("13/14/2024", None, 0, "invalid_date_components", True),
        ("00/04/2024", None, 0, "invalid_date_components", True),
        ("31/02/2024", None, 0, "error_unprocessed", True),
        ("2024-02-31", None, 0, "error_unprocessed", True),
        ("Foo 12, 2024", None, 0, "error_unprocessed", True),
        ("not a date", None, 0, "unparseable", True),
        (None, None, 0, "missing_value", True),
        ("  ", None, 0, "missing_value", True),
    ]
    got = check(spark, table, dates.cleaner(F.lit(None).cast("boolean"), F.lit(0)))
    assert json.loads(got[9].details) == {"error": "unhandled_exception_during_cleaning"} and got[9].original_value == "31/02/2024"
    assert got[1].original_value == "2024-3-5"


def test_majority_decides_ambiguous_dates(spark):
    values = ["25/03/2024", "26/03/2024", "27/03/2024", "28/03/2024", "29/03/2024", "03/04/2024"]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    row = dates.clean_column(df, "d", "cell").where("d = '03/04/2024'").first()["cell"]
    assert (row.cleaned_value, row.confidence, row.method) == ("2024-04-03", 75, "majority_pattern_inference")
    assert json.loads(row.details) == {"column_dayfirst_evidence_count": 5}


def test_no_evidence_is_null_and_a_tie_is_day_first(spark):
    none = dates.day_first_evidence(spark.createDataFrame([("01/02/2024",)], "d string"), "d").first()
    assert none["day_first"] is None and none["evidence"] == 0
    tie = dates.day_first_evidence(spark.createDataFrame([("13/02/2024",), ("02/13/2024",)], "d string"), "d").first()
    assert tie["day_first"] is True and tie["evidence"] == 2


def test_currencies(spark):
    table = [
        ("$120.50", "120.50", 95, "symbol_usd", False),
        ("$1,200", "1200.00", 95, "symbol_usd", False),
        ("1.500 TL", "1500.00", 95, "suffix_tl", False),
        ("12.50 TL", "1250.00", 95, "suffix_tl", False),
        ("₺2000", "2000.00", 95, "symbol_try", False),
        ("85,50", "85.50", 75, "bare_comma_decimal_currency_assumed", False),
        ("85.5", "85.50", 75, "plain_number_currency_assumed", False),
        ("₺20.5", None, 0, "unparseable", True),
        ("twelve", None, 0, "unparseable", True),
        ("", None, 0, "missing_value", True),
    ]
    got = check(spark, table, currencies.cleaner())
    assert json.loads(got[5].details)["currency_code"] == "TRY"
    hinted = cleaned(spark, ["85,50"], currencies.cleaner(F.lit(" usd ")))[0]
    assert json.loads(hinted.details) == {"currency_code": "USD", "currency_assumed": True}


def test_quantities(spark):
    table = [
        ("$1.2M", "1200000.00", 95, "quantity_normalized", False),
        ("₹5 Lacs", "500000.00", 95, "quantity_normalized", False),
        ("₹8.5 Cr", "85000000.00", 95, "quantity_normalized", False),
        ("₹1.35 L", "135000.00", 95, "quantity_normalized", False),
        ("50%", "50.00", 95, "quantity_normalized", False),
        ("₹20.24 K/sq.ft", "20240.00", 95, "quantity_normalized", False),
        ("1500 sq.ft", "1500.00", 95, "quantity_normalized", False),
        ("1.234,56", "1234.56", 75, "quantity_normalized", False),
        ("1,234.56", "1234.56", 75, "quantity_normalized", False),
        ("1.500", "1.50", 95, "quantity_normalized", False),
        ("1.500.000", "1500000.00", 95, "quantity_normalized", False),
        ("usd 5k", "5000.00", 95, "quantity_normalized", False),
        ("-5", None, 0, "unparseable", True),
        ("1.2.3", None, 0, "unparseable", True),
    ]
    got = check(spark, table, quantities.cleaner())
    assert json.loads(got[5].details) == {"currency_code": "INR", "magnitude": "K", "unit": "sqft"}
    assert json.loads(got[4].details) == {"currency_code": None, "magnitude": None, "unit": "percent"}


def test_contacts(spark):
    phones = [
        ("+905321234567", "+905321234567", 95, "valid_e164", False),
        ("+90 532 123 45 67", "+905321234567", 95, "valid_e164", False),
        ("0532 123 45 67", "+905321234567", 75, "normalized_to_e164", False),
        ("123", None, 0, "invalid_phone_number", True),
        ("call me", None, 0, "unparseable_phone", True),
        (None, None, 0, "missing_value", True),
    ]
    check(spark, phones, contacts.cleaner("phone"))
    emails = [
        ("alice@mail.com", "alice@mail.com", 95, "valid_email", False),
        ("Alice@Mail.COM", "Alice@mail.com", 95, "valid_email", False),
        ("  bob@mail.com ", "bob@mail.com", 95, "valid_email", False),
        ("not-an-email", None, 0, "invalid_email", True),
        ("a..b@mail.com", None, 0, "invalid_email", True),
    ]
    check(spark, emails, contacts.cleaner("email"))
    with pytest.raises(ValueError):
        contacts.cleaner("fax")


def test_ages(spark):
    table = [
        ("34", "34", 95, "rule_based_normalization", False),
        (" 41 ", "41", 95, "whitespace_stripped", False),
        (" thirty-five ", "35", 98, "text_to_number_pattern", False),
        ("Ninety nine", "99", 98, "text_to_number_pattern", False),
        ("007", "7", 95, "rule_based_normalization", False),
        ("999", "999", 75, "implausible_range", True),
        ("-3", "-3", 75, "implausible_range", True),
        ("3.5", None, 0, "unparseable", True),
        ("banana", None, 0, "unparseable", True),
        (None, None, 0, "missing_value", True),
    ]
    got = check(spark, table, ages.cleaner())
    assert json.loads(got[5].details) == {"plausible_range": [0, 120]}


def test_addresses(spark):
    table = [
        ("Kadıköy - İstanbul - Türkiye", "Kadıköy, İstanbul, Türkiye", 95, "lookup_table_exact_match", False),
        ("Somewhere in İstanbul", "İstanbul, Türkiye", 75, "lookup_table_partial_match", False),
        ("istanbul", None, 0, "unresolved", True),
        ("1 Main Street", None, 0, "unresolved", True),
    ]
    check(spark, table, addresses.cleaner())


def test_address_answers_are_accepted_only_if_borne_out(spark):
    assert addresses.known_place({"province": "Ankara", "district": "Çankaya"}) == "Çankaya, Ankara, Türkiye"
    assert addresses.known_place({"province": "Ankara"}) == "Ankara, Türkiye"
    assert addresses.known_place({"province": "Atlantis"}) is None
    assert addresses.known_place({"province": "Ankara", "district": "Kadıköy"}) is None

    def resolver(value, examples):
        return {"Abdalpur Kolkata": {"normalized_address": "Abdalpur, Kolkata, India"}, "somewhere": {"normalized_address": "Mumbai, India"}, "capital, Turkiye": {"province": "Ankara"}}.get(value)

    df = spark.createDataFrame([("Abdalpur Kolkata",), ("somewhere",), ("capital, Turkiye",), ("Konya",)], "a string")
    found = addresses.resolve(df, "a", resolver, [])
    joined = df.join(found, df["a"] == found["value"], "left")
    joined = cells_of(joined, F.col("a"), addresses.cleaner(F.col("resolved"), True), "c").collect()
    got = {r["a"]: (r["c"].cleaned_value, r["c"].confidence, r["c"].method) for r in joined}
    assert got == {
        "Abdalpur Kolkata": ("Abdalpur, Kolkata, India", 70, "llm_international_resolution"),
        "somewhere": (None, 0, "unresolved"),
        "capital, Turkiye": ("Ankara, Türkiye", 80, "llm_resolution"),
        "Konya": ("Konya, Türkiye", 75, "lookup_table_partial_match"),
    }


def every_cleaner():
    return [dates.cleaner(F.lit(True), F.lit(3)), currencies.cleaner(), quantities.cleaner(), contacts.cleaner("phone"), contacts.cleaner("email"), ages.cleaner(), addresses.cleaner()]


def all_cells(df, copies=1):
    """Every cleaner over the column raw, ``copies`` times."""
    return with_cells(df, {f"k{i}": Source(c, F.col("raw"), F.col("fix")) for i, c in enumerate(every_cleaner() * copies)}).drop("raw", "fix")


def test_cleaners_need_no_python_and_few_patterns(spark):
    """No Python in the plan, and no more than ten patterns run for any cell: expressions are bound, not repeated."""
    df = spark.createDataFrame([("x", None)], "raw string, fix string")
    text = all_cells(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
    for c in every_cleaner():
        plan = with_cells(df, {"k": Source(c, F.col("raw"), F.col("fix"))}).where("k.flagged")._jdf.queryExecution().optimizedPlan().toString()
        assert sum(plan.count(x) for x in ("RLIKE", "regexp_", "split(")) <= 10, c.agent


def test_cleaners_compile(spark):
    """The generated code of all cleaners side by side, twice over, stays within the limits of the machine's methods."""
    df = spark.range(10).select(F.col("id").cast("string").alias("raw"), F.lit(None).cast("string").alias("fix"))
    wide = all_cells(df, 2)
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    stages = debug.codegenStringSeq(wide._jdf.queryExecution().executedPlan())
    assert stages.size() > 0 and all("FailedToCompile" not in str(stages.apply(i)) for i in range(stages.size()))
    assert wide.count() == 10 and wide.where("k0.method is null").count() == 0


def test_cleaners_side_by_side_are_projected_outside_of_one_method(spark):
    """No step of two cleaners beside each other is part of one generated method, which would be too large to be compiled."""
    df = spark.range(20).select(F.col("id").alias("row_index"), F.lit("05/01/2020").alias("c0"), F.concat(F.lit("$"), F.col("id").cast("string"), F.lit(".50")).alias("c1"))
    made = with_cells(df, {"k0": Source(dates.cleaner(F.lit(True), F.lit(9)), F.col("c0")), "k1": Source(currencies.cleaner(None), F.col("c1"))})
    steps = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "_k1_" in line and "Project [" in line]
    assert len(steps) >= 3 and not any(line.lstrip(" :+-").startswith("*") for line in steps)
    assert {(r["k0"]["cleaned_value"], r["k1"]["cleaned_value"]) for r in made.collect()} == {("2020-01-05", f"{i}.50") for i in range(20)}
