"""The registered queries of the cleaning engine, each with SQL for the same rows.

Dirty columns are made from the clean test tables by fixed rules of their keys, over whole tables; the SQL says what
the cleaners must make of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import Source, cells_of, with_cells
from ..functions.text import two_decimals
from ..operators import addresses, ages, contacts, currencies, dates, feedback, narratives, profiling, quantities, rules, statistics
from ..sources import export
from . import cleaning

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _registered(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import stored_queries, synthetic_queries  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(cell: str = "cell") -> list[Column]:
    return [F.col(f"{cell}.{x}").alias(x) for x in ("cleaned_value", "confidence", "method", "flagged")]


# Dates.


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their dates in four formats by key."""
    d = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "dd/MM/yyyy")).when(kind == 2, F.date_format(d, "MM-dd-yyyy")).otherwise(F.date_format(d, "MMMM dd, yyyy"))
    return table(spark, sf_dir, "orders").withColumn("dirty", text)


def cleaned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.clean_column(dirty_orders(spark, sf_dir), "dirty", "cell")


_ORDER_DATES = """
with parts as (select *, o_orderkey % 4 as k, day(o_orderdate) as d, month(o_orderdate) as m, year(o_orderdate) as y from orders),
votes as (select count(*) filter (k = 1 and d > 12) as a, count(*) filter (k = 2 and d > 12) as b from parts),
clean as (
  select p.*, strftime(case when k in (0, 3) or d > 12 or (k = 1) = (v.a >= v.b) then make_date(y, m, d) else make_date(y, d, m) end, '%Y-%m-%d') as cleaned_value,
    case when k in (0, 3) or d > 12 then 95.0 else 75.0 end as confidence,
    case when k = 0 then 'iso_parse' when k = 3 then 'textual_month_parse' when d > 12 then 'unambiguous_day_gt_12' else 'majority_pattern_inference' end as method
  from parts p cross join votes v)
"""


@_registered(_ORDER_DATES + "select o_orderkey, cleaned_value, cast(confidence as double) as confidence, method, false as flagged from clean")
def date_clean_mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_orders(spark, sf_dir).select("o_orderkey", *flat())


@_registered("select count(*) filter (day(o_orderdate) > 12) as first_day, cast(0 as bigint) as second_day, true as day_first, count(*) filter (day(o_orderdate) > 12) as evidence from orders")
def date_dayfirst_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("dirty"))
    return dates.day_first_evidence(text, "dirty")


@_registered(_ORDER_DATES + "select method, count(*) as n, false as flagged from clean group by method")
def date_ambiguity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_orders(spark, sf_dir).groupBy(F.col("cell.method").alias("method"), F.col("cell.flagged").alias("flagged")).agg(F.count("*").alias("n"))


@_registered(
    """select o_orderkey, case o_orderkey % 6 when 1 then null when 5 then null when 2 then strftime(make_date(2024, 4, 3), '%Y-%m-%d') when 3 then null else null end as cleaned_value,
    cast(case o_orderkey % 6 when 2 then 35 else 0 end as double) as confidence,
    case o_orderkey % 6 when 0 then 'missing_value' when 1 then 'error_unprocessed' when 2 then 'ambiguous_guessed_low_confidence' when 3 then 'invalid_date_components' when 4 then 'unparseable' else 'error_unprocessed' end as method, true as flagged from orders"""
)
def missing_and_error_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "  ").when(k == 1, "31/02/2024").when(k == 2, "03/04/2024").when(k == 3, "00/04/2024").when(k == 4, "soon").otherwise("Foo 12, 2024")
    return cells_of(table(spark, sf_dir, "orders"), text, dates.cleaner(F.lit(None).cast("boolean"), F.lit(0))).select("o_orderkey", *flat())


# Amounts, quantities, ages.


@_registered(
    """with s as (select o_orderkey, o_orderkey % 6 as k, o_totalprice as p, cast(round(o_totalprice) as bigint) as w from orders)
    select o_orderkey,
      case k when 0 then printf('%.2f', cast(printf('%.2f', p) as double)) when 1 then printf('%.2f', cast(w as double)) when 2 then printf('%.2f', cast(w as double)) when 3 then printf('%.2f', cast(printf('%.2f', p) as double))
        when 4 then printf('%.2f', cast(printf('%.2f', p) as double)) end as cleaned_value,
      cast(case when k in (0, 1, 2) then 95 when k in (3, 4) then 75 else 0 end as double) as confidence,
      case k when 0 then 'symbol_usd' when 1 then 'suffix_tl' when 2 then 'symbol_try' when 3 then 'bare_comma_decimal_currency_assumed' when 4 then 'plain_number_currency_assumed' else 'unparseable' end as method,
      k = 5 as flagged,
      case when k = 0 then 'USD' when k in (1, 2) then 'TRY' when k = 3 then 'USD' when k = 4 then 'TRY' end as currency_code from s"""
)
def currency_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 6, F.col("o_totalprice")
    cents, whole = two_decimals(p), F.round(p).cast("bigint")
    text = (
        F.when(k == 0, F.concat(F.lit("$"), cents))
        .when(k == 1, F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(" TL")))
        .when(k == 2, F.concat(F.lit(" ₺"), whole.cast("string")))
        .when(k == 3, F.replace(cents, F.lit("."), F.lit(",")))
        .when(k == 4, cents)
        .otherwise(F.concat(F.lit("about "), cents))
    )
    hint = F.when(k == 3, " usd ").otherwise("")
    cells = cells_of(table(spark, sf_dir, "orders"), text, currencies.cleaner(hint))
    return cells.select("o_orderkey", *flat(), F.get_json_object("cell.details", "$.currency_code").alias("currency_code"))


@_registered(
    """with s as (select p_partkey, p_partkey % 6 as k, cast(printf('%.2f', p_retailprice) as double) as p from part)
    select p_partkey, printf('%.2f', case k when 0 then p * 100000 when 1 then p * 1000 when 2 then p * 10000000 when 3 then p when 4 then p * 1000000 else p end) as cleaned_value, cast(95 as double) as confidence, 'quantity_normalized' as method, false as flagged,
      case k when 0 then 'INR' when 1 then 'INR' when 2 then 'INR' when 4 then 'USD' end as currency_code, case k when 1 then 'sqft' when 3 then 'sqft' when 5 then 'percent' end as unit, case k when 0 then 'L' when 1 then 'K' when 2 then 'Cr' when 4 then 'M' end as magnitude from s"""
)
def quantity_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("p_partkey") % 6, two_decimals(F.col("p_retailprice"))
    text = (
        F.when(k == 0, F.concat(F.lit("₹"), p, F.lit(" L")))
        .when(k == 1, F.concat(F.lit("₹"), p, F.lit(" K/sq.ft")))
        .when(k == 2, F.concat(F.lit("₹ "), p, F.lit("Cr")))
        .when(k == 3, F.concat(p, F.lit(" sq.ft")))
        .when(k == 4, F.concat(F.lit("$"), p, F.lit("M")))
        .otherwise(F.concat(p, F.lit("%")))
    )
    cells = cells_of(table(spark, sf_dir, "part"), text, quantities.cleaner())
    return cells.select("p_partkey", *flat(), *[F.get_json_object("cell.details", f"$.{x}").alias(x) for x in ("currency_code", "unit", "magnitude")])


@_registered(
    """with s as (select p_partkey, p_partkey % 6 as k, p_size as n from part)
    select p_partkey, case when k in (0, 1) then cast(n as varchar) when k = 2 then cast(40 + n % 10 as varchar) when k = 3 then cast(n + 200 as varchar) end as cleaned_value,
      cast(case when k in (0, 1) then 95 when k = 2 then 98 when k = 3 then 75 else 0 end as double) as confidence,
      case k when 0 then 'rule_based_normalization' when 1 then 'whitespace_stripped' when 2 then 'text_to_number_pattern' when 3 then 'implausible_range' when 4 then 'unparseable' else 'missing_value' end as method, k >= 3 as flagged from s"""
)
def numeric_age_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_size")
    ones = F.element_at(F.array(*[F.lit(x) for x in ["", "-one", "-two", "-three", "-four", "-five", "-six", "-seven", "-eight", "-nine"]]), (n % 10 + 1).cast("int"))
    text = (
        F.when(k == 0, n.cast("string"))
        .when(k == 1, F.concat(F.lit("  "), n.cast("string"), F.lit(" ")))
        .when(k == 2, F.concat(F.lit(" Forty"), ones))
        .when(k == 3, (n + 200).cast("string"))
        .when(k == 4, F.concat(n.cast("string"), F.lit(".5")))
    )
    return cells_of(table(spark, sf_dir, "part"), text, ages.cleaner()).select("p_partkey", *flat())


# Contacts and addresses.


@_registered(
    """with s as (select c_custkey, c_custkey % 4 as k from customer)
    select c_custkey, case k when 0 then 'User' || c_custkey || '@mail.com' when 1 then 'user' || c_custkey || '@mail.com' when 2 then 'user.' || c_custkey || '@sub.mail.org' end as cleaned_value,
      cast(case when k = 3 then 0 else 95 end as double) as confidence, case when k = 3 then 'invalid_email' else 'valid_email' end as method, k = 3 as flagged from s"""
)
def email_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("User"), n, F.lit("@MAIL.com")))
        .when(k == 1, F.concat(F.lit("  user"), n, F.lit("@mail.com ")))
        .when(k == 2, F.concat(F.lit("user."), n, F.lit("@sub.mail.org")))
        .otherwise(F.concat(F.lit("user"), n, F.lit("@mail")))
    )
    return cells_of(table(spark, sf_dir, "customer"), text, contacts.cleaner("email")).select("c_custkey", *flat())


@_registered(
    """with s as (select c_custkey, c_custkey % 6 as k, '53' || lpad(cast(c_custkey as varchar), 8, '0') as d from customer)
    select c_custkey, case when k in (0, 1, 2, 5) then '+90' || d end as cleaned_value, cast(case when k in (0, 1) then 95 when k in (2, 5) then 75 else 0 end as double) as confidence,
      case when k in (0, 1) then 'valid_e164' when k in (2, 5) then 'normalized_to_e164' when k = 3 then 'invalid_phone_number' else 'unparseable_phone' end as method, k in (3, 4) as flagged from s"""
)
def phone_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("c_custkey") % 6, F.concat(F.lit("53"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    spaced = F.concat_ws(" ", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))
    text = (
        F.when(k == 0, F.concat(F.lit("+90"), d))
        .when(k == 1, F.concat(F.lit("+90 "), spaced))
        .when(k == 2, F.concat(F.lit("0"), spaced))
        .when(k == 3, F.concat(F.lit("+90"), F.substring(d, 1, 9)))
        .when(k == 4, F.concat(F.lit("no. "), d))
        .otherwise(d)
    )
    return cells_of(table(spark, sf_dir, "customer"), text, contacts.cleaner("phone")).select("c_custkey", *flat())


@_registered(
    """with s as (select c_custkey, c_custkey % 5 as k from customer)
    select c_custkey, case k when 0 then 'Çankaya, Ankara, Türkiye' when 1 then 'Nilüfer, Bursa, Türkiye' when 2 then 'Antalya, Türkiye' when 3 then 'Meram, Konya, Türkiye' end as cleaned_value,
      cast(case k when 2 then 75 when 4 then 0 else 95 end as double) as confidence, case k when 2 then 'lookup_table_partial_match' when 4 then 'unresolved' else 'lookup_table_exact_match' end as method, k = 4 as flagged from s"""
)
def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    text = F.element_at(F.array(*[F.lit(x) for x in ["Çankaya - Ankara - Türkiye", "no 5, nilüfer, BURSA", "Somewhere in Antalya", "Türkiye, Konya, Meram", "221b Baker Street"]]), (n % 5 + 1).cast("int"))
    return cells_of(table(spark, sf_dir, "customer"), text, addresses.cleaner()).select("c_custkey", *flat())


@_registered("select c_custkey, case c_custkey % 3 when 0 then 'Abdalpur, Kolkata, India' when 1 then 'Mumbai, India' else 'India' end as answer, c_custkey % 3 = 0 as grounded from customer")
def address_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.element_at(F.array(*[F.lit(x) for x in ["Abdalpur, Kolkata, India", "Mumbai, India", "India"]]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", answer.alias("answer"), addresses.grounded(answer, F.lit("12 abdalpur road kolkata")).alias("grounded"))


# Detection.


def mixed_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """row_index, c0...: an e-mail column with some junk, telephone numbers, amounts, segments, free text and a column of nulls."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        k.alias("row_index"),
        F.when(k % 5 == 0, "n/a n/a").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.com"))).alias("c0"),
        F.concat(F.lit("+90 53"), F.lpad(k.cast("string"), 8, "0")).alias("c1"),
        F.when(k % 2 == 0, F.concat(F.lit("$"), two_decimals(F.abs("c_acctbal")))).otherwise(F.concat(F.lit("₺"), k.cast("string"))).alias("c2"),
        F.col("c_mktsegment").alias("c3"),
        F.concat(F.lit("note "), k.cast("string")).alias("c4"),
        F.lit(None).cast("string").alias("c5"),
    )
    return df, ["contact_email", "mobile", "price", "segment", "notes", "empty"]


_MIXED = """
with c as (
  select c_custkey as k, case when c_custkey % 5 = 0 then 'n/a n/a' else 'u' || c_custkey || '@mail.com' end as email, c_mktsegment as segment from customer where c_custkey < 50),
"""


@_registered(
    _MIXED
    + """r as (select avg(case when regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 1.0 else 0.0 end) as e, count(distinct segment) as u, count(*) as n from c)
    select * from (
      select 'contact_email' as column_name, 'email' as detected_type, 'ContactAgent' as agent, round(least(1.0, e + 0.15), 4) as confidence, n as sample_size from r union all
      select 'mobile', 'phone', 'ContactAgent', 1.0, n from r union all
      select 'price', 'currency', 'CurrencyAgent', 1.0, n from r union all
      select 'segment', 'categorical', 'unclassified', round(1 - u / n, 4), n from r union all
      select 'notes', null, 'unclassified', 0.0, n from r union all
      select 'empty', null, 'unclassified', 0.0, 0 from r)"""
)
def column_type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = mixed_customers(spark, sf_dir)
    plan = cleaning.route(df, columns)
    rows = [(t.column, t.detected_type, t.agent, float(t.confidence), t.sample_size) for t in plan.types]
    return spark.createDataFrame(rows, "column_name string, detected_type string, agent string, confidence double, sample_size bigint")


@_registered(
    """select 'p_brand' as column_name, 0.0::double as null_pct, count(distinct p_brand) as unique_count, 'object' as inferred_dtype, min(p_brand) as min_value, max(p_brand) as max_value from part union all
    select 'p_size', 0.0, count(distinct p_size), 'int64', cast(min(p_size) as varchar), cast(max(p_size) as varchar) from part union all
    select 'p_odd', round(100 * (1 - count(*) filter (p_partkey % 3 <> 0) / count(*)), 2), count(distinct p_size) filter (p_partkey % 3 <> 0), 'float64', cast(cast(min(p_size) filter (p_partkey % 3 <> 0) as double) as varchar), cast(cast(max(p_size) filter (p_partkey % 3 <> 0) as double) as varchar) from part"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("p_odd", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")))
    names = ["p_brand", "p_size", "p_odd"]
    rows = [(n, p["null_pct"], p["unique_count"], p["inferred_dtype"], p["min_value"], p["max_value"]) for n, p in zip(names, profiling.profiles(df, names))]
    return spark.createDataFrame(rows, "column_name string, null_pct double, unique_count bigint, inferred_dtype string, min_value string, max_value string")


@_registered("select case when count(distinct p_brand) between 2 and 50 and count(distinct p_brand) / count(*) < 0.1 then 'p_brand' else 'two' end as category_column from part")
def category_column_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("two", F.when(F.col("p_size") > 25, "large").otherwise("small"))
    return spark.createDataFrame([(profiling.category_column(df, ["p_name", "two", "p_brand", "p_partkey"]),)], "category_column string")


@_registered("select 'ship' as event_date_column")
def event_date_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("order"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 7).cast("int")).alias("ship"), F.lit(None).cast("date").alias("none"))
    return spark.createDataFrame([(profiling.event_date_column(df, ["order", "none", "ship"]),)], "event_date_column string")


# Cells, feedback, export.


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cells of the orders' dates and amounts: record_id, ordinal, column_name, column_type, row_index, cell."""
    k = F.col("o_orderkey")
    amount = F.when(k % 10 == 0, F.lit("")).when(k % 10 == 1, "free").otherwise(F.concat(F.lit("$"), two_decimals(F.col("o_totalprice"))))
    sources = {"k0": Source(dates.cleaner(F.lit(True), F.lit(9)), F.col("dirty")), "k1": Source(currencies.cleaner(), amount)}
    wide = with_cells(dirty_orders(spark, sf_dir), sources).select(k.alias("row_index"), *sources)
    plan = cleaning.Plan(["order_date", "order_amount"], [profiling.ColumnType("order_date", "date", "DateAgent", 1.0, 50), profiling.ColumnType("order_amount", "currency", "CurrencyAgent", 1.0, 50)])
    return cleaning.unpivoted(wide, plan).withColumn("record_id", F.col("row_index") * 2 + F.col("ordinal"))


_CELLS = """
with parts as (select o_orderkey as k, o_totalprice as p, day(o_orderdate) as d, month(o_orderdate) as m, year(o_orderdate) as y from orders),
cells as (
  select k * 2 as record_id, 'order_date' as column_name, 'date' as column_type, 'DateAgent' as agent_type, k as row_index, strftime(case when k % 4 = 2 and d <= 12 then make_date(y, d, m) else make_date(y, m, d) end, '%Y-%m-%d') as cleaned_value,
    cast(case when k % 4 in (0, 3) or d > 12 then 95 else 75 end as double) as confidence, false as flagged, case when k % 4 = 0 then 'iso_parse' when k % 4 = 3 then 'textual_month_parse' when d > 12 then 'unambiguous_day_gt_12' else 'majority_pattern_inference' end as method from parts
  union all
  select k * 2 + 1, 'order_amount', 'currency', 'CurrencyAgent', k, case when k % 10 > 1 then printf('%.2f', cast(printf('%.2f', p) as double)) end, cast(case when k % 10 > 1 then 95 else 0 end as double), k % 10 <= 1,
    case k % 10 when 0 then 'missing_value' when 1 then 'unparseable' else 'symbol_usd' end from parts)
"""


@_registered(_CELLS + "select record_id, column_name, column_type, row_index, cleaned_value, confidence, method, flagged from cells")
def cells_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cells(spark, sf_dir).select("record_id", "column_name", "column_type", "row_index", *flat())


@_registered(_CELLS + "select k as row_index, d.cleaned_value as order_date, a.cleaned_value as order_amount, 'as is' as remark from parts join cells d on d.row_index = k and d.column_name = 'order_date' join cells a on a.row_index = k and a.column_name = 'order_amount'")
def cells_pivot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dirty_orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_index"), F.col("dirty").alias("order_date"), F.lit("?").alias("order_amount"), F.lit("as is").alias("remark"))
    long = order_cells(spark, sf_dir).select("row_index", "column_name", F.col("cell.cleaned_value").alias("cleaned_value"))
    return export.cleaned_table(raw, long, ["order_date", "order_amount", "remark"], ["order_amount", "order_date"])


@_registered(_CELLS + "select column_name, any_value(agent_type) as agent_type, count(*) as rows_processed, count(*) filter (flagged) as rows_flagged, cast(0 as bigint) as rows_influenced_by_feedback from cells group by column_name")
def column_cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.summary(order_cells(spark, sf_dir))


_FIXES = [(1, "mktsegment", "BUILDING", "Construction", 1), (2, "mktsegment", " building ", "Buildings", 3), (3, "mktsegment", "Automobile", "Cars", 2), (4, "other", "MACHINERY", "Machines", 4)]


def corrections(spark: SparkSession) -> DataFrame:
    rows = [(i, kind, original, None, new, at) for i, kind, original, new, at in _FIXES]
    return spark.createDataFrame(rows, "feedback_id bigint, column_type string, original_value string, agent_output string, corrected_value string, at int").select("feedback_id", "column_type", "original_value", "agent_output", "corrected_value", F.timestamp_seconds("at").alias("created_at"))


@_registered(
    """select c_custkey, case upper(c_mktsegment) when 'BUILDING' then 'Buildings' when 'AUTOMOBILE' then 'Cars' end as cleaned_value, cast(case when upper(c_mktsegment) in ('BUILDING', 'AUTOMOBILE') then 95 else 0 end as double) as confidence,
    case when upper(c_mktsegment) in ('BUILDING', 'AUTOMOBILE') then 'reused_prior_feedback' else 'unresolved' end as method, upper(c_mktsegment) not in ('BUILDING', 'AUTOMOBILE') as flagged from customer"""
)
def feedback_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedback.latest(corrections(spark), "mktsegment")
    df = table(spark, sf_dir, "customer").withColumn("value", F.concat(F.lit(" "), F.col("c_mktsegment")))
    df = feedback.with_correction(df, "value", found, "fix", len(_FIXES))
    return cells_of(df, F.col("value"), addresses.cleaner(), "cell", F.col("fix")).select("c_custkey", *flat())


# Rules.


def _rule(i: int, kind: str, target: str, op: str, value=None, severity: str = "medium") -> rules.Rule:
    return rules.Rule(i, 1, f"rule {i}", kind, target, op, value, "flag", severity)


RULES = [
    _rule(1, "column_name", "order_amount", "gte", 100000),
    _rule(2, "column_name", "order_amount", "lte", 150000.5, "high"),
    _rule(3, "column_name", "order_date", "eq", "1995-01-01"),
    _rule(4, "column_name", "order_date", "in", ["1995-01-01", "1996-02-02"], "low"),
    _rule(5, "column_name", "order_date", "regex_match", "199[0-6]"),
    _rule(6, "column_name", "order_amount", "not_null"),
    _rule(7, "detected_type", "date", "gte", 1),
    _rule(8, "detected_type", "currency", "regex_match", r"\d+\.\d\d"),
]
_RULE_SQL = {
    1: ("order_amount", "coalesce(try_cast(cleaned_value as double) >= 100000, false)"),
    2: ("order_amount", "coalesce(try_cast(cleaned_value as double) <= 150000.5, false)"),
    3: ("order_date", "cleaned_value = '1995-01-01'"),
    4: ("order_date", "cleaned_value in ('1995-01-01', '1996-02-02')"),
    5: ("order_date", "regexp_matches(cleaned_value, '^199[0-6]')"),
    6: ("order_amount", "cleaned_value is not null and trim(cleaned_value) <> ''"),
    7: ("order_date", "false"),
    8: ("order_amount", "regexp_matches(coalesce(cleaned_value, 'None'), '^\\d+\\.\\d\\d')"),
}
_VIOLATED = _CELLS + ", violated as (" + " union all ".join(f"select cast({i} as bigint) as rule_id, record_id, column_name, row_index, cleaned_value, '{RULES[i - 1].severity}' as severity, 'flag' as action from cells where column_name = '{c}' and not ({ok})" for i, (c, ok) in _RULE_SQL.items()) + ")"


def violated(spark: SparkSession, sf_dir: str, chosen: list[rules.Rule]) -> DataFrame:
    return rules.violations(order_cells(spark, sf_dir).withColumn("cleaned_value", F.col("cell.cleaned_value")), chosen)


def _rule_query(rule: rules.Rule, name: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return violated(spark, sf_dir, [rule])

    query.__name__ = name
    _registered(_VIOLATED + f" select * from violated where rule_id = {rule.rule_id}")(query)


for _r, _n in zip(RULES, ("rule_gte", "rule_lte", "rule_eq", "rule_in", "rule_regex_match", "rule_not_null", "rule_detected_type_fanout")):
    _rule_query(_r, _n)


@_registered(
    """with e as (select distinct p_size as rule_id from part where p_size <= 30), d as (select distinct p_size as rule_id from part where p_size > 20)
    select cast(rule_id as bigint) as rule_id, 'add' as change from (select * from d except select * from e) union all select cast(rule_id as bigint), 'remove' from (select * from e except select * from d)"""
)
def rule_apply_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("rule_id")).distinct()
    add, remove = rules.applied_difference(sizes.where("rule_id <= 30"), sizes.where("rule_id > 20"))
    return add.withColumn("change", F.lit("add")).unionByName(remove.withColumn("change", F.lit("remove")))



# Statistics.


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


_NUMBERS = ["l_quantity", "l_extendedprice", "net"]


@_registered(
    """with l as (select *, l_extendedprice * (1 - l_discount) as net from lineitem),
    r as (select 'l_quantity' as col1, 'l_extendedprice' as col2, corr(l_quantity, l_extendedprice) as r from l union all select 'l_quantity', 'net', corr(l_quantity, net) from l union all select 'l_extendedprice', 'net', corr(l_extendedprice, net) from l)
    select col1, col2, round(r, 3) as r, case when abs(r) > 0.6 then 'strong' when abs(r) >= 0.3 then 'moderate' else 'weak' end as strength, case when r > 0 then 'positive' else 'negative' end as direction from r where abs(r) >= 0.4"""
)
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.correlations(priced_lines(spark, sf_dir), _NUMBERS)


def _derived(i: int) -> str:
    """The i-th of many columns, with a gap in every seventh line, in words of both SQLs."""
    return f"case when l_linenumber % 7 <> {i % 7} then l_quantity * {i + 1} + l_extendedprice / {i + 1} * ((l_orderkey + {i}) % 5) end"


_MANY = 64
_PAIRS = [(i, j) for i in range(_MANY) for j in range(i + 1, _MANY)]


@_registered(
    f"""with v as (select {', '.join(f'{_derived(i)} as x{i}' for i in range(_MANY))} from lineitem), m as (select [{', '.join(f'corr(x{i}, x{j})' for i, j in _PAIRS)}] as r from v)
    select unnest([{', '.join(f"'x{i}'" for i, _ in _PAIRS)}]) as col1, unnest([{', '.join(f"'x{j}'" for _, j in _PAIRS)}]) as col2, round(unnest(r), 6) as r from m"""
)
def corr_of_many_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of 64 columns with gaps, over all lines."""
    columns = [f"x{i}" for i in range(_MANY)]
    df = table(spark, sf_dir, "lineitem").selectExpr(*[f"{_derived(i)} as x{i}" for i in range(_MANY)])
    return statistics.pairwise(df, columns).select("col1", "col2", F.round("r", 6).alias("r"))


@_registered(
    """with l as (select *, l_extendedprice * (1 - l_discount) as net from lineitem), h as (select 'l_quantity' as "row", 'l_extendedprice' as "column", round(corr(l_quantity, l_extendedprice), 3) as r from l union all select 'l_quantity', 'net', round(corr(l_quantity, net), 3) from l
      union all select 'l_extendedprice', 'net', round(corr(l_extendedprice, net), 3) from l)
    select "row", "column", r from h union all select "column", "row", r from h union all select x, x, 1.0 from (values ('l_quantity'), ('l_extendedprice'), ('net')) t(x)"""
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.correlation_matrix(priced_lines(spark, sf_dir), _NUMBERS)


_ODD = """
with s as (select avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
odd as (select 'value' as "column", event_id as row_index, round(value, 2) as value, round((value - mean) / sd, 1) as z_score, case when value > mean then 'above' else 'below' end as direction
  from events, s where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1))
"""


@_registered(_ODD + 'select "column", row_index, value, z_score, direction from odd')
def iqr_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.anomalies(table(spark, sf_dir, "events"), ["value"], "event_id").drop("ordinal")


_MONTHS = """
with m as (select strftime(o_orderdate, '%Y-%m') as period, cast(sum(cast(o_totalprice as decimal(28, 6))) as double) as total, count(o_totalprice) as n from orders group by 1),
w as (select *, lag(total) over (order by period) as b, lag(n) over (order by period) as bn from m),
trends as (select 'numeric_sum' as dimension, 'o_totalprice' as label, period, round(b, 2) as baseline, round(total, 2) as period_value, round((total - b) / b * 100, 1) as change_pct, case when total > b then 'increase' else 'decrease' end as direction
  from w where b <> 0 and n >= 3 and bn >= 3 and abs((total - b) / b) >= 0.2)
"""


@_registered(_ORDER_DATES + _MONTHS.replace("with m as", ", m as", 1).replace("strftime(o_orderdate, '%Y-%m')", "substr(cleaned_value, 1, 7)", 1).replace("from orders group by 1", "from clean group by 1", 1) + "select * from trends")
def monthly_sum_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By months of cleaned dates: where day and month are in doubt, the column's evidence decides."""
    cells = cleaned_orders(spark, sf_dir).select("o_orderkey", F.col("o_orderkey").alias("row_index"), F.col("o_totalprice").cast("string").alias("c1"), F.col("cell").alias("k0"), F.col("dirty").alias("c0"))
    plan = cleaning.Plan(["order_date", "o_totalprice"], [profiling.ColumnType("order_date", "date", "DateAgent", 1.0, 50), profiling.ColumnType("o_totalprice", None, profiling.UNCLASSIFIED, 0.0, 50)])
    typed = cleaning.analysis_table(cells, plan).withColumnsRenamed({"c0": "date", "c1": "o_totalprice"})
    return statistics.numeric_trends(typed, "date", ["o_totalprice"]).drop("ordinal")


@_registered(_MONTHS + "select period, round(total, 2) as value from m")
def trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.trend_line(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


_SPIKES = """
with c as (select 'p' || (o_custkey % 40) || '/' || case when o_custkey % 40 = 7 and month(o_orderdate) = 5 then 'x' else 'y' end as label, strftime(o_orderdate, '%Y-%m') as period, count(*) as n from orders group by 1, 2),
w as (select *, count(*) over (partition by label) as k, (sum(n) over (partition by label) - n) / (count(*) over (partition by label) - 1) as b from c),
spikes as (select 'category_count' as dimension, label, period, round(b, 1) as baseline, cast(n as double) as period_value, round((n - b) / b * 100, 1) as change_pct, case when n > b then 'increase' else 'decrease' end as direction
  from w where k >= 2 and b >= 3 and not (n < b and n < 3) and abs((n - b) / b) >= 0.75)
"""


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (F.col("o_custkey") % 40 == 7) & (F.month("o_orderdate") == 5)
    return table(spark, sf_dir, "orders").withColumn("label", F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), F.when(odd, "x").otherwise("y")))


@_registered(_SPIKES + "select * from spikes")
def category_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled_orders(spark, sf_dir).withColumn("category", F.col("label")).drop("label")
    return statistics.category_trends(df, "o_orderdate", "category").drop("ordinal")


@_registered("select o_orderpriority as category, count(*) as count, round(cast(sum(cast(o_totalprice as decimal(28, 6))) as double) / count(o_totalprice), 2) as avg_value from orders group by 1")
def category_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.category_bar(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@_registered(
    """with l as (select *, l_extendedprice * (1 - l_discount) as net from lineitem), f as (select regr_slope(net, l_extendedprice) as s, regr_intercept(net, l_extendedprice) as i, min(l_extendedprice) as a, max(l_extendedprice) as b from l)
    select round(a, 2) as x_min, round(i + s * a, 2) as y_at_min, round(b, 2) as x_max, round(i + s * b, 2) as y_at_max from f"""
)
def scatter_trendline(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = statistics.trendline(priced_lines(spark, sf_dir), "l_extendedprice", "net")
    return line.select(*[F.round(c, 2).alias(c) for c in ("x_min", "y_at_min", "x_max", "y_at_max")])


@_registered(
    _ODD.replace("with s as", "with s as", 1)
    + """, m as (select strftime(o_orderdate, '%Y-%m') as period, cast(sum(cast(o_totalprice as decimal(28, 6))) as double) as total, count(o_totalprice) as n from orders group by 1),
    w as (select *, lag(total) over (order by period) as b, lag(n) over (order by period) as bn from m)
    select 'anomaly' as kind, 'Row ' || row_index || '''s ' || "column" || ' value of ' || value || ' is ' || abs(z_score) || 'σ ' || direction || ' the normal range.' as text from odd union all
    select 'trend', 'o_totalprice ' || case when total > b then 'increased ' else 'decreased ' end || abs(round((total - b) / b * 100, 1)) || '% in ' || period || '.' from w where b <> 0 and n >= 3 and bn >= 3 and abs((total - b) / b) >= 0.2"""
)
def narrative_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = statistics.anomalies(table(spark, sf_dir, "events"), ["value"], "event_id")
    trends = statistics.numeric_trends(table(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"])
    c = F.col
    one = odd.select(F.lit("anomaly").alias("kind"), narratives.anomaly_text(c("column"), c("row_index"), c("value"), c("z_score"), c("direction")).alias("text"))
    return one.unionByName(trends.select(F.lit("trend").alias("kind"), narratives.trend_text(c("dimension"), c("label"), c("period"), c("change_pct"), c("direction")).alias("text")))


@_registered("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_details_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
