"""Registered queries over the synthetic dirty table of orders that the customers of the given tables place.

The SQL says from the customers' keys alone what every cell of it must be.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.addresses import COUNTRY, PROVINCES
from ..operators.ages import number_words
from ..sources import csv_folder, synthetic
from . import cleaning
from .catalog import _registered, table
from .stored_queries import scratch

SEED = 42


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many customers as the table has, numbered from 1."""
    return synthetic.people(table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("customer_id")), SEED)


# The SQL.


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return f"[{', '.join(map(_text, values))}]"


def _number(purpose: str, digits: int, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('/', '{SEED}', '{purpose}', {', '.join(keys)})), 1, {digits}))::bigint"


def _share(purpose: str, *keys: str) -> str:
    return f"({_number(purpose, 10, *keys)} / {1 << 40}::double)"


def _whole(purpose: str, low: int, high: int, *keys: str) -> str:
    return f"({low} + floor({_share(purpose, *keys)} * {high - low + 1})::int)"


def _pick(purpose: str, values: list[str], *keys: str) -> str:
    return f"{_list(values)}[{_whole(purpose, 1, len(values), *keys)}]"


def _weighted(purpose: str, shares: list[float], values: list[str], *keys: str) -> str:
    bounds = list(accumulate(shares))[:-1]
    return f"case {' '.join(f'when {_share(purpose, *keys)} < {b!r}::double then {v}' for b, v in zip(bounds, values))} else {values[-1]} end"


def _case(of: str, values: dict[str, str]) -> str:
    return f"case {of} {' '.join(f'when {k} then {v}' for k, v in values.items())} end"


def _by_segment(values: dict[str, object]) -> str:
    return _case("segment", {_text(k): f"{v}" for k, v in values.items()})


def _date(purpose: str, c: str) -> str:
    return _weighted(purpose, [0.40, 0.25, 0.20, 0.15], [f"strftime({c}, '{f}')" for f in ("%Y-%m-%d", "%d/%m/%Y", "%m-%d-%Y", "%B %d, %Y")], "row_index")


_C, _CO, _R = "customer_id", ("customer_id", "order_no"), "row_index"
_END, _SPIKE = f"date '{synthetic.END}'", f"'{synthetic.SPIKE_MONTH}'"
_FIRST_CATEGORY = _text(synthetic.CATEGORIES[0])
_LEAST, _MOST = (_by_segment({k: v[i] for k, v in synthetic.SEGMENT_ORDERS.items()}) for i in (0, 1))

_PEOPLE = f"""with chosen as (select *, {_pick("first", synthetic.FIRST_NAMES, _C)} || ' ' || {_pick("last", synthetic.LAST_NAMES, _C)} as name_true, {_pick("city", list(PROVINCES), _C)} as city,
    {_weighted("segment", list(synthetic.SEGMENT_SHARES.values()), [_text(s) for s in synthetic.SEGMENT_SHARES], _C)} as segment from (select c_custkey + 1 as customer_id from customer)),
settled as (select *, {_case("city", {_text(p): _list(inner) for p, inner in PROVINCES.items()})} as towns from chosen),
people as (select * exclude (towns), towns[floor({_share("district", _C)} * len(towns))::int + 1] as district, lower(replace(name_true, ' ', '.')) || customer_id || '@example.com' as email_true,
    '53' || lpad(floor({_share("phone", _C)} * 100000000)::bigint::varchar, 8, '0') as digits, {_END} - {_whole("signup", 200, 1800, _C)} as signup_date_true, {_whole("age", 18, 75, _C)} as age_true,
    {_case("customer_id", {str(i + 1): _text(p) for i, p in enumerate(synthetic.PAYLOADS)})} as payload, {_by_segment({k: f"{v}::double" for k, v in synthetic.SEGMENT_ADJUSTMENTS.items()})} as adjust from settled)"""

_ROWS = f"""{_PEOPLE},
bounds as (select *, {_LEAST} as least_, {_MOST} as most_ from people),
counted as (select * exclude (least_, most_), least_ + floor({_share("orders", _C)} * (most_ - least_ + 1))::int as n from bounds),
placed as (select * exclude (n), unnest(generate_series(1, n)) as order_no, greatest(signup_date_true, {_END} - {30 * synthetic.HISTORY_MONTHS}) as start from counted),
usual as (select * exclude (start), start + floor({_share("day", *_CO)} * (greatest(1, {_END} - start) + 1))::int as order_date_true, {_pick("category", synthetic.CATEGORIES, *_CO)} as category from placed),
months as (select strftime(order_date_true, '%Y-%m') as m, count(*) as n from usual where category = {_FIRST_CATEGORY} group by 1),
wanted as (select greatest(0, round(avg(n) filter (m <> {_SPIKE}) * {synthetic.SPIKE}::double) - coalesce(max(n) filter (m = {_SPIKE}), 0))::bigint as w from months),
more as (select 1000000 + unnest(generate_series(1, w)) as order_no from wanted),
extra as (select p.*, e.order_no, date '{synthetic.SPIKE_MONTH}-01' + {_whole("extra day", 0, 27, "p.customer_id", "e.order_no")} as order_date_true, {_FIRST_CATEGORY} as category
    from more e join people p on p.customer_id = floor({_share("extra", "e.order_no")} * (select max(customer_id) from people))::bigint + 1),
placed_all as (select * from usual union all by name select * from extra),
priced as (select *, row_number() over (order by order_date_true, customer_id, order_no) - 1 as row_index, day(order_date_true) <= 12 as early,
    greatest(8.0::double, 30 + 5.5::double * age_true + adjust + 18 * (sqrt(-2 * ln(1 - {_share("noise/u", *_CO)})) * cos({_share("noise/v", *_CO)} * 6.283185307179586::double))) as amount_true from placed_all),
drawn as (select *, row_number() over (order by {_number("outlier", 15, _R)}, row_index) <= {synthetic.OUTLIERS} as is_outlier,
    early and rank() over (partition by early order by {_number("vague", 15, _R)}) <= greatest(3, round_even(count(*) over () * {synthetic.AMBIGUOUS_SHARE}::double, 0)) as is_ambiguous from priced),
whole_rows as (select *, round(case when is_outlier then amount_true * (8 + 10 * {_share("factor", _R)}) else amount_true end, 2) as order_amount_true from drawn)"""

_STYLES = f"""{_ROWS},
styles as (select *, {_whole("currency", 0, 3, _R)} as style, round(order_amount_true)::bigint as amount, printf('%.2f', order_amount_true) as cents, {_whole("digit", 1, 10, _R)} as place,
    substr(digits, 1, 3) || ' ' || substr(digits, 4, 3) || ' ' || substr(digits, 7, 2) || ' ' || substr(digits, 9, 2) as spaced,
    case when {_share("no district", _R)} < 0.15::double then null else district end as its_district, case when {_share("no country", _R)} < 0.1::double then null else {_text(COUNTRY)} end as its_country from whole_rows)"""
_TYPO = f"'+90' || substr(digits, 1, place - 1) || ((substr(digits, place, 1)::int + {_whole('typo', 1, 9, _R)}) % 10) || substr(digits, place + 1, 10)"
_PHONES = ["'+90 ' || spaced", "'0' || spaced", "'+90  ' || substr(digits, 1, 3) || '   ' || substr(digits, 4, 3) || ' ' || substr(digits, 7, 2) || '  ' || substr(digits, 9, 2) || ' '", _TYPO, "'+90' || substr(digits, 1, place - 1) || substr(digits, place + 1, 10)"]
_EMAILS = [f"split_part(email_true, '@', 1) || '@' || {_pick('domain', synthetic.TYPO_DOMAINS, _R)}", "' ' || email_true || ' '", "email_true"]
_AGES = ["age_true::varchar", "' ' || age_true || ' '", _case("age_true", {str(v): _text(w.replace(" ", "-")) for w, v in number_words().items()}), "''"]
_DIRTY = f"""{_STYLES}
select row_index, customer_id::varchar as customer_id, coalesce(payload, name_true) as name, {_weighted("email style", [1 / 3] * 3, _EMAILS, _R)} as email, {_weighted("phone style", [0.2] * 5, _PHONES, _R)} as phone,
    {_date("signup format", "signup_date_true")} as signup_date, case when is_ambiguous then strftime(order_date_true, '%d/%m/%Y') else {_date("order format", "order_date_true")} end as order_date,
    case when {_share("order of parts", _R)} < 0.5::double then concat_ws(', ', its_country, city, its_district) else concat_ws(' - ', its_district, city, its_country) end as address,
    case style when 0 then '$' || cents when 1 then replace(format('{{:,}}', amount), ',', '.') || ' TL' when 2 then replace(cents, '.', ',') else '₺' || amount end as order_amount,
    case style when 0 then 'USD' when 2 then '' else 'TRY' end as currency_hint, {_weighted("age style", [0.75, 0.12, 0.10, 0.03], _AGES, _R)} as customer_age, category, segment as customer_segment from styles"""


# The queries.


@_registered(f"{_PEOPLE} select customer_id, name_true, email_true, digits, signup_date_true::varchar as signup_date_true, age_true, segment, city, district, payload from people")
def synthetic_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("customer_id", "name_true", "email_true", "digits", F.col("signup_date_true").cast("string").alias("signup_date_true"), "age_true", "segment", "city", "district", "payload")


@_registered(_DIRTY)
def synthetic_dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment, the spike, outliers and ambiguous dates, and every column's dirt."""
    return synthetic.tables(synthetic.labelled(_people(spark, sf_dir), SEED), SEED)[0]


@_registered(
    f"""{_ROWS} select row_index, customer_id, name_true, email_true, '+90' || digits as phone_true_e164, signup_date_true::varchar as signup_date_true, order_date_true::varchar as order_date_true, city as city_true, district as district_true,
    {_text(COUNTRY)} as country_true, order_amount_true, age_true as customer_age_true from whole_rows"""
)
def synthetic_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.tables(synthetic.labelled(_people(spark, sf_dir), SEED), SEED)[1]


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    people = _people(spark, sf_dir)
    synthetic.write_for(people, f"{path}/out", people.count(), SEED)
    return path


@_registered(_DIRTY)
def synthetic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table written as CSV files and read back by their headers."""
    path = _written(spark, sf_dir)
    return csv_folder.read(spark, f"{path}/out/dirty/*.csv", f"{path}/work", synthetic.COLUMNS, no_value=[]).rows.select("row_index", *synthetic.COLUMNS)


@_registered(
    f"""{_ROWS},
monthly as (select strftime(order_date_true, '%Y-%m') as m, count(*) as n from whole_rows where category = {_FIRST_CATEGORY} group by 1),
spike as (select round_even(avg(n) filter (m <> {_SPIKE}), 1) as normal_avg_monthly_count, max(n) filter (m = {_SPIKE}) as spike_month_count from monthly),
facts as (select count(*) as n_orders, count(*) filter (is_ambiguous) as n_ambiguous, count(*) filter (is_outlier) as n_outliers, count(payload) as n_payloads, round(corr(age_true, order_amount_true), 3) as pearson_r from whole_rows)
select segment, (200 * count(*) + count(distinct customer_id)) // (2 * count(distinct customer_id)) / 100 as avg_orders_per_customer, (2 * sum(round(order_amount_true * 100)::bigint) + count(*))::bigint // (2 * count(*)) / 100 as avg_amount, any_value(facts.n_orders) as n_orders, any_value(n_ambiguous) as n_ambiguous, any_value(n_outliers) as n_outliers,
    any_value(n_payloads) as n_payloads, any_value(pearson_r) as pearson_r, any_value(normal_avg_monthly_count) as normal_avg_monthly_count, any_value(spike_month_count) as spike_month_count from whole_rows, facts, spike group by segment"""
)
def synthetic_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written manifest says, a row a segment. Row numbers may be listed or, if there are many, counted."""
    text = spark.read.text(f"{_written(spark, sf_dir)}/out/manifest")
    at = lambda path, kind: F.get_json_object("value", f"$.{path}").cast(kind)
    rows = lambda name: F.coalesce(F.json_array_length(F.get_json_object("value", f"$.{name}")).cast("bigint"), at(name, "bigint"))
    segments = F.from_json(F.get_json_object("value", "$.segment_pattern"), "map<string, struct<avg_orders_per_customer: double, avg_amount: double>>")
    return text.select(
        F.explode(segments).alias("segment", "s"), at("n_orders", "bigint").alias("n_orders"), rows("ambiguous_date_rows").alias("n_ambiguous"), rows("outlier_rows").alias("n_outliers"), rows("sql_injection_rows").alias("n_payloads"),
        at("age_amount_correlation.pearson_r", "double").alias("pearson_r"), at("seasonal_anomaly.normal_avg_monthly_count", "double").alias("normal_avg_monthly_count"), at("seasonal_anomaly.spike_month_count", "bigint").alias("spike_month_count"),
    ).select("segment", "s.*", "n_orders", "n_ambiguous", "n_outliers", "n_payloads", "pearson_r", "normal_avg_monthly_count", "spike_month_count")


@_registered()
def synthetic_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table routed and cleaned: its cells."""
    columns, path = synthetic.COLUMNS, scratch(spark)
    synthetic_dirty_rows(spark, sf_dir).select("row_index", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).write.parquet(path)
    df = spark.read.parquet(path)  # made once, as routing and cleaning read it several times
    plan = cleaning.route(df, columns)
    return cleaning.unpivoted(cleaning.cells(df, plan), plan).select("column_name", "column_type", "row_index", "cell.*")
