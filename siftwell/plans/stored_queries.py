"""Registered queries that go through the service and its store, and those of what works beside the tables.

One service for each session and set of tables is set up at the first use: the orders are cleaned and stored whole,
one cell is corrected by hand, and rules are defined, applied, changed and taken back. The queries read what that left.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import cells_of
from ..functions.text import two_decimals
from ..operators import addresses, contacts, dates, feedback, gazetteer, narratives, profiling, quantities, rules, statistics
from ..sources import csv_folder, export, uploads
from ..sources.decisions import DecisionLog
from ..sources.store import NotFound
from . import cleaning
from .catalog import _ODD, _registered, corrections, dirty_orders, flat, table
from .service import BadRequest, Service, Unprocessable

UPLOAD = 1
_services: dict[tuple[str, str], Service] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share, removed when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftwell-store-")
    path = f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def served(spark: SparkSession, sf_dir: str) -> Service:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _services:
        _services[key] = _set_up(spark, sf_dir)
    return _services[key]


def _set_up(spark: SparkSession, sf_dir: str) -> Service:
    service = Service(spark, scratch(spark))
    k = F.col("o_orderkey")
    amount = F.when(k % 10 == 0, F.lit("")).when(k % 10 == 1, "free").otherwise(F.concat(F.lit("$"), two_decimals(F.col("o_totalprice"))))
    raw = dirty_orders(spark, sf_dir).select(k.alias("row_index"), F.col("dirty").alias("c0"), amount.alias("c1"), F.concat(F.lit("note "), k.cast("string")).alias("c2"))
    columns = ["order_date", "order_amount", "remark"]
    service.store.create_upload("data/orders.csv")
    service.clean(UPLOAD, raw, columns)
    free = service.store.cells(UPLOAD).where("column_name = 'order_amount' and row_index % 10 = 1").agg(F.min("record_id")).first()[0]
    service.correct(UPLOAD, free, "77.00")
    rule = lambda name, kind, target, op, value, severity: service.create_rule(UPLOAD, name=name, target_kind=kind, target_value=target, condition_operator=op, condition_value=value, severity=severity).rule_id
    big, bound = rule("big", "column_name", "order_amount", "gte", 100000, "medium"), rule("bound", "column_name", "order_amount", "lte", 150000.5, "high")
    early, gone = rule("early", "detected_type", "date", "regex_match", "199[0-6]", "low"), rule("gone", "column_name", "order_date", "not_null", None, "low")
    service.apply_rules(UPLOAD, [big, bound, early, gone])
    service.update_rule(UPLOAD, early, name="nineties")
    service.delete_rule(UPLOAD, gone)
    service.apply_rules(UPLOAD, [big, early])
    return service


_STORED = """
with parts as (select o_orderkey as k, o_totalprice as p, o_orderkey % 4 as f, day(o_orderdate) as d, month(o_orderdate) as m, year(o_orderdate) as y from orders),
votes as (select count(*) filter (f = 1 and d > 12) as a, count(*) filter (f = 2 and d > 12) as b, (select max(k) + 1 from parts) as h, (select min(k) from parts where k % 10 = 1) as fixed from parts),
cells as (
  select k + 1 as record_id, 'order_date' as column_name, 'date' as column_type, 'DateAgent' as agent_type, k as row_index, strftime(case when f in (0, 3) or d > 12 or (f = 1) = (a >= b) then make_date(y, m, d) else make_date(y, d, m) end, '%Y-%m-%d') as cleaned_value,
    cast(case when f in (0, 3) or d > 12 then 95 else 75 end as double) as confidence_score, case when f = 0 then 'iso_parse' when f = 3 then 'textual_month_parse' when d > 12 then 'unambiguous_day_gt_12' else 'majority_pattern_inference' end as method from parts, votes
  union all
  select h + k + 1, 'order_amount', 'currency', 'CurrencyAgent', k, case when k = fixed then '77.00' when k % 10 > 1 then printf('%.2f', cast(printf('%.2f', p) as double)) end, cast(case when k = fixed then 100 when k % 10 > 1 then 95 else 0 end as double),
    case k % 10 when 0 then 'missing_value' when 1 then 'unparseable' else 'symbol_usd' end from parts, votes),
violated as (
  select record_id, cast(1 as bigint) as rule_id, 'medium' as severity, 'big' as rule_name, column_name from cells where column_name = 'order_amount' and not coalesce(try_cast(cleaned_value as double) >= 100000, false)
  union all select record_id, 3, 'low', 'nineties', column_name from cells where column_name = 'order_date' and not regexp_matches(cleaned_value, '^199[0-6]')),
events as (
  select record_id, agent_type as agent_name, 'clean_value' as action, method as what from cells
  union all select record_id, 'RuleEngine', 'rule_violation', severity from violated
  union all select h + fixed + 1, 'UserFeedback', 'user_correction', '77.00' from votes)
"""


def _what():
    return F.coalesce(*[F.get_json_object("details", f"$.{x}") for x in ("method", "severity", "corrected_value")]).alias("what")


@_registered(_STORED + "select 'cells' as what, count(*) as n from cells union all select 'events', count(*) from events union all select 'violations', count(*) from violated")
def orders_cleaned_and_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other queries read, made anew: typing, cleaning, storing, insights, a correction and rules."""
    store = _set_up(spark, sf_dir).store
    count = lambda what, rows: rows.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count("cells", store.cells(UPLOAD)).unionByName(count("events", store.audit(UPLOAD))).unionByName(count("violations", store.violations(UPLOAD)))


# Reading.


@_registered(_STORED + "select record_id, column_name, column_type, agent_type, row_index, cleaned_value, confidence_score from cells")
def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of an upload, with no limit, and the correction laid over."""
    return served(spark, sf_dir).store.cells(UPLOAD).select("record_id", "column_name", "column_type", "agent_type", "row_index", "cleaned_value", "confidence_score")


@_registered(_STORED + "select record_id, row_index, cleaned_value, confidence_score, record_id in (select record_id from violated) as has_rule_violation from cells where column_name = 'order_amount' and confidence_score < 96 order by confidence_score desc nulls last, record_id limit 50 offset 10")
def page_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is the feature here: 50 cells from the tenth on."""
    store = served(spark, sf_dir).store
    page = store.page(UPLOAD, "order_amount", 96.0, "confidence_score", True, 50, 10)
    return store.with_violation_flag(UPLOAD, page).select("record_id", "row_index", "cleaned_value", "confidence_score", "has_rule_violation")


@_registered(_STORED + "select column_name, case when confidence_score >= 90 then 'High' when confidence_score >= 60 then 'Medium' else 'Low' end as band, count(*) as n from cells group by all")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.bands(served(spark, sf_dir).store.cells(UPLOAD), "confidence_score")


@_registered(_STORED + "select record_id, agent_name, action, what from events where record_id in (select record_id from violated where rule_id = 1)")
def lineage_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the cells that break one rule."""
    store = served(spark, sf_dir).store
    wanted = store.violations(UPLOAD).where("rule_id = 1")
    return store.lineages(UPLOAD, wanted).select("record_id", "agent_name", "action", _what())


@_registered(_STORED + "select record_id, agent_name, action, what, true as has_lineage from events where record_id = (select h + fixed + 1 from votes)")
def lineage_of_a_corrected_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = served(spark, sf_dir)
    record = service.store.cells(UPLOAD).where("confidence_score = 100").first()["record_id"]
    events = service.store.lineage(UPLOAD, record)
    return events.select("record_id", "agent_name", "action", _what(), F.lit(service.lineage(UPLOAD, record)["has_lineage"]).alias("has_lineage"))


@_registered(_STORED + "select agent_name, action, count(*) as n from events group by all")
def stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for every cell that was written, every violation and every correction."""
    return served(spark, sf_dir).store.audit(UPLOAD).groupBy("agent_name", "action").agg(F.count("*").alias("n"))


@_registered("select i, column_name from (values (0, 'order_amount'), (1, 'order_date')) t(i, column_name)")
def stored_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(served(spark, sf_dir).columns(UPLOAD))), "i int, column_name string")


@_registered("select cast(1 as bigint) as upload_id, 'data/orders.csv' as filename, count(*) as row_count, 'completed' as status, true as has_time, 'cleaned_orders.csv' as download from orders")
def stored_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = served(spark, sf_dir)
    name = F.lit(export.download_name(service.upload(UPLOAD)["filename"])).alias("download")
    return service.store.uploads().select("upload_id", "filename", "row_count", "status", F.col("uploaded_at").isNotNull().alias("has_time"), name)


@_registered(
    _STORED
    + """, mine as (select k, max(cleaned_value) filter (column_name = 'order_date') as day, max(try_cast(cleaned_value as double)) filter (column_name = 'order_amount' and row_index <> (select fixed from votes)) as v from (select row_index as k, * from cells) group by k),
    q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b from mine), months as (select substr(day, 1, 7) as period, cast(sum(cast(v as decimal(28, 6))) as double) as total, count(v) as n from mine where v is not null group by 1),
    w as (select *, lag(total) over (order by period) as t0, lag(n) over (order by period) as n0 from months)
    select true as available, 0 as n_correlations, cast(least(8, (select count(*) from w where t0 <> 0 and n >= 3 and n0 >= 3 and abs((total - t0) / t0) >= 0.2)) as int) as n_trends, cast((select count(*) from mine, q where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a)) as int) as anomaly_count,
      'Fewer than 2 numeric columns available — correlation analysis skipped.' as warning"""
)
def insight_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was computed and kept when the upload was cleaned."""
    found = served(spark, sf_dir).insights(UPLOAD)
    row = (found["available"], len(found["correlations"]), len(found["trends"]), found["anomaly_count"], "; ".join(found["warnings"]))
    return spark.createDataFrame([row], "available boolean, n_correlations int, n_trends int, anomaly_count int, warning string")


@_registered(_ODD + "select count(*) as n_anomalies, greatest(count(*), 300) as n_points, min(value) as low, max(value) as high from odd")
def anomaly_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anomalies, and normal values up to 300 points in all: the limit is the feature."""
    df = table(spark, sf_dir, "events").withColumnRenamed("event_id", "row_index")
    points = statistics.anomaly_points(df, "value", statistics.anomalies(df, ["value"]))
    odd = F.when(F.col("is_anomaly"), F.round("value", 2))
    return points.agg(F.count(odd).alias("n_anomalies"), F.count("*").alias("n_points"), F.min(odd).alias("low"), F.max(odd).alias("high"))


# Rules and corrections.


@_registered(_STORED + "select record_id, rule_id, severity, rule_name, column_name from violated")
def rule_violation_join_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served(spark, sf_dir).store.violations(UPLOAD).select("record_id", "rule_id", "severity", "rule_name", "column_name")


@_registered(_STORED + "select rule_id, severity, count(*) as n from violated group by all")
def rule_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.counts(served(spark, sf_dir).store.violations(UPLOAD))


@_registered(
    """select * from (values (1::bigint, 'big', 'gte', '100000', true, true), (2, 'bound', 'lte', '150000.5', true, false), (3, 'nineties', 'regex_match', '"199[0-6]"', true, true), (4, 'gone', 'not_null', null, false, false)) t(rule_id, name, condition_operator, condition_value, is_active, applied)"""
)
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as they are after being created, changed, applied and deleted."""
    service = served(spark, sf_dir)
    applied = service.applied_rules(UPLOAD)
    rows = [(r.rule_id, r.name, r.condition_operator, r.row()["condition_value"], r.is_active, r.rule_id in applied) for r in service.rules(UPLOAD)]
    return spark.createDataFrame(rows, "rule_id bigint, name string, condition_operator string, condition_value string, is_active boolean, applied boolean")


@_registered(
    """select p_partkey, case p_partkey % 9 when 0 then 0 when 1 then 1 when 2 then 1 when 3 then 1 when 4 then 1 when 5 then 1 when 6 then 1 when 7 then case when p_size > 25 then 1 else 0 end else case when p_size > 25 then 2 else 1 end end as n_errors from part"""
)
def rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition for every part: sound ones, conditions of the wrong kind, unknown targets, bounds that clash with a rule that is there."""
    k = F.col("p_partkey") % 9
    parts = table(spark, sf_dir, "part").select("p_partkey", k.alias("k"), F.col("p_size").cast("double").alias("size"))
    schema = "p_partkey bigint, n_errors int"

    def check(batches):
        import pandas as pd

        there = [rules.Rule(1, 1, "most", "column_name", "v", "lte", 25.0), rules.Rule(2, 1, "off", "column_name", "v", "lte", 1.0, is_active=False)]
        for b in batches:
            made = []
            for kind, size in zip(b["k"], b["size"]):
                op, value, target, target_kind = [
                    ("not_null", None, "v", "column_name"), ("gte", str(size), "v", "column_name"), ("in", "a", "v", "column_name"), ("regex_match", "(", "v", "column_name"), ("not_null", size, "v", "column_name"),
                    ("eq", size, "colour", "detected_type"), ("near", size, "v", "column_name"), ("gte", size, "v", "column_name"), ("gte", "x" if size > 25 else size, "w", "column_name"),
                ][kind]
                made.append(len(rules.validate(rules.Rule(0, 1, "r", target_kind, target, op, value), {"v"}, there)))
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "n_errors": made})

    return parts.mapInPandas(check, schema)


@_registered(_STORED + "select cast(1 as bigint) as feedback_id, 'currency' as column_type, 'free' as original_value, cast(null as varchar) as agent_output, '77.00' as corrected_value, 100.0::double as confidence_score, '{\"previous_value\":null,\"corrected_value\":\"77.00\"}' as details")
def correction_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a correction leaves: the row for reuse, found by its exact value, the cell, and the event."""
    store = served(spark, sf_dir).store
    kept = feedback.exact(store.table("feedback"), "currency", "free").drop("created_at")
    event = store.audit(UPLOAD).where("action = 'user_correction'").select("record_id", "details")
    return kept.crossJoin(event.join(store.cells(UPLOAD).select("record_id", "confidence_score"), "record_id").drop("record_id"))  # one row each


@_registered(
    """with c as (select p_partkey, lower(regexp_replace(p_name, '\\s+', ' ', 'g')) as key, p_brand from part where p_partkey % 2 = 0 order by p_partkey desc limit 500)
    select key, arg_max(p_brand, p_partkey) as corrected_value from c group by key"""
)
def feedback_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a type's corrections the 500 latest count: the limit is the feature."""
    k = F.col("p_partkey")
    made = table(spark, sf_dir, "part").select(
        k.cast("bigint").alias("feedback_id"), F.when(k % 2 == 0, "name").otherwise("other").alias("column_type"), F.concat(F.lit(" "), F.upper("p_name")).alias("original_value"), F.lit(None).cast("string").alias("agent_output"), F.col("p_brand").alias("corrected_value"), F.timestamp_seconds(k).alias("created_at")
    )
    return feedback.latest(made, "name")


def _segment_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction for every customer: its name, spelt in two ways, stands for its segment."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("bigint").alias("feedback_id"), F.when(k % 4 == 0, "other").otherwise("name").alias("column_type"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("c_name"))).otherwise(F.col("c_name")).alias("original_value"),
        F.lit(None).cast("string").alias("agent_output"), F.col("c_mktsegment").alias("corrected_value"), F.timestamp_seconds(k).alias("created_at"),
    )


@_registered("select cast(max(c_custkey) as bigint) as feedback_id, arg_max(c_mktsegment, c_custkey) as corrected_value from customer where c_custkey % 4 <> 0 and c_custkey % 3 <> 0 and c_name = (select max(c_name) from customer where c_custkey % 4 <> 0 and c_custkey % 3 <> 0)")
def feedback_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact value only: not the one that differs by white space and case."""
    made = _segment_corrections(spark, sf_dir)
    name = made.where("column_type = 'name' and original_value not like ' %'").agg(F.max("original_value")).first()[0]
    return feedback.exact(made, "name", name).select("feedback_id", "corrected_value")


@_registered(
    """select cast(c_custkey as bigint) as feedback_id, case when c_custkey % 4 = 0 then 'other' else 'name' end as column_type, case when c_custkey % 3 = 0 then ' ' || lower(c_name) else c_name end as original_value,
      case when c_custkey % 5 = 0 and c_custkey % 3 <> 0 and c_custkey % 4 <> 0 then 'was' end as agent_output, case when c_custkey % 5 = 0 and c_custkey % 3 <> 0 and c_custkey % 4 <> 0 then 'n' || c_nationkey else c_mktsegment end as corrected_value from customer
    union all select (select max(c_custkey) from customer) + row_number() over (order by c_name), 'name', c_name, 'was', 'n' || c_nationkey from customer where c_custkey % 5 = 0 and (c_custkey % 3 = 0 or c_custkey % 4 = 0)"""
)
def feedback_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new value for every fifth customer's name, exactly as it is written: some are there and are replaced, others are added."""
    changes = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.lit("name").alias("column_type"), F.col("c_name").alias("original_value"), F.lit("was").alias("agent_output"), F.concat(F.lit("n"), "c_nationkey").alias("corrected_value"), F.timestamp_seconds(F.lit(9)).alias("created_at"))
    return feedback.upsert(_segment_corrections(spark, sf_dir), changes).drop("created_at")


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.cast("bigint").alias("record_id"), F.lit("price").alias("column_name"), F.lit("currency").alias("column_type"), k.alias("row_index"), two_decimals(F.col("o_totalprice")).alias("cleaned_value"))


@_registered(
    """with r as (select p_partkey as rule_id, p_partkey % 4 as kind, p_retailprice as price, p_size from part),
    c as (select o_orderkey as record_id, printf('%.2f', o_totalprice) as v, cast(printf('%.2f', o_totalprice) as double) as x from orders),
    span as (select max(x) as top from c)
    select cast(rule_id as bigint) as rule_id, cast(record_id as bigint) as record_id from r, c, span where (kind = 0 and x < price) or (kind = 1 and x > top - price) or (kind = 2 and p_size = 1 and not starts_with(v, '1')) or (kind = 3 and p_size = 50 and v not in (printf('%.2f', price), printf('%.2f', price + 1)))"""
)
def rules_by_the_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every part over the prices of all orders: lower and upper bounds, a pattern and values to choose from for some."""
    # One small file makes as many rows as there are cells times rules; tasks by its own size would be one or two.
    cells = _prices(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "record_id")
    top = cells.agg(F.max(F.col("cleaned_value").cast("double"))).first()[0]
    price, kind = F.col("p_retailprice"), F.col("p_partkey") % 4
    of = lambda *values: F.when(kind == 0, values[0]).when(kind == 1, values[1]).when(kind == 2, values[2]).otherwise(values[3])
    made = table(spark, sf_dir, "part").where((kind < 2) | (F.col("p_size") == F.when(kind == 2, 1).otherwise(50))).select(
        F.col("p_partkey").cast("bigint").alias("rule_id"), F.when(kind == 0, "detected_type").otherwise("column_name").alias("target_kind"), F.when(kind == 0, "currency").otherwise("price").alias("target_value"),
        of(*[F.lit(x) for x in ("gte", "lte", "regex_match", "in")]).alias("condition_operator"), of(price.cast("string"), (F.lit(top) - price).cast("string"), F.lit('"1"'), F.to_json(F.array(two_decimals(price), two_decimals(price + 1)))).alias("condition_value"),
        F.lit("flag").alias("action"), F.lit("medium").alias("severity"), F.lit(True).alias("is_active"),
    )
    return rules.violations_of_table(cells, made).select("rule_id", "record_id")


@_registered(
    """with v as (select c_custkey, case when c_custkey % 10 = 3 then case when c_custkey % 20 = 3 then -1.0 else 5000.0 end else cast(printf('%.2f', c_acctbal) as double) end as x from customer)
    select cast(c_custkey as bigint) as row_index, rule_id from v, (values ('least'), ('most')) r(rule_id) where (rule_id = 'least' and x < 0) or (rule_id = 'most' and x > 9000)"""
)
def violations_after_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the balances of all customers are applied, a tenth of the cells is corrected, and only these are judged anew: what
    stands is what a judgement of all cells would say."""
    service = Service(spark, scratch(spark))
    upload = service.store.create_upload("balances.csv")
    value = two_decimals(F.col("c_acctbal"))
    cell = F.struct(value.alias("original_value"), value.alias("cleaned_value"), F.lit(95.0).alias("confidence"), F.lit("m").alias("method"), F.lit("CurrencyAgent").alias("agent_type"), F.lit(False).alias("flagged"), F.lit("{}").alias("details"))
    service.store.write_cells(upload, table(spark, sf_dir, "customer").select(F.lit(0).alias("ordinal"), F.lit("balance").alias("column_name"), F.lit("currency").alias("column_type"), F.col("c_custkey").cast("bigint").alias("row_index"), cell.alias("cell")))
    ids = [service.create_rule(upload, name=n, target_kind="column_name", target_value="balance", condition_operator=op, condition_value=v).rule_id for n, op, v in (("least", "gte", 0), ("most", "lte", 9000))]
    service.apply_rules(upload, ids)
    cells = service.store.cells(upload)
    service.correct_many(upload, cells.where("row_index % 10 = 3").select("record_id", F.when(F.col("row_index") % 20 == 3, "-1.0").otherwise("5000.0").alias("corrected_value")))
    found = service.store.violations(upload).join(cells.select("record_id", "row_index"), "record_id")
    return found.select("row_index", F.col("rule_name").alias("rule_id"))


# Types, routing, narratives.


def every_type(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """A column of each kind, by rules of the key."""
    k = F.col("c_custkey")
    text = k.cast("string")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    columns = {
        "born": pick("2020-01-05", "05/01/2020", "5-1-2020", "May 5, 2020"),
        "plot": F.concat(text, pick(" sq.ft", "%", " lakh", "K")),
        "built area": text,
        "where": pick("Konak, İzmir", "Çankaya - Ankara", "Türkiye, Van"),
        "customer age": (k % 60 + 18).cast("string"),
        "stage": (k % 60 + 18).cast("string"),
        "count": (k % 60 + 18).cast("string"),
        "mail": F.concat(F.lit("u"), text, F.lit("@mail.com")),
        "kind": pick("a", "b"),
        "currency_hint": pick("USD", "TRY"),
    }
    return table(spark, sf_dir, "customer").select(k.alias("row_index"), *[c.alias(f"c{i}") for i, c in enumerate(columns.values())]), list(columns)


@_registered(
    """select * from (values ('born', 'date', 'DateAgent', 1.0), ('plot', 'quantity', 'QuantityAgent', 1.0), ('built area', 'quantity', 'QuantityAgent', 1.0), ('where', 'address', 'AddressAgent', 1.0), ('customer age', 'numeric_age', 'NumericAgent', 1.0), ('stage', 'numeric_age', 'NumericAgent', 1.0),
    ('count', null, 'unclassified', 0.0), ('mail', 'email', 'ContactAgent', 1.0), ('kind', 'categorical', 'unclassified', 0.96), ('currency_hint', 'categorical', 'unclassified', 0.96)) t(column_name, detected_type, agent, confidence), (select 'currency_hint' as hint_column)"""
)
def detected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, columns = every_type(spark, sf_dir)
    rows = [(t.column, t.detected_type, t.agent, float(t.confidence), profiling.currency_hint_column(columns)) for t in profiling.detect(df.toDF("row_index", *columns), columns)]
    return spark.createDataFrame(rows, "column_name string, detected_type string, agent string, confidence double, hint_column string")


class _Fixed:
    """A client with prepared answers."""

    def __init__(self, answers: dict):
        self.answers, self.asked = answers, []

    def extract_structured(self, *, system_prompt: str, data: dict, response_model=None):
        answer = self.answers.get(data.get("column_name", data.get("metric")))
        self.asked.append((data.get("column_name"), len(data.get("sample_values", []))))
        if isinstance(answer, Exception):
            raise answer
        return answer


@_registered(
    """select * from (values ('count', 'NumericAgent', 0.8, 'no profile', null), ('notes', 'unclassified', 0.0, 'yes', 'unknown'), ('odd', 'unclassified', 0.0, 'yes', null), ('kind', 'unclassified', 0.96, 'no', null)) t(column_name, agent, confidence, llm_attempted, llm_agent_guess), (select 'count:20 notes:20 odd:20' as asked)"""
)
def routing_with_a_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that no detector placed are put to the classifier with at most 20 values; confidences beyond 100 are no answer."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("row_index"), (k % 60).cast("string").alias("c0"), F.concat(F.lit("n "), k).alias("c1"), F.concat(F.lit("o "), k).alias("c2"), (k % 2).cast("string").alias("c3"))
    client = _Fixed({"count": {"agent_type": "NumericAgent", "confidence": 80}, "notes": {"agent_type": "unknown", "confidence": 10}, "odd": {"agent_type": "DateAgent", "confidence": 250}})
    plan = cleaning.route(df, ["count", "notes", "odd", "kind"], client, DecisionLog())
    asked = " ".join(f"{c}:{n}" for c, n in client.asked)
    rows = [(t.column, t.agent, float(t.confidence), *(("yes" if t.profile["llm_attempted"] else "no", t.profile["llm_agent_guess"]) if t.profile else ("no profile", None)), asked) for t in plan.types]
    return spark.createDataFrame(rows, "column_name string, agent string, confidence double, llm_attempted string, llm_agent_guess string, asked string")


@_registered(
    """with l as (select *, l_extendedprice * (1 - l_discount) as net from lineitem), r as (select 'l_quantity' as a, 'l_extendedprice' as b, round(corr(l_quantity, l_extendedprice), 3) as r from l union all select 'l_quantity', 'net', round(corr(l_quantity, net), 3) from l union all select 'l_extendedprice', 'net', round(corr(l_extendedprice, net), 3) from l)
    select 'As ' || a || ' increases, ' || b || ' tends to ' || case when r > 0 then 'increase' else 'decrease' end || ' (r=' || r || '). Correlation does not imply causation.' as text from r where abs(r) >= 0.4"""
)
def narrative_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    found = statistics.correlations(df, ["l_quantity", "l_extendedprice", "net"])
    return found.select(narratives.correlation_text(F.col("col1"), F.col("col2"), F.col("r"), F.col("direction")).alias("text"))


@_registered("select o_orderkey, o_orderkey % 4 <> 1 and o_orderkey % 4 <> 3 as known from orders")
def narrative_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that give a share as it is or in percent, one with another number, one with a date."""
    k = F.col("o_orderkey") % 4
    share = (F.col("o_orderkey") % 100) / F.lit(100.0)
    number = lambda c: c.cast("string")
    text = F.when(k == 0, F.concat(F.lit("about "), number(share))).when(k == 1, F.concat(F.lit("up to "), number(share * 100 + 7000))).when(k == 2, F.concat(number(F.round(share * 100, 0)), F.lit("%"))).otherwise(F.concat(number(share), F.lit(" in 2025-12")))
    return table(spark, sf_dir, "orders").select("o_orderkey", narratives.known_numbers_only(text, [share]).alias("known"))


# Cleaners at their edges.


@_registered("select o_orderkey, case when o_orderkey % 2 = 1 then '2024-12-13' end as cleaned_value, cast(case when o_orderkey % 2 = 1 then 95 else 0 end as double) as confidence, case when o_orderkey % 2 = 1 then 'unambiguous_day_gt_12' else 'invalid_date_components' end as method, o_orderkey % 2 = 0 as flagged from orders")
def date_both_parts_too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, "13/14/2024").otherwise("12-13-2024")
    return cells_of(table(spark, sf_dir, "orders"), text, dates.cleaner(F.lit(True), F.lit(9))).select("o_orderkey", *flat())


@_registered(
    """with s as (select p_partkey, p_partkey % 7 as k, cast(printf('%.2f', p_retailprice) as double) as p from part)
    select p_partkey, case when k = 4 then null when k = 3 then '1234567.00' when k in (0, 1) then '1234.56' when k = 2 then '85.50' when k = 5 then '1234567.00' else printf('%.2f', p) end as cleaned_value, cast(case when k in (0, 1, 5) then 75 when k = 4 then 0 else 95 end as double) as confidence,
      case when k = 4 then 'unparseable' else 'quantity_normalized' end as method, k = 4 as flagged, k in (0, 6) as looks_like from s"""
)
def quantity_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number literals of all shapes; a bare one is a quantity only if a symbol, a magnitude or a unit says so."""
    k = F.col("p_partkey") % 7
    text = F.when(k == 0, "€1.234,56").when(k == 1, "1,234.56").when(k == 2, "85,5").when(k == 3, "1.234.567").when(k == 4, "1.2.3").when(k == 5, "1,234,567").otherwise(F.concat(two_decimals(F.col("p_retailprice")), F.lit(" %")))
    cells = cells_of(table(spark, sf_dir, "part"), text, quantities.cleaner())
    return cells.select("p_partkey", *flat(), quantities.looks_like(text).alias("looks_like"))


@_registered("select c_custkey, 'book' || c_custkey || '@mail.com' as cleaned_value, 75.0::double as confidence, 'cleaned_then_validated' as method, false as flagged from customer")
def email_lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter that only its lower case makes plain: the sign of the unit kelvin."""
    text = F.concat(F.lit("BOOK"), F.col("c_custkey").cast("string"), F.lit("@Mail.com"))
    return cells_of(table(spark, sf_dir, "customer"), text, contacts.cleaner("email")).select("c_custkey", *flat())


def _resolver(value: str, examples: list[dict]) -> dict | None:
    if value.startswith("capital"):
        return {"province": "Ankara", "district": "Çankaya"}
    if value.startswith("wrong"):
        return {"province": "Ankara", "district": "Kadıköy"}
    if value.startswith("Kolkata"):
        return {"normalized_address": "Kolkata, India"}
    return {"normalized_address": f"Mumbai, India {len(examples)}"} if value.startswith("made up") else None


@_registered(
    """with s as (select c_custkey, c_custkey % 6 as k from customer)
    select c_custkey, case k when 0 then 'Çankaya, Ankara, Türkiye' when 2 then 'Kolkata, India' when 5 then 'Van, Türkiye' end as cleaned_value, cast(case k when 0 then 80 when 2 then 70 when 5 then 75 else 0 end as double) as confidence,
      case k when 0 then 'llm_resolution' when 2 then 'llm_international_resolution' when 5 then 'lookup_table_partial_match' else 'unresolved' end as method, k not in (0, 2, 5) as flagged, case k when 2 then '{"scope":"international"}' when 0 then '{}' when 5 then '{}' else '{"llm_available":true}' end as details from s"""
)
def address_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers count if the table or the input bears them out. Three examples of five are shown."""
    k = F.col("c_custkey")
    texts = F.array(*[F.lit(x) for x in ["capital ", "wrong ", "Kolkata ", "made up ", "nowhere ", "Van "]])
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.element_at(texts, (k % 6 + 1).cast("int")), (k % 50).cast("string")).alias("raw"))
    found = addresses.resolve(df, "raw", _resolver, [{"original_value": str(i)} for i in range(5)])
    df = df.join(found, F.col("raw") == F.col("value"), "left").drop("value")
    return cells_of(df, F.col("raw"), addresses.cleaner(F.col("resolved"), True)).select("c_custkey", *flat(), F.col("cell.details").alias("details"))


_WORD = "[A-Za-z\u00e0-\u00ff]{8,}"


@_registered(
    f"""with words as (select distinct unnest(regexp_extract_all(lower(text), '{_WORD}')) as name from documents),
    outers as (select distinct left(name, 6) as name from words),
    d as (select doc_id, lower(text) as t from documents),
    chosen as (select doc_id, t, min(md5(o.name) || o.name) as o from d join outers o on contains(t, o.name) group by doc_id, t),
    parts as (select c.doc_id, min(md5(w.name) || w.name) as w from chosen c join words w on left(w.name, 6) = substr(c.o, 33) and contains(c.t, w.name) group by c.doc_id)
    select d.doc_id, substr(c.o, 33) as outer_name, substr(p.w, 33) as inner_name from d left join chosen c using (doc_id) left join parts p using (doc_id)"""
)
def places_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer of all long words of the documents under their first letters, looked up in all documents: the first in order of the
    outer names that a text holds, then the first of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORD})"))).alias("name")).distinct()
    path = scratch(spark)
    both = words.select("name", F.substring("name", 1, 6).alias("outer")).unionByName(words.select(F.substring("name", 1, 6).alias("name"), F.lit(None).cast("string").alias("outer")).distinct())
    key = lambda level, name: F.xxhash64(F.lit(level), name)
    of = F.col("outer")
    order = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 15), 16, 10).cast("bigint")  # the first sixty bits
    both.select(key(of.isNotNull(), F.col("name")).alias("id"), "name", F.when(of.isNotNull(), key(F.lit(False), of)).alias("outer_id"), order.alias("rank")).write.parquet(path)
    found = gazetteer.places(docs, "text", spark.read.parquet(path))
    return found.select("doc_id", F.col("place.outer").alias("outer_name"), F.col("place.inner").alias("inner_name"))


# Files and the service's edges.


@_registered("select c_custkey % 5 = 0 or c_custkey % 5 = 1 as missing, count(*) as n, count(distinct c_custkey) as n_keys from customer group by all")
def folder_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written and read as text by Spark: texts that stand for no value are null, quoted line breaks stay."""
    k = F.col("c_custkey")
    value = F.when(k % 5 == 0, "NA").when(k % 5 == 1, "").otherwise(F.concat(F.lit('two\nlines, "quoted" '), k.cast("string")))
    path = scratch(spark)
    table(spark, sf_dir, "customer").select(k.cast("string").alias("key"), value.alias("value")).write.csv(f"{path}/files", header=True, escape='"')
    read = csv_folder.read(spark, f"{path}/files", f"{path}/work", ["key", "value"]).rows
    whole = F.col("value") == F.concat(F.lit('two\nlines, "quoted" '), F.col("key"))
    return read.where(F.col("value").isNull() | whole).groupBy(F.col("value").isNull().alias("missing")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@_registered(
    """select cast(c_custkey as bigint) as row_index, cast(c_custkey as varchar) as whole, case when c_custkey % 3 > 0 then cast(c_nationkey as varchar) || '.0' end as gaps, case when c_custkey % 2 = 0 then 'x' else '0' || c_custkey end as text, cast(c_custkey as varchar) || '.5' as decimals from customer where c_custkey > 0"""
)
def canonical_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a table with inferred types prints them: leading zeros go, whole numbers beside blanks or decimals gain a decimal."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").where("c_custkey > 0").select(k.cast("bigint").alias("row_index"), F.concat(F.lit("00"), k).alias("whole"), F.when(k % 3 > 0, F.concat(F.lit(" "), "c_nationkey")).alias("gaps"), F.when(k % 2 == 0, "x").otherwise(F.concat(F.lit("0"), k)).alias("text"), F.concat(k, F.lit(".50")).alias("decimals"))
    return uploads.canonical(df, ["whole", "gaps", "text", "decimals"])


@_registered(
    """select cast(c_custkey as varchar) as key, case when c_custkey % 3 <> 2 then c_name || chr(10) || 'said "' || c_mktsegment || '", twice' else c_name end as name, cast(c_nationkey as varchar) as nation, cast(null as varchar) as error, cast(1 as bigint) as n from customer where c_custkey % 50 <> 5 or c_custkey % 3 <> 2
    union all select null, null, null, 'CSVParseError', count(*) from customer where c_custkey % 50 = 5 and c_custkey % 3 = 2 having count(*) > 0"""
)
def files_of_unlike_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their columns in three orders, line breaks and quotes in fields, and rows with a field too many: every row by name, and
    every row that cannot be read as an error."""
    k, path = F.col("c_custkey"), scratch(spark)
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), k.cast("string").alias("key"), "c_name", F.concat(F.col("c_name"), F.lit('\nsaid "'), F.col("c_mktsegment"), F.lit('", twice')).alias("name"), F.col("c_nationkey").cast("string").alias("nation"))
    rows.where("k % 3 = 0").select("key", "name", "nation").write.csv(f"{path}/files/a", header=True, escape='"')
    rows.where("k % 3 = 1").select("nation", F.lit("x").alias("other"), "key", "name").write.csv(f"{path}/files/b", header=True, escape='"')
    surplus = F.when(F.col("k") % 50 == 5, F.concat(F.col("c_name"), F.lit(",surplus"))).otherwise(F.col("c_name"))
    rows.where("k % 3 = 2").select(F.concat_ws(",", surplus, "nation", "key").alias("name,nation,key")).write.csv(f"{path}/files/c", header=True, sep="\t")
    found = csv_folder.read(spark, f"{path}/files", f"{path}/work", ["key", "name", "nation"])
    good = found.rows.select("key", "name", "nation", F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("n"))
    none = F.lit(None).cast("string")
    return good.unionByName(found.errors.groupBy("error").agg(F.count("*").alias("n")).select(none.alias("key"), none.alias("name"), none.alias("nation"), "error", "n"))


#: Letters of the texts, and those that stand for them in a Turkish and, with the plain ones, in a Russian file.
_WESTERN, _TURKISH = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ", "ıöüğçüâşöşıİÜĞÖÇŞÂÜÖİ"
_PLAIN, _RUSSIAN = "abcdefghijklmnopqrstuvwxyz" + _WESTERN, "абцдефгхийклмнопярстувшызж" + "еоенцуеаосиеенощаеуои"


@_registered(
    f"""with d as (select doc_id, regexp_replace(text, '[^\\x20-\\x7E\\n{_WESTERN}]', '', 'g') as t from documents where doc_id is not null),
    r as (select doc_id, case doc_id % 4 when 2 then translate(t, '{_WESTERN}', '{_TURKISH}') when 3 then translate(t, '{_PLAIN}', '{_RUSSIAN}') else t end as t from d)
    select cast(doc_id as varchar) as key, md5(t) as digest from r where t <> ''"""
)
def files_of_four_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in files of UTF-8, a western, a Turkish and a Russian code page; whole texts come back."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.regexp_replace("text", f"[^\\x20-\\x7E\\n{_WESTERN}]", "").alias("text")).where("text <> ''")
    image = lambda letters, encoding: letters.encode(encoding).decode("latin-1")  # noqa: E731  the characters that Latin-1 has for a page's bytes
    made = {"utf-8": F.col("text"), "iso-8859-1": F.col("text"), "windows-1254": F.translate("text", _WESTERN, image(_TURKISH, "windows-1254")), "windows-1251": F.translate("text", _PLAIN, image(_RUSSIAN, "windows-1251"))}
    for i, (name, text) in enumerate(made.items()):
        mine = docs.where(F.col("doc_id") % 4 == i).select(F.col("doc_id").cast("string").alias("key"), text.alias("text"))
        mine.write.csv(f"{path}/files/{name}", header=True, escape='"', encoding="utf-8" if i == 0 else "iso-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = csv_folder.read(spark, f"{path}/files", f"{path}/work", ["key", "text"], no_value=[])
    return found.rows.select("key", F.md5(F.col("text").cast("binary")).alias("digest"))


@_registered("select * from (values ('bad sort', 'BadRequest'), ('bad direction', 'BadRequest'), ('limit 0', 'BadRequest'), ('confidence 101', 'BadRequest'), ('unknown upload', 'NotFound'), ('unknown record', 'NotFound'), ('foreign rule', 'Unprocessable'), ('limit 500', '200'), ('most megabytes', '20'), ('extensions', '.csv')) t(what, answer)")
def service_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = served(spark, sf_dir)
    calls = {
        "bad sort": lambda: service.cells(UPLOAD, sort_by="method"), "bad direction": lambda: service.cells(UPLOAD, sort_dir="up"), "limit 0": lambda: service.cells(UPLOAD, limit=0), "confidence 101": lambda: service.cells(UPLOAD, max_confidence=101),
        "unknown upload": lambda: service.columns(99), "unknown record": lambda: service.lineage(UPLOAD, -5), "foreign rule": lambda: service.apply_rules(UPLOAD, [99]), "limit 500": lambda: len(service.cells(UPLOAD, limit=500)["items"]),
        "most megabytes": lambda: service.config()["max_upload_size_mb"], "extensions": lambda: ",".join(service.config()["allowed_extensions"]),
    }
    rows = []
    for what, call in calls.items():
        try:
            rows.append((what, str(call())))
        except (BadRequest, NotFound, Unprocessable) as error:
            rows.append((what, type(error).__name__))
    return spark.createDataFrame(rows, "what string, answer string")
