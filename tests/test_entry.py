"""The registered queries, synthetic data and the inbox."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftwell.plans import catalog
from siftwell.sources import synthetic

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def same(value):
    return None if value is None or value != value else float(value) if isinstance(value, float) else value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(str(tuple(map(same, r))) for r in x[sorted(x.columns)].astype(object).itertuples(index=False)) for x in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_synthetic_data(spark):
    dirty, truth, m = synthetic.generate(spark, 120)
    assert dirty.columns[1:] == synthetic.COLUMNS and dirty.count() == truth.count() == m["n_orders"]
    assert len(m["outlier_rows"]) == 5 and len(m["sql_injection_rows"]) >= 2 and m["seasonal_anomaly"]["spike_multiplier"] > 2
    again = synthetic.generate(spark, 120)[0]
    assert dirty.exceptAll(again).count() == 0
    assert m["age_amount_correlation"]["pearson_r"] > 0.2


def test_facts_of_synthetic_data(spark):
    """What must hold of the orders and their ground truth, whatever the seed's numbers are."""
    n = 300
    dirty, truth, m = synthetic.generate(spark, n)
    people = synthetic.customers(spark, n)
    pairs = truth.join(people.select("customer_id", "age_true", "segment"), "customer_id")
    facts = pairs.agg(
        F.count("*").alias("rows"), F.bool_and(F.col("age_true").between(18, 75)).alias("ages"), (F.countDistinct("segment") == 4).alias("segments"), F.bool_and(F.col("order_amount_true") >= 8).alias("amounts"),
        F.bool_and((F.col("order_date_true") >= F.greatest("signup_date_true", F.lit("2025-01-07"))) | F.col("order_date_true").startswith(synthetic.SPIKE_MONTH)).alias("within"), (F.countDistinct("row_index") == F.max("row_index") + 1).alias("numbered"),
    ).first()
    assert people.count() == n and facts["rows"] == m["n_orders"] == dirty.count() and all(facts[x] for x in ("ages", "segments", "amounts", "within", "numbered"))
    assert abs(len(m["ambiguous_date_rows"]) / m["n_orders"] - 0.015) < 0.001 and 2.4 < m["seasonal_anomaly"]["spike_multiplier"] < 3.1 and len(m["segment_pattern"]) == 4


def test_written_synthetic_data_is_read_back(spark, tmp_path, monkeypatch):
    """Several files, in order, that the reader of folders numbers as they were."""
    from siftwell.sources import csv_folder

    monkeypatch.setattr(synthetic, "ROWS_A_FILE", 100)
    m = synthetic.write(spark, f"file://{tmp_path}/out", 60)
    dirty = synthetic.generate(spark, 60)[0].orderBy("row_index").collect()
    found = csv_folder.read(spark, f"file://{tmp_path}/out/dirty/*.csv", f"file://{tmp_path}/work", synthetic.COLUMNS, no_value=[])
    got = found.rows.orderBy("row_index").collect()
    assert found.errors.count() == 0 and len(got) == m["n_orders"] == len(dirty) and found.files.count() >= 2
    assert all([g[c] for c in synthetic.COLUMNS] == [d[c] or "" for c in synthetic.COLUMNS] and g["row_index"] == d["row_index"] for g, d in zip(got, dirty))
    assert (tmp_path / "out/manifest").exists() and (tmp_path / "out/dictionary").exists()


def test_blocks_of_customers_number_rows_alike(spark, monkeypatch):
    whole = {(r["row_index"], r["customer_id"], r["order_date"]) for r in synthetic.generate(spark, 60)[0].collect()}
    monkeypatch.setattr(synthetic, "CUSTOMERS_A_BLOCK", 7)
    monkeypatch.setattr(synthetic, "MOST_LISTED", 1)
    dirty, _, m = synthetic.generate(spark, 60)
    assert {(r["row_index"], r["customer_id"], r["order_date"]) for r in dirty.collect()} == whole and m["outlier_rows"] == 5


def test_orders_are_made_by_all_cores_and_lie_in_parts(spark, monkeypatch):
    """However few tasks the customers come from; a part's rows lie in order, so that writing them takes no shuffle."""
    monkeypatch.setattr(synthetic, "LEAST_ROWS_A_FILE", 50)
    people = synthetic.people(spark.range(1, 61, 1, 1).select(F.col("id").alias("customer_id")))
    assert people.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = synthetic.labelled(people)
    got = rows.select(F.spark_partition_id().alias("task"), "part", "row_index").collect()
    assert [r["row_index"] for r in sorted(got, key=lambda r: r["task"])] == list(range(len(got)))
    assert len({r["part"] for r in got}) == len({r["task"] for r in got}) == len(got) // 50 > 4
    dirty = synthetic.tables(rows.persist().sortWithinPartitions("part", "order_date_true", "customer_id", "order_no"))[0].drop("row_index")
    plan = dirty._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    rows.unpersist()
    assert "Exchange" not in plan


def test_the_kth_smallest(spark):
    r = random.Random(2)
    values = [r.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [5] * 30 + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 115, 130, 231, 232, 500):
        assert synthetic.kth_smallest(df, "v", k) == sorted(values)[min(k, len(values)) - 1]
    assert synthetic.kth_smallest(df.limit(0), "v", 3) is None


def test_an_inbox_batch_that_is_run_again(spark, tmp_path):
    """The stream fails after its first file is stored and half-way through its second; run again it takes each once."""
    from siftwell.plans.service import Service
    from siftwell.streaming import inbox

    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_bytes(b"order_date\n2024-01-01\n")
    service = Service(spark, f"file://{tmp_path}/store", max_bytes=1000)
    (folder / "large.csv").write_bytes(b"order_date\n" + b"2024-01-02\n" * 200)
    clean, calls = service.clean, []

    def broken(upload_id, df, columns):
        calls.append(upload_id)
        if len(calls) == 2:
            raise RuntimeError("gone")
        return clean(upload_id, df, columns)

    service.clean = broken
    with pytest.raises(Exception):
        inbox.watch(service, str(folder), str(tmp_path / "checkpoint")).awaitTermination(120)
    inbox.watch(service, str(folder), str(tmp_path / "checkpoint")).awaitTermination(240)
    done = service.uploads()
    assert sorted(u["filename"].rsplit("/", 1)[-1] for u in done) == ["a.csv", "b.csv", "large.csv"] and {u["status"] for u in done} == {"completed"} and sorted(u["row_count"] for u in done) == [1, 1, 200]


def test_inbox(spark, tmp_path):
    from siftwell.plans.service import Service
    from siftwell.streaming import inbox

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"order_date\n2024-01-01\n")
    (folder / "b.txt").write_bytes(b"x")
    service, refused = Service(spark, f"file://{tmp_path}/store"), []
    for _ in range(2):  # the second run finds nothing new
        inbox.watch(service, str(folder), str(tmp_path / "checkpoint"), lambda path, e: refused.append(path)).awaitTermination(120)
    assert [u["filename"] for u in service.uploads()] == ["a.csv"] and len(refused) == 1
