"""A file's way through the service: validation, cleaning, reading, correcting, rules, export, deletion."""

import json
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.operators.resolvers import CircuitBreaker
from siftwell.plans.service import BadRequest, Service, Unprocessable
from siftwell.sources import commits, csv_folder, store, uploads
from siftwell.sources.decisions import DecisionLog, JsonLines
from siftwell.sources.store import NotFound, StoreError

CSV = b"""customer_id,name,order_date,order_amount,customer_age
1,Ann,2024-03-05,"85,50",34
2,Bob,25/03/2024,$120.50, thirty-five
3,Cem,soon,free,
"""


@pytest.fixture()
def service(spark, tmp_path):
    return Service(spark, f"file://{tmp_path}/store")


def test_bytes():
    with pytest.raises(uploads.EmptyFileError):
        uploads.load(b"", "a.csv")
    with pytest.raises(uploads.FileTooLargeError):
        uploads.load(b"a,b\n1,2\n", "a.csv", max_bytes=7)
    assert uploads.load(b"a,b\n1,2\n", "a.CSV", max_bytes=8).rows == [["1", "2"]]
    for raw, name in ((b"a\n1\n", "a.txt"), (b"\x89PNG\r\n\x1a\nxx", "a.csv"), (b"a\x00b\n", "a.csv")):
        with pytest.raises(uploads.InvalidFileTypeError):
            uploads.load(raw, name)
    with pytest.raises(uploads.EmptyFileError):
        uploads.load(b"\n\n", "a.csv")
    with pytest.raises(uploads.CSVParseError):
        uploads.load(b"a,b\n1,2,3\n", "a.csv")
    header = uploads.load(b"a,b,c\n", "a.csv")
    assert header.columns == ["a", "b", "c"] and header.rows == [] and "zero data rows" in header.warnings[0]
    double = uploads.load(b"name,name,email\nx,y\n\n,NA,z\n", "a.csv")
    assert double.columns == ["name", "name.1", "email"] and "name" in double.warnings[0] and double.rows == [["x", "y", None], [None, None, "z"]]
    assert uploads.load("ad\nGöl\n".encode("latin-1"), "a.csv").encoding != "utf-8"


def test_a_folder_is_one_upload(service, tmp_path):
    (tmp_path / "in").mkdir()
    for i, body in enumerate(("2024-03-05,N/A\n25/03/2024,\"x\ny\"\n", "soon\n,z\n")):
        (tmp_path / "in" / f"{i}.csv").write_text("order_date,note\n" + body)
    done = service.ingest_folder(str(tmp_path / "in"), ["order_date", "note"])
    assert done["rows"] == 4 and set(done["columns_cleaned"]) == {"order_date"} and service.upload(done["upload_id"])["status"] == "completed"
    rows = {tuple(r) for r in service.export(done["upload_id"]).collect()}
    assert rows == {("2024-03-05", "N/A"), ("2024-03-25", "x\ny"), (None, None), (None, "z")}
    with pytest.raises(NotFound):
        service.original(done["upload_id"])


def test_a_file_is_kept_as_it_came(service):
    raw = "\ufefforder_date,note\r\n2024-03-05,G\xf6l\r\n".encode()
    upload = service.ingest(raw, "a.csv")["upload_id"]
    assert service.original(upload) == raw
    service.delete_upload(upload)
    assert not service.store.exists(service._original(upload))


def test_a_file_is_cleaned_and_read(service):
    done = service.ingest(CSV, "dir/orders.csv")
    upload = done["upload_id"]
    assert done["rows"] == 3 and set(done["columns_cleaned"]) == {"order_date", "order_amount", "customer_age"} and done["columns_unclassified"] == ["customer_id", "name"]
    assert done["columns_cleaned"]["order_date"] == {"agent_type": "DateAgent", "rows_processed": 3, "rows_flagged": 1, "rows_influenced_by_feedback": 0}
    assert service.upload(upload)["status"] == "completed" and service.columns(upload) == ["customer_age", "order_amount", "order_date"]
    page = service.cells(upload, limit=999999)
    assert (page["limit"], page["total"]) == (200, 9) and [r["row_index"] for r in page["items"][:4]] == [0, 1, 2, 0]
    assert service.cells(upload, max_confidence=0)["items"] == []
    low = service.cells(upload, max_confidence=50, sort_by="confidence_score", sort_dir="desc")["items"]
    assert all(r["confidence_score"] < 50 for r in low)
    with pytest.raises(BadRequest):
        service.cells(upload, sort_by="1; drop table")
    assert service.insights(upload)["available"] and service.download_name(upload) == "cleaned_orders.csv"
    rows = [tuple(r) for r in service.export(upload).collect()]
    assert rows[1] == ("2", "Bob", "2024-03-25", "120.50", "35") and rows[2][2] is None
    other = service.ingest(CSV, "b.csv")["upload_id"]
    record = service.cells(other)["items"][0]["record_id"]
    assert record not in {r["record_id"] for r in page["items"]}
    with pytest.raises(NotFound):
        service.lineage(upload, record)
    assert [u["upload_id"] for u in service.uploads()] == [other, upload]
    service.delete_upload(upload)
    with pytest.raises(NotFound):
        service.cells(upload)
    assert service.cells(other)["total"] == 9


def test_corrections_are_reused(service):
    first = service.ingest(CSV, "a.csv")["upload_id"]
    record = next(r for r in service.cells(first, "order_date")["items"] if r["original_value"] == "soon")
    fixed = service.correct(first, record["record_id"], "2024-04-01")
    assert (fixed["cleaned_value"], fixed["confidence_score"]) == ("2024-04-01", 100.0)
    entries = service.lineage(first, record["record_id"])["entries"]
    assert [e["action"] for e in entries] == ["clean_value", "user_correction"] and json.loads(entries[1]["details"]) == {"previous_value": None, "corrected_value": "2024-04-01"}
    assert [r["order_date"] for r in service.export(first).collect()][2] == "2024-04-01"
    service.correct(first, record["record_id"], "2024-05-01")
    again = service.ingest(CSV.replace(b"soon", b"  SOON"), "b.csv")
    assert again["columns_cleaned"]["order_date"]["rows_influenced_by_feedback"] == 1
    cell = next(r for r in service.cells(again["upload_id"], "order_date")["items"] if r["row_index"] == 2)
    assert (cell["cleaned_value"], cell["confidence_score"]) == ("2024-05-01", 95.0)
    assert "influenced_by_prior_feedback" in service.lineage(again["upload_id"], cell["record_id"])["entries"][0]["details"]


def test_rules_apply_when_told(service):
    upload = service.ingest(CSV, "a.csv")["upload_id"]
    rule = service.create_rule(upload, name="big", target_kind="column_name", target_value="order_amount", condition_operator="gte", condition_value=100)
    assert service.violations(upload) == [] and [r.name for r in service.rules(upload)] == ["big"]
    assert service.apply_rules(upload, [rule.rule_id])["violation_count"] == 2
    found = service.violations(upload)
    assert {v["rule_name"] for v in found} == {"big"} and len(found) == 2
    flagged = {r["record_id"] for r in service.cells(upload)["items"] if r["has_rule_violation"]}
    assert flagged == {v["record_id"] for v in found}
    assert any(e["agent_name"] == "RuleEngine" for e in service.lineage(upload, found[0]["record_id"])["entries"])
    assert service.apply_rules(upload, [rule.rule_id])["violation_count"] == 2 and len(service.violations(upload)) == 2
    service.apply_rules(upload, [])
    assert service.violations(upload) == [] and service.applied_rules(upload) == []
    with pytest.raises(Unprocessable):
        service.apply_rules(upload, [999])
    with pytest.raises(Unprocessable):
        service.create_rule(upload, name="low", target_kind="column_name", target_value="order_amount", condition_operator="lte", condition_value=5)
    assert service.update_rule(upload, rule.rule_id, severity="high", condition_value=None).condition_value == 100
    service.apply_rules(upload, [rule.rule_id])
    service.delete_rule(upload, rule.rule_id)
    assert service.violations(upload) == [] and service.applied_rules(upload) == [] and service.rules(upload, active_only=True) == []
    assert not service.rules(upload)[0].is_active


def test_a_failed_write_leaves_nothing(service, spark):
    upload = service.store.create_upload("a.csv")
    bad = spark.sql("select 0 ordinal, 'v' column_name, 'date' column_type, 0L row_index, named_struct('original_value', 'x', 'cleaned_value', 'x', 'confidence', 150D, 'method', 'm', 'agent_type', 'A', 'flagged', false, 'details', '{}') cell")
    with pytest.raises(StoreError):
        service.store.write_cells(upload, bad)
    assert service.upload(upload)["status"] == "failed" and service.store.cells(upload).count() == 0
    with pytest.raises(NotFound):
        service.store.write_cells(999, bad)


def test_an_unfinished_write_shows_nothing(service, spark, monkeypatch):
    """Cells are written, then the writer is gone: readers go by the upload's status and by its commits."""
    upload = service.ingest(CSV, "a.csv")["upload_id"]
    cells = service.store.cells(upload).count()
    service.store.set_status(upload, "pending")
    assert cells > 0 and service.store.cells(upload).count() == 0 and service.store.audit(upload).count() == 0 and service.columns(upload) == []
    service.store.set_status(upload, "completed")
    rule = service.create_rule(upload, name="big", target_kind="column_name", target_value="order_amount", condition_operator="gte", condition_value=100)
    service.apply_rules(upload, [rule.rule_id])
    events, create = service.store.audit(upload).count(), commits.Files.create

    def gone(self, path, text):  # the process ends when all is written but the commit
        raise SystemExit

    monkeypatch.setattr(commits.Files, "create", gone)
    with pytest.raises(SystemExit):
        service.store.clear_violations(upload, [rule.rule_id])
    monkeypatch.setattr(commits.Files, "create", create)
    assert service.store.audit(upload).count() == events and len(service.violations(upload)) == 2
    service.store.clear_violations(upload, [rule.rule_id])
    assert service.store.audit(upload).count() == events - 2 and service.violations(upload) == []
    assert {e["action"] for e in service.audit(upload)} == {"clean_value"}


def cells_of(spark, rows, columns=2, confidence=50.0):
    cell = F.struct(F.col("row_index").cast("string").alias("original_value"), F.concat(F.lit("v"), F.col("row_index")).alias("cleaned_value"), (F.lit(confidence) + F.col("row_index") % 40).alias("confidence"), F.lit("m").alias("method"), F.lit("A").alias("agent_type"), F.lit(False).alias("flagged"), F.lit("{}").alias("details"))
    return spark.range(rows).select(F.col("id").alias("row_index")).select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("ordinal"), "row_index").select("ordinal", F.concat(F.lit("col"), "ordinal").alias("column_name"), F.lit("date").alias("column_type"), "row_index", cell.alias("cell"))


def test_lookups_open_few_files(service, spark, monkeypatch):
    """A cell and its lineage are in one file each of many; pages go through the files in order, from a place or by what they skip."""
    monkeypatch.setattr(store, "FILE_ROWS", 50)
    s, upload = service.store, service.store.create_upload("a.csv")
    s.write_cells(upload, cells_of(spark, 400))
    zones = s.zones(upload, "cells").orderBy("low").collect()
    assert len(zones) >= 12 and sum(z["rows"] for z in zones) == 800 == s.count(upload) and all(a["high"] < b["low"] for a, b in zip(zones, zones[1:]))
    assert len(s._record(upload, "cells", 555).inputFiles()) == 1 and s.cell(upload, 555)["row_index"] == 154
    assert len(s._record(upload, "audit", 555).inputFiles()) == 1 and s.lineage(upload, 555).count() == 1
    s.correct(upload, 555, "new")
    assert len(s._record(upload, "audit", 555).inputFiles()) == 2 and [r["action"] for r in s.lineage(upload, 555).collect()] == ["clean_value", "user_correction"]
    with pytest.raises(NotFound):
        s.cell(upload, 9999)
    ids = lambda page: [r["record_id"] for r in page.collect()]
    assert s.columns(upload) == ["col0", "col1"]
    first = s.page(upload, limit=30)
    assert ids(first) == list(range(1, 31)) and len(first.inputFiles()) <= 3
    assert ids(s.page(upload, limit=30, after=610)) == list(range(611, 641)) and len(s.page(upload, limit=30, after=610).inputFiles()) <= 4
    assert ids(s.page(upload, limit=5, descending=True)) == [800, 799, 798, 797, 796] and ids(s.page(upload, limit=5, descending=True, after=10)) == [9, 8, 7, 6, 5]
    assert ids(s.page(upload, column="col1", limit=3, offset=200)) == [601, 602, 603]
    assert ids(s.page(upload, max_confidence=51.0, limit=100)) == [i for i in range(1, 801) if (i - 1) % 400 % 40 == 0] and ids(s.page(upload, max_confidence=50.0)) == []


def test_a_failed_replacement_keeps_what_was_there(service, spark):
    s, upload = service.store, service.store.create_upload("a.csv")
    s.write_cells(upload, cells_of(spark, 5))
    with pytest.raises(StoreError):
        s.write_cells(upload, cells_of(spark, 5, confidence=90.0 + 20))
    assert service.upload(upload)["status"] == "completed" and s.cells(upload).count() == 10 == s.audit(upload).count()
    s.write_cells(upload, cells_of(spark, 7), audit=False)
    assert s.cells(upload).count() == 14 and s.audit(upload).count() == 0 and s.cells(upload).agg(F.min("record_id")).first()[0] == 11


def test_a_slow_writer_loses_nothing(service, spark, tmp_path, monkeypatch):
    """Two writers of unlike processes (their turns are not shared): one is held up in the middle of its change while the other goes on."""
    from concurrent.futures import ThreadPoolExecutor

    fast, held = store.Store(spark, f"file:{tmp_path}/store"), threading.Event()
    slow, create, tried = service.store, commits.Files.create, []

    def wait(self, path, text):
        if path.startswith("file:///"):
            tried.append(path)
            held.wait(60)
        return create(self, path, text)

    monkeypatch.setattr(commits.Files, "create", wait)
    with ThreadPoolExecutor(1) as pool:
        late = pool.submit(slow.create_upload, "slow.csv")
        early = [fast.create_upload(f"{i}.csv") for i in range(2)]
        fast.update("uploads", F.col("upload_id") == early[0], status=F.lit("failed"))
        held.set()
        assert early == [1, 2] and late.result(120) == 3 and len(tried) == 2
    assert [(r["upload_id"], r["filename"], r["status"]) for r in slow.table("uploads").orderBy("upload_id").collect()] == [(1, "0.csv", "failed"), (2, "1.csv", "pending"), (3, "slow.csv", "pending")]
    assert commits.Files(spark).create(f"{tmp_path}/new", "a") and not commits.Files(spark).create(f"{tmp_path}/new", "b") and (tmp_path / "new").read_text() == "a"


def test_many_small_writes_are_folded(service, spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_SMALL", 3)
    s, upload = service.store, service.store.create_upload("a.csv")
    s.write_cells(upload, cells_of(spark, 3))
    for i in range(6):
        s.correct(upload, 1 + i % 2, str(i))
    assert len(s._parts(upload, "overlay")) <= 3 and {r["record_id"]: r["cleaned_value"] for r in s.cells(upload).where("record_id < 3").collect()} == {1: "4", 2: "5"}
    assert [json.loads(r["details"])["corrected_value"] for r in s.lineage(upload, 1).collect()[1:]] == ["0", "2", "4"]
    assert [s.create_upload(f"{i}.csv") for i in range(5)] == [2, 3, 4, 5, 6] and len(s._history("uploads").snapshot().parts) <= 3


def test_corrections_are_judged_at_once(service, spark):
    """Only corrected cells are judged anew; the rest of the violations stays as it was."""
    upload = service.ingest(CSV, "a.csv")["upload_id"]
    rule = service.create_rule(upload, name="big", target_kind="column_name", target_value="order_amount", condition_operator="gte", condition_value=100)
    assert service.apply_rules(upload, [rule.rule_id])["violation_count"] == 2 and service.reevaluate(upload) == 0
    low, good, bad = sorted(service.cells(upload, "order_amount")["items"], key=lambda r: r["row_index"])
    service.correct(upload, low["record_id"], "500")
    assert [v["record_id"] for v in service.violations(upload)] == [bad["record_id"]]
    values = spark.createDataFrame([(good["record_id"], "5"), (bad["record_id"], "100"), (10**9, "7")], "record_id bigint, corrected_value string")
    assert service.correct_many(upload, values) == 2 and [v["record_id"] for v in service.violations(upload)] == [good["record_id"]]
    assert [json.loads(e["details"])["corrected_value"] for e in service.lineage(upload, good["record_id"])["entries"] if e["action"] == "user_correction"] == ["5"]
    assert service.apply_rules(upload, [rule.rule_id])["violation_count"] == 1 and service.reevaluate(upload) == 0


def test_large_record_numbers(service, spark):
    """Violations of the largest numbers are written, in order of record, then rule."""
    s, upload = service.store, service.store.create_upload("a.csv")
    s.write_cells(upload, cells_of(spark, 1))
    big = (1 << 63) - 2
    found = spark.createDataFrame([(5, big, "c", 0, "v", "low", "flag"), (2, big, "c", 0, "v", "low", "flag"), (9, 1, "c", 0, "v", "low", "flag")], "rule_id bigint, record_id bigint, column_name string, row_index bigint, cleaned_value string, severity string, action string")
    s.write_violations(upload, found, 3)
    assert [(r["record_id"], r["rule_id"]) for r in s.violations(upload).collect()] == [(1, 9), (big, 2), (big, 5)]
    s.clear_violations(upload, [5])
    assert [(r["record_id"], r["rule_id"]) for r in s.violations(upload).collect()] == [(1, 9), (big, 2)]


def test_eight_writers_at_once(service):
    """No update and no id is lost."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda i: service.store.create_upload(f"{i}.csv", i), range(24)))
    assert sorted(ids) == list(range(1, 25)) and {(r["filename"], r["row_count"]) for r in service.store.table("uploads").collect()} == {(f"{i}.csv", i) for i in range(24)}
    with ThreadPoolExecutor(8) as pool:
        bases = list(pool.map(lambda i: service.store._reserve(i, 10), ids[:8]))
    assert sorted(bases) == list(range(0, 80, 10))


def test_canonical_numbers(spark):
    df = uploads.load(b"a,b,c\n007,1,x\n8,,y\n", "a.csv").frame(spark)
    assert [tuple(r)[1:] for r in uploads.canonical(df, ["a", "b", "c"]).orderBy("row_index").collect()] == [("7", "1.0", "x"), ("8", None, "y")]


def test_folders_are_inspected(service, spark, tmp_path):
    for name, raw in {"ok.csv": b"a\n1\n", "x.txt": b"a", "p.csv": b"%PDF-1.4", "n.csv": b"a\x00"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["file"].rsplit("/", 1)[-1]: r["error"] for r in csv_folder.inspect(spark, f"{tmp_path}/*.*").collect()}
    assert got == {"ok.csv": None, "x.txt": "InvalidFileTypeError", "p.csv": "InvalidFileTypeError", "n.csv": "InvalidFileTypeError"}
    with pytest.raises(uploads.InvalidFileTypeError):
        service.ingest_folder(f"{tmp_path}/*.*", ["a"])


def test_folders_of_unlike_files(service, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes(b'order_date,note\n2024-03-05,"x\ny"\n2024-03-06,u,surplus\n')
    (tmp_path / "in/b.csv").write_bytes("note,order_date\nG\u00f6l,25/03/2024\n".encode("windows-1252"))
    with pytest.raises(uploads.CSVParseError, match="row 2"):
        service.ingest_folder(str(tmp_path / "in"), ["order_date", "note"])
    done = service.ingest_folder(str(tmp_path / "in"), refuse=False)
    upload = done["upload_id"]
    assert done["refused"] == 1 and [(r["row"], r["error"]) for r in service.refused(upload).collect()] == [(2, "CSVParseError")]
    assert {tuple(r) for r in service.export(upload).select("order_date", "note").collect()} == {("2024-03-05", "x\ny"), ("2024-03-25", "G\u00f6l")}
    assert not service.store.exists(f"{service.store.root}/work/upload_id={upload}")


def test_decisions_and_breaker(tmp_path):
    class Broken:
        def write(self, decision):
            raise OSError

    log = DecisionLog([Broken(), JsonLines(tmp_path / "log/d.jsonl")])
    log.log("A", "x", input_value=1)
    assert json.loads((tmp_path / "log/d.jsonl").read_text())["action"] == "x"
    now, calls = [0.0], []

    class Client:
        def extract_structured(self, **_):
            calls.append(1)
            raise RuntimeError("429 rate limit")

    breaker = CircuitBreaker(Client(), clock=lambda: now[0])
    ask = lambda: breaker.extract_structured(system_prompt="", data={})
    assert ask() is None and ask() is None and len(calls) == 1
    now[0] = 301.0
    assert ask() is None and len(calls) == 2


@pytest.mark.parametrize(
    "raw",
    [
        b"title,release_date,rating\nA,2024-01-01,7.5\nB,,\n",
        b"x1,x2,x3\n1,2.5,3\n4,5,6\n",
        "id,weird col,ünicode.col\n1,💥,ş\n2,,'; drop table x;--\n".encode(),
        b"value\n1\n2\n",
        b"a,b,c\n1,x,y\n",
        b"a,b\n,\n,\n",
        b"score,label\n-5,a\n-7,b\n",
        b"a,b,c\n",
    ],
)
def test_unrelated_shapes_never_fail(service, raw):
    done = service.ingest(raw, "any.csv")
    upload = service.upload(done["upload_id"])
    assert upload["status"] == "completed" and isinstance(upload["uploaded_at"], datetime)
    header = uploads.load(raw, "any.csv").columns
    assert set(done["columns_cleaned"]) | set(done["columns_unclassified"]) == set(header)
