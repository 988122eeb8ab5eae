"""Stored tables, each a history of commits over folders of Parquet files; no locks.

Small tables (uploads, corrections for reuse, rules, applied rules) take a row as a folder of its own, and are folded into one when
there are many; changes rewrite them. What belongs to an upload (its cells, audit events and corrections) shares one
history, so that cells and their events appear together, and replacing them is one step: readers see the old ones until
then, and keep them if the writer fails. An upload's cells and events count only while its row says ``completed``.

Cells and events lie in files of ranges of record_id, sorted, each with a zone: its rows, least and largest record_id, columns and
confidences. The cell, the lineage and the pages in order of record_id open only the files whose zones can hold them.
Human corrections are an overlay joined at reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Files, History, Snapshot

SCHEMA_VERSION = 2
SMALL = {
    "uploads": "upload_id bigint, filename string, uploaded_at timestamp, row_count bigint, status string, insights_json string, record_base bigint",
    "feedback": "feedback_id bigint, column_type string, original_value string, agent_output string, corrected_value string, created_at timestamp",
    "rules": "rule_id bigint, upload_id bigint, name string, target_kind string, target_value string, condition_operator string, condition_value string, action string, severity string, is_active boolean, created_at timestamp",
    "inbox": "inbox_id bigint, path string, modified timestamp, upload_id bigint, taken_at timestamp",
    "applied": "applied_id bigint, upload_id bigint, rule_id bigint, applied_at timestamp",
}
CELLS = "record_id bigint, column_name string, row_index bigint, original_value string, cleaned_value string, confidence_score double, agent_type string, column_type string, created_at timestamp, upload_id bigint"
AUDIT = "record_id bigint, agent_name string, action string, details string, timestamp timestamp, batch bigint, place bigint, step bigint, upload_id bigint"
OVERLAY = "record_id bigint, corrected_value string, corrected_at timestamp, place bigint, upload_id bigint"
INNER = {"cells": CELLS, "audit": AUDIT, "overlay": OVERLAY}
ZONES = "file string, rows bigint, low bigint, high bigint, columns array<string>, least double, most double"
#: The order of events.
EVENT_ORDER = ("batch", "place", "step")
SORTABLE = ("record_id", "column_name", "confidence_score", "original_value", "cleaned_value")
MAX_PAGE = 200
#: Rows of a file of cells or events; folders of up to FEW_ROWS rows are folded into one when there are more than MOST_SMALL of them.
FILE_ROWS, FEW_ROWS, MOST_SMALL = 500_000, 10_000, 30
#: Records that are looked up by themselves.
_FEW_IDS = 100


class StoreError(RuntimeError):
    """A write that did not take place, or a request for what is not there."""


class NotFound(StoreError): ...


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def exists(self, path: str) -> bool:
        return self.files.exists(path)

    def remove(self, path: str) -> None:
        self.files.remove(path)

    def _history(self, name: str) -> History:
        return History(self.files, f"{self.root}/{name}")

    # Small tables.

    def _rows(self, name: str, now: Snapshot) -> DataFrame:
        if not now.parts:
            return self.spark.createDataFrame([], SMALL[name])
        return self.spark.read.schema(SMALL[name]).parquet(*[f"{self.root}/{name}/{p['folder']}" for p in now.parts])

    def table(self, name: str) -> DataFrame:
        return self._rows(name, self._history(name).snapshot())

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select([F.col(c).cast(t).alias(c) for c, t in (tuple(f.split()) for f in SMALL[name].split(", "))])

    def change(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces a small table by what make says of its rows as they are when no other writer comes in between."""
        history = self._history(name)

        def write(now: Snapshot):
            folder = history.new_folder()
            self._shaped(name, make(self._rows(name, now))).coalesce(1).write.parquet(f"{history.path}/{folder}")
            return [{"folder": folder, "top": max([p["top"] for p in now.parts], default=0)}], [p["folder"] for p in now.parts]

        history.change(write)

    def insert(self, name: str, key: str, stamp: str, row: dict) -> int:
        """Appends a row with the next id under key and the time under stamp; returns the id. Ids are never given twice."""
        history, given = self._history(name), 0

        def write(now: Snapshot):
            nonlocal given
            given = max([p["top"] for p in now.parts], default=0) + 1
            one = self.spark.createDataFrame([row | {key: given, stamp: None}], SMALL[name]).withColumn(stamp, F.current_timestamp())
            folder, fold = history.new_folder(), len(now.parts) >= MOST_SMALL
            (self._rows(name, now).unionByName(one) if fold else one).coalesce(1).write.parquet(f"{history.path}/{folder}")
            return [{"folder": folder, "top": given}], [p["folder"] for p in now.parts] if fold else []

        history.change(write)
        return given

    def update(self, name: str, where: Column, /, **values: Column) -> None:
        self.change(name, lambda rows: rows.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()}))

    # Uploads.

    def create_upload(self, filename: str, row_count: int | None = None) -> int:
        return self.insert("uploads", "upload_id", "uploaded_at", {"filename": filename, "row_count": row_count, "status": "pending", "insights_json": None, "record_base": None})

    def set_status(self, upload_id: int, status: str, row_count: int | None = None) -> None:
        self.upload(upload_id)
        mine = F.col("upload_id") == upload_id
        self.update("uploads", mine, status=F.lit(status), **({} if row_count is None else {"row_count": F.lit(row_count)}))

    def save_insights(self, upload_id: int, text: str) -> None:
        self.update("uploads", F.col("upload_id") == upload_id, insights_json=F.lit(text))

    def upload(self, upload_id: int) -> dict:
        row = self.table("uploads").where(F.col("upload_id") == upload_id).first()
        if row is None:
            raise NotFound(f"Upload {upload_id} does not exist.")
        return row.asDict()

    def uploads(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self.table("uploads").orderBy(F.desc("upload_id")).offset(offset).limit(min(limit, MAX_PAGE))

    def delete_upload(self, upload_id: int) -> None:
        self.upload(upload_id)
        for name in ("applied", "rules", "uploads"):
            self.change(name, lambda rows: rows.where((F.col("upload_id") != upload_id) | F.col("upload_id").isNull()))
        self.remove(self._of(upload_id).path)

    # What belongs to an upload.

    def _of(self, upload_id: int) -> History:
        return self._history(f"data/upload_id={upload_id}")

    def _shown(self, upload_id: int) -> bool:
        return self.table("uploads").where((F.col("upload_id") == upload_id) & (F.col("status") == "completed")).count() > 0

    def _parts(self, upload_id: int, name: str, kind: str | None = None) -> list[dict]:
        """The folders of a completed upload; of others there is nothing to be seen."""
        parts = [p for p in self._of(upload_id).snapshot().parts if p["table"] == name and kind in (None, p["kind"])]
        return parts if parts and self._shown(upload_id) else []

    def _read(self, upload_id: int, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], INNER[name])
        inner = ", ".join(f for f in INNER[name].split(", ") if f.split()[0] != "upload_id")
        return self.spark.read.schema(inner).parquet(*paths).withColumn("upload_id", F.lit(upload_id).cast("bigint"))

    def _whole(self, upload_id: int, name: str, kind: str | None = None) -> DataFrame:
        root = self._of(upload_id).path
        return self._read(upload_id, name, [f"{root}/{p['folder']}/files" for p in self._parts(upload_id, name, kind)])

    def zones(self, upload_id: int, name: str, record_id: int | None = None) -> DataFrame:
        """A row a file of an upload's cells or events; with record_id, of the files that can hold it."""
        root = self._of(upload_id).path
        parts = [p for p in self._parts(upload_id, name) if record_id is None or p["low"] <= record_id <= p["high"]]
        if not parts:
            return self.spark.createDataFrame([], ZONES)
        rows = self.spark.read.schema(ZONES).parquet(*[f"{root}/{p['folder']}/zones" for p in parts])
        return rows if record_id is None else rows.where((F.col("low") <= record_id) & (F.col("high") >= record_id))

    def _record(self, upload_id: int, name: str, record_id: int) -> DataFrame:
        """One record's rows, from the files that can hold them."""
        paths = [r["file"] for r in self.zones(upload_id, name, record_id).collect()]  # one file of cells; of events one a folder
        return self._read(upload_id, name, paths).where(F.col("record_id") == record_id)

    def _write(self, history: History, name: str, kind: str, rows: DataFrame, n: int) -> dict | None:
        """rows as a folder of sorted files with their zones; what a commit notes of it. n: about how many rows there are."""
        folder = history.new_folder()
        path = f"{history.path}/{folder}"
        keys = ["record_id", *(EVENT_ORDER if name == "audit" else ())]
        files = -(-n // FILE_ROWS)
        dealt = rows.coalesce(1) if files <= 1 else rows.repartitionByRange(files, "record_id")
        dealt.sortWithinPartitions(*keys).write.parquet(f"{path}/files")
        of_cells = name == "cells"
        columns = F.array_sort(F.collect_set("column_name")) if of_cells else F.lit(None).cast("array<string>")
        least, most = (F.min("confidence_score"), F.max("confidence_score")) if of_cells else (F.lit(None).cast("double"),) * 2
        written = self.spark.read.schema(rows.schema).parquet(f"{path}/files").select("record_id", *(("column_name", "confidence_score") if of_cells else ()), F.col("_metadata.file_path").alias("file"))
        zones = written.groupBy("file").agg(F.count("*").alias("rows"), F.min("record_id").alias("low"), F.max("record_id").alias("high"), columns.alias("columns"), least.alias("least"), most.alias("most"))
        zones.coalesce(1).write.parquet(f"{path}/zones")
        all_ = self.spark.read.schema(ZONES).parquet(f"{path}/zones").agg(F.sum("rows"), F.min("low"), F.max("high")).first()
        return {"folder": folder, "table": name, "kind": kind, "rows": all_[0] or 0, "low": 0 if all_[1] is None else all_[1], "high": -1 if all_[2] is None else all_[2]}

    def _append(self, upload_id: int, make: Callable[[Snapshot], list[tuple[str, str, DataFrame, int]]]) -> None:
        """Adds folders (table, kind, rows, their number) in one commit; small ones of a kind are folded when there are many."""
        history = self._of(upload_id)

        def write(now: Snapshot):
            added, gone = [], []
            for name, kind, rows, n in make(now):
                small = [p for p in now.parts if (p["table"], p["kind"]) == (name, kind) and p["rows"] <= FEW_ROWS]
                if len(small) >= MOST_SMALL:
                    old = self._read(upload_id, name, [f"{history.path}/{p['folder']}/files" for p in small]).drop("upload_id")
                    rows, n = rows.unionByName(old), n + sum(p["rows"] for p in small)
                    gone += [p["folder"] for p in small]
                added.append(self._write(history, name, kind, rows, n))
            return added, gone

        history.change(write)

    def _reserve(self, upload_id: int, records: int) -> int:
        """So many record numbers of its own for an upload; returns the one before the first."""
        base: list[int] = []

        def make(rows: DataFrame) -> DataFrame:
            base.append(rows.agg(F.max("record_base")).first()[0] or 0)
            return rows.withColumn("record_base", F.when(F.col("upload_id") == upload_id, base[-1] + records).otherwise(F.col("record_base")))

        self.change("uploads", make)
        return base[-1]

    def write_cells(self, upload_id: int, cells: DataFrame, audit: bool = True) -> None:
        """cells: column_name, ordinal, row_index, column_type and the cell struct. All or nothing; with audit, an event for
        every cell. What was stored of the upload before is replaced by one commit, and stays if that does not come about."""
        self.upload(upload_id)
        history = self._of(upload_id)
        # Numbers follow column after column, row after row, without a shuffle.
        size = cells.agg(F.max("row_index"), F.max("ordinal"), F.min("cell.confidence"), F.max("cell.confidence"), F.count_if(F.col("cell.confidence").isNull()), F.count("*")).first()
        before = history.snapshot().parts
        made: list[dict] = []
        try:
            if size[0] is not None and (size[2] < 0 or size[3] > 100 or size[4]):
                raise StoreError("Confidence scores lie between 0 and 100.")
            height = (size[0] or 0) + 1
            base = self._reserve(upload_id, height * ((size[1] if size[1] is not None else -1) + 1))
            record_id = F.lit(base) + F.col("ordinal").cast("bigint") * height + F.col("row_index") + 1
            numbered = cells.select(record_id.alias("record_id"), "column_name", "row_index", "column_type", "cell")
            rows = numbered.select("record_id", "column_name", "row_index", "cell.original_value", "cell.cleaned_value", F.col("cell.confidence").alias("confidence_score"), "cell.agent_type", "column_type", F.current_timestamp().alias("created_at"))
            made.append(self._write(history, "cells", "cells", rows, size[5]))
            if audit:
                inner = F.col("cell.details")
                rest = F.when(inner == "{}", F.lit("}")).otherwise(F.concat(F.lit(", "), F.substring(inner, 2, 1_000_000_000)))
                info = F.concat(F.lit('{"method": "'), F.col("cell.method"), F.lit('", "flagged": '), F.col("cell.flagged").cast("string"), rest)
                events = numbered.select("record_id", F.col("cell.agent_type").alias("agent_name"), F.lit("clean_value").alias("action"), info.alias("details"), F.col("record_id").alias("place"))
                made.append(self._write(history, "audit", "cells", self._events(events, 1), size[5]))
            history.change(lambda now: (made, [p["folder"] for p in now.parts]), made_before=True)
        except Exception as error:
            for part in made:
                self.remove(f"{history.path}/{part['folder']}")
            if not before:
                self.set_status(upload_id, "failed")
            raise error if isinstance(error, StoreError) else StoreError(f"Cells of upload {upload_id} could not be written.") from error
        self.set_status(upload_id, "completed")

    @staticmethod
    def _events(events: DataFrame, batch: int) -> DataFrame:
        step = F.col("step") if "step" in events.columns else F.lit(0)
        return events.select("record_id", "agent_name", "action", "details", F.current_timestamp().alias("timestamp"), F.lit(batch).cast("bigint").alias("batch"), F.col("place").cast("bigint").alias("place"), step.cast("bigint").alias("step"))

    def write_audit(self, upload_id: int, events: DataFrame, kind: str = "other", n: int = 1) -> None:
        """events: record_id, agent_name, action, details, place and step (their order within this call); n: about how many."""
        self._append(upload_id, lambda now: [("audit", kind, self._events(events, now.version + 1), n)])

    def audit(self, upload_id: int) -> DataFrame:
        """Events; EVENT_ORDER is their order."""
        return self._whole(upload_id, "audit")

    def _corrected(self, upload_id: int, cells: DataFrame) -> DataFrame:
        """Cells with the latest correction of each laid over; corrections are few and one row a cell."""
        parts = self._parts(upload_id, "overlay")
        if not parts:
            return cells
        last = self._whole(upload_id, "overlay").groupBy("record_id").agg(F.max_by("corrected_value", "place").alias("corrected_value"))
        mine = F.col("corrected_value").isNotNull()
        joined = cells.join(last, "record_id", "left")
        return joined.withColumns({"cleaned_value": F.coalesce("corrected_value", "cleaned_value"), "confidence_score": F.when(mine, 100.0).otherwise(F.col("confidence_score"))}).drop("corrected_value").select(*cells.columns)

    def cells(self, upload_id: int) -> DataFrame:
        return self._corrected(upload_id, self._whole(upload_id, "cells"))

    def count(self, upload_id: int) -> int:
        """The number of cells, from the commit."""
        return sum(p["rows"] for p in self._parts(upload_id, "cells"))

    def page(self, upload_id: int, column: str | None = None, max_confidence: float | None = None, sort_by: str = "record_id", descending: bool = False, limit: int = 50, offset: int = 0, after: int | None = None) -> DataFrame:
        """A page of cells; confidence below max_confidence; an unknown sort column falls back to record_id, which also settles ties.
        after: only cells beyond this record_id in the order (by record_id), which makes every page as cheap as the first."""
        limit = min(limit, MAX_PAGE)
        key = sort_by if sort_by in SORTABLE else "record_id"

        def chosen(rows: DataFrame) -> DataFrame:
            if column is not None:
                rows = rows.where(F.col("column_name") == column)
            if max_confidence is not None:
                rows = rows.where(F.col("confidence_score") < max_confidence)
            if after is not None:
                rows = rows.where(F.col("record_id") < after if descending else F.col("record_id") > after)
            return rows

        order = F.desc_nulls_last(key) if descending else F.asc_nulls_first(key)
        if key != "record_id":
            return chosen(self.cells(upload_id)).orderBy(order, "record_id").offset(offset).limit(limit)
        zones = self.zones(upload_id, "cells")
        if column is not None:
            zones = zones.where(F.array_contains("columns", column))
        if max_confidence is not None:  # a correction only raises a confidence
            zones = zones.where(F.col("least") < max_confidence)
        if after is not None:
            zones = zones.where(F.col("low") < after if descending else F.col("high") > after)
        zones = zones.orderBy(F.desc("high") if descending else F.asc("low"))
        rows, take = None, 2
        while True:  # the files in order, twice as many if the page is not full yet
            files = [r["file"] for r in zones.limit(take).collect()]
            rows = chosen(self._corrected(upload_id, self._read(upload_id, "cells", files)))
            if len(files) < take or rows.limit(offset + limit).count() >= offset + limit:
                return rows.orderBy(order).offset(offset).limit(limit)
            take *= 2

    def columns(self, upload_id: int) -> list[str]:
        return sorted(r[0] for r in self.zones(upload_id, "cells").select(F.explode("columns")).distinct().collect())

    def lineage(self, upload_id: int, record_id: int) -> DataFrame:
        self.cell(upload_id, record_id)
        return self._record(upload_id, "audit", record_id).orderBy(*EVENT_ORDER)

    def lineages(self, upload_id: int, records: DataFrame) -> DataFrame:
        """The events of all cells whose record_id is in records; (record_id, batch, place, step) is their order."""
        return self.audit(upload_id).join(records.select("record_id").distinct(), "record_id", "left_semi")

    def cell(self, upload_id: int, record_id: int) -> dict:
        row = self._corrected(upload_id, self._record(upload_id, "cells", record_id)).first()
        if row is None:
            raise NotFound(f"Record {record_id} does not exist in upload {upload_id}.")
        return row.asDict()

    def correct(self, upload_id: int, record_id: int, value: str) -> dict:
        """A human's value for a cell."""
        self.cell(upload_id, record_id)
        one = self.spark.range(1).select(F.lit(record_id).cast("bigint").alias("record_id"), F.lit(value).alias("corrected_value"))
        self._correct(upload_id, self._corrected(upload_id, self._record(upload_id, "cells", record_id)), one, 1)
        return self.cell(upload_id, record_id)

    def correct_many(self, upload_id: int, values: DataFrame) -> int:
        """values: record_id, corrected_value, one row a cell, as many as wanted; of cells that are not there nothing is kept. Returns
        how many were corrected."""
        n = values.join(self.cells(upload_id), "record_id", "left_semi").count()
        if n:
            self._correct(upload_id, self.cells(upload_id), values, n)
        return n

    def _correct(self, upload_id: int, cells: DataFrame, values: DataFrame, n: int) -> None:
        """Values are laid over their cells and recorded, in one commit, and kept for reuse."""
        from ..operators import feedback

        path = f"{self.root}/work/corrections-{upload_id}-{uuid.uuid4().hex}"
        met = cells.join(values.select("record_id", "corrected_value"), "record_id").select("record_id", "original_value", F.coalesce("column_type", "agent_type").alias("kind"), F.col("cleaned_value").alias("before"), "corrected_value", F.current_timestamp().alias("at"))
        met.write.parquet(path)  # what was there before, as it is now
        met = self.spark.read.schema(met.schema).parquet(path)
        try:
            info = F.to_json(F.struct(F.col("before").alias("previous_value"), "corrected_value"), {"ignoreNullFields": "false"})
            events = met.select("record_id", F.lit("UserFeedback").alias("agent_name"), F.lit("user_correction").alias("action"), info.alias("details"), F.col("record_id").alias("place"))
            over = met.select("record_id", "corrected_value", F.col("at").alias("corrected_at"))
            self._append(upload_id, lambda now: [("overlay", "overlay", over.withColumn("place", F.lit(now.version + 1).cast("bigint")), n), ("audit", "corrections", self._events(events, now.version + 1), n)])
            kept = met.where("original_value is not null").groupBy(F.col("kind").alias("column_type"), "original_value").agg(F.max_by(F.struct(F.col("before").alias("agent_output"), "corrected_value", F.col("at").alias("created_at")), "record_id").alias("x")).select("column_type", "original_value", "x.*")
            self.change("feedback", lambda rows: feedback.upsert(rows, kept))
        finally:
            self.remove(path)

    def some_cells(self, upload_id: int, records: DataFrame) -> DataFrame:
        """The cells whose record_id is in records; of a few, from the files that can hold them."""
        ids = [r[0] for r in records.select("record_id").distinct().limit(_FEW_IDS + 1).collect()]
        if len(ids) > _FEW_IDS:
            return self.cells(upload_id).join(records.select("record_id").distinct(), "record_id", "left_semi")
        hit = reduce(lambda a, i: a | ((F.col("low") <= i) & (F.col("high") >= i)), ids, F.lit(False))
        paths = [r["file"] for r in self.zones(upload_id, "cells").where(hit).collect()]
        return self._corrected(upload_id, self._read(upload_id, "cells", paths).where(F.col("record_id").isin(ids)))

    def version(self, upload_id: int) -> int:
        """The number of the upload's latest commit."""
        return self._of(upload_id).snapshot().version

    def changed_since(self, upload_id: int, version: int) -> DataFrame:
        """record_id of the cells that were corrected in commits after this one."""
        return self._whole(upload_id, "overlay").where(F.col("place") > version).select("record_id").distinct()

    # Rules.

    def rules(self, upload_id: int | None = None, active_only: bool = False) -> list:
        import json

        from ..operators.rules import Rule

        rows = self.table("rules")
        if upload_id is not None:
            rows = rows.where(F.col("upload_id") == upload_id)
        if active_only:
            rows = rows.where("is_active")
        found = [r.asDict() for r in rows.orderBy(F.desc("created_at"), F.desc("rule_id")).collect()]
        return [Rule(**(r | {"condition_value": None if r["condition_value"] is None else json.loads(r["condition_value"])})) for r in found]

    def create_rule(self, rule) -> int:
        rule.rule_id = self.insert("rules", "rule_id", "created_at", rule.row())
        return rule.rule_id

    def update_rule(self, rule_id: int, **fields) -> None:
        """Fields that are None stay as they are."""
        import json

        values = {k: F.lit(json.dumps(v) if k == "condition_value" else v) for k, v in fields.items() if v is not None}
        if values:
            self.update("rules", F.col("rule_id") == rule_id, **values)

    def delete_rule(self, rule_id: int) -> None:
        """The rule stays as inactive; it is applied nowhere any more and its violations go."""
        for row in self.table("applied").where(F.col("rule_id") == rule_id).select("upload_id").distinct().collect():
            self.clear_violations(row[0], [rule_id])
        self.change("applied", lambda rows: rows.where(F.col("rule_id") != rule_id))
        self.update("rules", F.col("rule_id") == rule_id, is_active=F.lit(False))

    def applied_rules(self, upload_id: int) -> list[int]:
        return sorted(r[0] for r in self.table("applied").where(F.col("upload_id") == upload_id).select("rule_id").collect())

    def set_applied(self, upload_id: int, rule_ids: list[int]) -> tuple[set[int], set[int]]:
        """Makes these the applied rules; violations of rules that no longer are go. Returns what was added and removed."""
        from ..operators.rules import applied_difference

        moved: list[set[int]] = []

        def make(rows: DataFrame) -> DataFrame:
            mine = rows.where(F.col("upload_id") == upload_id).select("rule_id")
            add, drop = applied_difference(mine, self.spark.createDataFrame([(r,) for r in set(rule_ids)], "rule_id bigint"))
            moved[:] = [{r[0] for r in add.collect()}, {r[0] for r in drop.collect()}]  # the rules of one upload
            first = (rows.agg(F.max("applied_id")).first()[0] or 0) + 1
            new = self.spark.createDataFrame([(first + i, upload_id, r, None) for i, r in enumerate(sorted(moved[0]))], SMALL["applied"]).withColumn("applied_at", F.current_timestamp())
            return rows.where((F.col("upload_id") != upload_id) | ~F.col("rule_id").isin(sorted(moved[1]) or [-1])).unionByName(new)

        self.change("applied", make)
        add, drop = moved
        if drop:
            self.clear_violations(upload_id, sorted(drop))
        return add, drop

    def clear_violations(self, upload_id: int, rule_ids: list[int], records: DataFrame | None = None) -> None:
        """Takes out the violations of these rules, of some records only if these are given. Only violations are written anew."""
        history = self._of(upload_id)

        def write(now: Snapshot):
            parts = [p for p in now.parts if p["kind"] == "violations"]
            if not parts or not rule_ids:
                return None
            rows = self._read(upload_id, "audit", [f"{history.path}/{p['folder']}/files" for p in parts]).drop("upload_id")
            gone = F.col("step").isin(rule_ids)
            if records is not None:
                rows = rows.join(records.select("record_id", F.lit(True).alias("own")), "record_id", "left")
                gone = gone & F.col("own").isNotNull()
            left = rows.where(~gone).drop("own").select("record_id", "agent_name", "action", "details", "timestamp", *EVENT_ORDER)
            part = self._write(history, "audit", "violations", left, sum(p["rows"] for p in parts))
            return [part | {"as_of": max(p.get("as_of", 0) for p in parts)}], [p["folder"] for p in parts]

        history.change(write)

    @staticmethod
    def _violation_events(found: DataFrame) -> DataFrame:
        """Their order is record_id, then rule_id."""
        info = F.to_json(F.struct("rule_id", "severity", "action", F.col("column_name").alias("column")))
        return found.select("record_id", F.lit("RuleEngine").alias("agent_name"), F.lit("rule_violation").alias("action"), info.alias("details"), F.col("record_id").alias("place"), F.col("rule_id").alias("step"))

    def write_violations(self, upload_id: int, found: DataFrame, n: int) -> None:
        """found: rows of operators.rules.violations, n of them, beside those that are there."""
        self.write_audit(upload_id, self._violation_events(found), "violations", n)

    def replace_violations(self, upload_id: int, found: DataFrame, n: int, as_of: int, records: DataFrame | None = None) -> None:
        """found in place of all violations, or of those of some records; they hold for the cells as they were at the commit as_of."""
        history = self._of(upload_id)

        def write(now: Snapshot):
            parts = [p for p in now.parts if p["kind"] == "violations"]
            rows, size = self._events(self._violation_events(found), now.version + 1), n
            if records is not None and parts:
                old = self._read(upload_id, "audit", [f"{history.path}/{p['folder']}/files" for p in parts]).drop("upload_id")
                rows, size = rows.unionByName(old.join(records.select("record_id"), "record_id", "left_anti")), n + sum(p["rows"] for p in parts)
            return [self._write(history, "audit", "violations", rows, size) | {"as_of": as_of}], [p["folder"] for p in parts]

        history.change(write)

    def judged_at(self, upload_id: int) -> int:
        """The commit up to which the rules have seen the cells."""
        return max([p.get("as_of", 0) for p in self._of(upload_id).snapshot().parts if p["kind"] == "violations"], default=0)

    def _violating(self, upload_id: int) -> DataFrame:
        return self._whole(upload_id, "audit", "violations")

    def violations(self, upload_id: int) -> DataFrame:
        """Violations with the names of their rules, deleted ones included."""
        info = F.from_json("details", "rule_id bigint, severity string, action string, column string")
        rows = self._violating(upload_id).select("record_id", *EVENT_ORDER, info.alias("d")).select("record_id", *EVENT_ORDER, "d.rule_id", "d.severity", F.col("d.action").alias("rule_action"), F.col("d.column").alias("column_name"))
        names = self.table("rules").select("rule_id", F.col("name").alias("rule_name"))
        return rows.join(names, "rule_id", "left").orderBy(*EVENT_ORDER)

    def with_violation_flag(self, upload_id: int, page: DataFrame) -> DataFrame:
        hit = self._violating(upload_id).select("record_id").distinct().withColumn("has_rule_violation", F.lit(True))
        return page.join(hit, "record_id", "left").withColumn("has_rule_violation", F.coalesce("has_rule_violation", F.lit(False)))
