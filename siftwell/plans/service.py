"""The service: every operation of the application as a method, without a web server in between."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import addresses, profiling, rules
from ..operators.narratives import Writer
from ..sources import csv_folder, export, uploads
from ..sources.decisions import DecisionLog
from ..sources.store import EVENT_ORDER, MAX_PAGE, SORTABLE, NotFound, Store
from . import cleaning, insights
from .cleaning import ROW_INDEX

_log = logging.getLogger(__name__)


class BadRequest(ValueError):
    """An argument that is not allowed."""


class Unprocessable(ValueError):
    """A definition or a reference that does not hold."""


class Service:
    def __init__(self, spark: SparkSession, root: str, *, writer: Writer | None = None, resolver: addresses.Resolver | None = None, log: DecisionLog | None = None, max_bytes: int = uploads.MAX_BYTES, extensions: tuple[str, ...] = uploads.EXTENSIONS):
        self.spark, self.store, self.writer, self.resolver, self.log = spark, Store(spark, root), writer, resolver, log or DecisionLog()
        self.max_bytes, self.extensions = max_bytes, extensions

    def config(self) -> dict:
        return {"max_upload_size_mb": self.max_bytes // (1024 * 1024), "allowed_extensions": list(self.extensions)}

    # Uploads.

    def ingest(self, raw: bytes, filename: str, begun: Callable[[int], None] | None = None) -> dict:
        """Validates, routes, cleans, stores and analyses one file. begun is told the upload's number before anything is stored of it."""
        loaded = uploads.load(raw, filename, self.max_bytes, self.extensions)
        upload_id = self.store.create_upload(filename, len(loaded.rows))
        if begun is not None:
            begun(upload_id)
        try:
            df = loaded.frame(self.spark, cleaning.internal(loaded.columns))
            self.spark.createDataFrame([(bytearray(raw),)], "content binary").coalesce(1).write.mode("overwrite").parquet(self._original(upload_id))
            # Its rows are kept too, with empty cells only as missing, for the export.
            kept = uploads.Upload(*uploads.parse(uploads.decode(raw)[0], [""])[:2], "", [])
            self._keep(upload_id, kept.frame(self.spark, cleaning.internal(kept.columns)), loaded.columns)
            return self.clean(upload_id, df, loaded.columns) | {"warnings": loaded.warnings, "filename": filename}
        except Exception:
            self.store.set_status(upload_id, "failed")
            raise

    def ingest_folder(self, path: str, columns: list[str] | None = None, *, refuse: bool = True, begun: Callable[[int], None] | None = None) -> dict:
        """Cleans and stores all CSV files of a folder as one upload of any size: Spark reads them, each by its own header, and no
        row comes to the driver. columns: those that are wanted, else all that any file has. Rows are numbered by file and place.
        With refuse, the first file or row that cannot be read fails the upload; without, such rows are left out and kept for
        ``refused``."""
        upload_id = self.store.create_upload(path)
        if begun is not None:
            begun(upload_id)
        work = f"{self.store.root}/work/upload_id={upload_id}"
        try:
            found = csv_folder.read(self.spark, path, work, columns, extensions=self.extensions, no_value=[""])
            errors = found.errors.persist()
            first = errors.orderBy("file", "row").first()
            if first is not None and refuse:
                place = "" if first["row"] is None else f", row {first['row']}"
                raise getattr(uploads, first["error"])(f"{first['file']}{place}: {first['message']}")
            if not found.columns:
                raise uploads.EmptyFileError(f"There is no table in {path}.")
            errors.write.mode("overwrite").parquet(self._refused(upload_id))
            names = cleaning.internal(found.columns)
            self._keep(upload_id, found.rows.select(uploads.ROW_INDEX, *[F.col(f"`{c}`").alias(n) for c, n in zip(found.columns, names)]), found.columns)
            kept = self.spark.read.parquet(self._raw(upload_id))
            return self.clean(upload_id, kept.withColumns({n: uploads.without_no_value(F.col(n)) for n in names}), found.columns) | {"refused": errors.count()}
        except Exception:
            self.store.set_status(upload_id, "failed")
            raise
        finally:
            self.store.remove(work)

    def refused(self, upload_id: int) -> DataFrame:
        """file, row (null: the whole file), error and message of what was left out of a folder."""
        self.store.upload(upload_id)
        path = self._refused(upload_id)
        return self.spark.read.parquet(path) if self.store.exists(path) else self.spark.createDataFrame([], csv_folder.ERRORS)

    def _keep(self, upload_id: int, rows: DataFrame, columns: list[str]) -> None:
        rows.write.mode("overwrite").parquet(self._raw(upload_id))
        self.spark.createDataFrame([(json.dumps(columns),)], "value string").coalesce(1).write.mode("overwrite").text(self._header(upload_id))

    def clean(self, upload_id: int, df: DataFrame, columns: list[str]) -> dict:
        """df: row_index, c0, c1, ... as text. The cleaned table is written before it is used, so that a lost executor costs a read
        and nobody is asked for an answer twice."""
        df = df.select(ROW_INDEX, *cleaning.internal(columns))
        plan = cleaning.route(df, columns, self.writer, self.log, upload_id)
        made = f"{self.store.root}/work/cleaned-{upload_id}-{uuid.uuid4().hex}"
        cleaning.cells(df, plan, self._corrections(), self.resolver).write.parquet(made)
        wide = self.spark.read.parquet(made)
        try:
            long = cleaning.unpivoted(wide, plan)
            self.store.write_cells(upload_id, long)
            rows = wide.count()
            self.store.set_status(upload_id, "completed", rows)
            per_column = {r["column_name"]: {k: v for k, v in r.asDict().items() if k != "column_name"} for r in cleaning.summary(long).collect()}
            try:  # enrichment: the upload stands without it
                self.store.save_insights(upload_id, json.dumps(self.analyse(wide, plan)))
            except Exception:
                _log.exception("Insights of upload %s could not be computed.", upload_id)
            return {
                "upload_id": upload_id,
                "rows": rows,
                "columns_cleaned": {plan.columns[i]: per_column.get(plan.columns[i]) for i in plan.cleaned()},
                "columns_unclassified": plan.unclassified(),
                "columns_profiled": {t.column: {"detected_type": t.detected_type} | t.profile for t in plan.types if t.profile is not None},
            }
        finally:
            self.store.remove(made)

    def analyse(self, wide: DataFrame, plan: cleaning.Plan) -> dict:
        """wide: row_index, c0, c1, ... and the cells beside them; no join."""
        table = cleaning.analysis_table(wide, plan)
        of = lambda *kinds: [f"c{i}" for i in plan.cleaned() if plan.types[i].detected_type in kinds]
        numbers = of("currency", "numeric_age", "quantity")
        if not numbers:  # every column of numbers then
            numeric = [i for i, t in enumerate(plan.types) if t.profile and t.profile["inferred_dtype"] in ("int64", "float64")]
            numbers = [f"c{i}" for i in numeric]
            table = table.withColumns({c: F.col(c).try_cast("double") for c in numbers}) if numbers else table
        category = profiling.category_column(table, [f"c{i}" for i, t in enumerate(plan.types) if t.agent == profiling.UNCLASSIFIED and f"c{i}" not in numbers])
        date = profiling.event_date_column(table, of("date"))
        names = {f"c{i}": c for i, c in enumerate(plan.columns)}
        return insights.cards(table, date=date, category=category, numbers=numbers, sums=of("currency"), names=names, writer=self.writer)

    def _corrections(self) -> DataFrame | None:
        try:
            return self.store.table("feedback")
        except Exception:
            _log.exception("Corrections could not be read; going on without them.")
            return None

    def _raw(self, upload_id: int) -> str:
        return f"{self.store.root}/raw/upload_id={upload_id}"

    def _refused(self, upload_id: int) -> str:
        return f"{self.store.root}/refused/upload_id={upload_id}"

    def _original(self, upload_id: int) -> str:
        return f"{self.store.root}/originals/upload_id={upload_id}"

    def _header(self, upload_id: int) -> str:
        return f"{self.store.root}/headers/upload_id={upload_id}"

    def uploads(self, limit: int = 50, offset: int = 0) -> list[dict]:
        return [r.asDict() for r in self.store.uploads(limit, offset).collect()]

    def upload(self, upload_id: int) -> dict:
        return self.store.upload(upload_id)

    def delete_upload(self, upload_id: int) -> dict:
        self.store.delete_upload(upload_id)
        for path in (self._original(upload_id), self._raw(upload_id), self._header(upload_id), self._refused(upload_id)):
            try:  # best effort
                self.store.remove(path)
            except Exception:
                _log.exception("%s could not be removed.", path)
        return {"deleted": upload_id}

    # Reading.

    def cells(self, upload_id: int, column: str | None = None, max_confidence: float | None = None, sort_by: str = "record_id", sort_dir: str = "asc", limit: int = 50, offset: int = 0, after: int | None = None) -> dict:
        """after: the last record_id of the page before, in the order of record_id; cheaper than an offset."""
        self.store.upload(upload_id)
        if sort_by not in SORTABLE:
            raise BadRequest(f"sort_by is one of {', '.join(SORTABLE)}.")
        if sort_dir not in ("asc", "desc") or limit < 1 or offset < 0 or (max_confidence is not None and not 0 <= max_confidence <= 100):
            raise BadRequest("sort_dir, limit, offset or max_confidence is out of range.")
        page = self.store.page(upload_id, column, max_confidence, sort_by, sort_dir == "desc", limit, offset, after)
        if column is None and max_confidence is None:
            total = self.store.count(upload_id)
        else:
            rows = self.store.cells(upload_id)
            rows = rows.where(F.col("column_name") == column) if column is not None else rows
            total = (rows.where(F.col("confidence_score") < max_confidence) if max_confidence is not None else rows).count()
        order = F.desc_nulls_last(sort_by) if sort_dir == "desc" else F.asc_nulls_first(sort_by)
        items = self.store.with_violation_flag(upload_id, page).orderBy(order, "record_id")
        return {"items": [r.asDict() for r in items.collect()], "total": total, "limit": min(limit, MAX_PAGE), "offset": offset}

    def columns(self, upload_id: int) -> list[str]:
        self.store.upload(upload_id)
        return self.store.columns(upload_id)

    def lineage(self, upload_id: int, record_id: int) -> dict:
        events = [r.asDict() for r in self.store.lineage(upload_id, record_id).collect()]
        return {"record_id": record_id, "has_lineage": bool(events), "entries": events}

    def correct(self, upload_id: int, record_id: int, value: str) -> dict:
        """A human's value for a cell; the applied rules judge it at once."""
        cell = self.store.correct(upload_id, record_id, value)
        self.reevaluate(upload_id)
        return cell

    def correct_many(self, upload_id: int, values: DataFrame) -> int:
        """values: record_id, corrected_value. As correct, for any number of cells in one step."""
        self.store.upload(upload_id)
        n = self.store.correct_many(upload_id, values)
        self.reevaluate(upload_id)
        return n

    def insights(self, upload_id: int) -> dict:
        text = self.store.upload(upload_id)["insights_json"]
        return {"available": False} if text is None else {"available": True} | json.loads(text)

    def export(self, upload_id: int) -> DataFrame:
        """The cleaned table, under the file's own column names."""
        self.store.upload(upload_id)
        if not self.store.exists(self._raw(upload_id)):
            raise NotFound(f"The file of upload {upload_id} is gone.")
        columns = json.loads(self.spark.read.text(self._header(upload_id)).first()[0])
        raw = self.spark.read.parquet(self._raw(upload_id)).toDF("row_index", *columns)
        return export.cleaned_table(raw, self.store.cells(upload_id), columns, self.store.columns(upload_id)).drop("row_index")

    def original(self, upload_id: int) -> bytes:
        """The uploaded file as it came. What was read from a folder has none."""
        self.store.upload(upload_id)
        if not self.store.exists(self._original(upload_id)):
            raise NotFound(f"The file of upload {upload_id} is gone.")
        return bytes(self.spark.read.parquet(self._original(upload_id)).first()[0])

    def download_name(self, upload_id: int) -> str:
        return export.download_name(self.store.upload(upload_id)["filename"])

    # Rules.

    def rules(self, upload_id: int, active_only: bool = False) -> list[rules.Rule]:
        self.store.upload(upload_id)
        return self.store.rules(upload_id, active_only)

    def create_rule(self, upload_id: int, **definition) -> rules.Rule:
        """Defines a rule. It flags nothing until it is applied."""
        self.store.upload(upload_id)
        rule = rules.Rule(0, upload_id, **definition)
        if errors := rules.validate(rule, set(self.store.columns(upload_id)), self.store.rules(upload_id, True)):
            raise Unprocessable("; ".join(errors))
        self.store.create_rule(rule)
        return rule

    def _own_rule(self, upload_id: int, rule_id: int) -> rules.Rule:
        found = next((r for r in self.store.rules(upload_id) if r.rule_id == rule_id), None)
        if found is None:
            raise NotFound(f"Rule {rule_id} does not exist in upload {upload_id}.")
        return found

    def update_rule(self, upload_id: int, rule_id: int, **fields) -> rules.Rule:
        rule = self._own_rule(upload_id, rule_id)
        for k, v in fields.items():
            if v is not None:
                setattr(rule, k, v)
        others = [r for r in self.store.rules(upload_id, True) if r.rule_id != rule_id]
        if errors := rules.validate(rule, set(self.store.columns(upload_id)), others):
            raise Unprocessable("; ".join(errors))
        self.store.update_rule(rule_id, **fields)
        return self._own_rule(upload_id, rule_id)

    def delete_rule(self, upload_id: int, rule_id: int) -> dict:
        self._own_rule(upload_id, rule_id)
        self.store.delete_rule(rule_id)
        return {"deleted": rule_id}

    def applied_rules(self, upload_id: int) -> list[int]:
        self.store.upload(upload_id)
        return self.store.applied_rules(upload_id)

    def apply_rules(self, upload_id: int, rule_ids: list[int]) -> dict:
        """Makes these the applied rules and evaluates all of them anew over the stored cells."""
        self.store.upload(upload_id)
        own = {r.rule_id: r for r in self.store.rules(upload_id, True)}
        if unknown := [r for r in rule_ids if r not in own]:
            raise Unprocessable(f"Unknown, inactive or foreign rules: {unknown}.")
        self.store.set_applied(upload_id, rule_ids)
        as_of = self.store.version(upload_id)
        found = rules.violations(self.store.cells(upload_id), [own[r] for r in sorted(set(rule_ids))])
        return {"applied_rule_ids": sorted(set(rule_ids)), "violation_count": self._judged(upload_id, found, as_of)}

    def _judged(self, upload_id: int, found: DataFrame, as_of: int, records: DataFrame | None = None) -> int:
        """Violations are written before they are counted and stored, so that rules run once."""
        path = f"{self.store.root}/work/violations-{upload_id}-{uuid.uuid4().hex}"
        try:
            found.write.parquet(path)
            kept = self.spark.read.schema(found.schema).parquet(path)
            count = kept.count()
            self.store.replace_violations(upload_id, kept, count, as_of, records)
            return count
        finally:
            self.store.remove(path)

    def reevaluate(self, upload_id: int) -> int:
        """Judges the cells that were corrected since the applied rules last saw them, and these only. Returns how many there are."""
        applied = set(self.applied_rules(upload_id))
        as_of = self.store.version(upload_id)
        changed = self.store.changed_since(upload_id, self.store.judged_at(upload_id))
        n = changed.count() if applied else 0
        if n:
            own = [r for r in self.store.rules(upload_id, True) if r.rule_id in applied]
            self._judged(upload_id, rules.violations(self.store.some_cells(upload_id, changed), own), as_of, changed)
        return n

    def violations(self, upload_id: int, limit: int = MAX_PAGE, offset: int = 0) -> list[dict]:
        """A page of violations in the order they were found; store.violations has all of them as a table."""
        self.store.upload(upload_id)
        return [r.asDict() for r in self.store.violations(upload_id).offset(offset).limit(min(limit, MAX_PAGE)).collect()]

    def audit(self, upload_id: int, limit: int = 100, offset: int = 0) -> list[dict]:
        return [r.asDict() for r in self.store.audit(upload_id).orderBy(*EVENT_ORDER).offset(offset).limit(min(limit, MAX_PAGE)).collect()]
