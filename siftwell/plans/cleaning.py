"""From a raw text table to cells: routing, one projection for all cells, one unpivot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import CELL_TYPE, Source, with_cells
from ..functions.text import is_missing, strip
from ..operators import addresses, ages, contacts, currencies, dates, feedback, profiling, quantities, resolvers
from ..operators.narratives import Writer
from ..sources.decisions import DecisionLog

ROW_INDEX = "row_index"


@dataclass
class Plan:
    """Which column goes where. columns are the user's names; in the tables they are c0, c1, ..."""

    columns: list[str]
    types: list[profiling.ColumnType]
    warnings: list[str] = field(default_factory=list)

    def cleaned(self) -> list[int]:
        return [i for i, t in enumerate(self.types) if t.agent != profiling.UNCLASSIFIED]

    def unclassified(self) -> list[str]:
        return [t.column for t in self.types if t.agent == profiling.UNCLASSIFIED]


def internal(columns: list[str]) -> list[str]:
    return [f"c{i}" for i in range(len(columns))]


def route(df: DataFrame, columns: list[str], writer: Writer | None = None, log: DecisionLog | None = None, upload_id: int | None = None) -> Plan:
    """df: row_index, c0, c1, .... Detects all types at once; columns that nothing claims are put to the classifier, if there
    is one, and profiled otherwise."""
    log = log or DecisionLog()
    names = internal(columns)
    rows = {r["ordinal"]: r.asDict() for r in profiling.match_rates(profiling.unpivot(df, names)).collect()}
    types = [profiling.decide(c, rows.get(i)) for i, c in enumerate(columns)]
    open_columns = [i for i, t in enumerate(types) if t.agent == profiling.UNCLASSIFIED]
    guesses: dict[int, dict | None] = {}
    if writer is not None and open_columns:
        asked = [i for i in open_columns if types[i].detected_type is None]
        few = profiling.sample(profiling.unpivot(df, names), resolvers.MOST_SAMPLES).where(F.col("ordinal").isin(asked or [-1])).collect()
        for i in asked:
            values = [r["value"] for r in sorted((r for r in few if r["ordinal"] == i), key=lambda r: r["row_index"])]
            guesses[i] = resolvers.classify_column(columns[i], values, writer)
            if guesses[i] and guesses[i]["agent_type"] != "unknown":
                types[i].agent, types[i].confidence = guesses[i]["agent_type"], guesses[i]["confidence"] / 100
                log.log("Orchestrator", "llm_assisted_classification", columns[i], types[i].agent, guesses[i]["confidence"], upload_id)
    profiled = [i for i in open_columns if types[i].agent == profiling.UNCLASSIFIED]
    for i, p in zip(profiled, profiling.profiles(df, [names[i] for i in profiled])):
        g = guesses.get(i)
        types[i].profile = p | {"llm_attempted": i in guesses, "llm_agent_guess": g["agent_type"] if g else None}
    for t in types:
        log.log("Orchestrator", "detect_column_type", t.column, t.agent, t.confidence * 100, upload_id, {"detected_type": t.detected_type, "scores": t.scores})
    return Plan(columns, types)


def cells(df: DataFrame, plan: Plan, corrections: DataFrame | None = None, resolver: addresses.Resolver | None = None) -> DataFrame:
    """df's columns and k0, k1, ...: the cells of the columns that plan cleans, side by side, in one pass over the table.

    Joins are only with small sides: a row of date evidence, and the latest corrections of a type.
    """
    hint_name = profiling.currency_hint_column(plan.columns)
    hint = None if hint_name is None else F.col(f"c{plan.columns.index(hint_name)}")
    wanted = plan.cleaned()
    date_columns = [i for i in wanted if plan.types[i].agent == "DateAgent"]
    out = df
    if date_columns:  # the evidence of all date columns in one aggregate
        aggregates = []
        for i in date_columns:
            value = F.when(~is_missing(F.col(f"c{i}")), F.col(f"c{i}"))
            first, second = dates.votes(value)
            aggregates += [first.alias(f"first{i}"), second.alias(f"second{i}")]
        r = df.agg(*aggregates).first()
        evidence = {i: (r[f"first{i}"], r[f"second{i}"]) for i in date_columns}
    reuse: dict[int, Column] = {}
    for kind in dict.fromkeys(plan.types[i].detected_type for i in wanted):
        if corrections is None or kind is None:
            continue
        found = feedback.latest(corrections, kind)
        if found.isEmpty():
            continue
        for i in (i for i in wanted if plan.types[i].detected_type == kind):
            out = feedback.with_correction(out, f"c{i}", found, f"fixed{i}", feedback.MOST)
            reuse[i] = F.col(f"fixed{i}")
    answers: dict[int, Column] = {}
    if resolver is not None:
        for i in (i for i in wanted if plan.types[i].agent == "AddressAgent"):
            examples = [] if corrections is None else [r.asDict() for r in feedback.latest(corrections, plan.types[i].detected_type).limit(addresses.MOST_EXAMPLES).collect()]
            found = addresses.resolve(df, f"c{i}", resolver, examples).select(F.col("value").alias(f"place{i}"), F.col("resolved").alias(f"resolved{i}"))
            out = out.join(found, strip(F.col(f"c{i}")) == F.col(f"place{i}"), "left")
            answers[i] = F.col(f"resolved{i}")
    made: dict[str, Source] = {}
    for i in wanted:
        t = plan.types[i]
        if t.agent == "DateAgent":
            a, b = evidence[i]
            cleaner = dates.cleaner(F.lit(a >= b if a + b else None).cast("boolean"), F.lit(a + b))
        elif t.agent == "CurrencyAgent":
            cleaner = currencies.cleaner(hint)
        elif t.agent == "QuantityAgent":
            cleaner = quantities.cleaner()
        elif t.agent == "ContactAgent":
            cleaner = contacts.cleaner(t.detected_type if t.detected_type in ("phone", "email") else "email")
        elif t.agent == "NumericAgent":
            cleaner = ages.cleaner()
        elif t.agent == "AddressAgent":
            cleaner = addresses.cleaner(answers.get(i), resolver is not None)
        else:
            raise ValueError(f"no cleaner for {t.agent!r}")
        made[f"k{i}"] = Source(cleaner, F.col(f"c{i}"), reuse.get(i))
    return with_cells(out, made).select(*df.columns, *made)


def unpivoted(wide: DataFrame, plan: Plan) -> DataFrame:
    """ordinal (among the cleaned columns), column_name, column_type, row_index, cell."""
    wanted = plan.cleaned()
    if not wanted:
        return wide.sparkSession.createDataFrame([], f"ordinal int, column_name string, column_type string, row_index bigint, cell {CELL_TYPE}")
    each = [F.struct(F.lit(n).alias("ordinal"), F.lit(plan.columns[i]).alias("column_name"), F.lit(plan.types[i].detected_type).cast("string").alias("column_type"), F.col(f"k{i}").alias("cell")) for n, i in enumerate(wanted)]
    return wide.select(ROW_INDEX, F.inline(F.array(*each))).select("ordinal", "column_name", "column_type", ROW_INDEX, "cell")


def summary(long: DataFrame) -> DataFrame:
    """For each column: agent_type, rows_processed, rows_flagged, rows_influenced_by_feedback."""
    return long.groupBy("column_name").agg(
        F.first("cell.agent_type").alias("agent_type"),
        F.count("*").alias("rows_processed"),
        F.count_if("cell.flagged").alias("rows_flagged"),
        F.count_if(F.col("cell.method") == "reused_prior_feedback").alias("rows_influenced_by_feedback"),
    )


def bands(cells: DataFrame, confidence: str = "cell.confidence") -> DataFrame:
    """Cells of each column by how far they can be trusted: column_name, band, n."""
    c = F.col(confidence)
    return cells.groupBy("column_name", F.when(c >= 90, "High").when(c >= 60, "Medium").otherwise("Low").alias("band")).agg(F.count("*").alias("n"))


def analysis_table(both: DataFrame, plan: Plan) -> DataFrame:
    """row_index, c0, c1, ...: cleaned values in place of raw ones, amounts as doubles and dates as dates. both: row_index, c0, c1, ...,
    and the cells k0, k1, ... of the cleaned columns."""
    casts = {"date": "date", "currency": "double", "quantity": "double", "numeric_age": "double"}
    columns = []
    for i, t in enumerate(plan.types):
        if t.agent == profiling.UNCLASSIFIED:
            columns.append(F.col(f"c{i}"))
        else:
            value = F.col(f"k{i}.cleaned_value")
            columns.append((value.try_cast(casts[t.detected_type]) if t.detected_type in casts else value).alias(f"c{i}"))
    return both.select(ROW_INDEX, *columns)
