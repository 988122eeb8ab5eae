"""Column samples, profiles and type scores, for all columns of a table in one pass each.

Tables are unpivoted to (ordinal, row_index, value); column names stay with the caller, so headers with dots,
spaces or repeats need no quoting.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, strip
from . import addresses, quantities

SAMPLE = 50
#: Numbers of first rows in which the sample is looked for before the whole table is.
FIRST_ROWS = (1_000, 1_000_000)
# The thresholds of type detection.
LEAST_RATE, LEAST_SCORE, HEADER_BONUS = 0.30, 0.50, 0.15
MOST_CATEGORIES, MOST_CATEGORY_RATIO = 50, 0.2
MOST_CHART_CATEGORIES, MOST_CHART_RATIO = 50, 0.1
# Types in the order that settles ties, and the parts of a header that speak for each.
HEADER_WORDS = {
    "email": ["email", "mail", "e-mail"],
    "phone": ["phone", "tel", "mobile", "gsm"],
    "date": ["date", "dt"],
    "currency": ["amount", "price", "cost", "total", "currency", "fee", "fiyat", "tutar"],
    "quantity": ["price", "amount", "sq.ft", "sqft", "area", "size", "emi", "%", "percent"],
    "address": ["address", "addr", "city", "location", "adres"],
    "numeric_age": ["age", "yas", "yaş"],
}
DIMENSION_WORDS = ["sq.ft", "sqft", "sq ft", "area", "size", "%", "percent"]
AGENTS = {"email": "ContactAgent", "phone": "ContactAgent", "date": "DateAgent", "currency": "CurrencyAgent", "quantity": "QuantityAgent", "address": "AddressAgent", "numeric_age": "NumericAgent", "categorical": "unclassified"}
UNCLASSIFIED = "unclassified"
NUMBER = r"^-?\d+(\.\d+)?$"


@dataclass
class ColumnType:
    column: str
    detected_type: str | None
    agent: str
    confidence: float
    sample_size: int
    scores: dict[str, float] = field(default_factory=dict)
    profile: dict | None = None


def unpivot(df: DataFrame, columns: list[str], row_index: str = "row_index") -> DataFrame:
    """row_index, ordinal, value."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]))
    return df.select(F.col(row_index).alias("row_index"), values.alias("cell")).select("row_index", "cell.ordinal", "cell.value")


def sample(cells: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The first values by row of each column that are neither null nor blank, untrimmed. The rank is limited inside
    every partition before anything is shuffled."""
    order = Window.partitionBy("ordinal").orderBy("row_index")
    return cells.where(F.col("value").isNotNull() & (strip(F.col("value")) != "")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place")


def matchers(value: Column) -> dict[str, Column]:
    """Whether a value looks like each type."""
    lower = F.lower(value)
    known = contains_any(lower, [p.lower() for p in addresses.PROVINCES] + [addresses.COUNTRY.lower()])
    date = value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{1,2}/\d{1,2}/\d{4}$|^\d{1,2}-\d{1,2}-\d{4}$|^[A-Za-z]+ \d{1,2},\s?\d{4}$")
    money = value.rlike(r"^\$\s?\d[\d,]*\.?\d*$|^\d[\d.]*\s?TL$|^₺\s?\d[\d,]*$|^\d+,\d{1,2}$")
    return {
        "email": value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "phone": F.regexp_replace(value, r"[\s\-()]", "").rlike(r"^\+?\d{9,13}$"),
        "date": date,
        "currency": money,
        "quantity": quantities.looks_like(value),
        "address": known & (value.contains(",") | value.contains(" - ")),
        "numeric_age": value.rlike(NUMBER),
    }


def match_rates(cells: DataFrame) -> DataFrame:
    """For each ordinal: sample_size, uniques, a share for each type, and plain (the share of bare numbers)."""
    found = matchers(F.col("value"))
    rates = [F.avg(F.when(c, 1.0).otherwise(0.0)).alias(k) for k, c in found.items()]
    plain = F.avg(F.when(F.col("value").rlike(NUMBER) | found["quantity"], 1.0).otherwise(0.0)).alias("plain")
    return sample(cells).groupBy("ordinal").agg(F.count("*").alias("sample_size"), F.countDistinct("value").alias("uniques"), *rates, plain)


def score(header: str, rates: dict[str, float]) -> dict[str, float]:
    """Scores of the types with enough evidence in the values; a header word adds a bonus and never carries a type alone."""
    name, out = header.lower(), {}
    for kind, words in HEADER_WORDS.items():
        hit = any(w in name for w in words)
        rate = rates["plain"] if kind == "quantity" and any(w in name for w in DIMENSION_WORDS) else rates[kind]
        if (kind == "numeric_age" and not hit) or rate < LEAST_RATE:
            continue
        out[kind] = min(1.0, rate + HEADER_BONUS * hit)
    return out


def decide(header: str, row: dict | None) -> ColumnType:
    if row is None:
        return ColumnType(header, None, UNCLASSIFIED, 0.0, 0)
    scores, n = score(header, row), row["sample_size"]
    winner = max(scores, key=scores.get, default=None)  # the first of equals
    if winner is not None and scores[winner] >= LEAST_SCORE:
        return ColumnType(header, winner, AGENTS[winner], round(scores[winner], 4), n, scores)
    ratio = row["uniques"] / n
    if 2 <= row["uniques"] <= MOST_CATEGORIES and ratio <= MOST_CATEGORY_RATIO:
        return ColumnType(header, "categorical", UNCLASSIFIED, round(1 - ratio, 4), n, scores)
    return ColumnType(header, None, UNCLASSIFIED, round(max(scores.values(), default=0.0), 4), n, scores)


def detect(df: DataFrame, columns: list[str], row_index: str = "row_index") -> list[ColumnType]:
    """The type of every column; one row a column comes to the driver. The first values are looked for among the first rows, then
    among more, and in the whole table only for the columns that still lack some: files and parts of files that hold none of
    these rows are passed over by what their footers say."""
    rows: dict[int, dict] = {}
    open_ = list(range(len(columns)))
    for bound in (*FIRST_ROWS, None):
        if not open_:
            break
        part = df if bound is None else df.where(F.col(row_index) < bound)
        found = {open_[r["ordinal"]]: r.asDict() for r in match_rates(unpivot(part, [columns[i] for i in open_], row_index)).collect()}
        rows |= found
        open_ = [i for i in open_ if i not in found or found[i]["sample_size"] < SAMPLE]
    return [decide(c, rows.get(i)) for i, c in enumerate(columns)]


def profiles(df: DataFrame, columns: list[str]) -> list[dict]:
    """null_pct, unique_count, inferred_dtype, min_value and max_value of every column. Each column's values are counted by value
    first, so a shuffled row is a distinct value of a column, however many columns there are."""
    if not columns:
        return []
    v = F.col("value")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])).alias("c")).select("c.*")
    values = cells.groupBy("ordinal", "value").agg(F.count("*").alias("n"))
    number = v.try_cast("double")
    rows = values.groupBy("ordinal").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.count(v).alias("u"), F.bool_and(v.rlike(r"^\s*[+-]?\d+\s*$")).alias("i"),
        F.bool_and(F.when(v.isNotNull(), number.isNotNull())).alias("f"), F.bool_and(v.isin("True", "False", "true", "false", "TRUE", "FALSE")).alias("b"), F.min(v).alias("a"), F.max(v).alias("z"), F.min(number).alias("x"), F.max(number).alias("y"),
    )
    found = {x["ordinal"]: x for x in rows.collect()}  # a row a column
    none = dict.fromkeys(("rows", "n", "u"), 0) | dict.fromkeys("ifbazxy")
    out = []
    for i in range(len(columns)):
        r = found.get(i, none)
        n, total = r["n"], r["rows"]
        if not n:
            kind = "float64" if total else "object"
        elif r["b"]:
            kind = "bool" if n == total else "object"
        elif r["i"]:
            kind = "int64" if n == total else "float64"
        else:
            kind = "float64" if r["f"] else "object"
        numeric = kind in ("int64", "float64") and n
        low, high = (r["x"], r["y"]) if numeric else (r["a"], r["z"])
        if kind == "int64":
            low, high = int(low), int(high)
        out.append({"null_pct": round(100 * (1 - n / total), 2) if total else 0.0, "unique_count": r["u"], "inferred_dtype": kind, "min_value": None if low is None else str(low), "max_value": None if high is None else str(high), "llm_attempted": False, "llm_agent_guess": None})
    return out


def currency_hint_column(columns: list[str]) -> str | None:
    return next((c for c in columns if "currency" in c.lower() and "hint" in c.lower()), None)


def event_date_column(df: DataFrame, date_columns: list[str]) -> str | None:
    """The date column with the shortest span; one without any date comes last."""
    if not date_columns:
        return None
    r = df.agg(*[F.datediff(F.max(f"`{c}`"), F.min(f"`{c}`")).alias(str(i)) for i, c in enumerate(date_columns)]).first()
    spans = [float("inf") if x is None else x for x in r]
    return date_columns[spans.index(min(spans))]


def category_column(df: DataFrame, columns: list[str]) -> str | None:
    """Of the text columns with 2 to 50 distinct values that are fewer than a tenth of the rows, the one with most."""
    if not columns:
        return None
    # Values are counted by value first, so a shuffled row is a distinct value of a column, however many columns there are.
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])))
    values = cells.groupBy("ordinal", "value").agg(F.count("*").alias("n"))
    v = F.col("value")
    found = values.groupBy("ordinal").agg(F.sum("n").alias("rows"), F.count(v).alias("u"), F.bool_and(F.when(v.isNotNull(), v.try_cast("double").isNotNull())).alias("numbers")).collect()  # a row a column
    counts = {"rows": max([r["rows"] for r in found], default=0)} | {str(i): 0 for i in range(len(columns))} | {f"n{i}": None for i in range(len(columns))}
    for r in found:
        counts |= {str(r["ordinal"]): r["u"], f"n{r['ordinal']}": r["numbers"]}
    best, most = None, -1
    for i, c in enumerate(columns):
        n = counts[str(i)]
        if not counts[f"n{i}"] and 2 <= n <= MOST_CHART_CATEGORIES and n / max(1, counts["rows"]) < MOST_CHART_RATIO and n > most:
            best, most = c, n
    return best
