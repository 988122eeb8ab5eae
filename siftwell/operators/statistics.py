"""Correlations, trends, anomalies and chart data as DataFrame aggregations.

Thresholds are applied to unrounded numbers, results are rounded, and ties are broken by ordinals.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import comoments

# Thresholds of the insights.
LEAST_R, STRONG_R, MODERATE_R = 0.4, 0.6, 0.3
IQR_FACTOR, LEAST_VALUES = 1.5, 4
MONTH_CHANGE, LEAST_MONTH_ROWS = 0.20, 3
SPIKE_CHANGE, LEAST_MONTH_COUNT = 0.75, 3
MOST_POINTS = 300
#: Columns up to which every pair is an expression of its own.
FEW_COLUMNS = 12
#: Accuracy of the sketch that brackets a quantile: its ranks are off by one in so many at most.
ACCURACY = 10_000


def _number(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are there; null for fewer than two such rows or without variance."""
    both = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    x, y = F.when(both, a), F.when(both, b)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied & (F.count(x) > 1), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def strength(r: Column) -> Column:
    return F.when(F.abs(r) > STRONG_R, "strong").when(F.abs(r) >= MODERATE_R, "moderate").otherwise("weak")


def pairwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """place, col1, col2, r of all pairs of columns, from one aggregation over the table: an expression a pair for a few columns,
    matrices by blocks for more, as a plan does not grow with the square of the columns then."""
    pairs = list(combinations(range(len(columns)), 2))
    if len(columns) > FEW_COLUMNS:
        names = F.array(*[F.lit(c) for c in columns])
        n = F.lit(len(columns))
        place = (F.col("i") * (2 * n - F.col("i") - 1) / 2 + F.col("j") - F.col("i") - 1).cast("int")
        return comoments.matrix(df, columns).select(place.alias("place"), F.get(names, "i").alias("col1"), F.get(names, "j").alias("col2"), "r")
    if not pairs:
        return df.sparkSession.createDataFrame([], "place int, col1 string, col2 string, r double")
    one = df.agg(*[_correlation(_number(columns[i]), _number(columns[j])).alias(f"r{k}") for k, (i, j) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(columns[i]).alias("col1"), F.lit(columns[j]).alias("col2"), F.col(f"r{k}").alias("r")) for k, (i, j) in enumerate(pairs)])
    return one.select(F.inline(rows))


def correlations(df: DataFrame, columns: list[str], least: float = LEAST_R) -> DataFrame:
    """col1, col2, r, strength, direction of the pairs with |r| of at least ``least``, strongest first."""
    found = pairwise(df, columns).where(F.abs("r") >= least)
    return (
        found.select("place", "col1", "col2", F.round("r", 3).alias("r"), strength(F.col("r")).alias("strength"), F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"))
        .orderBy(F.desc(F.abs("r")), "place")
        .drop("place")
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """row, column, r: symmetric, 1 on the diagonal of columns that vary; null where r is undefined."""
    half = pairwise(df, columns).select(F.col("col1").alias("row"), F.col("col2").alias("column"), F.round("r", 3).alias("r"))
    own = df.agg(*[F.when(F.min(_number(c)) < F.max(_number(c)), 1.0).alias(str(i)) for i, c in enumerate(columns)])
    diagonal = own.select(F.inline(F.array(*[F.struct(F.lit(c).alias("row"), F.lit(c).alias("column"), F.col(str(i)).alias("r")) for i, c in enumerate(columns)])))
    return half.unionByName(half.select(F.col("column").alias("row"), F.col("row").alias("column"), "r")).unionByName(diagonal)


def long_numbers(df: DataFrame, columns: list[str], row_index: str = "row_index") -> DataFrame:
    values = F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), _number(c).alias("value")) for i, c in enumerate(columns)]))
    return df.select(F.col(row_index).alias("row_index"), values).where(F.col("value").isNotNull() & ~F.isnan("value"))


def quantiles(cells: DataFrame, shares: tuple[float, ...] = (0.25, 0.75), in_memory: int = 2_000_000, bins: int = 1000, few: int = 20_000) -> DataFrame:
    """ordinal, n, mean, sd, q (the exact quantiles, linear between neighbours) of the values of each ordinal.

    Up to in_memory values the built-in exact percentile does it in one pass. Its state grows with the distinct values, so beyond
    that the ranks are bracketed: a sketch of all columns and shares in one pass says between which values a rank lies, and
    is repeated within the brackets until each holds few values besides its ends; these are counted and the rank is picked.
    """
    moments = cells.groupBy("ordinal").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    small = cells.groupBy("ordinal").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.array(*[F.lit(x) for x in shares])).alias("q"))
    known = [r.asDict() for r in moments.collect()] if in_memory else []  # a row a column
    if sum(r["n"] for r in known) <= in_memory:
        return small
    spark = cells.sparkSession
    chosen = _selected(cells, known, shares, bins, few)
    stats = spark.createDataFrame([(r["ordinal"], r["n"], r["mean"], r["sd"]) for r in known], "ordinal int, n bigint, mean double, sd double")
    q = chosen.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("q"))
    return stats.join(F.broadcast(q), "ordinal").select("ordinal", "n", "mean", "sd", F.transform("q", lambda x: x["value"]).alias("q"))  # a row a column


def _bracketed(r: dict, bins: int) -> tuple[float, float]:
    """Values of the sketch's grid that hold both order statistics, whatever the sketch's error is."""
    slack = r["inside"] / ACCURACY + 1
    at = lambda rank: rank / r["inside"] * bins
    low, high = int(at(r["first"] - r["below"] - slack)) - 1, int(at(r["second"] - r["below"] + slack)) + 2
    return r["grid"][max(0, low)] if low > 0 else r["low"], r["grid"][min(bins, high)] if high < bins else r["high"]


def _selected(cells: DataFrame, known: list[dict], shares: tuple[float, ...], bins: int, few: int, most_rounds: int = 60) -> DataFrame:
    """ordinal, k (of shares), value."""
    spark = cells.sparkSession
    targets = []
    for r in known:
        for k, share in enumerate(shares):
            first = int((r["n"] - 1) * share)
            targets.append({"ordinal": r["ordinal"], "k": k, "part": (r["n"] - 1) * share - first, "first": first, "second": min(first + 1, r["n"] - 1), "low": r["low"], "high": r["high"]})
    value, schema = F.col("value"), "ordinal int, k int, part double, first bigint, second bigint, low double, high double"
    for _ in range(most_rounds):
        wanted = F.broadcast(spark.createDataFrame([tuple(t[c.split()[0]] for c in schema.split(", ")) for t in targets], schema))  # some rows a column
        inside = value.between(F.col("low"), F.col("high"))
        grid = F.percentile_approx(F.when(inside, value), F.array(*[F.lit(i / bins) for i in range(bins + 1)]), ACCURACY)
        met = cells.join(wanted, "ordinal")
        found = met.groupBy("ordinal", "k").agg(F.count_if(value < F.col("low")).alias("below"), F.count_if(inside).alias("inside"), F.count_if((value > F.col("low")) & (value < F.col("high"))).alias("loose"), grid.alias("grid"))
        by = {(r["ordinal"], r["k"]): r.asDict() for r in found.collect()}
        if all(r["loose"] <= few for r in by.values()):
            break
        for t in targets:
            r = by[t["ordinal"], t["k"]]
            if r["loose"] > few:
                t["low"], t["high"] = _bracketed(t | r, bins)
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    below = F.broadcast(spark.createDataFrame([(o, k, r["below"]) for (o, k), r in by.items()], "ordinal int, k int, below bigint"))
    counts = met.where(inside).groupBy("ordinal", "k", "part", "first", "second", "value").agg(F.count("*").alias("n")).join(below, ["ordinal", "k"])
    upto = Window.partitionBy("ordinal", "k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # few values and two ends
    ranked = counts.withColumn("end", F.col("below") + F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    at = lambda rank: F.max(F.when((F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("end")), value))
    pair = ranked.groupBy("ordinal", "k", "part").agg(at("first").alias("a"), at("second").alias("b"))
    return pair.select("ordinal", "k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def anomalies(df: DataFrame, columns: list[str], row_index: str = "row_index") -> DataFrame:
    """Values outside the quartiles by more than 1.5 interquartile ranges, exactly: column, row_index, value, z_score,
    direction, ordinal. The bounds of all columns are a few rows and are joined back as such."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, row_index bigint, value double, z_score double, direction string, ordinal int")
    cells = long_numbers(df, columns, row_index)
    stats = quantiles(cells)
    stats = stats.where(F.col("n") >= LEAST_VALUES).select("ordinal", "mean", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).where("q3 != q1")
    reach = IQR_FACTOR * (F.col("q3") - F.col("q1"))
    out = cells.join(F.broadcast(stats), "ordinal").where((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach))  # a row a column
    z = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 0.0).otherwise((F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0)))
    return out.select("column", "row_index", F.round("value", 2).alias("value"), F.round(z, 1).alias("z_score"), F.when(F.col("value") > F.col("mean"), "above").otherwise("below").alias("direction"), "ordinal")


def by_size(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc(F.abs("z_score")), "ordinal", "row_index")


def monthly(df: DataFrame, date: str, column: str) -> DataFrame:
    """period, total (0 for a month of nulls), n (values)."""
    period = F.date_format(F.col(f"`{date}`"), "yyyy-MM")
    rows = df.where(F.col(f"`{date}`").isNotNull()).select(period.alias("period"), _number(column).alias("value"))
    return rows.groupBy("period").agg(F.coalesce(F.sum(F.col("value").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("total"), F.count("value").alias("n"))


def numeric_trends(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """Months whose sum differs from the one of the month before by a fifth or more."""
    parts = [monthly(df, date, c).select(F.lit(i).alias("ordinal"), F.lit(c).alias("label"), "*") for i, c in enumerate(columns)]
    if not parts:
        return df.sparkSession.createDataFrame([], "ordinal int, dimension string, label string, period string, baseline double, period_value double, change_pct double, direction string")
    months = parts[0]
    for p in parts[1:]:
        months = months.unionByName(p)
    order = Window.partitionBy("ordinal").orderBy("period")
    months = months.withColumns({"before": F.lag("total").over(order), "n_before": F.lag("n").over(order)})
    change = (F.col("total") - F.col("before")) / F.nullif("before", F.lit(0.0))
    kept = months.where((F.col("n") >= LEAST_MONTH_ROWS) & (F.col("n_before") >= LEAST_MONTH_ROWS) & (F.abs(change) >= MONTH_CHANGE))
    return kept.select("ordinal", *_trend("numeric_sum", F.round("before", 2), F.round("total", 2), change))


def _trend(dimension: str, baseline: Column, value: Column, change: Column) -> list[Column]:
    return [
        F.lit(dimension).alias("dimension"), "label", "period", baseline.alias("baseline"), value.alias("period_value"),
        F.round(change * 100, 1).alias("change_pct"), F.when(change > 0, "increase").otherwise("decrease").alias("direction"),
    ]


def category_trends(df: DataFrame, date: str, category: str) -> DataFrame:
    """Months whose count of a category differs from the mean of its other months by three quarters or more."""
    rows = df.select(F.date_format(F.col(f"`{date}`"), "yyyy-MM").alias("period"), F.col(f"`{category}`").cast("string").alias("label")).where("period is not null and label is not null")
    counts = rows.groupBy("label", "period").agg(F.count("*").alias("n"))
    own = Window.partitionBy("label")
    counts = counts.withColumns({"months": F.count("*").over(own), "sum": F.sum("n").over(own)}).where("months >= 2")
    counts = counts.withColumn("baseline", (F.col("sum") - F.col("n")) / (F.col("months") - 1))
    change = (F.col("n") - F.col("baseline")) / F.col("baseline")
    few = (F.col("n") < F.col("baseline")) & (F.col("n") < LEAST_MONTH_COUNT)
    kept = counts.where((F.col("baseline") >= LEAST_MONTH_COUNT) & ~few & (F.abs(change) >= SPIKE_CHANGE))
    return kept.select(F.lit(1_000_000).alias("ordinal"), *_trend("category_count", F.round("baseline", 1), F.col("n").cast("double"), change))


def by_change(trends: DataFrame) -> DataFrame:
    return trends.orderBy(F.desc(F.abs("change_pct")), "ordinal", "label", "period")


def trend_line(df: DataFrame, date: str, column: str) -> DataFrame:
    rows = df.where(F.col(f"`{date}`").isNotNull() & F.col(f"`{column}`").isNotNull())
    return monthly(rows, date, column).select("period", F.round("total", 2).alias("value"))


def category_bar(df: DataFrame, category: str, value: str) -> DataFrame:
    rows = df.where(F.col(f"`{category}`").isNotNull()).select(F.col(f"`{category}`").cast("string").alias("category"), _number(value).alias("value"))
    mean = F.sum(F.col("value").cast("decimal(28,6)")).cast("double") / F.nullif(F.count("value"), F.lit(0))
    return rows.groupBy("category").agg(F.count("*").alias("count"), F.round(mean, 2).alias("avg_value"))


def chosen_points(df: DataFrame, row_index: str = "row_index", most: int = MOST_POINTS) -> DataFrame:
    """Up to ``most`` rows, the same ones on every run and however the table is partitioned."""
    return df.orderBy(F.xxhash64(row_index, F.lit(42)), row_index).limit(most)


def trendline(df: DataFrame, x: str, y: str) -> DataFrame:
    """x_min, y_at_min, x_max, y_at_max of the least-squares line; no row unless x varies."""
    a, b = _number(x), _number(y)
    rows = df.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null")
    one = rows.agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("var"))
    slope = F.col("cov") / F.nullif("var", F.lit(0.0))
    at = lambda c: F.col("my") + slope * (F.col(c) - F.col("mx"))
    return one.where("n >= 2 and x_min < x_max").select("x_min", at("x_min").alias("y_at_min"), "x_max", at("x_max").alias("y_at_max"))


def anomaly_points(df: DataFrame, column: str, found: DataFrame, row_index: str = "row_index", most: int = MOST_POINTS) -> DataFrame:
    """All anomalies of a column and chosen normal values up to ``most`` points: row_index, value, is_anomaly."""
    cells = long_numbers(df, [column], row_index).select("row_index", "value")
    odd = found.where(F.col("column") == column).select("row_index")
    points = cells.join(odd, "row_index", "left_semi").withColumn("is_anomaly", F.lit(True))
    budget = max(0, most - points.count())
    return points.unionByName(chosen_points(cells.join(odd, "row_index", "left_anti"), "row_index", budget).withColumn("is_anomaly", F.lit(False)))
