"""Correlations of many columns at once, over rows where both are there, from blocked co-moments.

A task turns blocks of rows into matrices by products of whole blocks: for each pair of columns (i, j) the rows that have both, the
mean of i among them, its squared deviations, and the products of both deviations. Deviations are taken from means, block by
block, and blocks are merged by the usual formulas, so nothing cancels. A row of the result of a task is one column's line of
the matrices; lines are merged by column, first a share of the tasks at a time, then the shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; lines of a column that one task merges at a time.
BLOCK, FAN_IN = 4096, 64
_LINE = "i int, n binary, mean binary, dev binary, cross binary, low binary, high binary"
_FIELDS = ("n", "mean", "dev", "cross", "low", "high")


class Moments:
    """n[i, j]: rows with i and j; mean[i, j], dev[i, j], low[i, j] and high[i, j]: of i among them; cross[i, j]: of both deviations."""

    def __init__(self, *parts: np.ndarray):
        self.n, self.mean, self.dev, self.cross, self.low, self.high = parts

    @classmethod
    def of(cls, x: np.ndarray, varied: np.ndarray | None = None) -> Moments:
        """x: rows by columns, NaN where there is no value. varied[i, j]: i is known to vary beside j from rows before; its range is no
        longer looked for among the rows that have both, as a range only tells whether a column varies."""
        there = ~np.isnan(x)
        middle = np.where(there, x, 0).sum(0) / np.maximum(there.sum(0), 1)
        d, m = np.where(there, x - middle, 0.0), there.astype(float)
        n = m.T @ m
        some = np.maximum(n, 1)
        mean = (d.T @ m) / some
        low, high = (np.repeat(f(np.where(there, x, fill), axis=0)[:, None], x.shape[1], 1) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
        for j in np.flatnonzero(~there.all(0)):  # only beside a column with gaps can a pair's range be narrower
            i = np.arange(x.shape[1]) if varied is None else np.flatnonzero(~varied[:, j])
            if len(i):
                both = there[:, i] & there[:, [j]]
                low[i, j], high[i, j] = (f(np.where(both, x[:, i], fill), axis=0) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
        return cls(n, mean + middle[:, None], np.maximum((d * d).T @ m - n * mean**2, 0), d.T @ d - n * mean * mean.T, low, high)

    def add(self, other: Moments, theirs: tuple[np.ndarray, np.ndarray] | None = None) -> Moments:
        """Both together. Of single lines theirs are the means of j beside i, of each side."""
        n = self.n + other.n
        share = self.n * other.n / np.maximum(n, 1)
        gap = other.mean - self.mean
        across = gap.T if theirs is None else theirs[1] - theirs[0]
        return Moments(n, self.mean + gap * other.n / np.maximum(n, 1), self.dev + other.dev + gap**2 * share, self.cross + other.cross + gap * across * share, np.minimum(self.low, other.low), np.maximum(self.high, other.high))


def _lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column and task: i and that line of every matrix, with the means of the other columns beside it."""
    # Many columns that are computed make one generated method too large for the JVM to compile, and slow; beside an array function
    # they are projected outside of it.
    beside = F.exists(F.array(F.spark_partition_id()), lambda p: p >= 0).alias("beside")
    source = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)], beside)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            x = b.iloc[:, : len(columns)].to_numpy(float)
            for at in range(0, len(x), BLOCK):
                part = Moments.of(x[at : at + BLOCK], None if total is None else total.low < total.high)
                total = part if total is None else total.add(part)
        if total is not None:
            out = {"i": np.arange(len(columns), dtype=np.int32)} | {f: [line.tobytes() for line in getattr(total, f)] for f in _FIELDS}
            yield pd.DataFrame(out | {"beside": [line.tobytes() for line in np.ascontiguousarray(total.mean.T)], "task": np.full(len(columns), hash(total.mean.tobytes()) & 0x7FFFFFFF)})

    return source.mapInPandas(run, f"{_LINE}, beside binary, task bigint")


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """All lines of one column as one, in an order of their own so that sums are the same on every run."""
    total, beside = None, None
    for r in part.sort_values(["n", "mean", "cross"]).itertuples():
        line = Moments(*(np.frombuffer(getattr(r, f)) for f in _FIELDS))
        means = np.frombuffer(r.beside)
        if total is None:
            total, beside = line, means
        else:
            both = total.add(line, theirs=(beside, means))
            beside = beside + (means - beside) * line.n / np.maximum(both.n, 1)
            total = both
    out = {"i": [part["i"].iloc[0]]} | {f: [getattr(total, f).tobytes()] for f in _FIELDS}
    return pd.DataFrame(out | {"beside": [beside.tobytes()], "task": [0]})


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, r (i < j, by place among columns): Pearson's r; null for fewer than two rows with both or where one does not vary."""
    lines = _lines(df, columns)
    schema = f"{_LINE}, beside binary, task bigint"
    shares = lines.groupBy("i", F.pmod("task", F.lit(FAN_IN)).alias("share")).applyInPandas(lambda key, part: _merge(part), schema)
    whole = shares.groupBy("i").applyInPandas(_merge, schema)

    def correlate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                n, dev, cross, low, high = (np.frombuffer(getattr(r, f)) for f in ("n", "dev", "cross", "low", "high"))
                j = np.arange(len(n))
                yield pd.DataFrame({"i": np.full(len(n), r.i), "j": j, "n": n, "dev": dev, "cross": cross, "varied": low < high})

    # The deviations of j beside i are in j's line: both lines of a pair meet by grouping, so that nothing is computed twice.
    flat = whole.mapInPandas(correlate, "i int, j int, n double, dev double, cross double, varied boolean").where("i <> j")
    own = F.col("i") < F.col("j")
    pairs = flat.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.max(F.when(own, F.col("dev"))).alias("dev"), F.max(F.when(~own, F.col("dev"))).alias("dev_j"), F.max(F.when(own, F.col("cross"))).alias("cross"), F.max("n").alias("n"), F.min("varied").alias("varied")
    )
    fine = F.col("varied") & (F.col("n") > 1)
    r = F.when(fine, F.col("cross") / F.nullif(F.sqrt("dev") * F.sqrt("dev_j"), F.lit(0.0)))
    bounded = F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)
    return pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), bounded.alias("r"))
