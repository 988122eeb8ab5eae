"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_key, materialise

#: Bytes of an edge, by which written tables are bounded.
EDGE = 24


def connected_components(edges: DataFrame, *, a: str, b: str, most_edges: int, most_rounds: int = 40, few: int = 200_000) -> DataFrame:
    """node, component (its smallest node) for every node with an edge to another. The edges stay distributed; every
    round is a written table, of which the one before is then removed. most_edges: a bound on the rows of edges. Up to ``few``
    rows of smallest neighbours, which the edges counted bound, are broadcast; more are written and joined, so that
    a node with very many edges is split. Rounds grow with the logarithm of the longest path; not ending in
    ``most_rounds`` is an error. Edges from a node to itself and repeated edges say nothing; no edge, no row."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = materialise(now, "edges", most_edges * EDGE)
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        written: list[DataFrame] = [now]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = joined_by_key(both, least, "u", 2 * state[0], few, EDGE, written).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = joined_by_key(large, low, "u", 2 * state[0], few, EDGE, written)
        small = pairs.where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u != v").distinct(), "edges", 2 * state[0] * EDGE)
        for old in written:
            discard(old)
    raise RuntimeError(f"no end after {most_rounds} rounds")
