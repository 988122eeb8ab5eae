"""Hard negatives by norm-bucketed search, exact.

Candidates are sorted by norm, longest first, and cut into buckets of up to ``bucket`` rows; queries are dealt into blocks. A
query's score with any row of a bucket is at most the product of its own norm and the bucket's largest (Cauchy-Schwarz), so a
bucket whose product stays below the lower limit of all the query's windows is not even sent the query. Within a task the bucket is
gone through in runs of falling norm, and a window is closed as soon as the product falls below its lower limit or its running
kth score. The search runs twice: among rows of the query's label, without a window, for the positives; then among rows of
other labels, with a window for every positive, for the negatives. A task returns at most k rows a window.

Scores are inner products of integers: components times ``scale``, rounded down. They are computed in double precision where that is
exact (every sum below 2^53) and in Python's integers elsewhere.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite component take no part; rows are compared
with rows of their own length only; zero and empty vectors score 0; rows that share an id are rows of their own, each an anchor
and each a candidate of the other; ties go to the smaller id; an anchor without another row of its label, or whose window is
empty (as it is below a score of 0), gives no rows; a score beyond 64 bits is an error; empty tables give empty results;
columns besides the named ones are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise

#: Rows of a bucket that are scored at once, and windows that are open at once in a task.
RUN, WINDOWS = 2048, 1024
#: Up to so many buckets are broadcast with their norms (of 40 bytes each).
FEW = 200_000
_SLACK = 1 + 1e-9  # of bounds in floating point


def _decode(packed: list[bytes], dim: int) -> np.ndarray:
    """Rows of integers in double precision. Short rows travel in 16 bits a component."""
    if not dim:
        return np.zeros((len(packed), 0))
    if all(len(p) == 2 * dim for p in packed):
        return np.frombuffer(b"".join(packed), np.int16).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(p, np.int16 if len(p) == 2 * dim else np.float64) for p in packed], np.float64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: int64, or Python's integers where a sum may pass 2^53."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    return whole(a) @ whole(b).T


class _Queries:
    """A block of queries with the windows of each."""

    def __init__(self, part: pd.DataFrame, dim: int) -> None:
        self.x = _decode(part["v"].tolist(), dim)
        self.norm, self.label, self.row = part["norm"].to_numpy(), part["label"].to_numpy(), part["row"].to_numpy()


def scan(q: _Queries, query: np.ndarray, low: list, high: list, k: int, c: _Queries, ids: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates (by score, then smaller id) of every window: window, place of the candidate, score. query[w] is the
    window's query; low and high bound its scores (None: no bound). same: candidates of the query's label, but for itself; else
    those of other labels."""
    order = np.argsort(-c.norm, kind="stable")
    window, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = [None] * len(query)
    for at in range(0, len(order), RUN):
        run = order[at : at + RUN]
        bound = q.norm[query] * (c.norm[run[0]] * _SLACK) + 1e-9
        open_ = [w for w in range(len(query)) if not (low[w] is not None and bound[w] < low[w]) and not (kth[w] is not None and bound[w] < kth[w])]
        if not open_:
            break  # norms fall, so no later run can do better
        for part in (open_[i : i + WINDOWS] for i in range(0, len(open_), WINDOWS)):
            own, of = np.unique(query[part], return_inverse=True)
            s = inner(q.x[own], c.x[run])
            fits = q.label[own][:, None] == c.label[run][None, :]
            fits = fits & (q.row[own][:, None] != c.row[run][None, :]) if same else ~fits
            for start in range(0, len(part), 256):
                some = part[start : start + 256]
                mine, ok = s[of[start : start + 256]], fits[of[start : start + 256]]
                for bounds, ufunc in ((low, np.greater_equal), (high, np.less_equal)):
                    if bounds[some[0]] is not None:
                        ok = ok & ufunc(mine, np.array([bounds[w] for w in some], mine.dtype)[:, None]).astype(bool)
                least = np.array([-1 << 62 if kth[w] is None else kth[w] for w in some], mine.dtype)[:, None]
                ok = ok & (mine >= least).astype(bool)
                if len(run) > k and mine.dtype == np.int64:  # only what reaches the run's own kth, with all that equals it
                    level = np.where(ok, mine, np.iinfo(np.int64).min)
                    ok &= mine >= np.partition(level, len(run) - k, 1)[:, len(run) - k][:, None]
                i, j = np.nonzero(ok)
                window = np.concatenate([window, np.array(some, np.int64)[i]])
                place = np.concatenate([place, run[j]])
                score = np.concatenate([score, mine[i, j]])
        window, place, score = _first(window, place, score, ids, k)
        full = np.flatnonzero(np.bincount(window, minlength=len(query)) >= k) if len(window) else []
        last = np.searchsorted(window, full, "right") - 1
        for w, i in zip(full, last):
            kth[w] = score[i]
    return window, place, score


def _first(window: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of every window, in order."""
    order = np.lexsort((ids[place], -score, window)) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda i: (window[i], -score[i], ids[place[i]])), np.int64)
    window, place, score = window[order], place[order], score[order]
    rank = np.arange(len(window)) - np.searchsorted(window, window)
    return window[rank < k], place[rank < k], score[rank < k]


def mine(
    vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, bucket: int = 1 << 17, query_block: int = 8192
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: a condition on id_col. A negative's
    score lies between low and high percent of the positive's. Large tables have buckets of ``bucket`` rows; small ones smaller
    buckets, so that all cores have some."""
    spark = vectors.sparkSession
    label_type = vectors.schema[label_col].dataType.simpleString()
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)

    def pack(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"id": b["id"], "label": b["label"], "v": [], "dim": [], "norm": []}
            for v in b["v"]:
                x = np.floor(scale * np.array(v, np.float64))
                short = np.abs(x).max(initial=0) < 1 << 15
                out["v"].append((x.astype(np.int16) if short else x).tobytes())
                out["dim"].append(len(x))
                out["norm"].append(float(np.sqrt((x * x).sum())))
            yield out

    packed = map_batches(rows, pack, f"id bigint, label {label_type}, v binary, dim int, norm double").withColumn("row", F.monotonically_increasing_id())
    packed = materialise(packed, "vectors")
    total = packed.count()
    size = min(bucket, max(1024, -(-total // (4 * max(2, spark.sparkContext.defaultParallelism)))))
    dealt = lambda by, name: _buckets(packed, by, max(1, -(-total // size)), name)
    queries = packed.where(is_anchor(F.col("id")))
    queries = materialise(queries.withColumn("spread", F.xxhash64("row", F.lit("query"))), "anchors")
    asked = queries.count()

    near = dealt(["dim", "label"], "by-label")
    kept = _grid(near, near.groupBy("dim", "label", "bucket").agg(F.max("norm").alias("most")), queries.withColumns({"low": F.lit(None).cast("array<string>"), "high": F.lit(None).cast("array<string>")}), ["dim", "label"], asked, query_block, positives, True)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    limits = lambda f: F.transform("positives", lambda p: f(p["score"]).cast("string"))
    whole = lambda x: x.cast("decimal(30,0)")
    windows = windows.withColumns({"low": limits(lambda s: F.ceil(whole(s) * low / F.lit(100))), "high": limits(lambda s: F.floor(whole(s) * high / F.lit(100)))})
    ready = materialise(queries.join(windows, queries["row"] == windows["anchor"]).drop("anchor"), "windows")

    far = dealt(["dim"], "by-norm")
    kept = _grid(far, far.groupBy("dim", "bucket").agg(F.max("norm").alias("most")), ready.drop("positives"), ["dim"], asked, query_block, negatives, False)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    chosen = best.join(ready.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "positives"), "anchor")
    positive = F.get("positives", F.col("window"))
    return chosen.select("anchor_id", positive["id"].alias("positive_id"), F.col("rank").cast("int"), F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def _buckets(packed: DataFrame, by: list[str], parts: int, name: str) -> DataFrame:
    """The rows cut into buckets of falling norm. Equal norms are told apart by the row, so that no bucket outgrows the others."""
    order: list[Column] = [*map(F.col, by), F.desc("norm"), F.xxhash64("row")]
    return materialise(packed.repartitionByRange(parts, *order).withColumn("bucket", F.spark_partition_id()), name)


def _grid(candidates: DataFrame, bounds: DataFrame, queries: DataFrame, by: list[str], asked: int, query_block: int, k: int, same: bool) -> DataFrame:
    """anchor (row), window, id, score: the k best of every bucket for every window that the bucket's norm lets in."""
    spark = candidates.sparkSession
    bounds = materialise(bounds, "norms-of-buckets")
    few = bounds.count() <= FEW
    group = queries.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("blocks"))
    near = queries.join(group, by).withColumn("block", F.pmod(F.col("spread"), F.col("blocks"))).drop("blocks", "spread")
    lowest = F.array_min(F.transform("low", lambda x: x.cast("double")))
    reach = F.col("norm") * F.col("most") * _SLACK + 1e-9
    sent = near.join(F.broadcast(bounds) if few else bounds, by).where(lowest.isNull() | (reach >= lowest)).drop("most")
    meets = materialise(sent.select("bucket", "block", *by).distinct(), "meetings")
    held = candidates.join(F.broadcast(meets) if meets.count() <= FEW else meets, ["bucket", *by])
    keys = ["bucket", "block", *by]

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            c, ids = _Queries(right, dim), right["id"].to_numpy()
            for at in range(0, len(left), WINDOWS):
                part = left.iloc[at : at + WINDOWS]
                q = _Queries(part, dim)
                if same:
                    query, lows, highs = np.arange(len(part)), [None] * len(part), [None] * len(part)
                    number = np.zeros(len(part), np.int64)
                else:
                    counts = [len(x) for x in part["low"]]
                    query = np.repeat(np.arange(len(part)), counts)
                    lows, highs = [int(v) for x in part["low"] for v in x], [int(v) for x in part["high"] for v in x]
                    number = np.concatenate([np.arange(n) for n in counts])
                window, place, score = scan(q, query, lows, highs, k, c, ids, same)
                out.append(pd.DataFrame({"anchor": q.row[query[window]], "window": number[window], "id": ids[place], "score": score}))
        found = pd.concat(out) if out else pd.DataFrame({"anchor": [], "window": [], "id": [], "score": []})
        return found.astype({"anchor": "int64", "window": "int32", "id": "int64", "score": "int64"})

    spread = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = sent.select(*keys, *[c for c in ("label",) if c not in by], "row", "norm", "v", "low", "high").repartition(spread, *keys)
    right = held.select(*keys, *[c for c in ("label",) if c not in by], "id", "row", "norm", "v").repartition(spread, *keys)
    return materialise(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "anchor bigint, window int, id bigint, score bigint"), "found")
