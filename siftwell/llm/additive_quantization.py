"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of several full-dimensional codebooks. Codebooks are
fitted level by level on residuals of a bounded, deterministic sample and refined together by least squares;
every row is encoded by beam search, and the squared norm of its reconstruction is stored with the code. A
query is scored against all codes through lookup tables of its inner products with the codewords; the best
``rerank`` codes of each query are rescored exactly, in double precision, on the original vectors.

Equal vectors are searched as one, which stands for its smallest ids, and equal codes are scored as one; every
vector of a chosen code is rescored, and all codes that tie with the last one chosen are chosen too. So no copy and
no near copy is lost to the cut.

Queries meet all codes in a grid of query blocks and code blocks, so neither side is broadcast; a task holds one
block of each and the lookup tables of QUERIES_AT_ONCE queries. Defined results: vectors that are null, zero, of another
length than most (of equally common lengths the shorter) or that hold a null or a non-finite component take no part on
either side; a query with fewer candidates gets all of them; ties go to the smaller id; rows that share an id are rows of their own, each a
query with 20 answers and each a candidate of the other; rows with a null id take no part; an empty table gives an empty
result; columns besides the two named ones are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise


#: Queries whose lookup tables a task holds at a time: levels x size x 4 bytes each, and 4 bytes a code of the block.
QUERIES_AT_ONCE = 64
#: Codes whose sums are taken at a time, so that they stay near the processor.
CODES_AT_ONCE = 4096
#: Bytes of a component, and of an id or a count, by which tables are bounded.
_WIDE = 9


@dataclass
class Codebooks:
    words: np.ndarray  # levels x size x dimensions
    beam: int

    @property
    def levels(self) -> int:
        return self.words.shape[0]

    @property
    def size(self) -> int:
        return self.words.shape[1]


def usable(column: str):
    """True for an array without null or non-finite components and not all zero."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & fine & F.exists(column, lambda x: x != 0), F.lit(False))


def _means(x: np.ndarray, group: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Means of the rows of x by group; a group without rows keeps its old one."""
    order = np.argsort(group, kind="stable")
    n = np.bincount(group, minlength=len(old))
    out, used = old.copy(), n > 0
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])[used]
    out[used] = np.add.reduceat(x[order], starts, 0) / n[used, None]
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        centres = _means(x, np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1), centres)
    return centres


def train(sample: np.ndarray, *, levels: int, size: int, beam: int, rounds: int = 6, refine: int = 2, seed: int = 11) -> Codebooks:
    """Residual codebooks, then rounds of refinement: beam search finds the codes, and every codebook in turn
    takes the means of what the other codebooks leave over."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    size = max(1, min(size, len(x)))
    words, rest = [], x.copy()
    for _ in range(levels):
        c = _kmeans(rest, size, rng, rounds)
        words.append(c)
        rest = rest - c[np.argmax(rest @ c.T - 0.5 * (c**2).sum(1), 1)]
    books = Codebooks(np.array(words), beam)
    for _ in range(refine):
        codes, _ = encode(books, x)
        rest = x - sum(books.words[m][codes[:, m]] for m in range(levels))
        for m in range(levels):
            rest += books.words[m][codes[:, m]]
            books.words[m] = _means(rest, codes[:, m], books.words[m])
            rest -= books.words[m][codes[:, m]]
    return books


def encode(books: Codebooks, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x levels) and squared norms of the reconstructions, by beam search over the residuals."""
    n, k, width, d = len(x), books.size, books.beam, x.shape[1]
    out, norms = np.zeros((n, books.levels), np.int64), np.zeros(n, np.float32)
    squares = (books.words**2).sum(2)
    for at in range(0, n, 1024):
        block = x[at : at + 1024]
        rows = np.arange(len(block))[:, None]
        rest = block[:, None, :]
        codes = np.zeros((len(block), 1, 0), np.int64)
        for m in range(books.levels):
            near = (rest.reshape(-1, d) @ books.words[m].T).reshape(len(block), -1, k)
            cost = ((rest**2).sum(2)[:, :, None] - 2 * near + squares[m]).reshape(len(block), -1)
            keep = min(width, cost.shape[1])
            best = np.argpartition(cost, keep - 1, 1)[:, :keep]
            rest = rest[rows, best // k] - books.words[m][best % k]
            codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], 2)
        least = np.argmin((rest**2).sum(2), 1)
        out[at : at + 1024] = codes[rows[:, 0], least]
        norms[at : at + 1024] = ((block - rest[rows[:, 0], least]) ** 2).sum(1)
    return out, norms


def _matrix(column: list) -> np.ndarray:
    return np.array(column, np.float32)


def search(
    vectors: DataFrame,
    *,
    id_col: str,
    vector_col: str,
    is_query,
    k: int = 20,
    levels: int = 32,
    size: int = 256,
    beam: int = 4,
    train_rows: int = 8192,
    rerank: int = 600,
    measure: str = "inner",
    code_block: int = 1 << 19,
    query_block: int = 1 << 14,
) -> DataFrame:
    """is_query: a condition on id_col. Returns query_id, rank, id_col, score. train_rows bounds the sample that the codebooks
    are fitted on; every row is indexed. measure: inner (product) or euclidean (score is the negative squared distance)."""
    spark = vectors.sparkSession
    # Vectors travel in their own type; products are taken in double precision.
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null").where(usable("v"))
    # The commonest length is the index's.
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    total, dimensions = (lengths[0]["count"], lengths[0]["n"]) if lengths else (0, 1)
    size_of = lambda n: n * _WIDE * (dimensions + 4)
    numbered = rows.where(F.size("v") == dimensions).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(numbered, "vectors", size_of(total)).withColumn("q", is_query(F.col("id")))
    # One row a vector: its k + 1 first rows are all that any query can need of it. The limit works before the shuffle too.
    copies = Window.partitionBy("v").orderBy("id", "row")
    few = rows.select("id", "row", "v").withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1)
    vectors = materialise(few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids")).select(F.col("ids")[0]["id"].alias("id"), "v", "ids"), "distinct-vectors", size_of(total))
    total = vectors.count() if total else 0
    share = min(1.0, train_rows / max(1, total))  # at most 2 * train_rows vectors come to the driver
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit("codebooks")), F.lit(1_000_003)) < share * 1_000_003).select("id", "v").limit(2 * train_rows).collect()
    schema = f"query_id bigint, rank int, `{id_col}` bigint, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sample = _matrix([r["v"] for r in sorted(picked)] or [vectors.select("v").first()["v"]])
    books = spark.sparkContext.broadcast(train(sample, levels=levels, size=size, beam=beam))
    # Queries with equal vectors ask as one, named by one of their rows.
    asking = materialise(rows.where("q").groupBy("v").agg(F.min("row").alias("query")).select("query", "v"), "query-vectors", size_of(total))
    queries = asking.count()
    parallel = max(2, spark.sparkContext.defaultParallelism)
    code_blocks = -(-total // code_block)
    query_blocks = max(-(-queries // query_block), min(parallel, -(-queries // 64)), 1)

    word = np.uint8 if books.value.size <= 256 else np.uint16

    def code(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if b["id"]:
                codes, norms = encode(books.value, _matrix(b["v"]))
                yield b | {"code": [c.tobytes() for c in codes.astype(word)], "norm": norms.tolist()}

    coded = materialise(map_batches(vectors, code, f"id bigint, v {kind}, ids array<struct<id:bigint,row:bigint>>, code binary, norm float").withColumn("key", F.xxhash64("code")), "vector-codes")
    codes = coded.groupBy("key").agg(F.min("code").alias("code"), F.min("norm").alias("norm"))
    grid_codes = codes.withColumn("c", F.pmod(F.xxhash64("key"), F.lit(code_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select("key", "code", "norm", "c", "q")
    asked = asking.select("query", "v", F.pmod(F.xxhash64("query", F.lit("query")), F.lit(query_blocks)).cast("int").alias("q"))
    grid_queries = asked.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(code_blocks - 1).cast("long")))).select("query", "v", "c", "q")

    def lookup(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best of one block of codes for one block of queries, by sums of looked-up inner products."""
        out: dict[str, list] = {"query": [], "key": [], "guess": []}
        if len(left) and len(right):
            b = books.value
            keys = right["key"].to_numpy()
            order = np.argsort(keys)
            keys = keys[order]
            flat = (np.frombuffer(b"".join(right["code"]), word).reshape(len(right), -1)[order].T + (np.arange(b.levels) * b.size)[:, None]).astype(np.intp)
            keep = min(rerank + 1, len(keys))  # the query's own code may be one of them
            norms = right["norm"].to_numpy()[order] * np.float32(-0.5 if measure == "euclidean" else 0)
            for at in range(0, len(left), QUERIES_AT_ONCE):
                part = left.iloc[at : at + QUERIES_AT_ONCE]
                # A word's line of the tables has its products with all queries at hand, so a code's sum is taken for all of them at once.
                tables = b.words.reshape(-1, b.words.shape[2]) @ _matrix(part["v"].tolist()).T
                guesses = np.empty((len(part), len(keys)), np.float32)
                for lo in range(0, len(keys), CODES_AT_ONCE):
                    piece = slice(lo, lo + CODES_AT_ONCE)
                    total = norms[piece, None] + tables[flat[0, piece]]
                    for level in flat[1:, piece]:
                        total += tables[level]
                    guesses[:, piece] = total.T
                for query, guess in zip(part["query"], guesses):
                    best = np.flatnonzero(guess >= np.partition(guess, len(guess) - keep)[len(guess) - keep])
                    out["query"].append(np.full(len(best), query))
                    out["key"].append(keys[best])
                    out["guess"].append(guess[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()}).astype({"query": "int64", "key": "int64", "guess": "float32"})

    found = grid_queries.groupBy("c", "q").cogroup(grid_codes.groupBy("c", "q")).applyInPandas(lookup, "query bigint, key bigint, guess float")
    if code_blocks > 1:
        nearest = Window.partitionBy("query").orderBy(F.desc("guess"))
        found = found.withColumn("place", F.rank().over(nearest)).where(F.col("place") <= rerank + 1)
    pairs = found.select("query", "key").join(coded.select("key", "id", "v", "ids"), "key").join(asking.withColumnRenamed("v", "w"), "query")
    term = (lambda a, b: a * b) if measure == "inner" else (lambda a, b: -(a - b) * (a - b))
    wide = lambda c: c.cast("double")
    exact = F.aggregate(F.zip_with("v", "w", lambda a, b: term(wide(a), wide(b))), F.lit(0.0), lambda s, x: s + x)
    # The best k + 1 vectors hold the best k + 1 rows, for a vector goes by its first row; one of them may be the query itself.
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id", F.col("ids")[0]["row"])
    best = pairs.select("query", "id", "ids", exact.alias("score")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    best = best.select("query", "score", F.inline("ids")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    askers = rows.where("q").select(F.col("id").alias("query_id"), F.col("row").alias("asker"), "v").join(asking, "v").select("query_id", "asker", "query")
    answers = askers.join(best.select("query", "id", "row", "score"), "query").where("asker != row")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "id", "row")
    ranked = answers.select("query_id", "asker", "id", "row", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
