"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors of one group (label and length) are at a distance of sqrt(2 - 2 cos). A hash is the floor of a shifted
Gaussian projection divided by a width; ``depth`` of them make a bucket of one table. The depth follows from the rows of the
largest group, so that unlike vectors fill a bucket to about ``bucket`` rows, and the number of tables from the wanted recall
of a pair right at the threshold. In every bucket all pairs get their exact cosine, in double precision.

What many rows share: equal vectors of a group are one representative with a count. Where the first table has a bucket of over
``tile`` representatives, those within half the threshold's angle of its first one are a core: by the triangle inequality
all of a core are linked, so their links are counted and not compared, and costs grow with the core, not with its square.
Buckets of over ``tile`` rows are cut into blocks that meet in tiles; blocks of one core do not meet. A pair is counted in the first
table whose bucket it shares, which its tile can tell as every row carries all its hashes; so no pair is emitted: a tile gives
a number of links a row and a spanning forest of them.

Defined results: a null, empty or zero vector, one with a null or non-finite component, or with a null label links with nothing and is
a component of its own; vectors of unlike length never link; rows that share an id are vectors of their own, and of a component the
smallest id stands; rows with a null id take no part and are not returned; an empty table gives an empty result; columns
besides the named ones are not read, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .additive_quantization import usable
from .common import discard, joined_by_key, map_batches, map_groups, materialise
from .components import connected_components
from .ngram_jaccard_join import _forest

#: Rows of keys that are broadcast; more are joined.
FEW = 200_000
_BUCKET = ["label", "dim", "t", "hash"]


def collision(distance: float, width: float) -> float:
    """Chance that two vectors at this distance fall into one interval of a projection."""
    c = width / max(distance, 1e-12)
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(rows: int, threshold: float, recall: float, bucket: int, width: float) -> tuple[int, int]:
    """depth and tables for a group of so many rows."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    depth = max(1, math.ceil(math.log(max(1.0, rows / bucket)) / -math.log(far)))
    return depth, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**depth)))


def unit(raw: list[bytes], kind: type) -> np.ndarray:
    """Rows of length one, in double precision whatever the size of the components."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hashes(x: np.ndarray, depth: int, tables: int, width: float, seed: int = 29) -> np.ndarray:
    """rows x tables, 32 bits of every table's bucket."""
    rng = np.random.default_rng([seed, x.shape[1], depth, tables])
    lines, shifts = rng.standard_normal((x.shape[1], depth * tables)), rng.uniform(0, width, depth * tables)
    cells = np.floor((x @ lines + shifts) / width).astype(np.int32)
    return np.array([[xxhash.xxh32_intdigest(row[t * depth : (t + 1) * depth].tobytes()) for t in range(tables)] for row in cells], np.uint32).reshape(len(x), tables)


def near_duplicates(
    vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, threshold: float = 0.93, recall: float = 0.999, bucket: int = 256, tile: int = 512, width: float = 1.5, few: int = FEW
) -> DataFrame:
    """id_col, n_links (other vectors of the label linked directly), component_id (the smallest id reachable by links) and kept, for
    every row."""
    wide = vectors.schema[vector_col].dataType.simpleString() != "array<float>"
    kind, typed = (np.float64, "array<double>") if wide else (np.float32, "array<float>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(typed).alias("v"), F.col(label_col).alias("label")).where("id is not null")
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & usable("v"), F.col("v")))
    size = 9 * (rows.count() + 1)
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    distinct = materialise(distinct.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v")}), "distinct-vectors")
    largest = distinct.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    depth, tables = plan(largest, threshold, recall, bucket, width)

    def sign(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {"node": b["node"], "label": b["label"], "dim": b["dim"], "copies": b["copies"], "v": [np.array(v, kind).tobytes() for v in b["v"]]}
            keys: list[bytes] = [b""] * len(out["v"])
            for dim in set(b["dim"]):
                mine = [i for i, d in enumerate(b["dim"]) if d == dim]
                for i, row in zip(mine, hashes(unit([out["v"][i] for i in mine], kind), depth, tables, width)):
                    keys[i] = row.tobytes()
            yield out | {"keys": keys}

    label_type = vectors.schema[label_col].dataType.simpleString()
    schema = f"node bigint, label {label_type}, dim int, copies bigint, v binary, keys binary"
    signed = materialise(map_batches(distinct.select("node", "label", "dim", "copies", "v"), sign, schema), "hashes")
    written: list[DataFrame] = []
    table_key = lambda t: F.conv(F.hex(F.substring("keys", 4 * t + 1, 4)), 16, 10).cast("long")
    signed, cores = _cores(signed.withColumn("hash", table_key(0)), kind, threshold, tile, few, written)

    members = signed.drop("hash", "v").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    members = members.withColumn("hash", F.conv(F.hex(F.expr("substring(keys, 4 * t + 1, 4)")), 16, 10).cast("long")).select(*_BUCKET, "node", "core")
    parts = members.groupBy(*_BUCKET, "core").agg(F.count("*").alias("n"))
    dense = (F.col("core") >= 0) & (F.col("n") >= tile)
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    layout = parts.groupBy(*_BUCKET).agg(F.sum("n").alias("n"), F.sum(F.when(dense, 0).otherwise(F.col("n"))).alias("loose"), F.collect_list(F.when(dense, F.struct("core", blocks.alias("blocks")))).alias("dense"))
    layout = materialise(layout.where("n > 1").drop("n"), "buckets")
    written.append(layout)
    placed = joined_by_key(members, layout, _BUCKET, layout.count(), few, 60, written)
    # A member's block: of its core if that is dense here, else one of the loose ones. Loose blocks meet all, a core's blocks all but its own.
    loose = F.struct(F.lit(-1).cast("long").alias("core"), F.ceil(F.col("loose") / F.lit(tile)).cast("int").alias("blocks"))
    placed = placed.withColumn("mine", F.filter("dense", lambda x: x["core"] == F.col("core")))
    placed = placed.withColumns({"own_core": F.coalesce(F.get("mine", F.lit(0))["core"], F.lit(-1).cast("long")), "own_blocks": F.coalesce(F.get("mine", F.lit(0))["blocks"], loose["blocks"])})
    name = lambda core, i: F.concat_ws("/", core, i)
    placed = placed.withColumn("own", name("own_core", F.pmod(F.xxhash64("node"), F.col("own_blocks"))))
    others = F.filter(F.concat(F.array(loose), F.col("dense")), lambda x: (x["blocks"] > 0) & ((F.col("own_core") < 0) | (x["core"] != F.col("own_core"))))
    named = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda i: name(x["core"], i))))
    tiles = placed.withColumn("other", F.explode(named)).select("label", "dim", "t", "hash", "node", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    tiles = tiles.join(signed.select("node", "core", "copies", "v", "keys"), "node")

    def compare(key: tuple, rows: dict[str, list]) -> dict[str, list]:
        """Links of a tile that no core and no earlier table has: their number by row, and a forest of them."""
        x = unit(rows["v"], kind)
        core = np.array(rows["core"])
        linked = np.triu(x @ x.T >= threshold, 1) & ((core[:, None] != core[None, :]) | (core[:, None] < 0))
        if key[4] != key[5]:
            own = np.array([o == key[4] for o in rows["own"]])
            linked &= own[:, None] != own[None, :]
        i, j = np.nonzero(linked)
        if key[2] and len(i):
            words = np.frombuffer(b"".join(rows["keys"]), np.uint32).reshape(len(x), -1)
            for t in range(key[2]):
                fresh = words[i, t] != words[j, t]
                i, j = i[fresh], j[fresh]
            linked = np.zeros_like(linked)
            linked[i, j] = True
        linked |= linked.T
        found = np.flatnonzero(linked.any(1))
        node = np.array(rows["node"])
        root = _forest(linked)
        return {"node": node[found].tolist(), "links": (linked[found] @ np.array(rows["copies"])).tolist(), "root": node[root[found]].tolist()}

    links = map_groups(tiles.select("label", "dim", "t", "hash", "a", "b", "own", "node", "core", "copies", "v", "keys"), [*_BUCKET, "a", "b"], compare, "node bigint, links bigint, root bigint")
    links = materialise(links.unionByName(cores), "links")
    for table in written:
        discard(table)
    component = connected_components(links, a="node", b="root", most_edges=links.count())
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = distinct.select("node", "label", "v", "copies", "first").join(counted, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = materialise(nodes.join(smallest, "component").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "known", size * 40)
    with_links = rows.where("v is not null").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = with_links.unionByName(alone)
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _cores(signed: DataFrame, kind: type, threshold: float, tile: int, few: int, written: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """signed with a core (-1: none), and the links within cores: node, links, root."""
    by = ["label", "dim", "hash"]
    first = signed.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("node", "v")).alias("pivot")).where(F.col("n") > tile)
    first = materialise(first.select(*by, F.col("pivot.node").alias("pivot"), F.col("pivot.v").alias("w")), "pivots")
    written.append(first)
    most = first.count()
    none = F.lit(-1).cast("long")
    empty = signed.sparkSession.createDataFrame([], "node bigint, links bigint, root bigint")
    if not most:
        return signed.withColumn("core", none), empty
    half = math.cos(math.acos(threshold) / 2 - 1e-7)

    def near(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if b["node"]:
                dims = np.array(b["dim"])
                inside = np.zeros(len(dims), bool)
                for dim in set(b["dim"]):
                    at = np.flatnonzero(dims == dim)
                    inside[at] = (unit([b["v"][i] for i in at], kind) * unit([b["w"][i] for i in at], kind)).sum(1) >= half
                yield {"node": [n for n, k in zip(b["node"], inside) if k], "core": [p for p, k in zip(b["pivot"], inside) if k], "copies": [c for c, k in zip(b["copies"], inside) if k]}

    asked = joined_by_key(signed.select(*by, "node", "copies", "v"), first, by, most, min(few, 20_000), 600, written)
    close = materialise(map_batches(asked.select("node", "dim", "copies", "v", "pivot", "w"), near, "node bigint, core bigint, copies bigint"), "cores")
    written.append(close)
    sums = close.groupBy("core").agg(F.count("*").alias("n"), F.sum("copies").alias("all")).where(F.col("n") >= tile)
    kept = joined_by_key(close, sums.drop("n"), "core", most, few, 24, written)
    kept = materialise(kept, "members-of-cores")
    marked = materialise(signed.join(kept.select("node", "core"), "node", "left").withColumn("core", F.coalesce("core", none)), "marked")
    return marked, kept.select("node", (F.col("all") - F.col("copies")).alias("links"), F.col("core").alias("root"))
