"""N-gram Jaccard join by chosen paths.

A document is the set of its word n-grams; two documents are linked if the Jaccard similarity of their sets is
at least the threshold. Equal sets are one class from the start and stand as one representative.

Every representative has minwise values, of which those at one coordinate are its token there. From the root of
each run, a node chooses one or two coordinates by its own hash (1 / threshold of them on average), and its
members go on to the children named by their tokens: similar sets share a path, others part. A node with at most
``bucket`` members is compared by brute force; larger ones are split again, down to ``depth``. Nodes that are
still larger then are compared in tiles of ``tile`` by ``tile`` members, so no pair is left out and no task
gathers an unbounded group. The number of runs follows from the target recall: the chance that a pair right at
the threshold survives all splits.

Buckets compare minwise sketches and hand on only a spanning forest of likely links, never all pairs. The
clusters that these make are verified on their exact n-gram sets, read from the texts once more: a cluster of up to
``tile`` members and ``held_grams`` n-grams in one task. Of a larger one every text travels once, to a block of its cluster where the cluster's
centre is too, and is kept as its difference from the centre: the centre's n-grams that it lacks and those that it
has besides. Blocks then meet in tiles of ``diff_tile`` by ``diff_tile`` differences, which say exactly how many
n-grams any two members share. Links are counted there and classes are the components of the verified links.

Hot nodes and groups: sizes by node, component or vertex are broadcast while their count is small and written before
they are joined otherwise, which lets Spark split a key that many rows have. Exact copies beyond the first cost a
signature each.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; case and
punctuation count. Defined results: a text with fewer words than n is the single gram of all its words; a null
text or one without a word is linked with nothing; a row with a null id takes no part and is not returned; rows with one
id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_key, map_batches, map_groups, materialise
from .components import connected_components

COORDINATES = 128
#: Up to so many rows of ids (of 8 to 40 bytes) are broadcast; more are joined by key.
BROADCAST_ROWS = 1_000_000
#: The same for tables of keys and counts inside the join.
BROADCAST_KEYS = 200_000
#: n-grams of the texts that one task of exact verification holds (8 bytes each besides the texts).
HELD_GRAMS = 2_000_000
_rng = np.random.default_rng(2023)
_MULTIPLY = (_rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of the whole text."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * _STEP
        out ^= out >> np.uint64(31)
    return np.unique(out)


def minwise(grams: np.ndarray) -> np.ndarray:
    x = (grams >> np.uint64(16)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (x[at : at + 4096] * _MULTIPLY + _ADD).min(1))
    return least


def sketch(signature: np.ndarray) -> np.ndarray:
    """Eight mixed bits of every minwise value."""
    return ((signature * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)


def children(node: int, signature: np.ndarray, threshold: float) -> list[int]:
    """The node's children that a set goes on to. Which coordinates are chosen depends on the node alone."""
    draw = xxhash.xxh3_64_intdigest(b"coordinates%d" % node)
    wanted = 1 / threshold
    count = int(wanted) + ((draw & 0xFFFF) / 65536 < wanted % 1)
    out = []
    for i in range(count):
        at = (draw >> (16 + 12 * i)) % COORDINATES
        out.append(xxhash.xxh3_64_intdigest(b"%d/%d/%d" % (node, at, signature[at])) >> 1)
    return out


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair with exactly the threshold's similarity still shares a node after depth splits."""
    wanted = 1 / threshold
    more = wanted % 1
    s = 1.0
    for _ in range(depth):
        miss = 1 - threshold * s
        s = 1 - ((1 - more) * miss ** int(wanted) + more * miss ** (int(wanted) + 1))
    return s


def _forest(linked: np.ndarray) -> np.ndarray:
    """The first member of every member's component, by the symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] >= 0:
            continue
        front = np.zeros(len(linked), bool)
        front[i] = True
        while front.any():
            root[front] = i
            front = linked[front].any(0) & (root < 0)
    return root


def common_grams(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by blocks of columns of the incidence matrix; grams of one set only are left out."""
    m = len(sets)
    out = np.zeros((m, m))
    if m <= 6:
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    keep = counts[place] > 1
    column = (np.cumsum(counts > 1) - 1)[place[keep]]
    row = row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = 4096
    for at in range(0, int((counts > 1).sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, width), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        out += block @ block.T
    return out


def _blocks(n: str, tile: int):
    return F.ceil(F.col(n) / F.lit(tile)).cast("int")


def _tiled(members: DataFrame) -> DataFrame:
    """members have own, their block of ``blocks``. Adds t and u: the tiles a member takes part in, all (t, u) with t <= u where
    its own block is one of both. A group of one block has the one tile (0, 0)."""
    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"t": F.least("own", "other"), "u": F.greatest("own", "other")}).drop("other")


def _links(ids: np.ndarray, own: np.ndarray, copies: np.ndarray, size: np.ndarray, both: np.ndarray, threshold: float, one_block: bool) -> dict[str, list]:
    """Links and a forest of them, from the sizes of sets and of their intersections. Pairs within a block count only if the tile
    is of one block."""
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    if len(set(ids.tolist())) < len(ids):  # the texts of one id are one document, linked as any of them is
        _, first, at = np.unique(ids, return_index=True, return_inverse=True)
        some = np.zeros((len(first), len(first)), bool)
        np.logical_or.at(some, (at[:, None], at[None, :]), linked)
        ids, own, copies, linked = ids[first], own[first], copies[first], some
    np.fill_diagonal(linked, False)
    counted = linked if one_block else linked & (own[:, None] != own[None, :])
    root = _forest(linked)
    return {"node": ids.tolist(), "links": (counted @ copies).tolist(), "root": ids[root].tolist()}


def classes(
    docs: DataFrame, *, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, recall: float = 0.999, bucket: int = 64, depth: int = 3, tile: int = 512, diff_tile: int = 512, slack: float = 0.14, held_grams: int = HELD_GRAMS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Every document: id_col, class_id (the smallest id of its class) and n_links (documents linked with it, copies included)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def sign(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = _WordHashes()
        for b in batches:
            out: dict[str, list] = {"id": b["id"], "digest": [], "signature": [], "grams": []}
            for text in b["text"]:
                grams = shingles(text, n, hashes)
                out["digest"].append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                out["signature"].append(minwise(grams).tobytes() if len(grams) else None)
                out["grams"].append(len(grams))
            yield out

    signed = materialise(map_batches(source, sign, "id bigint, digest binary, signature binary, grams bigint"), "signatures")
    rows = signed.count()
    few = min(broadcast_rows, BROADCAST_KEYS)
    distinct = signed.where("digest is not null").groupBy("digest", "id").agg(F.first("signature").alias("signature"), F.first("grams").alias("grams"))  # rows with one id count once
    reps = distinct.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("grams").alias("grams"))
    reps = materialise(reps, "representatives", rows * (4 * COORDINATES + 56))
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth))))

    def roots(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"node": [], "rep": []}
            for rep, raw in zip(b["rep"], b["signature"]):
                signature = np.frombuffer(raw, np.uint32)
                nodes = {c for r in range(runs) for c in children(-1 - r, signature, threshold)}
                out["node"] += nodes
                out["rep"] += [rep] * len(nodes)
            yield out

    def split(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"node": [], "rep": []}
            for node, rep, raw in zip(b["node"], b["rep"], b["signature"]):
                nodes = children(node, np.frombuffer(raw, np.uint32), threshold)
                out["node"] += nodes
                out["rep"] += [rep] * len(nodes)
            yield out

    signatures = reps.select("rep", "signature")
    members = map_batches(signatures, roots, "node bigint, rep bigint")
    leaves, written = None, []
    for level in range(1, depth + 1):
        members = materialise(members, "members")
        sizes = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        sizes = materialise(sizes, "nodes", members.count() * 12)
        written += [members, sizes]
        own = F.broadcast(sizes) if sizes.count() <= few else sizes  # a counted table, else one that is joined with hot nodes split
        sized = members.join(own, "node")  # members that are alone in a node go
        small = sized if level == depth else sized.where(f"n <= {bucket}")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = sized.where(f"n > {bucket}")
        if level == depth or sizes.where(f"n > {bucket}").isEmpty():
            break
        members = map_batches(large.select("node", "rep").join(signatures, "rep").select("node", "rep", "signature"), split, "node bigint, rep bigint")

    likely = threshold - slack

    def compare(key: tuple, rows: dict[str, list]) -> dict[str, list]:
        signatures = sketch(np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows["rep"]), -1))
        agree = np.zeros((len(signatures), len(signatures)), np.uint8)
        for column in signatures.T:
            agree += column[:, None] == column[None, :]
        root = _forest(agree >= likely * COORDINATES)
        own = np.array(rows["rep"])
        moved = root != np.arange(len(root))
        return {"a": own[moved].tolist(), "b": own[root[moved]].tolist()}

    leaves = leaves.select("node", "rep", _blocks("n", tile).alias("blocks"))
    leaves = leaves.withColumn("own", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    tiles = _tiled(leaves).join(signatures, "rep").select("node", "t", "u", "rep", "signature")
    edges = materialise(map_groups(tiles, ["node", "t", "u"], compare, "a bigint, b bigint"), "likely-links")
    for table in written:
        discard(table)
    clusters = connected_components(edges, a="a", b="b", most_edges=edges.count(), few=few)
    count = clusters.count()
    kept: list[DataFrame] = []
    clusters = clusters.join(reps.groupBy(F.col("rep").alias("node")).agg(F.max("copies").alias("copies"), F.sum("grams").alias("grams")), "node")
    clusters = materialise(clusters, "likely-clusters", count * 40)
    kept.append(clusters)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"), F.sum("grams").alias("all"))
    clusters = joined_by_key(clusters, sizes, "component", count, few, 32, kept)
    # Clusters of up to a tile, and of texts that a task can hold, are whole; of others every block gets the centre, the cluster's
    # smallest member, besides its own.
    held = F.ceil(F.col("all") / F.lit(held_grams)).cast("int")
    clusters = clusters.withColumn("blocks", F.when((F.col("n") <= tile) & (held <= 1), 0).otherwise(F.greatest(_blocks("n", diff_tile), F.least(held, F.col("n").cast("int")))))
    clusters = clusters.withColumn("own", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))).otherwise(0).cast("int"))
    clusters = clusters.select(F.col("node").alias("id"), "component", "blocks", "own", "copies", F.lit(False).alias("centre"))
    centres = clusters.where("blocks > 0 and id = component").withColumns({"own": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "centre": F.lit(True)})
    chosen = materialise(clusters.unionByName(centres.select(clusters.columns)), "clusters", 2 * count * 48)
    if chosen.count() <= broadcast_rows:
        chosen = F.broadcast(chosen)  # at most broadcast_rows rows of 40 bytes

    nothing = {k: None for k in ("component", "blocks", "own", "copies", "size", "lacks", "adds")}

    def verify(key: tuple, rows: dict[str, list]) -> dict[str, list]:
        """Links of a whole cluster, or the differences of a block's members from the cluster's centre."""
        hashes = _WordHashes()
        sets: list[np.ndarray] = []
        place, seen, centre = [], set(), None
        for i, text in enumerate(rows["text"]):
            grams = shingles(text, n, hashes)
            digest = xxhash.xxh3_128_digest(grams.tobytes())
            if rows["centre"][i]:
                centre = (digest, grams) if centre is None else min(centre, (digest, grams), key=lambda x: x[0])  # of an id with several texts the same one everywhere
            elif len(grams) and (rows["id"][i], digest) not in seen:
                seen.add((rows["id"][i], digest))
                sets.append(grams)
                place.append(i)
        ids, own, copies = (np.array([rows[k][i] for i in place], np.int64) for k in ("id", "own", "copies"))
        if not sets:
            return {k: [] for k in ("node", "links", "root", *nothing)}
        if centre is None:
            size = np.array([len(s) for s in sets], np.float64)
            found = _links(ids, own, copies, size, common_grams(sets), threshold, True)
            return found | {k: [v] * len(found["node"]) for k, v in nothing.items()}
        m, blocks = len(sets), rows["blocks"][place[0]]
        lacks = [np.flatnonzero(~np.isin(centre[1], s, assume_unique=True)).astype(np.uint32).tobytes() for s in sets]
        adds = [np.setdiff1d(s, centre[1], assume_unique=True).tobytes() for s in sets]
        known = {"component": [key[0]] * m, "blocks": [blocks] * m, "own": own.tolist(), "copies": copies.tolist(), "size": [len(s) for s in sets], "lacks": lacks, "adds": adds}
        return {"node": ids.tolist(), "links": [None] * m, "root": [None] * m} | known

    def verify_differences(key: tuple, rows: dict[str, list]) -> dict[str, list]:
        ids, own, copies = (np.array(rows[k]) for k in ("node", "own", "copies"))
        size = np.array(rows["size"], np.float64)
        lacks, adds = [np.frombuffer(x, np.uint32) for x in rows["lacks"]], [np.frombuffer(x, np.uint64) for x in rows["adds"]]
        lost = np.array([len(x) for x in lacks], np.float64)
        centre = size[0] - len(adds[0]) + lost[0]
        both = centre - lost[:, None] - lost[None, :] + common_grams(lacks) + common_grams(adds)
        return _links(ids, own, copies, size, both, threshold, key[1] == key[2])

    texts = source.join(chosen, "id").select("component", "own", "blocks", "id", "copies", "centre", "text")
    schema = "node bigint, links bigint, root bigint, component bigint, blocks int, own int, copies bigint, size bigint, lacks binary, adds binary"
    found = materialise(map_groups(texts, ["component", "own"], verify, schema), "links")
    differences = found.where("size is not null")
    found = found.where("size is null").select("node", "links", "root")
    if not differences.isEmpty():
        tiles = _tiled(differences.drop("links", "root"))
        found = found.unionByName(materialise(map_groups(tiles, ["component", "t", "u"], verify_differences, "node bigint, links bigint, root bigint"), "links-of-blocks"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots_of = connected_components(found.select("node", "root"), a="node", b="root", most_edges=found.count(), few=few)
    for table in kept:
        discard(table)
    by_rep = links.join(roots_of, "node", "left").select(F.col("node").alias("rep"), "links", "component")
    known = signed.where("digest is not null").select("id", "digest").distinct().join(reps.select("digest", "rep", "copies"), "digest").join(by_rep, "rep", "left")
    result = known.select("id", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # An id with several texts is one document; one without a word is alone.
    result = result.groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    alone = signed.groupBy("id").agg(F.count("digest").alias("with_words")).where("with_words = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return result.unionByName(alone).withColumnRenamed("id", id_col)


def without_duplicates(docs: DataFrame, *, id_col: str, text_col: str, **options) -> DataFrame:
    """The rows of docs that stand for their class: the one with the smallest id, of rows with that id the one with the smallest
    digest of its text. Where ids repeat, every row is a document of its own, so rows with one id and unlike texts stay; of
    rows with one id and equal texts one stays. Rows with a null id stay."""
    few = options.get("broadcast_rows", BROADCAST_ROWS)
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        found = materialise(classes(docs, id_col=id_col, text_col=text_col, **options), "classes", 24 * docs.count())
        gone = found.where(F.col(id_col) != F.col("class_id")).select(id_col)
        if gone.count() <= few:
            gone = F.broadcast(gone)  # ids only, counted; the texts then stay where they are
        return docs.join(gone, id_col, "left_anti")
    row = "_row"
    while row in docs.columns:  # a name that docs has not
        row += "_"
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    mine = rows.where(F.col(id_col).isNotNull()).select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialise(classes(mine, id_col="row", text_col="text", **options), "classes", 24 * rows.count())
    keys = mine.select("row", "id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).join(found.select("row", "class_id"), "row")
    best = keys.groupBy("class_id").agg(F.min(F.struct("id", "digest", "row")).alias("best")).select("best.*")
    best = best.groupBy("id", "digest").agg(F.min("row").alias("row"))  # texts without a word are in no class with others
    gone = materialise(found.select("row").join(best.select("row"), "row", "left_anti").select(F.col("row").alias(row)), "gone", 12 * rows.count())
    if gone.count() <= few:
        gone = F.broadcast(gone)
    return rows.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
