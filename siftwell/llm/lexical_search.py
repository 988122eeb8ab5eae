"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

``build`` cuts the documents of every task into shards of some ``shard_terms`` terms, without a shuffle of texts. A shard holds its
documents' ids, sorted, and the postings of all its terms as compressed rows: the sorted terms, where each term's postings
start, the document's place in the shard and the impact there, an integer computed once from the term's count, the document's
length and the collection's N and L. ``search`` adds up the document frequencies of the items' terms over all shards, then goes
through every shard once for a block of items: term at a time into a dense accumulator, the best ``k`` by partition with all
ties of the last one looked at, so that equal scores fall to smaller ids. A task keeps the best of all its shards; the tasks'
lists are merged by item, in two steps so that no task sorts what all tasks found.

Terms are the maximal runs of characters other than ASCII controls, white space and punctuation, only A-Z lower-cased.

Defined results: a null or empty text, or one without a term, is counted nowhere and never found, and an item of that kind finds
nothing; texts may be of any length, but the terms of one document are held by one task; rows that share a document id are
documents of their own; a null id comes after all others at equal scores; rows that share an item id are items of their own,
each ranked from 1; items come in blocks of a bounded count and of bounded terms, each broadcast; empty tables give empty results;
columns besides the named ones are not read, whatever they are called.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Shares of the merge's first step.
_SHARES = 64
_SHARD = "docs array<bigint>, terms binary, starts binary, places binary, impacts binary"


@dataclass
class Index:
    shards: DataFrame
    documents: int  # N: with at least one term
    terms: int  # L: all terms, with repeats


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 50 + (50 * n * N) div L, in integers."""
    if len(n) and int(n.max()) * documents * 50 >= 1 << 62:
        return np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
    return 50 + 50 * n * documents // terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Shard:
    """Documents of a shard as they are read."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.words = array("i")
        self.vocabulary: dict[bytes, int] = {}

    def add(self, doc: int | None, text: str | None) -> None:
        words = terms_of(text)
        if words:
            number = self.vocabulary
            self.words.extend([number.setdefault(w, len(number)) for w in words])
            self.docs.append(doc)
            self.lengths.append(len(words))

    def close(self, documents: int, terms: int) -> dict[str, list]:
        by_id = sorted(range(len(self.docs)), key=lambda i: (self.docs[i] is None, self.docs[i] or 0))
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        lengths = np.array(self.lengths, np.int64)
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocabulary[w] for w in names]] = np.arange(len(names))
        key = rank[np.frombuffer(self.words, np.int32)] * len(by_id) + np.repeat(place, lengths)
        key, tf = np.unique(key, return_counts=True)
        term, at = np.divmod(key, len(by_id))
        m = length_norm(lengths[by_id], documents, terms)
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        return {
            "docs": [[self.docs[i] for i in by_id]],
            "terms": [b"\n".join(names)],
            "starts": [starts.astype(np.int64).tobytes()],
            "places": [at.astype(np.int32).tobytes()],
            "impacts": [impact(tf.astype(np.int64), m[at]).astype(np.int32).tobytes()],
        }


def build(docs: DataFrame, *, id_col: str, text_col: str, shard_terms: int = 2_000_000) -> Index:
    """An index of all documents and all their terms, written to the shared folder."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        documents = terms = 0
        for b in batches:
            for text in b["text"]:
                n = len(terms_of(text))
                documents, terms = documents + (n > 0), terms + n
        yield {"documents": [documents], "terms": [terms]}

    counted = map_batches(source.select("text"), count, "documents bigint, terms bigint", rows=200)
    documents, terms = counted.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shard = _Shard()
        for b in batches:
            for doc, text in zip(b["id"], b["text"]):
                shard.add(doc, text)
                if len(shard.words) >= shard_terms:
                    yield shard.close(documents, terms)
                    shard = _Shard()
        if shard.docs:
            yield shard.close(documents, terms)

    return Index(materialise(map_batches(source, run, _SHARD, rows=200), "postings"), documents, terms)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0, largest first, equal ones in order of place."""
    found = np.flatnonzero(scores)  # no score is below 0
    if len(found) > k:
        values = scores[found]
        last = values[np.argpartition(values, len(values) - k)[len(values) - k]]
        above, level = found[values > last], found[values == last]
        found = np.concatenate([above, level[: k - len(above)]])
    return found[np.lexsort((found, -scores[found]))]


def search(items: DataFrame, index: Index, *, item_col: str, text_col: str, id_col: str = "doc_id", k: int = 50, items_at_once: int = 2000, terms_at_once: int = 500_000) -> DataFrame:
    """item_col, rank (from 1), id_col, score: the k documents with the highest scores above 0 of every item."""
    spark = items.sparkSession

    def split(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"item": b["item"], "terms": [sorted({t.decode() for t in terms_of(text)}) for text in b["text"]]}

    asked = map_batches(items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")), split, "item bigint, terms array<string>")
    asked = materialise(asked.where("size(terms) > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-n // items_at_once), -(-size // terms_at_once))
    found = spark.createDataFrame([], "row bigint, doc bigint, score bigint")
    for block in range(blocks if index.documents else 0):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "terms").collect()  # a bounded block
        if some:
            found = found.unionByName(_search_block(index, [(r["row"], [t.encode() for t in r["terms"]]) for r in some], k))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    first = Window.partitionBy("row", "share").orderBy(*order)
    found = found.withColumn("share", F.pmod(F.xxhash64("doc"), F.lit(_SHARES))).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place", "share")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return found.join(asked.select("row", "item"), "row").select(F.col("item").alias(item_col), F.col("rank").cast("int"), F.col("doc").alias(id_col), "score")


def _search_block(index: Index, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    spark = index.shards.sparkSession
    wanted = spark.sparkContext.broadcast({t for _, terms in items for t in terms})

    def frequencies(batches: Iterator[dict]) -> Iterator[dict]:
        found: dict[bytes, int] = {}
        asked = wanted.value
        for b in batches:
            for terms, starts in zip(b["terms"], b["starts"]):
                counts = np.diff(np.frombuffer(starts, np.int64)).tolist()
                for term, df in zip(terms.split(b"\n"), counts):
                    if term in asked:
                        found[term] = found.get(term, 0) + df
        yield {"term": list(found), "df": list(found.values())}

    df = map_batches(index.shards.select("terms", "starts"), frequencies, "term binary, df bigint", rows=1).groupBy("term").agg(F.sum("df"))
    weights = spark.sparkContext.broadcast({bytes(t): weight(f, index.documents) for t, f in df.collect()})  # a row a term of the block
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        best: dict[int, list[tuple[int, bool, int]]] = {}
        weight_of = weights.value
        for b in batches:
            for docs, names, starts, places, impacts in zip(*(b[c] for c in ("docs", "terms", "starts", "places", "impacts"))):
                starts, places, impacts = np.frombuffer(starts, np.int64), np.frombuffer(places, np.int32), np.frombuffer(impacts, np.int32)
                at = {t: i for i, t in enumerate(names.split(b"\n")) if t in weight_of}
                for row, terms in shared.value:
                    scores = np.zeros(len(docs), np.int64)
                    for term in terms:
                        i = at.get(term)
                        if i is not None:
                            part = slice(starts[i], starts[i + 1])
                            scores[places[part]] += weight_of[term] * impacts[part].astype(np.int64)
                    mine = [(-int(scores[p]), docs[p] is None, docs[p] or 0) for p in _best(scores, k)]
                    if mine:
                        best[row] = sorted(best.get(row, []) + mine)[:k]
        flat = [(row, None if none else doc, -score) for row, found in best.items() for score, none, doc in found]
        yield {"row": [x[0] for x in flat], "doc": [x[1] for x in flat], "score": [x[2] for x in flat]}

    return map_batches(index.shards, run, "row bigint, doc bigint, score bigint", rows=1)
