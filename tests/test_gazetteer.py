"""Places by a table of names: the first in order, then its own first, whatever the size of the table's blocks."""

import random

import pytest

from siftwell.functions.cells import cells_of
from siftwell.operators import addresses, gazetteer
from pyspark.sql import functions as F


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_places_of_random_tables(spark, block_bytes):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abİIi") for _ in range(r.randint(1, 4)))
    outers = [(i, word(), None, r.randint(0, 5)) for i in range(12)] + [(50, None, None, 0), (51, "", None, 0)]
    inners = [(100 + i, word(), r.randrange(14), r.choice([None, 1, 2])) for i in range(40)]
    big = (1 << 62) + 1  # numbers that floating point does not hold
    outers, inners = [(i + big, *x) for i, *x in outers], [(i, n, o + big, k) for i, n, o, k in inners]
    texts = [(i, None if i % 9 == 0 else " ".join(word() for _ in range(r.randint(0, 6))).upper()) for i in range(80)]
    names = spark.createDataFrame(outers + inners, "id long, name string, outer_id long, rank long")
    df = spark.createDataFrame(texts, "k long, text string").withColumn("id", F.lit("x"))
    lower = {row[0]: row[1] for row in spark.createDataFrame([(x[1],) for x in outers + inners if x[1]] + [(t[1],) for t in texts if t[1]], "v string").distinct().select("v", F.lower("v")).collect()}

    def first(text, among):
        held = [(2**63 if rank is None else rank, i, name) for i, name, _, rank in among if name and text is not None and lower[name] in lower.get(text, "")]
        return min(held, default=(None, None, None))

    for row in gazetteer.places(df, "text", names, block_bytes).collect():
        text = dict(texts)[row["k"]] or None
        _, outer, outer_name = first(text, outers)
        inner_name = None if outer is None else first(text, [x for x in inners if x[2] == outer])[2]
        assert (row["place"]["outer"], row["place"]["inner"], row["id"]) == (outer_name, inner_name, "x")


def test_the_built_in_table_and_the_same_as_a_table(spark):
    rows, at = [], 0
    for i, (p, inner) in enumerate(addresses.PROVINCES.items()):
        rows.append((at, p, None, i))
        rows += [(at + 1 + j, d, at, j) for j, d in enumerate(inner)]
        at += 1 + len(inner)
    names = spark.createDataFrame(rows, "id long, name string, outer_id long, rank long")
    texts = [("Kadıköy - İstanbul - Türkiye",), ("Somewhere in İzmir",), ("nowhere",), (None,), ("Çankaya, Ankara",), ("",)]
    df = gazetteer.places(spark.createDataFrame(texts, "raw string"), "raw", names)
    both = cells_of(cells_of(df, F.col("raw"), addresses.cleaner(), "a"), F.col("raw"), addresses.cleaner(place=F.col("place")), "b").select("a", "b").collect()
    assert all(r["a"] == r["b"] for r in both) and len({r["a"]["method"] for r in both}) >= 3


def test_no_names(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert gazetteer.places(df, "t", spark.createDataFrame([], "id long, name string, outer_id long, rank long")).first()["place"] == (None, None)


@pytest.mark.parametrize("share_bytes", [1 << 20, 300])
def test_of_a_large_level_no_worker_holds_more_than_a_group(spark, monkeypatch, share_bytes):
    """Names beyond a block are not broadcast, block after block, to stay in every worker; texts of one outer name are dealt to shares."""
    outers = [(i, f"place{i}", None, -i) for i in range(9)]
    inners = [(100 + i, f"part{i}", i % 2, i) for i in range(60)]
    names = spark.createDataFrame(outers + inners, "id long, name string, outer_id long, rank long")
    texts = [(i, f"Place0 and place1, PART{i % 60}.") for i in range(120)] + [(120, "nothing"), (121, None)]
    monkeypatch.setattr(gazetteer, "_Names", None)
    got = {r["k"]: tuple(r["place"]) for r in gazetteer.places(spark.createDataFrame(texts, "k long, text string"), "text", names, 200, **({} if share_bytes > 300 else {"share_bytes": share_bytes})).collect()}
    part = lambda i: next((f"part{j}" for j in (i // 10, i) if j % 2 and (j < 10 or j == i)), None)  # noqa: E731  part5 is in part57
    assert len(got) == 122 and got[120] == got[121] == (None, None)
    assert all(got[i] == ("place1", part(i % 60) if i % 60 >= 10 else (f"part{i % 60}" if i % 2 else None)) for i in range(120))
