"""Hard negatives, ranked lexical search and near-duplicate vectors, held against brute force, with odd rows."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from siftwell.llm import euclidean_hashing, lexical_search, norm_bucket_mining, queries

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_norm_bucket_mining", "op12_lexical_search", "op13_euclidean_hashing"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


# 11: hard negatives


def negatives(rows, every, scale=256):
    """By sorting all rows for every anchor; in whole numbers of any size."""
    fine = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, anchor in enumerate(fine):
        if anchor[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(anchor[2], c[2])), c[0], c[1]) for b, c in enumerate(fine) if a != b and len(c[2]) == len(anchor[2]))
        for s, p, _ in [x for x in scored if x[2] == anchor[1]][:5]:
            kept = [(n, t) for t, n, label in scored if label != anchor[1] and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(anchor[0], p, k + 1, n, -s, -t) for k, (n, t) in enumerate(kept)]
    return sorted(out)


def mined(spark, rows, every=5, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as row", "2 as bucket", "3 as norm", "4 as id", "5 as v", "6 as block")
    found = norm_bucket_mining.mine(df, id_col="vec_id", vector_col="embedding", label_col="label", is_anchor=lambda i: i % every == 0, **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("bucket, query_block", [(1 << 17, 8192), (50, 7)])
def test_negatives_of_unlike_norms(spark, monkeypatch, bucket, query_block):
    """Norms over three orders, a hot vector under many ids, ties, and rows that take no part; runs and buckets of few rows."""
    monkeypatch.setattr(norm_bucket_mining, "RUN", 40)
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=6) * 10 ** r.uniform(-1, 2)).tolist(), int(r.integers(0, 4))) for i in range(400)]
    rows += [(400 + i, [1.0, 2.0, 3.0, 1.0, 0.0, 1.0], i % 3) for i in range(200)]
    rows += [(5, [1.0] * 6, 1), (605, None, 1), (610, [NAN] * 6, 1), (615, [INF] + [0.0] * 5, 1), (620, [1.0, None] + [0.0] * 4, 1), (625, [1.0] * 6, None), (None, [1.0] * 6, 1), (630, [0.0] * 6, 1), (635, [], 2), (640, [2.0, 1.0], 2), (641, [2.0, 1.0], 2), (642, [1.0, 1.0], 1)]
    got = mined(spark, rows, bucket=bucket, query_block=query_block)
    assert len(got) > 300 and got == negatives(rows, 5)


def test_negatives_of_huge_components(spark):
    """Sums beyond 2^53 are exact; beyond 64 bits they are an error."""
    r = random.Random(3)
    rows = [(i, [float(r.randrange(1 << 20)) for _ in range(8)], i % 2) for i in range(60)]
    want = negatives(rows, 5)
    assert max(x[4] for x in want) > 1 << 53 and mined(spark, rows) == want
    with pytest.raises(Exception, match="(?i)overflow|too large|int64|convert"):
        mined(spark, [(i, [1e300, 1e300], i % 2) for i in range(12)])


def test_negatives_of_little(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []  # no positive
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []  # no negative
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2)]) == []  # below 0 the window is empty
    assert mined(spark, [(0, [0.0], 1), (1, [3.0], 1), (2, [1.0], 2), (3, [2.0], 2)]) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]


# 12: ranked lexical search


def ranked(docs, items, k=50):
    terms = lambda t: lexical_search.terms_of(t)
    kept = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, total = len(kept), sum(len(t) for _, t in kept)
    df = Counter(t for _, words in kept for t in set(words))
    out = []
    for item, text in items:
        found = []
        for d, words in kept:
            tf, m = Counter(words), 50 + 50 * len(words) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=50, shard_terms=2_000_000, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as docs", "3 as terms", "'x' as places").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as row", "2 as item", "3 as doc", "4 as score", "5 as rank")
    index = lexical_search.build(d, id_col="doc_id", text_col="text", shard_terms=shard_terms)
    return sorted((tuple(r) for r in lexical_search.search(i, index, item_col="item_id", text_col="text", k=k, **options).collect()), key=repr)


def test_terms():
    assert lexical_search.terms_of("Ab-c_d\x00É ÉA\x7f9' x") == [b"ab", b"c", b"d", "É".encode(), "Éa".encode(), b"9", " x".encode()]
    assert lexical_search.terms_of(None) == lexical_search.terms_of(" .\n") == []


@pytest.mark.parametrize("shard_terms, items_at_once", [(2_000_000, 2000), (60, 2)])
def test_search_of_odd_texts(spark, shard_terms, items_at_once):
    """Ties by the hundred, repeated and null ids, texts without a term, a very long one; shards and blocks of any size."""
    r = random.Random(4)
    words = ["Cat", "dog", "cat", "é", "ox-ox", "Zebra", "a1", "ÄB"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(150)]
    docs += [(1000 + i, "same words here") for i in range(120)] + [(7, "dog dog"), (7, "dog dog"), (None, "dog zebra"), (500, None), (501, ""), (502, "--- \n"), (503, "zebra " * 20_000 + "rare")]
    items = [(0, "cat DOG"), (1, "same"), (2, "zebra é"), (3, "rare rare"), (4, "unknown"), (5, None), (6, ""), (0, "ox"), (None, "a1"), (8, "äb")]
    got = searched(spark, docs, items, shard_terms=shard_terms, items_at_once=items_at_once)
    assert got == ranked(docs, items) and len([x for x in got if x[0] == 1]) == 50


def test_search_of_nothing(spark):
    assert searched(spark, [], [(0, "a")]) == [] and searched(spark, [(0, "a")], []) == [] and searched(spark, [(0, None)], [(0, "a")]) == []


# 13: near-duplicate vectors


def linked(rows, threshold=0.93):
    """(id, links, component) of every row; all pairs are compared."""
    rows = [x for x in rows if x[0] is not None]
    fine = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit, parent, links = [], list(range(len(rows))), [0] * len(rows)
    for _, v, label in rows:
        x = np.array(v, float) / max(map(abs, v)) if fine(v, label) else None
        unit.append(None if x is None else x / np.sqrt(x @ x))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if unit[i] is not None:
            groups[label, len(v)].append(i)
    for group in groups.values():
        x = np.array([unit[i] for i in group])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            i, j = group[a], group[b]
            links[i], links[j] = links[i] + 1, links[j] + 1
            parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, row in enumerate(rows):
        least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted((row[0], links[i], least[find(i)], row[0] == least[find(i)]) for i, row in enumerate(rows))


def hashed(spark, rows, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as node", "2 as keys", "3 as core", "4 as id", "5 as v", "6 as t")
    return sorted(tuple(r) for r in euclidean_hashing.near_duplicates(df, id_col="vec_id", vector_col="embedding", label_col="label", **options).collect())


def test_collisions():
    """The formula against drawn projections, and the plan's recall."""
    r = np.random.default_rng(0)
    for distance in (0.2, 0.37, 1.4):
        cells = np.floor((np.array([[0.0], [distance]]) * r.normal(size=200_000) + r.uniform(0, 1.5, 200_000)) / 1.5)
        assert abs((cells[0] == cells[1]).mean() - euclidean_hashing.collision(distance, 1.5)) < 0.005
    for rows in (1, 5000, 10**9):
        depth, tables = euclidean_hashing.plan(rows, 0.93, 0.999, 256, 1.5)
        assert 1 - (1 - euclidean_hashing.collision(math.sqrt(0.14), 1.5) ** depth) ** tables >= 0.999


@pytest.mark.parametrize("tile, few", [(512, 200_000), (30, 0)])
def test_links_of_groups(spark, tile, few):
    """A tight group and a loose one beyond a tile, chains, copies and scaled copies, in two labels."""
    r = np.random.default_rng(5)
    base = r.normal(size=(4, 16))
    near = lambda b, n, spread: b + spread * np.linalg.norm(b) / 4 * r.normal(size=(n, 16))
    x = np.concatenate([near(base[0], 300, 0.05), near(base[1], 200, 0.25), near(base[2], 60, 0.4), r.normal(size=(200, 16)), np.repeat(base[3:], 90, 0), base[3] * r.uniform(0.1, 9, (20, 1))])
    ids = r.permutation(len(x))
    rows = [(int(i), v.tolist(), int(k % 7 == 0)) for k, (i, v) in enumerate(zip(ids, x))]
    want, got = linked(rows), hashed(spark, rows, tile=tile, few=few)
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    exact = sum(g == w for g, w in zip(got, want))
    assert exact >= 0.99 * len(want)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is only just enough, among many vectors of one label."""
    r = np.random.default_rng(9)
    a = r.normal(size=(1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = r.normal(size=a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = r.uniform(0.9301, 0.935, (1500, 1))
    rows = [(i, v.tolist(), 3) for i, v in enumerate(np.concatenate([a, cos * a + np.sqrt(1 - cos * cos) * other]))]
    got = hashed(spark, rows)
    assert sum(g[1] for g in got) >= 0.995 * 3000 and max(g[1] for g in got) == 1


@pytest.mark.parametrize("kind", ["double", "float"])
def test_vectors_that_link_with_nothing(spark, kind):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [NAN, 1.0], 1), (8, [1.0, None], 1), (9, [INF, 0.0], 1), (10, [], 1), (11, [1.0], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (13, [1e30, 0.0], 1), (1, [0.0, 1.0], 1), (14, [0.0, 5.0], 1), (5, None, None)]
    assert hashed(spark, rows, kind) == linked(rows)
    assert hashed(spark, []) == []
