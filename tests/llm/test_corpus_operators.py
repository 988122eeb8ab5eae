"""Operators over whole corpora: joins, packing, search and order, held against brute force, with odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from siftwell.llm import additive_quantization, components, ngram_jaccard_join, packing, queries, training_order
from siftwell.llm.tokens import document_ids, encoder

SF = "/root/testdata/sf0.01"


def brute_links(rows, n=5, threshold=0.8):
    """class and number of links of every id, by an inverted index."""
    sets, links, parent, index = {}, Counter(), {}, defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in index[g])
        for j, k in shared.items():
            if k >= threshold * (len(sets[i]) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            index[g].append(i)
    return {i: (find(i), links[i]) for i in sets}


def as_dict(found):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found.collect()}


def test_op4_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert as_dict(queries.op4_ngram_jaccard_join(spark, SF)) == brute_links(rows)


@pytest.mark.parametrize("bucket, depth, tile, diff_tile, few, held", [(64, 3, 512, 1024, 10**6, 2_000_000), (4, 2, 16, 40, 10**6, 2_000_000), (8, 3, 30, 1024, 0, 2_000_000), (64, 3, 512, 1024, 10**6, 700)])
def test_join_of_large_groups(spark, bucket, depth, tile, diff_tile, few, held):
    """Near copies beyond a bucket and a tile, exact copies, and a passage that unlike documents share."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(base)) for i in range(30)]
    rows += [(len(rows) + i, " ".join(passage + [word() for _ in range(100)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_dict(ngram_jaccard_join.classes(df, id_col="doc_id", text_col="text", bucket=bucket, depth=depth, tile=tile, diff_tile=diff_tile, broadcast_rows=few, held_grams=held))
    want = brute_links(rows)
    assert got.keys() == want.keys() and all(got[i] == want[i] for i in want if want[i][1] == 0)
    assert sum(g[1] for g in got.values()) >= 0.999 * sum(w[1] for w in want.values()) and all(got[i][1] <= want[i][1] for i in want)
    assert {got[i][0] for i in range(150)} == {want[i][0] for i in range(150)}


def test_a_group_of_thousands_of_near_copies(spark):
    """Every link of some 3,000 near copies; what is handed on for verification is a difference, not a text, for every tile."""
    m, width, r = 3300, 80, np.random.default_rng(6)
    w = np.tile(np.arange(width), (m, 1))
    for i in range(m):
        at = r.choice(width, r.integers(0, 4), replace=False)
        w[i, at] = width + r.integers(0, 500, len(at))
    w = np.unique(w, axis=0)[r.permutation(len(np.unique(w, axis=0)))]
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(w)], "doc_id long, text string").repartition(8)
    got = as_dict(ngram_jaccard_join.classes(df, id_col="doc_id", text_col="text"))
    links, classes = np.zeros(len(w), int), np.arange(len(w))
    for i in range(len(w)):
        same = w == w[i]
        both = (same[:, :-4] & same[:, 1:-3] & same[:, 2:-2] & same[:, 3:-1] & same[:, 4:]).sum(1)
        linked = both >= 0.8 * (2 * (width - 4) - both) - 1e-9
        links[i] = linked.sum() - 1
        if (c := classes[linked]).min() != c.max():
            classes[np.isin(classes, c)] = c.min()
    assert len(w) > 1024 and got == dict(enumerate(zip(classes.tolist(), links.tolist())))


def test_join_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a b"), (6, "a c"), (None, "a b"), (7, "x " * 30_000), (8, "x " * 20_000), (9, "p q r s t u"), (9, "p q r s t u"), (10, "P q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as class_id", "3 as node", "4 as digest")
    got = as_dict(ngram_jaccard_join.classes(df, id_col="doc_id", text_col="text"))
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 1), 8: (7, 1), 9: (9, 0), 10: (10, 0)}
    kept = ngram_jaccard_join.without_duplicates(df, id_col="doc_id", text_col="text")
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 10] and kept.columns == df.columns
    assert as_dict(ngram_jaccard_join.classes(df.limit(0), id_col="doc_id", text_col="text")) == {}


def test_every_text_of_a_repeated_id_is_verified(spark):
    """Two texts of one id whose smallest eight grams and number of grams agree: links of either are found."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    grams = lambda w: ngram_jaccard_join.shingles(" ".join(w), 5, ngram_jaccard_join._WordHashes())
    change = lambda w, i: [*w[:i], word(), *w[i + 1 :]]
    one = [word() for _ in range(60)]
    other = next(x for x in (change(one, r.randrange(5, 31)) for _ in range(1000)) if (grams(x)[:8] == grams(one)[:8]).all() and len(grams(x)) == len(grams(one)))
    rows = [(i, " ".join(w)) for i, w in [(1, one), (1, other), (2, change(other, 40)), (3, change(one, 50))]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(ngram_jaccard_join.classes(df, id_col="doc_id", text_col="text")) == {1: (1, 2), 2: (1, 1), 3: (1, 1)}


def test_rows_with_one_id_and_unlike_texts_stay(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (5, c), (7, c + "end"), (8, None), (8, None), (8, ""), (None, a), (-3, "one text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "2 as class_id", "3 as digest").repartition(4)
    kept = ngram_jaccard_join.without_duplicates(df, id_col="doc_id", text_col="text")
    assert kept.columns == df.columns
    want = [(1, a), (5, b), (5, c), (8, None), (8, ""), (None, a), (-3, "one text")]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)


def test_survival_falls_with_depth():
    s = [ngram_jaccard_join.survival(0.8, d) for d in range(5)]
    assert s[0] == 1 and all(a > b for a, b in zip(s, s[1:])) and abs(s[1] - 0.84) < 0.01


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 7000), (7000, 6999), (5, 5), (200, 201), (201, 200)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long"), a="a", b="b", most_edges=70, few=few).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 7000: 100, 6999: 100, 200: 200, 201: 200}


# 5: packing


def test_best_fit():
    placed, fill = packing.best_fit([600, 424, 700, 324, 1024, 1, 1], 1024)
    assert sorted(fill) == [2, 1024, 1024, 1024] and placed[0][0] == placed[1][0] and placed[2][0] == placed[3][0]
    assert packing.best_fit([], 8) == ([], [])
    assert packing.pieces(5, 8) == [(0, 5)] and packing.pieces(8, 8) == [(0, 8)] and packing.pieces(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.pieces(16, 8) == [(0, 8), (8, 8)]


def held(rows, capacity=1024):
    """Checks that sequences are gapless and not too long; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op5(spark):
    from tokenizers import Tokenizer

    rows = queries.op5_best_fit_packing(spark, SF).collect()
    count, tokens = held(rows), sum(r["length"] for r in rows)
    assert count <= -(-tokens // 1024) + 2
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert by.keys() == {d for d, _ in docs}
    for doc_id, text in docs[::7]:
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for n, r in enumerate(sorted(by[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == 1024) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_over_many_partitions(spark):
    """The tree merges what partitions leave over, in one round or several; odd rows."""
    rows = [(i, "word " * (i * 37 % 700)) for i in range(300)] + [(7, "twice"), (7, "twice"), (8, None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as bin", "3 as offset").repartition(40)
    for options in ({}, {"fan_in": 3}, {"fan_in": 2, "slack": 100, "at_once": 1}):
        got = packing.pack(df, id_col="doc_id", text_col="text", vocabulary=P.path("byte_bpe_50k.json"), pattern=P.PATTERN, **options).collect()
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in rows)
        count = held(got)
        assert "slack" in options or count <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert packing.pack(df.limit(0), id_col="doc_id", text_col="text", vocabulary=P.path("byte_bpe_50k.json"), pattern=P.PATTERN).count() == 0


def test_bulk_plan_equals_best_fit():
    r = random.Random(4)
    for n in [0, 1, 2, 5, 50, 3000]:
        for sizes in ([r.randint(1, 100) for _ in range(n)], [r.choice([60, 40, 35, 7]) for _ in range(n)], [r.choice([100, 51, 1]) for _ in range(n)]):
            runs, bins, _ = packing.plan(Counter(sizes), 100)
            assert bins == len(packing.best_fit(sizes, 100)[1])
            rows = []
            for size, count in Counter(sizes).items():
                for (start, first, each, offset), end in zip(runs[size], [x[0] for x in runs[size][1:]] + [count]):
                    rows += [{"sequence_id": first + j // each, "offset": offset + j % each * size, "length": size} for j in range(end - start)]
            assert len(rows) == n and held(rows, 100) == bins


def test_steps_of_a_round_say_how_full_every_bin_becomes():
    r = random.Random(8)
    for sizes in ([r.randint(1, 94) for _ in range(2000)], [r.choice([60, 40, 35, 7]) for _ in range(500)], [60] * 9, [31] * 10, [50, 50], []):
        counts, fills, said = Counter(sizes), Counter(), {}
        for size, cut in packing.steps(counts, 100, 95).items():
            for (item, first, each, offset, fill, number), end in zip(cut, [x[0] for x in cut[1:]] + [counts[size]]):
                for j in range(end - item):
                    b = first + j // each
                    fills[b] += size
                    assert said.setdefault(b, (fill, number + j // each if fill else None)) == (fill, number + j // each if fill else None)
        assert fills.total() == sum(sizes) and len(fills) == packing.plan(counts, 100)[1]
        assert all(said[b][0] == (f if f < 95 else 0) for b, f in fills.items())
        for fill in {f for f in fills.values() if f < 95}:
            assert sorted(n for f, n in said.values() if f == fill) == list(range(sum(f == fill for f in fills.values())))


def test_rounds_pack_underfull_bins_as_items(spark, monkeypatch):
    """One bin a partition; bins that fill each other are siblings, or meet in a later round, and come out where they meet."""
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    options = {"id_col": "doc_id", "text_col": "text", "vocabulary": P.path("byte_bpe_50k.json"), "pattern": P.PATTERN, "fan_in": 2}
    for lengths, level in ([600, 420] * 4, 1), ([600, 1022, 420, 1022] * 2, 2), ([600, 1022, 1022, 1022, 420, 1022, 1022, 1022], 3):
        df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate("word " * n for n in lengths)), len(lengths)), "doc_id long, text string")
        got = packing.pack(df, **options).collect()
        assert held(got) == sum(n + 2 for n in lengths) // 1024
        assert {(r["length"], r["sequence_id"] >> packing.ROUND_BITS) for r in got} == {(n + 2, level if n < 1000 else 0) for n in lengths}


def test_no_bin_is_closed_because_there_are_many(spark):
    """Two kinds of partitions that fill each other's bins only when these are opened."""
    rows = [(i, "word " * (600 if i < 200 else 400)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id").repartitionByRange(8, "doc_id")
    got = packing.pack(df, id_col="doc_id", text_col="text", vocabulary=P.path("byte_bpe_50k.json"), pattern=P.PATTERN, fan_in=2).collect()
    assert len(got) == 400 and held(got) == 200


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode, r = encoder(P.path("byte_bpe_50k.json"), P.PATTERN, added_tokens=True), random.Random(2)
    letters = [*"abcd eé日本\n\t  123'sll½²\x1c\x85\xa0٣\U0001f600_-!", "<|endoftext|>", "<|endof", "text|>"]
    for text in ["".join(r.choice(letters) for _ in range(n)) for n in range(300)] + ["<|endoftext|>", "", "a" * 5000]:
        assert document_ids(encode, text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_added_tokens_are_recognised_as_by_the_library(spark, tmp_path):
    """Under the library's defaults: in the encoder, in what is packed and in the shards."""
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(7)
    parts = ["<|endoftext|>", "a ", " b", "  ", "\n\n", "<|endof", "text|>", "<|", "|>", "é", " 日本"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  y", *("".join(r.choices(parts, k=n)) for n in range(100)), "word " * 1500 + "<|endoftext|>"]
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert want[0] == [64, 220, 50256, 275, 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    options = {"id_col": "doc_id", "text_col": "text", "vocabulary": P.path("byte_bpe_50k.json"), "pattern": P.PATTERN}
    got = packing.pack(df, **options).collect()
    assert Counter(i for r in got for i in [r["doc_id"]] * r["length"]) == Counter({i: len(x) for i, x in enumerate(want)})
    assert all(r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] :][: r["length"]], "<u4").tobytes()) for r in got)
    out = f"file://{tmp_path}/order"
    made = training_order.materialise_order(df, out, key="k", **options).orderBy("slot").collect()
    read = [x[: r["n_tokens"]].tolist() for r, x in zip(made, training_order.read_slots(out, 0))]
    assert Counter(i for x in read for i in x) == Counter(i for x in want for i in x)
    encode = encoder(P.path("byte_bpe_50k.json"), P.PATTERN, added_tokens=True)
    assert [document_ids(encode, x).tolist() for x in texts] == want


# 9: training order


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(size):
    numbers = np.arange(size)
    slots = training_order.permute(numbers, size, "k")
    assert sorted(slots) == list(range(size)) and (training_order.unpermute(slots, size, "k") == numbers).all()
    if size > 100:
        assert (slots != training_order.permute(numbers, size, "other")).mean() > 0.9 and abs(np.corrcoef(numbers, slots)[0, 1]) < 0.15


@pytest.mark.parametrize("most_tasks", [20_000, 4])
def test_shards_hold_all_tokens_in_order(spark, tmp_path, most_tasks):
    out = f"file://{tmp_path}/order"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_000, None), (10_001, ""), (None, "no id"), (0, "again")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more).selectExpr("*", "1 as slot", "2 as tokens", "3 as id").repartition(5)
    made = training_order.materialise_order(rows, out, id_col="doc_id", text_col="text", vocabulary=P.path("byte_bpe_50k.json"), pattern=P.PATTERN, key="k", shard_sequences=100, most_tasks=most_tasks).orderBy("slot").collect()
    assert [r["slot"] for r in made] == list(range(len(made)))
    read = list(training_order.read_slots(out, 0, shard_sequences=100))
    assert len(read) == len(made) and all(zlib.crc32(x.tobytes()) == r["tokens_crc32"] and r["byte_offset"] == r["slot"] % 100 * 2048 and r["shard"] == r["slot"] // 100 for x, r in zip(read, made))
    resumed = list(training_order.read_slots(out, 137, shard_sequences=100, last=333))
    assert len(resumed) == 196 and all((a == b).all() for a, b in zip(resumed, read[137:333]))
    encode = encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    want = Counter(x for r in rows.select("text").collect() for x in document_ids(encode, r[0]).tolist())
    assert Counter(t for x, r in zip(read, made) for t in x[: r["n_tokens"]].tolist()) == want
    owners = Counter(i for r in made for i in set(r["doc_ids"]))
    assert set(owners) == {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert len(list((tmp_path / "order").glob("shard-*.bin"))) == -(-len(made) // 100) and not list((tmp_path / "order").glob("**/.shard-*"))


def test_order_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert training_order.materialise_order(df, f"file://{tmp_path}/o", id_col="doc_id", text_col="text", vocabulary=P.path("byte_bpe_50k.json"), pattern=P.PATTERN, key="k").count() == 0


def test_op9(spark):
    """Every manifest row against sequences cut and placed one by one, partition by partition."""
    made = {r["slot"]: r for r in queries.op9_training_order(spark, SF).collect()}
    encode, numbered = encoder(P.path("byte_bpe_50k.json"), P.PATTERN, added_tokens=True), []
    parts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.spark_partition_id().alias("p")).collect()
    for p in sorted({r["p"] for r in parts}):
        stream = [(t, r["doc_id"]) for r in parts if r["p"] == p for t in document_ids(encode, r["text"]).tolist()]
        numbered += [stream[i : i + 1024] for i in range(0, len(stream), 1024)]
    slots = training_order.permute(np.arange(len(numbered)), len(numbered), "epoch-0").tolist()
    assert sorted(made) == sorted(slots)
    for slot, sequence in zip(slots, numbered):
        r, tokens = made[slot], np.zeros(1024, "<u2")
        tokens[: len(sequence)] = [t for t, _ in sequence]
        assert (r["shard"], r["byte_offset"], r["n_tokens"], r["tokens_crc32"]) == (slot // 8192, slot % 8192 * 2048, len(sequence), zlib.crc32(tokens.tobytes()))
        assert r["doc_ids"] == list(dict.fromkeys(d for _, d in sequence))


# 3: nearest neighbours


def exact(rows, k=20):
    ids, a = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.where(ids % 20 == 0)[0]:
        s = a @ a[i]
        order = np.lexsort((ids, -s))
        out[ids[i]] = [(ids[j], s[j]) for j in order if j != i][:k]
    return out


def nearest(found):
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r[0]].append((r[2], r[3], r[1]))
    return got


def recall(got, want):
    """Checks ranks, order and scores; the share of the true neighbours that were found."""
    assert got.keys() == want.keys()
    for q in want:
        assert [x[2] for x in got[q]] == list(range(1, 21)) and [(-x[1], x[0]) for x in got[q]] == sorted((-x[1], x[0]) for x in got[q])
        truth = dict(want[q])
        assert all(abs(s - truth[v]) < 1e-12 for v, s, _ in got[q] if v in truth)
    return np.mean([len({x[0] for x in got[q]} & {x[0] for x in want[q]}) / 20 for q in want])


@pytest.mark.parametrize("name, rerank", [("sf0.01", 100), ("sf0.1", 300)])
def test_recall(spark, name, rerank):
    """With far fewer codes rescored than there are."""
    df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    want = exact(df.select("vec_id", "embedding").collect())
    assert recall(nearest(additive_quantization.search(df, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, rerank=rerank, code_block=4096, query_block=300)), want) > 0.9


def test_recall_on_many_vectors(spark):
    """The query's own parameters on 20,000 generated vectors of 64 components in clusters; a fortieth of the queries."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(200, 64))
    a = (centres[r.integers(0, 200, 20_000)] + 0.7 * r.normal(size=(20_000, 64))).round(4)
    df = spark.createDataFrame(list(enumerate(a.tolist())), "vec_id long, embedding array<double>")
    queries = range(0, 20_000, 800)
    got = nearest(additive_quantization.search(df, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 800 == 0))
    want = {}
    for q in queries:
        s = a @ a[q]
        want[q] = [(i, s[i]) for i in np.lexsort((np.arange(20_000), -s)) if i != q][:20]
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("kind", ["double", "float"])
def test_an_id_with_vectors_of_two_lengths(spark, kind):
    r = random.Random(4)
    good = [(i, [round(r.gauss(0, 1), 3) for _ in range(4)]) for i in range(30)]
    rows = good + [(0, [9.0]), (3, [-9.0]), (5, [9.0, 9.0]), (7, [9.0] * 9)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = nearest(additive_quantization.search(df, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, levels=4, size=8))
    want = exact([(i, np.array(v, np.float32 if kind == "float" else float).astype(float)) for i, v in good])
    assert {q: [x[:2] for x in got[q]] for q in got} == {q: [(i, pytest.approx(s)) for i, s in want[q]] for q in want}


def test_vectors_that_take_no_part(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(25)] + [(40, [0.0] * 4), (41, None), (42, [1.0, None, 0.0, 0.0]), (43, [float("nan"), 1.0, 1.0, 1.0]), (44, [float("inf"), 1.0, 1.0, 1.0]), (60, [1.0, 2.0]), (None, [1.0] * 4), (80, []), (21, [1.0, 1.0, 1.0, 1.0]), (22, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([x for x in rows if x[0] not in (21, 22) or x[1] == [1.0] * 4], "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as rank", "4 as score")
    got = nearest(additive_quantization.search(df, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, levels=4, size=8))
    fine = {i for i in range(25)}
    assert got.keys() == {0, 20} and all({x[0] for x in got[q]} <= fine - {q} and len(got[q]) == 20 for q in got)
    few = nearest(additive_quantization.search(df.where("vec_id < 4"), id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, levels=2, size=4))
    assert {x[0] for x in few[0]} == {1, 2, 3}
    tied = nearest(additive_quantization.search(df.where("vec_id in (0, 21, 22)"), id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, levels=2, size=4))
    assert [x[0] for x in tied[0]] == [21, 22]
    assert additive_quantization.search(df.limit(0), id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0).count() == 0


def test_every_row_of_an_id_is_a_candidate(spark):
    rows = [(1, [5.0, 0.0]), (1, [-5.0, 0.0]), (2, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in additive_quantization.search(df, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, levels=2, size=4).collect())
    first = [(20, 1, 1, 5.0), (20, 2, 2, 1.0), (20, 3, 2, 1.0), (20, 4, 20, 0.0), (20, 5, 1, -5.0)]
    second = [(20, 1, 1, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 2, 0.0), (20, 5, 20, 0.0)]
    assert got == sorted(first + second)


def test_euclidean(spark):
    r = np.random.default_rng(0)
    a = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "vec_id long, embedding array<double>")
    got = nearest(additive_quantization.search(df, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, measure="euclidean", levels=8, size=32, k=5))
    for q, found in got.items():
        d = ((a - a[q]) ** 2).sum(1)
        assert [x[0] for x in found] == [i for i in np.argsort(d) if i != q][:5]


@pytest.mark.parametrize("code_block", [1 << 20, 400])
def test_copies_and_near_copies_beyond_the_rerank(spark, code_block):
    """Ties of equal vectors go to the smallest ids however many there are; near copies with one code are all rescored."""
    r = np.random.default_rng(3)
    a = r.normal(size=(1800, 8))
    a[300:900] = a[300]
    a[900:1500] = 2 * a[300] + np.arange(600)[:, None] * 1e-6
    ids = r.permutation(1800)
    rows = [(int(i), x.tolist()) for i, x in zip(ids, a)]
    want = exact(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(additive_quantization.search(df, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, levels=4, size=16, rerank=50, code_block=code_block, query_block=30))
    assert got.keys() == want.keys()
    for q in ids[300:1500][ids[300:1500] % 20 == 0]:
        assert [x[0] for x in got[q]] == [x[0] for x in want[q]]
    tied = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(700)], "vec_id long, embedding array<double>")
    got = nearest(additive_quantization.search(tied, id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0, levels=2, size=4, rerank=50, code_block=code_block))
    assert len(got) == 35 and all([x[0] for x in got[q]] == [i for i in range(21) if i != q][:20] for q in got)


# The pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(5000, None, "en", "s", 0), (5001, "12 34 ###", "en", "s", 9), (5002, docs.where("doc_id = 6").first()["text"], "en", "s", 5)], docs.schema)
    now = docs.unionByName(odd)
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, now, SF).persist()
        counts.append(now.count())
        assert now.columns == docs.columns and now.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
        if name == "language id":
            assert now.where("doc_id in (5000, 5001)").count() == 0 and counts[1] >= counts[0] - 10
        if name == "quality classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            kept = {r[0]: r[1] for r in before.join(labels, "doc_id").join(now.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0)))).collect()}
            assert kept[1] > 0.95 and kept[0] < 0.2
        if name == "n-gram jaccard join":
            want = brute_links([tuple(r) for r in before.select("doc_id", "text").collect()])
            assert {r[0] for r in now.select("doc_id").collect()} == {i for i, (c, _) in want.items() if c == i}
            assert now.where("doc_id = 5002").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    held(packed)
    assert {r["doc_id"] for r in packed} == {r[0] for r in now.select("doc_id").collect()}
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())


def test_a_column_of_any_name_stays(spark):
    """Where ids repeat, rows are numbered in a column of a name that the table has not."""
    rows = [(7, "one two three four five six", "keep1", "a"), (7, "one two three four five six", "keep2", "b"), (7, "other words that are not the same here", "keep3", "c"), (9, "one two three four five six", "keep4", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string, row string").selectExpr("*", "'x' as _row_", "'i' as id", "'d' as digest")
    kept = ngram_jaccard_join.without_duplicates(df, id_col="doc_id", text_col="text")
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"][:3], r["_row_"]) for r in kept.collect()) == [(7, "one", "x"), (7, "oth", "x")]
    assert {r["_row"] for r in kept.collect()} <= {"keep1", "keep2", "keep3"} and {(r["_row"], r["row"]) for r in kept.collect()} <= {x[2:] for x in rows}


def test_pipeline_of_odd_tables(spark):
    """Extra columns whose names the operators use themselves, null rows, and no row at all."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, docs.first()["text"], None, None, None), (7, "", "en", "s", 0)], docs.schema)
    extra = docs.unionByName(odd).selectExpr("*", "'i' as id", "2 as class_id", "3 as digest", "array(1) as score", "'r' as rep", "5 as piece")
    for now, some in ((extra, True), (extra.limit(0), False)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "/root/testdata/sf0.001").persist()
            assert now.columns == extra.columns and (now.count() > 0) == some, name
            assert now.where("text is null or text = ''").count() == 0, name
        packed = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}
