import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import ann, decontamination, simhash
from framelake.llm._graph import components


def naive_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {d: naive_print(t) for d, t in rows}
    ids = sorted(d for d in prints if d is not None)
    want = closure(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = simhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % (1 << 64) == prints[r.doc_id]
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]


def test_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "h i j k l m n o p"), (3, "h i j k l m n o p"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert sorted(r.doc_id for r in simhash.keep_one(spark, df).collect()) == [1, 4]


def test_no_documents(spark, no_docs):
    assert simhash.near_duplicates(spark, no_docs).count() == 0
    assert simhash.keep_one(spark, no_docs).count() == 0


@pytest.mark.parametrize("distance", [0, 2, 4, 6])
def test_links_against_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    prints = set(rng.integers(0, 1 << 63, 300).tolist())
    for base in rng.integers(0, 1 << 63, 25).tolist():  # clusters, one of which fills its cells
        for _ in range(250 if base % 5 == 0 else 12):
            x = base
            for b in rng.choice(63, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    nodes = dict(enumerate(sorted(prints)))
    want = closure(nodes, [(a, b) for (a, x), (b, y) in itertools.combinations(nodes.items(), 2) if (x ^ y).bit_count() <= distance])
    edges = simhash.links(spark.createDataFrame(list(nodes.items()), "node long, fp long"), distance).collect()
    assert closure(nodes, [(r.a, r.b) for r in edges]) == want


def test_components_of_chains(spark):
    rng = random.Random(2)
    order = list(range(200))
    rng.shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(1000, 1001), (1001, 1002), (5000, 5000)] + [(300, n) for n in range(301, 400)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 1000: 1000, 1001: 1000, 1002: 1000, **dict.fromkeys(range(300, 400), 300)}


ITEM = "the quick brown fox jumps over a lazy dog while seven small birds sing about rain and distant hills at dawn"


def contaminated(rng, text, changes):
    words = text.split()
    for k in rng.sample(range(len(words)), changes):
        words[k] = "zz%d" % k
    return " ".join(words)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_overlaps(spark, docs, broadcast):
    rng = random.Random(1)
    noise = lambda n: " ".join("w%d" % rng.randint(0, 5000) for _ in range(n))
    other = " ".join("item%d" % k for k in range(40))
    rows = [(0, f"{noise(50)} {ITEM.upper()}! {noise(50)}"), (1, f"{noise(9)} {contaminated(rng, ITEM, 2)}"), (2, noise(500)), (3, other), (4, f"{ITEM} {noise(30)} {other}"), (5, " ".join(ITEM.split()[:6])), (4, f"{ITEM} {noise(30)} {other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    items = spark.createDataFrame([(7, ITEM, "x"), (8, other, "x"), (9, None, "x"), (10, "", "x"), (11, "two words", "x"), (None, ITEM, "x")], "item_id long, text string, doc_id string")
    got = decontamination.overlaps(spark, df, items, broadcast_tokens=broadcast).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 7), (1, 7), (3, 8), (4, 7), (4, 8)}
    best = {(r.doc_id, r.item_id): r for r in got}
    assert (best[0, 7].doc_start, best[0, 7].n_matched) == (50, len(ITEM.split()))
    assert best[1, 7].n_matched >= 13
    kept = decontamination.remove(spark, df, items)
    assert sorted(r.doc_id for r in kept.where("doc_id < 100").collect()) == [2, 5]
    assert kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_no_items(spark, docs, no_docs, broadcast):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlaps(spark, docs, items, broadcast_tokens=broadcast).count() == 0
    assert decontamination.overlaps(spark, no_docs, spark.createDataFrame([(1, ITEM)], items.schema), broadcast_tokens=broadcast).count() == 0


def test_shuffled_as_broadcast(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    a, b = (sorted(decontamination.overlaps(spark, docs, items, broadcast_tokens=n).collect()) for n in (2_000_000, 0))
    assert a == b and a


def nearest_of(rows, top=5):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    ids = sorted(usable)
    x = np.array([usable[i] for i in ids], dtype=float)
    out = {}
    for k, i in enumerate(ids):
        if i % 50 == 0:
            s = ann._exact(x[k], x)
            out[i] = [(ids[j], s[j]) for j in sorted((j for j in range(len(ids)) if j != k), key=lambda j: (-s[j], ids[j]))][:top]
    return out


def test_nearest_with_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 260)]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan"), 1.0, 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, [1.0]), (None, [1.0] * 4), (7, rng.normal(size=4).tolist()), (8, rows[8][1]), (350, [1e-200] * 4), (400, [1e200, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, rank string, cell int")
    got = {}
    for r in sorted(ann.nearest(spark, df, F.col("vec_id") % 50 == 0, gather=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == nearest_of(rows)


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in ann.nearest(spark, df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert ann.nearest(spark, df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(spark, df.where("false"), F.col("vec_id") == 0).count() == 0


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.flatnonzero(ids % 50 == 0)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -9
    want = {(int(ids[q]), int(ids[j])) for q, row in zip(queries, np.argsort(-s, axis=1)[:, :5], strict=True) for j in row}
    got = {(r.query_id, r.vec_id) for r in ann.nearest(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_walk_is_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    sums = [a[i] + b[j] for i, j in ann.walk(a, b)]
    assert len(sums) == 35 and sums == sorted(sums)
