import itertools
import random

import numpy as np

import corpus_pipeline
from framelake.llm import near_copies

from .test_search import closure


def five_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, set()).add(five_words(t))
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if any(similar(x, y) for x in sets[a] for y in sets[b])]
    groups = closure(list(sets), linked)
    return sorted(d for d in sets if groups[d] == d)


def families(rng):
    """Texts and edited versions of them, some of similarity just above and below 0.8."""
    out = []
    for n in (12, 60, 200, 400):
        for _ in range(8):
            words = ["w%d" % rng.randint(0, 5000) for _ in range(n)]
            for _ in range(6):
                out.append(list(words))
                for k in rng.sample(range(n), rng.randint(0, max(1, n // 40))):
                    out[-1][k] = "x%d" % rng.randint(0, 5000)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_stage_keeps_one_of_each_group(spark):
    rows = families(random.Random(3))
    df = spark.createDataFrame([*rows, (5000, None), (5001, " "), (5002, rows[0][1].upper()), (5003, rows[1][1]), (5003, "quite another text that nobody else has here"), (5004, "quite another text that nobody else has here")], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df.unionByName(spark.createDataFrame([(None, "no id")], df.schema)), "").collect() if r.doc_id is not None)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_stage_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_keys_meet_at_the_similarity():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 180, dtype=np.int64).astype(np.uint64)
        met += bool((near_copies.band_keys(x[:162]) == near_copies.band_keys(x[18:])).any())  # 144 of 180
    assert met == 300


def test_no_documents(spark, no_docs):
    assert near_copies.keep_one(spark, no_docs).count() == 0


def test_keys_dealt_over_blocks(spark, monkeypatch):
    """Keys that many classes share meet in pairs of blocks; no link is lost."""
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rng = random.Random(9)
    base = ["w%d" % rng.randint(0, 5000) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(0, 9)):
            words[k] = "x%d" % rng.randint(0, 5000)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "row", 1) for i, t in rows], "doc_id long, text string, node string, h int")
    got = near_copies.keep_one(spark, df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_marks_tell_likeness():
    rng = np.random.default_rng(1)
    for n in (50, 180, 2000, 9000):
        for _ in range(100):
            x = rng.permutation(np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)))
            a, b = np.sort(x[: -(n // 10)]), np.sort(x[n // 10 :])  # 8 of 10
            assert near_copies.agreement(near_copies.marks(a), near_copies.marks(b)[None])[0] >= near_copies.LIKELY


def test_row_of_a_repeated_id_is_fixed(spark):
    rows = [(1, "some text of the first row", "a"), (1, "some text of the first row", "b"), (2, "other words altogether in this one", "c")]
    kept = {tuple(sorted((r.doc_id, r.lang) for r in near_copies.keep_one(spark, spark.createDataFrame(rows[::k], "doc_id long, text string, lang string").repartition(3)).collect())) for k in (1, -1)}
    assert len(kept) == 1
