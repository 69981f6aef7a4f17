"""Repeated ids, clashing columns, short items, pieces of texts, and no Python where none may run."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from framelake.llm import bpe, chat, decontamination, line_dedup, quality, simhash, token_counts
from framelake.llm.queries import op9_chat, tokenizer_path

from .test_lines_chat import brute

LINE = "one line that many documents share"


def test_two_texts_of_one_id(spark):
    rows = [(1, f"{LINE}\nx"), (1, "a line which nobody else has at all\ny"), (2, LINE), (3, LINE), (3, f"z\n{LINE}"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(spark, df).collect()), key=str)
    assert got == brute(rows)
    assert (1, 2, 0, "a line which nobody else has at all\ny") in got


def test_line_dedup_with_clashing_columns(spark):
    rows = [(d, LINE, "a", "b", "c", 1, 2) for d in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep string, _doc string, keep string, n_lines int, t int")
    out = line_dedup.dedup_lines(spark, df)
    assert out.columns == ["doc_id", "text", "_keep", "_doc", "keep", "t", "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r._keep, r._doc, r.keep, r.t, r.n_dropped) for r in out.collect()} == {(d, "" if d < 3 else LINE, "a", "b", "c", 2, int(d < 3)) for d in range(4)}


def test_no_python_in_chat_query(spark):
    seen, todo = [], [op9_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().execute()]
    while todo:
        rdd = todo.pop()
        seen.append(rdd.getClass().getSimpleName())
        deps = rdd.dependencies()
        todo += [deps.apply(k).rdd() for k in range(deps.size())]
    assert len(seen) > 3 and not any("Python" in x for x in seen)


NAMES = "y _keep score predicted n_lines n_dropped ids decoded node keys component row own id fp cell".split()


def test_stages_leave_other_columns_alone(spark):
    texts = [None, "", " ", "word " * 300, f"{LINE}\nfirst", f"{LINE}\nsecond", f"{LINE}\nthird", "ok " * 30000, "é한🎉", "same text of this", "same text of this"]
    rows = [(i, t, "en", "src", 5, *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)] + [(9, "same text of this", "en", "src", 5, *(f"{n}9" for n in NAMES))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in NAMES))
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == df.count()
            continue
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)
        empty = stage(spark, df.where("false"), sf)
        assert empty.columns == df.columns and empty.count() == 0
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-copy dedup"](spark, df, sf).collect()}
    assert {0, 9} <= kept and not {1, 2, 10} & kept


def test_operators_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words of a text", "a", "b", 1.5, "c")], "doc_id long, text string, fp string, node string, n_tokens double, h string")
    assert simhash.near_duplicates(spark, df).count() == simhash.keep_one(spark, df).count() == 1
    row = token_counts.token_counts(df, tokenizer_path()).first()
    assert (row.fp, row.node, row.h) == ("a", "b", "c") and isinstance(row.n_tokens, int)
    row = bpe.encode_decode(df.selectExpr("*", "'x' as ids", "'y' as decoded"), tokenizer_path()).first()
    assert row.decoded != "y" and len(row.ids) > 3
    labels = spark.createDataFrame([(1, 1, "q"), (2, 0, "q")], "doc_id long, quality int, y string")
    assert quality.score(df.selectExpr("*", "7 as y"), quality.fit(df.selectExpr("*", "7 as y"), labels)).first().y == 7
    assert chat.format_chats(df.limit(0).selectExpr("1 as conv_id", "1 as turn", "'user' as role", "text", "fp as turns")).count() == 0


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_short_items_match_whole(spark, broadcast):
    items = [(1, "six words stand in this item"), (2, "Three little words!"), (3, "two words"), (4, "one"), (5, "..."), (6, "")]
    texts = [(1, "Six words stand in this item."), (2, "before, six words stand in this item and after"), (3, "six words stand in that item"), (4, "two words"), (5, "these two words here"), (6, "one"), (7, "with three little words inside"), (8, None), (9, "three little birds")]
    docs, tests = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_start, r.n_matched) for r in decontamination.overlaps(spark, docs, tests, broadcast_tokens=broadcast).collect()}
    assert got == {(1, 1, 0, 6), (2, 1, 1, 6), (4, 3, 0, 2), (6, 4, 0, 1), (7, 2, 1, 3)}


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_decontamination_against_all_alignments(spark, broadcast):
    """The best overlap over every alignment of every item with every text."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate(rng.integers(8, 40, 25))]
    texts = []
    for d in range(260):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 80))))
        for _ in range(int(rng.integers(0, 3))):
            said = items[int(rng.integers(len(items)))][1].split()
            at, end = sorted(rng.integers(0, len(said) + 1, 2))
            part = [w if rng.random() > 0.1 else "zz" for w in said[at:end]]
            words[int(rng.integers(len(words))) :] = part
        texts.append((d, " ".join(words)))
    memo = decontamination._Tokens()
    want = {}
    for (d, text), (i, item) in itertools.product(texts, items):
        a, b = decontamination.token_hashes(text, memo), decontamination.token_hashes(item, memo)
        best = max((hit[3] for s in range(-len(b), len(a)) if (hit := decontamination.overlap(a, b, s))), default=0)
        if best:
            want[d, i] = best
    docs, tests = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontamination.overlaps(spark, docs, tests, broadcast_tokens=broadcast).collect()}
    assert got == want and len(want) > 30


def test_features_do_not_depend_on_pieces():
    rng = np.random.default_rng(3)
    texts = ["Some words, and more of them.\n" * 3000, "x" * 5000 + " tail tail", " lead\x00\ttwo  three ", "é한🎉 " * 700, " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(2000))]
    for text in texts:
        whole = np.sort(np.concatenate(list(quality.features(text, 1 << 40))))
        for piece in (1, 10, 1000):
            assert (np.sort(np.concatenate(list(quality.features(text, piece)))) == whole).all()


def test_training_against_dense_softmax():
    """The sparse steps equal those of a dense model with the same draws."""
    rng = np.random.default_rng(4)
    good, bad = "the quick brown fox jumps over dogs".split(), "zx qv zx zx vv kq kq".split()
    texts = [" ".join(rng.choice(good if k % 2 else bad, 6)) for k in range(40)] + [None]
    y = [k % 2 for k in range(40)] + [1]
    model = quality.train(texts, y)
    buckets = 1 << quality.BITS
    x = np.zeros((len(texts), buckets), dtype=np.float32)
    for i, t in enumerate(texts):
        for f in quality.features(t):
            np.add.at(x[i], f, 1)
        x[i] /= max(1.0, x[i].sum())
    draw = np.random.default_rng(7)
    vectors, layer = (draw.random((buckets, quality.DIM)) - 0.5) / quality.DIM, np.zeros((quality.DIM, 2))
    n_good = sum(y)
    bias = np.log(np.array([len(y) - n_good, n_good]) / len(y))
    epochs = max(quality.EPOCHS, -(-quality.LEAST_STEPS * quality.BATCH // len(y)))
    steps, done = epochs * -(-len(y) // quality.BATCH), 0
    used = np.flatnonzero(x.any(axis=0))
    x, target = x[:, used].astype(float), np.eye(2)[y]
    small = vectors[used]
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(y), quality.BATCH):
            rate = quality.RATE * (1 - done / steps)
            done += 1
            own = np.array([i for i in order[at : at + quality.BATCH] if x[i].any()])
            hidden = x[own] @ small
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - target[own]) / len(own)
            step = x[own].T @ (p @ layer.T)
            layer = layer - rate * hidden.T @ p
            small = small - rate * quality.SCALE * step
    scores = 1 / (1 + np.exp(-(x @ (small @ (layer[:, 1] - layer[:, 0])) + bias[1] - bias[0])))
    assert np.allclose(scores, model.scores(texts), atol=1e-3)
