import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import decontamination, language_id, quality
from framelake.llm.queries import op1_language_id, op5_quality

from .test_lines_chat import brute
from .test_search import closure, naive_print

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op5_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(tested) > 50 and np.mean(tested) >= 0.97


def test_odd_texts_get_scores(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (2, 0, 0), (4, None, 0), (5, 7, 0), (None, 1, 0), (3, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.lang == "k" for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip(" \n")}) == 1
    assert quality.score(no_docs, model).count() == 0
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_features_of_long_texts_add_up():
    text = "Some words, and more of them.\n" * 60000
    cut, whole = np.concatenate(list(quality.features(text))), np.concatenate(list(quality.features(text, 1 << 40)))
    assert (np.sort(cut) == np.sort(whole)).all()
    assert list(quality.features(None)) == list(quality.features("  \n")) == []


def test_languages(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op1_language_id(spark, SF).collect()
    assert len(rows) == len(pages)
    assert np.mean([f"/{r.lang}/" in pages[r.page_id] for r in rows]) > 0.98


def profiles():
    texts = {"en": "the and of that with this from which would there ", "fr": "les des dans une que pour avec est sont nous ", "de": "der die und nicht mit eine auch sich werden "}
    return language_id.learn([t * 20 for t in texts.values()], list(texts))


def test_evidence_is_fused(spark):
    host = [(i, "http://www.exemple.fr/p", f"<html lang='fr'><p>{'les des dans une que pour ' * 5}</p>") for i in range(30)]
    odd = [(100, "http://www.exemple.fr/x", "<p>ok</p>"), (101, "https://new.exemple.fr/", None), (102, None, "<html lang=de-AT><body>12</body>"), (103, "no address", ""), (104, "http://other.com", "<html lang='fr'>" + "the and of that with this from which would there " * 9), (104, "http://other.com", "<html lang='xx'>")]
    df = spark.createDataFrame([(*r, "?", 2.0) for r in host + odd], "page_id long, url string, html string, lang string, host double")
    rows = language_id.identify(spark, df, profiles()).collect()
    assert len(rows) == len(host) + len(odd) and {"page_id", "url", "host", "lang", "confidence", "text_lang", "declared"} == set(rows[0].asDict())
    lang = {r.page_id: r.lang for r in rows if r.page_id != 104}
    assert all(lang[i] == "fr" for i in (*range(30), 100, 101)) and lang[102] == "de"
    assert {r.lang for r in rows if r.page_id == 104 and r.declared == "fr"} == {"en"}
    assert all(0 < r.confidence <= 1.000001 for r in rows)


def test_languages_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.identify(spark, none, profiles()).count() == 0
    one = spark.createDataFrame([(1, "http://a.b", "<p>x</p>")], none.schema)
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_id.identify(spark, one, empty).first().lang is None


def test_pipeline_against_brute_force(spark):
    """Each stage against a plain version of it, on what the stage before returned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    names = list(steps)

    def go(name, df):
        return steps[name](spark, df, SF)

    first = go(names[0], docs)
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert kept == {r.doc_id for r in op5_quality(spark, SF).collect() if r.predicted == 1} and first.columns == docs.columns

    second = go(names[1], first)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert sorted(((r.doc_id, r.text or "") for r in second.collect()), key=str) == sorted(((d, t) for d, _, _, t in brute(rows)), key=str)

    texts = {r.doc_id: r.text for r in second.collect()}
    prints = {d: naive_print(t) for d, t in texts.items()}
    order = sorted(prints)
    values = np.array([prints[d] for d in order], dtype=np.uint64)
    pairs = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    want = closure(order, [(order[a], order[b]) for a, b in pairs if a < b])
    third = go(names[2], second)
    assert {r.doc_id for r in third.collect()} == {d for d in order if want[d] == d} and third.columns == docs.columns

    fourth = go(names[3], third)
    grams = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = r.text.lower().split()
        for k in range(len(words) - 12):
            grams[" ".join(words[k : k + 13])] = r.item_id
    whole = {d for d, t in texts.items() if want[d] == d and any(" ".join(w[k : k + 13]) in grams for w in [(t or "").lower().split()] for k in range(len(w) - 12))}
    gone = {r.doc_id for r in third.collect()} - {r.doc_id for r in fourth.collect()}
    assert whole <= gone and gone == {r.doc_id for r in decontamination.overlaps(spark, third, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}

    last = go(names[4], fourth)
    assert last.columns == ["doc_id", "ids", "decoded"] and last.count() == fourth.count()
