import time
from collections import defaultdict

import numpy as np
import pytest

from framelake.llm import language_id
from framelake.llm.queries import op1_language_id

from .test_models import profiles


def fused(rows, profiles):
    """Languages and posteriors, page by page, with sums over all other pages."""
    names = profiles.languages
    text = [profiles.likelihoods(language_id.visible_text(h)) for _, h in rows]
    declared = [d if (d := language_id.declared_language(h)) in names else None for _, h in rows]
    soft = [np.exp(t - t.max()) / np.exp(t - t.max()).sum() for t in text]
    both = []
    for i, t in enumerate(text):
        says = np.zeros(len(names))
        if declared[i]:
            counts = np.where(np.eye(len(names)) == 1, 1.0, 0.05)
            for j, d in enumerate(declared):
                if d and j != i:
                    counts[names.index(d)] += soft[j]
            says = np.log(counts[names.index(declared[i])]) - np.log(counts.sum(axis=0))
        both.append(t + says)
    # The sums of the address hold each other page's share under all declarations.
    share = []
    for t, d in zip(text, declared, strict=True):
        if d:
            counts = np.where(np.eye(len(names)) == 1, 1.0, 0.05)
            for j, e in enumerate(declared):
                if e:
                    counts[names.index(e)] += soft[j]
            own = soft[len(share)]
            t = t + np.log(counts[names.index(d)] - own) - np.log(counts.sum(axis=0) - own)
        share.append(np.exp(t - t.max()) / np.exp(t - t.max()).sum())
    where = [language_id.address(u) for u, _ in rows]
    out = []
    for i in range(len(rows)):
        others = [j for j in range(len(rows)) if j != i]
        prior = (sum((share[j] for j in others), np.zeros(len(names))) + 1.0) / (len(others) + len(names))
        for k in (2, 1, 0):
            same = [j for j in others if where[j][k:] == where[i][k:]]
            prior = (sum((share[j] for j in same), np.zeros(len(names))) + language_id.SMOOTH * prior) / (len(same) + language_id.SMOOTH)
        z = both[i] + np.log(prior)
        p = np.exp(z - z.max())
        p /= p.sum()
        out.append((names[int(p.argmax())], p.max(), names[int(text[i].argmax())], declared[i]))
    return out


def test_against_a_plain_version(spark):
    words = {"en": "the and of that with this ", "fr": "les des dans une que pour ", "de": "der die und nicht mit eine "}
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        lang = ["en", "fr", "de"][rng.integers(3)]
        said = rng.choice(["", f"<html lang='{lang}'>", "<html lang='fr'>", "<html lang='xx'>"])
        host = rng.choice([f"http://www.{lang}.example.org/", f"http://{lang}.net/", "http://mixed.com/", None])
        rows.append((None if host is None else str(host) + str(i), None if i % 17 == 0 else f"{said}<p>{words[lang] * int(rng.integers(0, 4))}</p>"))
    rows += rows[:3]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in language_id.identify(spark, df, profiles()).collect()}
    want = fused(rows, profiles())
    assert len(got) == len(rows)
    for i, (lang, p, text, declared) in enumerate(want):
        assert (got[i].lang, got[i].text_lang, got[i].declared) == (lang, text, declared)
        assert got[i].confidence == pytest.approx(p, abs=1e-9)


def test_many_languages(spark):
    """120 languages, each of them found; the plan doesn't grow with their number."""
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {f"x{chr(97 + k // 26)}{chr(97 + k % 26)}": ["".join(rng.choice(letters, 6)) for _ in range(30)] for k in range(120)}
    docs = spark.createDataFrame([(k, " ".join(w * 4), lang) for k, (lang, w) in enumerate(words.items())], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(k, f"http://h{k % 50}.org/", f"<p>{' '.join(w)}</p>") for k, w in enumerate(words.values())], "page_id long, url string, html string")
    at = time.time()
    found = language_id.fit(docs)
    rows = language_id.identify(spark, pages, found).collect()
    assert time.time() - at < 60
    names = list(words)
    assert found.languages == sorted(names) and all(r.lang == r.text_lang == names[r.page_id] for r in rows)


def test_rare_languages_are_learned(spark):
    rows = [(i, "the and of that with", "en") for i in range(3000)] + [(5000, "les des dans une que", "fr"), (None, "x", "de"), (5001, None, "de"), (5002, "x", None)]
    found = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert found.languages == ["en", "fr"]


def test_query_is_stable(spark):
    sf = "/root/testdata/sf0.001"
    a, b = (sorted((r.page_id, r.lang, r.declared) for r in op1_language_id(spark, sf).collect()) for _ in range(2))
    ids = defaultdict(int)
    for r in a:
        ids[r[0]] += 1
    assert a == b and set(ids.values()) == {1}
