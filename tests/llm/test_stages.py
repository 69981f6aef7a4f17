"""Stages 3 to 5 of the pipeline against plain versions, each on what the stage before returned: near copies by five words and a similarity of 0.8."""

import math

import corpus_pipeline
from framelake.llm import decontamination
from framelake.llm._common import materialize
from framelake.llm.queries import tokenizer_path

from .test_near_copies import brute

SF = "/root/testdata/sf0.01"


def plain_overlap(a, b):
    """Whether an item's tokens b meet a text's tokens a in any alignment: 13 equal tokens (as many as a shorter item allows to change) and a share of 0.8."""
    least = len(b) if len(b) < 7 else min(13, max(math.ceil(0.8 * len(b)), len(b) - 2))
    at = {}
    for k, w in enumerate(a):
        at.setdefault(w, []).append(k)
    shifts = {}
    for k, w in enumerate(b):
        for p in at.get(w, ()):
            shifts[p - k] = shifts.get(p - k, 0) + 1
    for shift, n in shifts.items():
        if n < least:
            continue
        same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
        sums = [0]
        for s in same:
            sums.append(sums[-1] + s)
        if any(sums[y] - sums[x] >= least and 5 * (sums[y] - sums[x]) >= 4 * (y - x) for x in range(len(b)) for y in range(x + least, len(b) + 1)):
            return True
    return False


def test_last_three_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, quality), (_, lines), (_, copies), (_, leaks), (_, tokens) = corpus_pipeline.STAGES
    second = materialize(spark, lines(spark, materialize(spark, quality(spark, docs, SF), "one"), SF), "two")

    third = materialize(spark, copies(spark, second, SF), "three")
    rows = [(r.doc_id, r.text) for r in third.collect()]
    assert sorted(d for d, _ in rows) == brute([(r.doc_id, r.text) for r in second.collect()]) and third.columns == docs.columns

    fourth = materialize(spark, leaks(spark, third, SF), "four")
    memo = decontamination._Tokens()
    items = [decontamination.token_hashes(r.text, memo).tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, t in rows if any(plain_overlap(decontamination.token_hashes(t, memo).tolist(), item) for item in items)}
    assert {r.doc_id for r in fourth.collect()} == {d for d, _ in rows} - leaked and len(leaked) > 5 and fourth.columns == docs.columns

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(tokenizer_path()))
    library.no_truncation(), library.no_padding()
    last = tokens(spark, fourth, SF)
    assert last.columns == ["doc_id", "ids", "decoded"]
    got = {r.doc_id: (list(r.ids), r.decoded) for r in last.collect()}
    texts = {r.doc_id: r.text or "" for r in fourth.collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[d] == (ids, library.decode(ids, skip_special_tokens=False)), d


def test_a_text_goes_through_the_stages_once(spark):
    """Rows beside the texts hold no second copy of them, and columns come back in their order."""
    docs = spark.createDataFrame([("s", 3, "One line that is long enough.\nown", True)] + [("r", k, "One line that is long enough.", None) for k in (1, 2)], "source string, doc_id long, text string, score boolean")
    assert corpus_pipeline._apart(docs).schema["own"].dataType.names == ["source", "doc_id", "score"]
    out = corpus_pipeline.line_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [("r", 1, "", None), ("r", 2, "", None), ("s", 3, "One line that is long enough.\nown", True)]
