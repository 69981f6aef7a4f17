import itertools

import numpy as np
import pytest

from framelake.llm import decontamination

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing about rain and distant hills at dawn in early spring".split()


def changed(words, at):
    return " ".join("zz%d" % k if k in at else w for k, w in enumerate(words))


def stretch(same, least):
    """(equal tokens, -length, -start) of the best stretch that suffices, by trying all."""
    found = [(m, a - b, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if (m := int(same[a:b].sum())) >= least and 5 * m >= 4 * (b - a)]
    return max(found, default=None)


def test_every_overlap_that_suffices_is_found():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(600):
        n = int(rng.integers(1, 45))
        item = np.arange(1, n + 1, dtype=np.uint64)
        same = rng.random(n) > rng.choice([0.05, 0.15, 0.25])
        before = int(rng.integers(0, 5))
        doc = np.concatenate((np.full(before, 900, np.uint64), np.where(same, item, np.uint64(999)), np.full(3, 901, np.uint64)))
        want = stretch(same, min(13, n))
        got = decontamination.overlap(doc, item, before)
        assert got == (want and (before - want[2], -want[2], -want[1], want[0]))
        found += want is not None
    assert found > 100


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_changes_near_both_ends(spark, broadcast):
    runs = [w for k in range(8) for w in ["r%dw%d" % (k, j) for j in range(13)]]
    apart = [w for k in range(8) for w in [*runs[13 * k : 13 * k + 13], *(["gap%d%d" % (k, j) for j in range(4)] if k < 7 else [])]]
    items = [(0, " ".join(WORDS[:15])), (1, " ".join(WORDS[4:20])), (2, " ".join(WORDS[:20])), (3, " ".join(apart))]
    texts = [(0, changed(WORDS[:15], (2, 12))), (1, changed(WORDS[4:20], (1, 13))), (2, changed(WORDS[:20], (2, 10, 17))), (3, " ".join("zz" if w.startswith("gap") else w for w in apart)), (4, changed(WORDS[:15], (2, 7, 12)))]
    docs, tests = spark.createDataFrame([(i, f"some other words {t} and more") for i, t in texts], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.overlaps(spark, docs, tests, broadcast_tokens=broadcast).collect()}
    assert (got[0, 0].n_tokens, got[0, 0].n_matched) == (15, 13)
    assert (got[1, 1].n_tokens, got[1, 1].n_matched) == (16, 14)
    assert (got[2, 2].n_tokens, got[2, 2].n_matched) == (20, 17)
    assert got[3, 3].n_matched >= 13 and 5 * got[3, 3].n_matched >= 4 * got[3, 3].n_tokens
    assert (4, 0) not in got


@pytest.mark.parametrize("n", [13, 14, 15, 16, 17, 20])
def test_a_mask_fits_every_overlap(n):
    masks = [int(m[::-1], 2) << p for m in decontamination.MASKS for p in range(n - len(m) + 1)]
    for at in itertools.combinations(range(n), n - max(13, -(-4 * n // 5))):
        equal = (1 << n) - 1 - sum(1 << k for k in at)
        assert any(equal & m == m for m in masks)
