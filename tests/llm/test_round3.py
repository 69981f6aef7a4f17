"""Embedding near-duplicates, the prefix trie and importance resampling against plain versions of their contracts."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelake.llm import ann, decontamination, embedding_dups, importance, language_id, prefix_trie, simhash
from framelake.llm._order import named, running
from framelake.llm.queries import op11_embedding_dups, op12_prefix_trie, op13_importance

from .test_search import closure

SF = "/root/testdata/sf0.01"


def plain_links(rows, cosine=0.93):
    """{id: (n_links, component)} of (id, vector, label), ids distinct."""
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            x = x / np.abs(x).max()
            ok[i] = (label, x / np.sqrt((x * x).sum()))
    ids, links, edges = sorted(ok), Counter(), []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine:
                links.update((a, b))
                edges.append((a, b))
    root = closure([i for i, _, _ in rows], edges)
    return {i: (links[i], root[i]) for i, _, _ in rows}


def found_links(df):
    out = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert len({r.vec_id for r in out}) == len(out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def test_embeddings_against_all_pairs(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found_links(op11_embedding_dups(spark, SF)) == plain_links(rows)


def test_links_near_the_threshold_and_in_blocks(spark):
    """Chains, tight groups, copies and pairs about the threshold; buckets cut into blocks of 16."""
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for label in (1, 2):
        for spread in (0.0, 0.02, 0.3, 0.4, 0.45):
            centre = rng.standard_normal(24)
            for _ in range(40):
                v = centre + spread * rng.standard_normal(24)
                rows.append((i * 7 % 1009, [float(np.float32(x)) for x in v], label))
                i += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain_links(rows)
    assert found_links(embedding_dups.near_duplicates(spark, df)) == want
    assert found_links(embedding_dups.near_duplicates(spark, df, block=16)) == want
    assert len({c for _, c in want.values()}) > 10 and max(n for n, _ in want.values()) >= 39


def test_odd_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, -0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, math.nan, 3.0], 0),
            (10, [1.0, math.inf, 3.0], 0), (11, [1.0, 2.0], 0), (12, [1e300, 2e300, 3e300], 0), (13, [1e-300, 2e-300, 3e-300], 0), (14, v, 0), (15, [0.0, 1.0, 0.0], 0), (16, [-0.0, 1.0, 0.0], 0)]
    full = rows + [(1, v, 0), (None, v, 0)]
    df = spark.createDataFrame([(*r, "x", 5) for r in full], "vec_id long, embedding array<double>, label int, node string, is int")
    assert found_links(embedding_dups.near_duplicates(spark, df)) == plain_links(rows)
    assert embedding_dups.near_duplicates(spark, df.where("false")).count() == 0
    assert found_links(embedding_dups.near_duplicates(spark, df.where("vec_id in (5, 6)"))) == {5: (0, 5), 6: (0, 6)}


def test_tables_cover_the_threshold():
    for rows in (1, 10_000, 10**6, 10**9):
        bits, tables = embedding_dups.tables_for(rows)
        same = 1 - math.acos(0.93) / math.pi
        assert (1 - same**bits) ** tables <= 1e-4 and (bits == 8 or rows / 2**bits <= embedding_dups.BUCKET)


def plain_trie(rows, family=20, openings=4):
    """Nodes of (conv_id, turn, role, text) as the contract's columns, in order."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % openings
        whole[c] = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for t in members:
        children[t[:-1]] += bool(t)
    for t, m in members.items():
        for d in range(len(t) + 1):
            leaves[t[:d]] += not children[t]
            saved[t[:d]] += (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", t[-1][1])) if t else 0)
    out = []
    for t, m in members.items():
        ended = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(t))))
        out.append((min(m), len(t), min(members[t[:-1]]) if t else None, len(m), children[t], leaves[t], saved[t], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def found_trie(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert {f.dataType.simpleString() for f in df.schema.fields if f.name != "ends_sha256"} == {"bigint"}
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda x: (x[1], x[0]))


def test_trie_of_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_trie(op12_prefix_trie(spark, SF)) == plain_trie(rows)


def test_trie_of_odd_conversations(spark, monkeypatch):
    """Long and turnless conversations, copies, absent lenders, negative ids, ties, nulls, repeated rows; frequent names and short texts of ids."""
    rng = random.Random(3)
    rows = []
    for c in [*range(-45, 45), 207, 208, 209, 1001, 1002, 4000, 4001]:
        n = rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 31])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", "\x1cd \x85e", None, ""])) for t in range(n)]
    rows += [(500 + c, t, "user", "the same all the way") for c in range(30) for t in range(6)]
    rows += [(60, None, "b", "x"), (60, None, "b", "x"), (60, None, None, "y"), (60, 2, "a", "z"), (60, 2, "a", "w")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows + [(None, 0, "user", "nobody's")]], "conv_id long, turn long, role string, text string, name int, pos string")
    want = plain_trie(rows)
    assert any(x[1] == 31 for x in want) and any(x[1] == 1 and x[3] > 30 for x in want)
    assert found_trie(prefix_trie.trie(spark, df)) == want
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    assert found_trie(prefix_trie.trie(spark, df)) == want
    assert prefix_trie.trie(spark, df.where("false")).count() == 0


def test_running_sums_over_ranges(spark):
    """One group holds most rows, so it spans ranges."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(9), k, rng.randrange(5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    want, sums = {}, Counter()
    for g, k, v in sorted(rows):
        sums[g] += v
        want[k] = sums[g]
    out = running(spark, df, "g", [df["k"].asc()], ["v"], "test")
    assert {r.k: r.upto_v for r in out.collect()} == want
    names = named(spark, df.select("g", "k"), ["g"], "test").collect()
    assert len(names) == 3000 and {r.name for r in names} == set(range(9)) and {r.held for r in names if rows[r.k][0] == 0} == {Counter(g for g, _, _ in rows)[0]}


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_draw(docs, target):
    """{(doc_id, n_features, weight, score, rank)} of (doc_id, text), as the contract spells it."""

    def grams(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text))
    for text in target:
        t.update(grams(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (all_s + 10000)) / float((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for doc, text in docs:
        g = grams(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append([doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)) >= 20])
    open_ = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(open_[: 5 * len(open_) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_importance_against_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = op13_importance(spark, SF)
    assert {f.dataType.simpleString() for f in got.schema.fields} == {"bigint"}
    got = Counter(tuple(r[n] for n in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect())
    assert got == plain_draw(docs, target) and max(r[4] or 0 for r in got) > 40


def test_importance_of_odd_texts(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names = ("doc_id", "n_features", "weight", "score", "rank")
    for target in (docs, no_docs):
        got = importance.resample(spark, docs, target).collect()
        assert Counter(tuple(r[n] for n in names) for r in got) == plain_draw(rows, [r.text for r in target.collect()])
    assert importance.resample(spark, no_docs, docs).count() == 0
    many = docs.crossJoin(spark.range(40).select("id")).select("text", "doc_id")  # ties: equal rows take neighbouring ranks
    got = importance.resample(spark, many, docs).collect()
    assert Counter(tuple(r[n] for n in names) for r in got) == plain_draw([(r.doc_id, r.text) for r in many.collect()], [r.text for r in docs.collect()])


@pytest.mark.parametrize("length", [0, 1, 7, 255, 256, 70_001])
def test_crc_of_parts(length):
    rng = random.Random(length)
    head, word = rng.randbytes(50), rng.randbytes(length)
    got = importance.append(np.array([zlib.crc32(head)], np.uint32), np.array([zlib.crc32(word)], np.uint32), np.array([length]))
    assert got[0] == zlib.crc32(head + b" " + word)


def plain_text(page):
    """What isn't in comments, scripts, styles or tags, by a scanner that looks at each place once."""
    out, at, low = [], 0, page.lower()
    while at < len(page):
        if page[at] != "<":
            out.append(page[at])
            at += 1
            continue
        out.append(" ")
        name = next((x for x in ("script", "style") if low.startswith(x, at + 1) and not re.match(r"\w", page[at + 1 + len(x) : at + 2 + len(x)])), None)
        if name:
            end = re.compile(rf"</{name}\s*>").search(low, at)
            at = end.end() if end else len(page)
        else:
            close = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(close, at + (4 if close == "-->" else 1))
            at = end + len(close) if end >= 0 else len(page)
    return "".join(out)


def test_broken_markup_in_linear_time():
    parts = ["<!--", "<script", "<script>", "</script", "</script >", "<", "<p>", "<style>", "<html lang=de", ">", "-->", "--", "word ", "</", "<scripts>", "\n"]
    rng = random.Random(4)
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert language_id.visible_text(page) == plain_text(page), page
    for part in parts:
        page = "words before " + part * (1_000_000 // len(part))
        began = time.perf_counter()
        text = language_id.visible_text(page)
        language_id.declared_language(page)
        assert time.perf_counter() - began < 5 and text.startswith("words before "), part
        small = page[:5000]
        assert language_id.visible_text(small) == plain_text(small)


def test_broken_pages_are_identified(spark):
    profiles = language_id.learn(["der die und das nicht mit ist ein " * 30, "the and of is with not this that " * 30], ["de", "en"])
    rows = [(1, "http://a.de/", "der die und das nicht <!-- " * 40_000), (2, "http://b.com/", "the and of <script> is not " * 30_000), (3, None, "<" * 1_000_000)]
    got = {r.page_id: r.text_lang for r in language_id.identify(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), profiles).collect()}
    assert got[1] == "de" and got[2] == "en" and len(got) == 3


@pytest.mark.parametrize("n", range(7, 15))
def test_a_mask_fits_every_overlap_with_a_short_item(n):
    """All ways to change tokens of an item of n such that a stretch suffices: one of its shapes fits inside the stretch."""
    shapes = [int(m[::-1], 2) << p for _, m in decontamination.own_shapes(n, 0.8) for p in range(n - len(m) + 1)]
    least, tried = decontamination.needed(n, 0.8), 0
    assert least == max(math.ceil(0.8 * n), n - 2)
    for a in range(n):
        for b in range(a + least, n + 1):
            for changed in range(b - a - least + 1):
                for at in itertools.combinations(range(a, b), changed):
                    if 5 * (b - a - changed) >= 4 * (b - a):
                        equal = sum(1 << k for k in range(a, b) if k not in at)
                        assert any(equal & m == m for m in shapes), (a, b, at)
                        tried += 1
    assert tried > 5


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_short_items_with_changes_against_all_alignments(spark, broadcast):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate([*range(5, 18)] * 2)]
    texts = []
    for d in range(250):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 60))))
        said = items[int(rng.integers(len(items)))][1].split()
        for k in rng.choice(len(said), int(rng.integers(0, 4)), replace=False):
            said[int(k)] = "zz"
        at = int(rng.integers(len(words) + 1))
        texts.append((d, " ".join(words[:at] + said[int(rng.integers(0, 2)) :] + words[at:])))
    memo, want = decontamination._Tokens(), {}
    for (d, text), (i, item) in itertools.product(texts, items):
        a, b = decontamination.token_hashes(text, memo).tolist(), decontamination.token_hashes(item, memo).tolist()
        least = len(b) if len(b) < 7 else min(13, max(math.ceil(0.8 * len(b)), len(b) - 2))
        best = 0
        for shift in range(-len(b), len(a)):
            same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
            if sum(same) >= least:
                best = max([best, *(m for x in range(len(b)) for y in range(x + least, len(b) + 1) if (m := sum(same[x:y])) >= least and 5 * m >= 4 * (y - x))])
        if best:
            want[d, i] = best
    docs, tests = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontamination.overlaps(spark, docs, tests, broadcast_tokens=broadcast, short_share=0.8).collect()}
    assert got == want and len(want) > 90 and sum(m < len(items[i][1].split()) for (_, i), m in want.items()) > 30


@pytest.mark.parametrize("cell", [3, 40])
def test_cells_in_blocks(spark, monkeypatch, cell):
    """Fingerprints around a few centres, so that cells are far above what one task compares."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(prints)[:4]:
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    prints = sorted(prints)
    want = closure(range(len(prints)), [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    df = spark.createDataFrame([(n, p - (1 << 64) if p >> 63 else p) for n, p in enumerate(prints)], "node long, fp long")
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    assert closure(range(len(prints)), edges) == want and len(set(want.values())) < len(prints) - 150


def test_one_of_repeated_rows_is_kept_whatever_their_order(spark):
    rows = [(1, "b", 5), (1, "b", 4), (2, "c d e f g", 1), (None, "b", 1)]
    for some in (rows, rows[::-1]):
        kept = simhash.keep_one(spark, spark.createDataFrame(some, "doc_id long, text string, n long")).collect()
        assert sorted(map(tuple, kept), key=str) == [(1, "b", 4), (2, "c d e f g", 1), (None, "b", 1)]


def test_what_to_gather_follows_from_the_vectors(spark):
    """Clustered vectors need a small share, vectors without structure a large one; both reach the recall."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((60, 16)) * 4
    kinds = {"clusters": centres[rng.integers(60, size=3000)] + rng.standard_normal((3000, 16)) * 0.3, "noise": rng.standard_normal((3000, 16))}
    took = {}
    for name, x in kinds.items():
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        placed = {}

        def held(placed_, books, cells, *a, f=ann.gather_for, name=name, placed=placed):
            placed[name] = f(placed_, books, cells, *a)
            return placed[name]

        with pytest.MonkeyPatch.context() as m:
            m.setattr(ann, "gather_for", held)
            rows = ann.nearest(spark, df, "vec_id % 10 = 0").collect()
        took[name] = placed[name]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit @ unit.T
        np.fill_diagonal(near, -2)
        true = {(q, int(v)) for q in range(0, 3000, 10) for v in np.argsort(-near[q])[:5]}
        got = {(r.query_id, r.vec_id) for r in rows}
        assert len(got) == len(true) and len(got & true) >= 0.92 * len(true)
    assert 2 * took["clusters"] < took["noise"] <= 1
    assert ann.words_for(10) == 32 and ann.words_for(10**6) == 141 and ann.words_for(10**12) == 1000
