import hashlib
import shutil
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framelake.llm import bpe, token_counts, token_store
from framelake.llm.queries import op6_token_store, op8_bpe, op10_token_counts, tokenizer_path
from framelake.llm.tokenization import library_text_encoder

from .conftest import ODD_TEXTS

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_as_the_library(docs, library):
    for r in bpe.encode_decode(docs, PATH).collect():
        assert r.ids == ids_of(library, r.text)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
        assert r.lang == "k"


def test_encode_then_decode_apart(docs, library):
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(rows) == docs.count()
    assert all(r.decoded == library.decode(ids_of(library, r.text), skip_special_tokens=False) for r in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizer(docs, name):
    path = tokenizer_path(name)
    other = Tokenizer.from_file(path)
    for r in bpe.encode_decode(docs, path).collect():
        assert r.ids == ids_of(other, r.text)
        assert r.decoded == other.decode(r.ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    library = Tokenizer.from_file(PATH)
    want = np.array(ids_of(library, text), dtype="<u4").tobytes()
    assert list(library_text_encoder(PATH).ids([text])) == [want]
    assert list(bpe._encoder(PATH)[1].ids([text])) == [want]


def test_characters(library):
    texts = ["aB" + chr(c) + "c" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe._encoder(PATH)[1].ids(texts)] == [ids_of(library, t) for t in texts]


def test_ranks_that_come_alive_late():
    """A merge that makes a pair of lower rank has it applied before a later pair of its own rank."""
    model = {"type": "BPE", "vocab": {c: i for i, c in enumerate(["a", "b", "c", "ab", "abc", "bc", "cabc"])}, "merges": [["c", "abc"], ["ab", "c"], ["a", "b"]], "end_of_word_suffix": None}
    index = bpe.PairIndex(model)
    assert [np.frombuffer(x, "<u4").tolist() for x in index.encode(["abcabc", "cabc", "aab"])] == [[4, 4], [6], [0, 3]]


def test_counts(docs, library):
    rows = token_counts.token_counts(docs, PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count() and "text" not in rows[0]
    for r in rows:
        n = len(ids_of(library, texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 2048)


def test_counts_by_sentencepiece(docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(model.encode(texts[r.doc_id] or "")) for r in token_counts.token_counts(docs, path).collect())


def test_empty_tables(no_docs):
    assert bpe.encode_decode(no_docs, PATH).count() == 0
    assert token_counts.token_counts(no_docs, PATH).count() == 0


def test_op8_digests(spark, library):
    for r in op8_bpe(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        ids = ids_of(library, r.text)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_store_round_trip(spark, docs, library, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(spark, docs, path, PATH)
    assert token_store.verify(spark, path)
    rows = sorted(token_store.read(spark, path).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(docs.count()))
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in rows]
    assert keys == sorted(keys)
    texts, start = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in rows:
        want = np.array([*ids_of(library, texts[r.doc_id]), 1], dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (start, len(want) // 4, zlib.crc32(want))
        start += r.n_tokens
    chunks = token_store._parts(spark, path, "chunk")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_store_of_nothing(spark, no_docs, tmp_path):
    path = f"file://{tmp_path}/none"
    token_store.write(spark, no_docs, path, PATH)
    assert token_store.read(spark, path).count() == 0 and token_store.verify(spark, path)


def test_store_notices_damage(spark, docs, tmp_path):
    path = f"file://{tmp_path}/damaged"
    token_store.write(spark, docs.limit(5), path, PATH)
    wrong = token_store.recipes(spark, path).selectExpr("ordinal", "doc_id", "start", "n_tokens + 1 as n_tokens", "root", "chunks").collect()
    shutil.rmtree(tmp_path / "damaged/recipes")
    spark.createDataFrame(wrong, "ordinal long, doc_id long, start long, n_tokens long, root binary, chunks array<binary>").write.parquet(f"{path}/recipes")
    assert not token_store.verify(spark, path)
    with pytest.raises(Exception, match="recipe"):
        token_store.read(spark, path).collect()


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 40000, 30000).astype("<u4")
    a = token_store.cut_points(ids)
    b = token_store.cut_points(np.concatenate((ids[:7], ids)))
    assert a[-1] == len(ids) and max(np.diff([0, *a])) <= token_store.LONGEST
    assert len({x + 7 for x in a} & set(b)) >= len(a) - 2
    assert token_store.cut_points(ids[:0]) == []
    for ids in (np.array([70000, 1, 2], "<u4"), np.array([5], "<u4")):
        assert (token_store.unpack(*token_store.pack(ids)) == ids).all()


def test_queries_against_the_library(spark, library):
    """op6 and op10 on the whole table, in order."""
    rows = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    stored = {r.doc_id: r for r in op6_token_store(spark, "/root/testdata/sf0.01").collect()}
    counted = {r.doc_id: r for r in op10_token_counts(spark, "/root/testdata/sf0.01").collect()}
    assert len(stored) == len(counted) == len(rows)
    start = 0
    for doc_id, text in rows:
        ids = ids_of(library, text)
        data = np.array([*ids, 1], dtype="<u4").tobytes()
        assert (stored[doc_id].start, stored[doc_id].n_tokens, stored[doc_id].ids_crc32) == (start, len(ids) + 1, zlib.crc32(data))
        assert (counted[doc_id].n_tokens, counted[doc_id].over_limit) == (len(ids), len(ids) > 2048)
        start += len(ids) + 1


def test_streams_are_cut_apart():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 40000, n).astype("<u4") for n in (1, 0, 3000, 15, 16, 17, 9000)]
    ends = np.cumsum([len(p) for p in parts])
    whole = token_store.cut_points(np.concatenate(parts), ends)
    alone = [c + e - len(p) for p, e in zip(parts, ends.tolist(), strict=True) for c in token_store.cut_points(p)]
    assert whole == alone


def test_long_texts_in_small_slices(library):
    """Results don't depend on how a batch is sliced."""
    import pyarrow as pa

    from framelake.llm._common import slices

    texts = ["word and, more " * 2000, None, "é" * 5000, "", "x y <|endoftext|> z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    got = [r for part in slices(batch, "t", 100) for r in part.column(0).to_pylist()]
    assert got == texts and len(list(slices(batch, "t", 100))) > 2
    assert list(library_text_encoder(PATH).ids([t or "" for t in texts])) == [np.array(ids_of(library, t), dtype="<u4").tobytes() for t in texts]
