"""Token counts without token ids.

One pass over the texts writes each document's distinct pre-tokens with their frequencies, as numbers of a dictionary that its task builds
and writes beside them, a run of documents at a time.  Only dictionaries are counted: their entries meet by pre-token, in order, so that every
distinct one of the corpus is counted once, and its count goes to each entry.  Then a dictionary's counts join its own documents, where frequencies
times counts are summed; no id list of a document is built.  A frequent pre-token is one row of a dictionary like any other, so there are no hot keys and nothing is
broadcast.

Null and empty texts count zero tokens and zero bytes; texts of any length are counted whole; repeated rows are counted row by
row; further columns (of types that Parquet holds) pass through, but for those named like the results, which give way; an empty table gives
an empty one. A SentencePiece model counts each distinct text as a whole, as its rules about white space hold for whole texts.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, slices, texts_of
from .tokenization import CACHE_ENTRIES, numbered_units, spread, word_tokenizer

#: Tokens beyond which a document is over the limit.
LIMIT = 2048
#: Bytes of text that share one dictionary, at most, but for a text longer than that.
RUN = 32_000_000
#: Bytes of text whose pre-tokens are held at once.
_SLICE = 2_000_000


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class PieceFrequencies:
    """Pre-tokens of texts with how often each stands in a text; words met before are not split again."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer, self._entries, self.cleared = word_tokenizer(path), entries, 0
        self._clear()

    def _clear(self) -> None:
        self.cleared += 1  # numbers of pieces hold as long as this stays
        self._units, self._pieces = _Numbers(), _Numbers()
        self.names = pa.array([], pa.string())  # of all pieces
        self._flat, self._ends, self._special = np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, bool)  # pieces of units one after another, where each unit's end

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of texts (none null), numbers of their pieces, frequencies; and the number of special tokens in each text."""
        if len(self._units) > self._entries:
            self._clear()
        units, sizes = numbered_units(self.tokenizer, texts, self._units.__getitem__)
        self._learn()
        text = np.repeat(np.arange(len(texts)), sizes)
        special = np.bincount(text[self._special[units]], minlength=len(texts))
        k = np.diff(self._ends)[units]
        pieces, all_ = self._flat[spread(self._ends[:-1][units], k)], max(1, len(self._pieces))
        keys, n = np.unique(np.repeat(text, k) * all_ + pieces, return_counts=True)
        return keys // all_, keys % all_, n, special

    def _learn(self) -> None:
        """Split the units that are new."""
        new, known = list(itertools.islice(self._units, len(self._special), None)), len(self._pieces)
        if not new:
            return
        is_word = np.fromiter((isinstance(u, str) and u[:1] not in ("", "\0") for u in new), dtype=bool, count=len(new))
        rest = [u for u, word in zip(new, is_word.tolist(), strict=True) if not word]  # special tokens, pieces of odd texts and nothing
        pieces, at, of = self.tokenizer.pieces_of_words([u for u, word in zip(new, is_word.tolist(), strict=True) if word])
        numbers = np.fromiter(map(self._pieces.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        counts = np.zeros(len(new), dtype=np.int64)
        counts[is_word] = np.bincount(of, minlength=int(is_word.sum()))
        counts[~is_word] = [isinstance(u, str) and u != "" for u in rest]
        flat, of_word = np.empty(int(counts.sum()), dtype=np.int64), np.repeat(is_word, counts)
        flat[of_word] = numbers[at]
        flat[~of_word] = [self._pieces[u[1:]] for u in rest if isinstance(u, str) and u]
        self._flat = np.concatenate((self._flat, flat))
        self._ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(counts)))
        self._special = np.concatenate((self._special, np.fromiter((not isinstance(u, str) for u in new), dtype=bool, count=len(new))))
        self.names = pa.concat_arrays([self.names, pa.array(list(itertools.islice(self._pieces, known, None)), pa.string())])


class SentencePieceCounts:
    """Counts by a SentencePiece model, whose rules about white space hold for whole texts: each distinct text is one pre-token."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)

    def totals(self, texts: pa.Array) -> np.ndarray:
        found = texts.dictionary_encode()
        counts = np.array(list(map(len, self._model.encode(found.dictionary.to_pylist(), num_threads=1))) if len(found) else [], dtype=np.int64)
        return counts[found.indices.to_numpy()]


@functools.lru_cache(maxsize=2)
def _frequencies(path: str) -> PieceFrequencies:
    return PieceFrequencies(path)


@functools.lru_cache(maxsize=2)
def _whole_texts(path: str) -> SentencePieceCounts:
    return SentencePieceCounts(path)


_NEW = ("n_bytes", "n_tokens", "over_limit")


def _packed(piece: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Numbers (ascending in each document) and frequencies of documents of ``sizes`` entries: steps and frequencies by byte planes."""
    ends = np.cumsum(sizes)
    steps = np.diff(piece, prepend=0)
    first = (ends - sizes)[sizes > 0]
    steps[first] = piece[first]
    planes = np.stack((steps, n), axis=1).astype("<u4").view(np.uint8)
    return pa.array([planes[e - k : e].T.tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u4")
    return np.cumsum(pairs[:, 0], dtype=np.int64), pairs[:, 1].astype(np.int64)


def frequencies(df: DataFrame, tokenizer_path: str, text_col: str) -> DataFrame:
    """Documents (``head, n_bytes, special, entries``) and entries of dictionaries (``number, piece``) by ``task`` and ``run``."""
    kept = F.struct(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(df.schema.fields) if f.name not in (text_col, *_NEW)), F.lit(True).alias("is_row"))
    rows = df.select(kept.alias("head"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*T._parse_datatype_string("task int, run int, number long, piece string").fields, T.StructField("head", rows.schema["head"].dataType), *T._parse_datatype_string("n_bytes long, special long, entries binary").fields])

    def run(batches):
        found, task, number, held, cleared = _frequencies(tokenizer_path), TaskContext.get().partitionId(), -1, RUN, 0
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts = texts_of(part.column("text"))
                at, piece, n, special = found.of(texts)
                size = pc.binary_length(texts).cast(pa.int64())
                if held + part.nbytes > RUN or cleared != found.cleared:
                    number, held, cleared, written = number + 1, 0, found.cleared, np.zeros(0, dtype=bool)
                held += part.nbytes
                written = np.concatenate((written, np.zeros(len(found.names) - len(written), dtype=bool)))
                new = np.flatnonzero(np.bincount(piece, minlength=len(written)).astype(bool) & ~written)
                written[new] = True
                docs, words = len(texts), len(new)
                columns = [
                    pa.array(np.full(docs + words, task, dtype=np.int32)),
                    pa.array(np.full(docs + words, number, dtype=np.int32)),
                    pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(new)]),
                    pa.concat_arrays([pa.nulls(docs, pa.string()), found.names.take(pa.array(new))]),
                    part.column("head").take(pa.concat_arrays([pa.array(np.arange(docs)), pa.nulls(words, pa.int64())])),
                    pa.concat_arrays([size, pa.nulls(words, pa.int64())]),
                    pa.concat_arrays([pa.array(special.astype(np.int64)), pa.nulls(words, pa.int64())]),
                    pa.concat_arrays([_packed(piece, n, np.bincount(at, minlength=docs)), pa.nulls(words, pa.binary())]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


#: Counted entries that a task holds before it packs them by dictionary.
_HELD = 400_000


def piece_counts(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """``task, run, entries``: numbers and token counts of what dictionaries hold, packed; each distinct piece is tokenized once, where its entries meet in order."""

    def run(batches):
        tokenize = word_tokenizer(tokenizer_path).library.model.tokenize
        last, known, held, rows = None, 0, [], 0

        def packed():
            task, number_of_run, number, tokens = np.concatenate(held, axis=1)
            order = np.lexsort((number, number_of_run, task))
            task, number_of_run, number, tokens = task[order], number_of_run[order], number[order], tokens[order]
            starts = np.concatenate(([0], np.flatnonzero((task[1:] != task[:-1]) | (number_of_run[1:] != number_of_run[:-1])) + 1))
            entries = _packed(number, tokens, np.diff(np.append(starts, len(task))))
            return pa.RecordBatch.from_arrays([pa.array(task[starts].astype(np.int32)), pa.array(number_of_run[starts].astype(np.int32)), entries], names=["task", "run", "entries"])

        for batch in batches:
            if not batch.num_rows:
                continue
            piece = batch.column("piece")
            new = np.concatenate(([True], pc.not_equal(piece.slice(1), piece.slice(0, len(piece) - 1)).to_numpy(zero_copy_only=False)))
            distinct = piece.take(pa.array(np.flatnonzero(new))).to_pylist()
            counts = [known if p == last else len(tokenize(p)) for p in distinct]
            last, known = distinct[-1], counts[-1]
            held.append(np.stack([*(batch.column(c).to_numpy().astype(np.int64) for c in ("task", "run", "number")), np.array(counts, dtype=np.int64)[np.cumsum(new) - 1]]))
            rows += len(piece)
            if rows >= _HELD:
                yield packed()
                held, rows = [], 0
        if rows:
            yield packed()

    return words.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "task int, run int, entries binary")


def _summed(batches):
    """``head, n_bytes, n_tokens`` of documents, each behind the counts of its dictionary, by number."""
    of, counts = None, np.zeros(0, dtype=np.int64)
    for batch in batches:
        docs, sums = [], []
        columns = (batch.column(c).to_pylist() for c in ("task", "run", "n_bytes", "entries"))
        for k, (task, run, n_bytes, data) in enumerate(zip(*columns, strict=True)):
            numbers, n = _unpacked(data)
            if of != (task, run):
                of, counts = (task, run), np.zeros(0, dtype=np.int64)
            if n_bytes is None:
                counts = np.concatenate((counts, np.zeros(max(0, int(numbers.max(initial=-1)) + 1 - len(counts)), dtype=np.int64)))
                counts[numbers] = n
            else:
                docs.append(k)
                sums.append(int(counts[numbers] @ n))
        kept = batch.take(pa.array(docs, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column("head"), kept.column("n_bytes"), pc.add(kept.column("special"), pa.array(sums, pa.int64()))], names=["head", "n_bytes", "n_tokens"])


def token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The columns of ``df`` but the text, and ``n_bytes long``, ``n_tokens long`` and ``over_limit boolean``."""
    if tokenizer_path.endswith(".model"):
        return _by_whole_texts(df, tokenizer_path, text_col, limit)
    stored = materialize(df.sparkSession, frequencies(df, tokenizer_path, text_col), "frequencies", "zstd")
    words = stored.where("number is not null").select("task", "run", "number", "piece")
    docs = stored.where("number is null").select("task", "run", "head", "n_bytes", "special", "entries")
    met = docs.unionByName(piece_counts(words, tokenizer_path), allowMissingColumns=True).repartition("task", "run").sortWithinPartitions("task", "run", F.col("n_bytes").asc_nulls_first())
    head = stored.schema["head"].dataType
    schema = T.StructType([T.StructField("head", head), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    kept = [f.name for f in df.schema.fields]
    out = [F.col(f"head.c{k}").alias(name) for k, name in enumerate(kept) if name not in (text_col, *_NEW)]
    return met.mapInArrow(_summed, schema).select(*out, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _by_whole_texts(df: DataFrame, tokenizer_path: str, text_col: str, limit: int) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name not in (text_col, *_NEW)]
    names = [f.name for f in kept]

    def run(batches):
        counts = _whole_texts(tokenizer_path)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = texts_of(part.column(text_col))
                n = counts.totals(texts)
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), size, pa.array(n), pa.array(n > limit)], names=[*names, *_NEW])

    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return df.mapInArrow(run, schema)
