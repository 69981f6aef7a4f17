"""BPE encoding and decoding with a pair occurrence index.

All distinct pieces of a partition's batch lie in one symbol array, linked within each piece.  The index maps each
mergeable pair (named by its rank) to all positions at which it occurs.  Ranks that occur are applied in ascending
order from a heap; a merge changes at most two neighbouring pairs, whose new occurrences join the lists they belong to.
A rank that a merge brings to life below the current one is applied next, so each piece sees its own lowest rank first
and, of equal ones, the leftmost: the order that defines BPE.

Nulls and empty texts give no ids and decode to the empty text; repeated rows and ties are independent rows; columns of other
names pass through untouched, while columns ``ids`` and ``decoded`` give way to the results; a text of any length is encoded
whole (its ids have to fit into a row); an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import slices, texts_of
from .tokenization import TextEncoder, WordTokenizer, _cut, word_tokenizer

#: Symbols in one index; bounds a worker's memory, changes no result.
INDEX_SYMBOLS = 500_000
#: Bytes of text encoded at once; bounds memory alike.
TEXT = 4_000_000


class PairIndex:
    """The merges of a BPE model as sorted arrays, and the batch encoder over them."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models without byte fallback, prefixes, dropout or ignored merges")
        vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(key, kind="stable")
        self.none = len(pairs)
        self.key, self.rank = key[order], order.astype(np.int32)
        self._one = {c: i for c, i in vocab.items() if len(c) == 1}
        self._last = {c: vocab[c + self.end] for c in self._one if c + self.end in vocab}
        self._codes = np.full((2, max(map(ord, self._one)) + 1), -1, dtype=np.int32)
        for row, table in enumerate((self._one, self._last)):
            for c, i in table.items():
                self._codes[row, ord(c)] = i

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or ``none``."""
        if not self.none:
            return np.zeros(len(left), dtype=np.int32)
        want = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.key, want)
        at[at == self.none] = 0
        return np.where(self.key[at] == want, self.rank[at], self.none).astype(np.int32)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece (a non-empty run of byte-level characters)."""
        out: list[bytes] = []
        group: list[str] = []
        held = 0
        for p in pieces:
            if group and held + len(p) > INDEX_SYMBOLS:
                out += self._encode(group)
                group, held = [], 0
            group.append(p)
            held += len(p)
        return out + (self._encode(group) if group else [])

    def _encode(self, pieces: list[str]) -> list[bytes]:
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(p) for p in pieces])
        n, last = len(chars), ends - 1
        sym = self._codes[0][chars]
        sym[last] = self._codes[1][chars[last]]
        if (sym < 0).any():
            raise ValueError("a piece holds a character outside the byte-level alphabet")
        word = np.zeros(n, dtype=np.int32)
        word[ends[:-1]] = 1
        word = np.cumsum(word, dtype=np.int32)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[last] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends[:-1]] = -1
        none = self.none
        rank = np.full(n, none, dtype=np.int32)
        has = np.flatnonzero(nxt >= 0)
        rank[has] = self.ranks(sym[has], sym[has + 1])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Add positions to the lists of the ranks that stand there."""
            found = rank[at]
            keep = found < none
            if not keep.all():
                at, found = at[keep], found[keep]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, a, b in zip(found[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        note(has)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]  # a position whose pair has changed since is no longer this pair
            if not len(at):
                continue
            if len(at) > 1:
                w = word[at]
                again = w[1:] == w[:-1]
                if again.any():  # further ones in the same piece wait: this merge may bring a lower rank before them
                    again = np.concatenate(([False], again))
                    index[r] = [at[again]]
                    heapq.heappush(heap, r)
                    at = at[~again]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.new[r]
            nxt[at] = after
            rank[at] = none
            rank[gone] = none
            sym[gone] = -1
            follows = after >= 0
            prv[after[follows]] = at[follows]
            before = prv[at]
            left = np.concatenate((at[follows], before[before >= 0]))
            if len(left):
                rank[left] = self.ranks(sym[left], sym[nxt[left]])
                note(left)
        alive = sym >= 0
        return _cut(sym[alive], np.bincount(word[alive], minlength=len(pieces)))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[WordTokenizer, TextEncoder]:
    t = word_tokenizer(path)
    return t, TextEncoder(t, PairIndex(t.model).encode)


def _append(df: DataFrame, add: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with columns that ``make`` derives from each record batch; columns of these names are replaced."""
    kept = [f for f in df.schema.fields if f.name not in add]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            yield from make(batch, names)

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(k, v) for k, v in add.items())]))


def _emit(batch: pa.RecordBatch, names: list[str], path: str, text_col: str, decoded: bool):
    t, encoder = _encoder(path)
    for part in slices(batch, text_col, TEXT):
        ids, ends = encoder.coded(texts_of(part.column(text_col)))
        offsets = np.concatenate(([0], ends))
        columns = [*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))]
        if decoded:
            columns.append(pa.array([t.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), ends.tolist(), strict=True)], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", *["decoded"] * decoded])


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids array<int>``, the token ids of ``text_col`` without any added special tokens."""

    def make(batch, names):
        yield from _emit(batch, names, tokenizer_path, text_col, False)

    return _append(df, {"ids": T.ArrayType(T.IntegerType())}, make)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded string``, the text of ``ids_col``; null ids give the empty text."""

    def make(batch, names):
        t = word_tokenizer(tokenizer_path)
        out = [t.decode([i for i in x or () if i is not None]) for x in batch.column(ids_col).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, "decoded"])

    return _append(df, {"decoded": T.StringType()}, make)


def encode_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Both at once, in one pass through Python: ``ids`` and the text ``decoded`` from them."""

    def make(batch, names):
        yield from _emit(batch, names, tokenizer_path, text_col, True)

    return _append(df, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, make)
