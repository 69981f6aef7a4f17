"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens that leaves some positions out, so two passages share its hash although
tokens at these positions differ.  Hashes of the test items and of the training texts are joined; each hit says at which
offset an item may lie in a text, and there tokens are compared one by one.  An overlap is the stretch of most equal tokens among
those in which they have a share of ``MIN_SHARE`` or more, without unequal ones at its ends; it is reported from ``MIN_MATCHED``
equal tokens on.  An item of 7 to 14 tokens needs the share ``short_share`` of its own, and all but two (by default every one, as far as ``MIN_MATCHED``
goes); what it takes is proved in the tests: every such overlap holds one of the masks, or the short one, which those items are hashed by as well.

A Bloom filter over the hashes of the items, of bounded size, tells which hashes of a text are worth joining.  Where the
items are few (a checked bound) each task joins and verifies against a broadcast copy, so nothing is shuffled and
a passage that a third of all texts hold is no hot key.  Beyond that bound, the texts' stretches around
hits are joined by hash and by item in shuffles, which adaptive execution splits where they are skewed.

Tokens are runs of anything but white space, in lower case, without ASCII punctuation at the ends; tokens of
punctuation alone don't count.  Null and empty texts match nothing; rows without an id are left out; of repeated rows the
best overlap is reported once, of equally good ones the first in the text.  An item of fewer tokens than the shortest mask is
hashed whole and matches where all its tokens stand in a row; one of fewer than ``RUN`` tokens matches only texts that hold nothing else.
Texts of any length are searched whole; further columns are ignored, whatever their names; an empty table gives no overlap.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, sliced

#: Fixed masks: 1 for a token that counts, 0 for one that may differ.  One of them fits in every overlap that suffices, tried for all of 13 to 25 tokens.
MASKS = ("1110111", "11011011", "110101011", "1110010011")
#: Any 4 tokens in a row: with the masks it fits in every overlap of an item of 7 to 14 tokens with two changed at most, and a share of 0.8.
SHORT_MASK = "1111"
#: Fewest tokens of an item that is looked for inside longer texts.
RUN = 3
#: Equal tokens that an overlap needs, and their share in it.
MIN_MATCHED, MIN_SHARE = 13, 0.8
#: Share of its tokens that an item of 7 to 14 tokens needs where substitutions in it are looked for.
SHORT_SHARE = 0.8
#: Tokens of all items up to which they are broadcast, and the most bits of the filter.
BROADCAST_TOKENS, FILTER_BITS = 2_000_000, 1 << 27

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = (1 << 64) - 1
_OUT = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_matched int"


class _Tokens(dict):
    """64-bit hashes of tokens as they stand in a text; 0 for those that don't count."""

    def __missing__(self, token):
        if len(self) > 300_000:
            self.clear()
        own = token.lower().strip(_PUNCTUATION)
        h = self[token] = xxhash.xxh3_64_intdigest(own.encode()) | 1 if own else 0
        return h


def token_hashes(text: str | None, known: _Tokens) -> np.ndarray:
    words = (text or "").split()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    return h[h != 0]


_LEAST = min(map(len, MASKS))


def needed(n: int, short_share: float = 1.0) -> int:
    """Equal tokens that an overlap with an item of ``n`` tokens needs."""
    return n if n < _LEAST else min(MIN_MATCHED, max(-(-round(100 * short_share) * n // 100), n - 2))


def shapes_of(sizes: Iterable[int], short_share: float = 1.0) -> list[tuple[int, str]]:
    """Numbered shapes to look for: the masks, the short one if an item calls for it, and, for each length of a shorter item, all of it."""
    sizes = {int(n) for n in sizes}
    short = [(len(MASKS), SHORT_MASK)] if any(n >= _LEAST and needed(n, short_share) < min(MIN_MATCHED, n) for n in sizes) else []
    return [*enumerate(MASKS), *short, *((100 + n, "1" * n) for n in sorted(n for n in sizes if 0 < n < _LEAST))]


def own_shapes(n: int, short_share: float = 1.0) -> list[tuple[int, str]]:
    """The shapes of an item of ``n`` tokens."""
    return shapes_of([n], short_share) if n >= _LEAST else shapes_of([n])[len(MASKS) :]


def seed_hashes(tokens: np.ndarray, mask: int, shape: str) -> np.ndarray:
    """The hash of the shape of number ``mask`` at every position where it fits."""
    n = len(tokens) - len(shape) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, mask + 1, dtype=np.uint64)
    for k, kept in enumerate(shape):
        if kept == "1":
            h = (h ^ tokens[k : k + n]) * np.uint64((0x9E3779B97F4A7C15 + 2 * k) & _WORD)
            h ^= h >> np.uint64(32)
    return h


def _probes(h: np.ndarray, bits: int) -> Iterable[np.ndarray]:
    """Three places of each hash in a filter of ``bits`` (a power of two)."""
    for k in range(3):
        yield ((h >> np.uint64(21 * k)) ^ (h >> np.uint64(60))) & np.uint64(bits - 1)


@dataclass
class Filter:
    bits: int
    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        """Where ``h`` may be one of the items' hashes."""
        at = None
        for p in _probes(h, self.bits):
            p = p if at is None else p[at]
            hit = np.flatnonzero((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1))
            at = hit if at is None else at[hit]
            if not len(at):
                break
        return at


@dataclass
class Items:
    """All items: tokens one after another, and their seed hashes in order."""

    ids: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], short_share: float = 1.0) -> Items:
        known = _Tokens()
        tokens = [token_hashes(t, known) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens], dtype=np.int64)))
        found = [(h, i) for i, t in enumerate(tokens) for m, shape in own_shapes(len(t), short_share) if len(h := seed_hashes(t, m, shape))]
        hashes = np.concatenate([h for h, _ in found]) if found else np.empty(0, np.uint64)
        item = np.concatenate([np.full(len(h), i) for h, i in found]) if found else np.empty(0, np.int64)
        position = np.concatenate([np.arange(len(h)) for h, _ in found]) if found else np.empty(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        return cls(np.array(ids, dtype=np.int64), starts, np.concatenate(tokens) if tokens else np.empty(0, np.uint64), hashes[order], item[order], position[order])

    def of_item(self, i: int) -> np.ndarray:
        return self.tokens[self.starts[i] : self.starts[i + 1]]


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, short_share: float = 1.0) -> tuple[int, int, int, int] | None:
    """(start in doc, start in item, tokens, equal ones) of the best stretch where item[i] lies at doc[i + shift], if it suffices."""
    a, b, least = max(0, -shift), min(len(item), len(doc) - shift), needed(len(item), short_share)
    if b <= a:
        return None
    same = item[a:b] == doc[a + shift : b + shift]
    at = np.flatnonzero(same)
    if len(at) < least:
        return None
    equal = np.concatenate(([0], np.cumsum(same)))
    sums = equal * 100 - round(MIN_SHARE * 100) * np.arange(len(equal))  # not lower at a stretch's end than at its start if the share suffices
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums)  # the earliest start for each end
    counts = equal - equal[first]
    matched = int(counts.max())
    if matched < least:
        return None
    ends = equal[counts == matched]
    starts, lengths = at[ends - matched], at[ends - 1] + 1 - at[ends - matched]
    k = int(np.argmin(lengths))
    return a + int(starts[k]) + shift, a + int(starts[k]), int(lengths[k]), matched


def _best(found: dict, key, hit) -> None:
    if hit and (key not in found or (-hit[3], hit) < (-found[key][3], found[key])):
        found[key] = hit


def _build_filter(hashes: DataFrame, count: int) -> Filter:
    """The filter over a column ``h``; words without a bit aren't sent, and there are at most FILTER_BITS / 64."""
    bits = 1 << 20
    while bits < 128 * count and bits < FILTER_BITS:
        bits *= 2

    def places(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(list(_probes(h, bits)))).astype(np.int64))], names=["at"])

    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = hashes.select("h").mapInArrow(places, "at long").groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(bits, words)


def _local_filter(h: np.ndarray) -> Filter:
    bits = 1 << 20
    while bits < 128 * len(h) and bits < FILTER_BITS:
        bits *= 2
    words = np.zeros(bits // 64, dtype=np.uint64)
    for p in _probes(h, bits):
        np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
    return Filter(bits, words)


def _rows(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=ids)


_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def overlaps(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_tokens: int = BROADCAST_TOKENS, short_share: float = 1.0) -> DataFrame:
    """A row for each text and item that overlap: where in either, over how many tokens, how many of them equal."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]  # no fewer than twice the tokens
    found = (_broadcast if size <= 2 * broadcast_tokens else _shuffled)(spark, docs, items, short_share)
    order = F.struct(-F.col("n_matched"), "doc_start", "item_start", "n_tokens")
    best = found.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("doc_start", "item_start", "n_tokens", "n_matched"), order).alias("o"))
    return best.select("doc_id", "item_id", "o.*")


def _broadcast(spark: SparkSession, docs: DataFrame, items: DataFrame, short_share: float) -> DataFrame:
    rows = items.orderBy("item_id", "text").toArrow()
    known = Items.of(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), short_share)
    shared = spark.sparkContext.broadcast((known, _local_filter(known.hashes)))

    def run(batches):
        known, seen = shared.value
        memo = _Tokens()
        shapes = shapes_of(np.diff(known.starts).tolist(), short_share)
        for batch in sliced(batches, 1):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = token_hashes(text, memo)
                shifts: set[tuple[int, int]] = set()
                for m, shape in shapes:
                    h = seed_hashes(tokens, m, shape)
                    at = seen.has(h) if len(h) else h
                    if len(at):
                        low, high = np.searchsorted(known.hashes, h[at]), np.searchsorted(known.hashes, h[at], side="right")
                        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                            shifts.update((i, p - q) for i, q in zip(known.item[a:b].tolist(), known.position[a:b].tolist(), strict=True))
                best: dict = {}
                for i, shift in shifts:
                    if len(known.of_item(i)) < RUN and len(tokens) != len(known.of_item(i)):
                        continue
                    _best(best, int(known.ids[i]), overlap(tokens, known.of_item(i), shift, short_share))
                out += [(doc_id, i, *hit) for i, hit in best.items()]
            yield _rows(_NAMES, out)

    return docs.mapInArrow(run, _OUT)


def _shuffled(spark: SparkSession, docs: DataFrame, items: DataFrame, short_share: float) -> DataFrame:
    def split(batches):
        memo = _Tokens()
        for batch in sliced(batches, 1):
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = token_hashes(text, memo)
                for m, shape in own_shapes(len(t), short_share):
                    h = seed_hashes(t, m, shape)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item_id)), pa.array(np.arange(len(h), dtype=np.int32))], names=["h", "item_id", "position"])

    def tokens(batches):
        memo = _Tokens()
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([token_hashes(t, memo).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["item_id", "item"])

    seeds = materialize(spark, items.mapInArrow(split, "h long, item_id long, position int"), "seeds")
    seen = spark.sparkContext.broadcast(_build_filter(seeds, seeds.count()))
    sizes = items.mapInArrow(tokens, "item_id long, item array<long>").select(F.size("item").alias("n"))
    longest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    kinds = sizes.where(F.col("n") < max(_LEAST, MIN_MATCHED + 3)).distinct().collect()  # a few lengths at most
    shapes = shapes_of([r["n"] for r in kinds], short_share)

    def stretches(batches):
        memo = _Tokens()
        for batch in sliced(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = token_hashes(text, memo)
                hits = [(int(p), int(h[p])) for m, shape in shapes if len(h := seed_hashes(t, m, shape)) for p in seen.value.has(h)]
                if not hits:
                    continue
                hits.sort()
                positions = np.array([p for p, _ in hits])
                cuts = [0, *(np.flatnonzero(np.diff(positions) > 2 * longest) + 1).tolist(), len(hits)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    start, end = max(0, int(positions[a]) - longest), int(positions[b - 1]) + longest
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": doc_id, "start": start, "size": len(t), "doc": t[start:end].view(np.int64), "hits": [{"h": h - (1 << 64) if h >> 63 else h, "p": p} for p, h in hits[a:b]]}],
                        schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("doc", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32())])))]),
                    )

    spans = materialize(spark, docs.mapInArrow(stretches, "doc_id long, start int, size int, doc array<long>, hits array<struct<h:long,p:int>>").withColumn("span", F.xxhash64("doc_id", "start", "doc")), "spans")
    hits = spans.select("doc_id", "span", F.explode("hits").alias("hit")).select("doc_id", "span", "hit.h", "hit.p").join(seeds, "h")
    pairs = hits.select("doc_id", "span", "item_id", (F.col("p") - F.col("position")).alias("shift")).distinct()
    texts = items.mapInArrow(tokens, "item_id long, item array<long>")
    both = pairs.join(texts, "item_id").join(spans.select("doc_id", "span", "start", "size", "doc").distinct(), ["doc_id", "span"])

    def verify(batches):
        for batch in batches:
            out = []
            (docs_, doc_ends), (items_, item_ends) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("doc"), batch.column("item")))
            rows = (batch.column(c).to_pylist() for c in ("doc_id", "item_id", "shift", "start", "size"))
            for k, (doc_id, item_id, shift, start, size) in enumerate(zip(*rows, strict=True)):
                item = items_[item_ends[k] : item_ends[k + 1]]
                hit = overlap(docs_[doc_ends[k] : doc_ends[k + 1]], item, shift - start, short_share)
                if hit and (len(item) >= RUN or size == len(item)):
                    out.append((doc_id, item_id, hit[0] + start, *hit[1:]))
            yield _rows(_NAMES, out)

    return both.select("doc_id", "item_id", "shift", "start", "size", "doc", "item").mapInArrow(verify, _OUT)


def remove(spark: SparkSession, df: DataFrame, items: DataFrame, short_share: float = 1.0) -> DataFrame:
    """``df`` without the documents that overlap an item."""
    return df.join(overlaps(spark, df, items, short_share=short_share).select("doc_id").distinct(), "doc_id", "left_anti").select(*df.columns)
