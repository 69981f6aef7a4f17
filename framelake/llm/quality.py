"""Quality scores by supervised subword embeddings.

A text's features are the hashes of its words, of pairs of words in a row (by the difference of their hashes, so that all words said twice share one), and of the 3- and 4-character pieces of its words
(which include a mark at either end).  Each feature has a learned vector; a document is the mean of its features' vectors, and
a softmax layer turns it into the probability of label 1.  Vectors and layer are fitted by stochastic gradient descent
in numpy on a bounded sample of labelled rows; every document is scored in one pass that needs no shuffle.

The softmax over two labels depends on the difference of its logits only, which is linear in the mean, so scoring looks up one
number for each feature.

Null and empty texts have no feature and get the model's prior.  Texts of any length count whole.  Repeated rows are scored alike;
of several labels of one doc_id the largest counts, of several texts the smallest.  Labels other than 0 and 1 are ignored;
without any, every score is 0.5.  Further columns pass through, whatever their names, but for ``score`` and ``predicted``, which
give way to the results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import sliced

#: Labelled rows learned from at most (those of the smallest hashes of their ids), and the probability of a good text.
TRAIN_ROWS, THRESHOLD = 4000, 0.7
#: Hash buckets (as a power of two), dimensions, passes, rows in a step, learning rate, and by what it is larger for vectors,
#: each of which has a small share in a document.
BITS, DIM, EPOCHS, BATCH, RATE, SCALE = 16, 8, 6, 16, 0.5, 100
#: Steps made at least, with more passes where rows are few.
LEAST_STEPS = 1500

_BLANK = re.compile("[\x00-\x20]+")
_POWERS = np.cumprod(np.array([1, *[0x100000001B3] * 255], dtype=np.uint64), dtype=np.uint64)
#: Characters of text turned into features at once, up to the end of a word.
_PIECE = 500_000


@dataclass
class Model:
    """One number for each bucket (its share in the difference of logits) and the difference for no features."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            total, n = 0.0, 0
            for f in features(text):
                total += float(self.weights[f].sum())
                n += len(f)
            out[i] = self.bias + (total / n if n else 0.0)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, piece: int = _PIECE):
    """Buckets of all features of a text, in arrays for pieces that end with a word; where they end changes no feature."""
    data = _BLANK.sub(" ", text or "").strip(" ")
    at, before = 0, None
    while at < len(data):
        cut = data.find(" ", at + piece)
        end = cut if cut >= 0 else len(data)
        found, before = _features(np.frombuffer(f" {data[at:end]} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64), before)
        yield found
        at = end + 1


def _features(c: np.ndarray, before: np.uint64 | None) -> tuple[np.ndarray, np.uint64]:
    """Buckets of a run of words, the pair with the word before it included, and the hash of the last word."""
    blank = c == 0x20
    edges = np.flatnonzero(blank)
    sizes = np.diff(edges)
    place = (np.arange(len(c) - 1) - np.repeat(edges[:-1], sizes)) & 255
    words = np.add.reduceat((c[:-1] + np.uint64(1)) * _POWERS[place], edges[:-1])
    inner = ~blank[1:-1]  # what stands between the ends of a piece may not be blank
    three = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
    four = three[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ c[3:]
    line = words if before is None else np.concatenate(([before], words))
    pairs = line[1:] - line[:-1]
    return np.concatenate((_bucket(words, 1), _bucket(three[inner], 2), _bucket(four[inner[:-1] & inner[1:]], 3), _bucket(pairs, 4))), words[-1]


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Fit vectors and softmax layer; label counts alone decide where a class is missing."""
    y = np.array(labels, dtype=np.int64)
    good = int(y.sum())
    if not 0 < good < len(y):
        return Model(np.zeros(1 << BITS), 0.0 if not len(y) else (5.0 if good else -5.0))
    rng = np.random.default_rng(seed)
    rows, share = [], []
    for text in texts:
        counts = np.zeros(1 << BITS, dtype=np.int64)
        for f in features(text):
            counts += np.bincount(f, minlength=1 << BITS)
        own = np.flatnonzero(counts)
        rows.append(own.astype(np.int32))
        share.append((counts[own] / max(1, counts.sum())).astype(np.float32))
    vectors = (rng.random((1 << BITS, DIM)) - 0.5) / DIM
    layer, bias = np.zeros((DIM, 2)), np.log(np.array([len(y) - good, good]) / len(y))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
    steps, done = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            own = [i for i in order[at : at + BATCH] if len(rows[i])]
            if not own:
                continue
            ids, w = np.concatenate([rows[i] for i in own]), np.concatenate([share[i] for i in own])
            doc = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
            hidden = np.add.reduceat(vectors[ids] * w[:, None], cuts, axis=0)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            back = p @ layer.T
            layer -= rate * (hidden.T @ p)
            used, where = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(where, w * back[doc, k], len(used)) for k in range(DIM)], axis=1)
            vectors[used] -= rate * SCALE * step
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents that are not held out."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)")
    chosen = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")  # at most ``rows``
    found = found.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).toArrow().sort_by("id")
    return train(found.column("text").to_pylist(), found.column("y").to_pylist())


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score double`` and ``predicted int``."""
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers

    def run(batches):
        model = shared.value
        for batch in sliced(batches, text_col):
            s = model.scores(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
