"""Target-distribution importance resampling over hashed word n-grams.

Every run of one to ``WORDS`` words is a feature, and its bucket is the CRC-32 of the words joined by spaces, modulo ``BUCKETS``.  The CRC
of each word is computed once; those of longer runs follow by algebra: appending n bytes multiplies a CRC by a 32 x 32 matrix over
GF(2), a power of the matrix for one zero byte, and adds the CRC of what was appended.  No n-gram is ever spelled out.

Two passes read the texts: one sums the buckets of the corpus and of the target, within tasks first, so no word is a hot key; the
other adds up the gains of each document.  The drawing (Gumbel noise from the document's id, so it repeats exactly) ranks scores by
ranges, never in one task.

Words are runs of letters a-z (A-Z are lower-cased), digits and characters beyond ASCII.  Null, empty and blank texts have no features
and weight 0.  Texts of any length count whole; each of repeated rows is a document of its own, and equal ones take
neighbouring ranks; a row without doc_id is drawn by the noise of the empty id, after its ties.  Further columns are ignored, whatever their names;
an empty corpus gives an empty table, an empty target leaves the corpus's frequencies alone to decide.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, slices, texts_of
from ._order import running

#: Buckets, longest run of words, least words of a document that may be drawn, percent drawn, and the seed of the noise.
BUCKETS, WORDS, LEAST, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text whose words are held at once.
_SLICE = 2_000_000

_WORD_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(0x80, 0x100))
_CLEAN = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())
_POLYNOMIAL = 0xEDB88320
_SPACE = np.uint32(zlib.crc32(b" "))


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), given by its 32 columns, times each of ``values``, whose bits are the vectors."""
    bits = (values[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits.astype(bool), matrix, np.uint32(0)), axis=1)


@functools.cache
def _shift_columns(power: int) -> np.ndarray:
    """Columns of the matrix that appends 2 ** power zero bytes to a CRC."""
    if power:
        half = _shift_columns(power - 1)
        return _times(half, half)
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        columns = (columns >> np.uint32(1)) ^ np.where(columns & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return columns


@functools.cache
def _shift_tables(power: int) -> np.ndarray:
    """The same matrix as its products with each value of each byte."""
    every = np.arange(256, dtype=np.uint32)
    return np.stack([_times(_shift_columns(power), every << np.uint32(8 * k)) for k in range(4)])


def _by_tables(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24]


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC after ``n`` further zero bytes, by the binary digits of n."""
    out = crc.copy()
    for power in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero((n >> power) & 1)
        out[at] = _by_tables(_shift_tables(power), out[at])
    return out


def append(crc: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of texts followed by a space and a word, from those of the texts and of the words of ``n`` bytes."""
    spaced = _by_tables(_shift_tables(0), crc) ^ _SPACE
    return shift(spaced, n) ^ word


def features(texts: Iterable[str | bytes], words: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature)."""
    found, counts = [], []
    for text in texts:
        own = (text.encode() if isinstance(text, str) else text).translate(_CLEAN).split()
        counts.append(len(own))
        found += own
    of = np.repeat(np.arange(len(counts)), counts)
    word = np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found))
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    crc, places, all_ = word, [of], [word % np.uint32(buckets)]
    for k in range(1, words):
        crc = append(crc[:-1], word[k:], n[k:])
        whole = of[k:] == of[: len(of) - k]  # runs that don't reach over the end of a text
        places.append(of[k:][whole])
        all_.append(crc[whole] % np.uint32(buckets))
    return np.array(counts, dtype=np.int64), np.concatenate(places), np.concatenate(all_).astype(np.int64)


def bucket_counts(df: DataFrame, text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the features of all texts by bucket, summed within tasks before the shuffle."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, _SLICE):
                total += np.bincount(features(texts_of(part.column(0)).cast(pa.binary()).to_pylist(), words, buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths: how much likelier it is in the target than in the corpus, each count raised by one."""
    all_ = spark.range(buckets).withColumnRenamed("id", "bucket")
    counts = [bucket_counts(x, text_col, words, buckets).withColumnRenamed("n", n) for x, n in ((corpus, "s"), (target, "t"))]
    rows = all_.join(counts[0], "bucket", "left").join(counts[1], "bucket", "left").fillna(0).collect()  # a row for each bucket
    table = np.array([(r.bucket, r.s, r.t) for r in rows], dtype=np.int64)
    s, t = (table[np.argsort(table[:, 0]), k].astype(np.float64) for k in (1, 2))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, _SLICE):
                n, of, bucket = features(texts_of(part.column(1)).cast(pa.binary()).to_pylist(), words, len(gain))
                weight = np.zeros(len(n), dtype=np.int64)
                np.add.at(weight, of, gain[bucket])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(np.bincount(of, minlength=len(n))), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(spark: SparkSession, weighed: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: ranks of the drawn documents, null for the others."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("open", (F.col("n_words") >= least).cast("long"))
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    scored = materialize(spark, scored.withColumn("all", F.lit(0).cast("long")), "weights")
    placed = running(spark, scored, "all", by, ["open"], "scores")
    drawn = (placed.agg(F.sum("open")).first()[0] or 0) * percent // 100
    rank = F.when((F.col("open") == 1) & (F.col("upto_open") <= drawn), F.col("upto_open"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resample(spark: SparkSession, corpus: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with weight and score, ranked where drawn towards the distribution of ``target``."""
    return draw(spark, weigh(corpus, gains(spark, corpus, target, text_col), id_col, text_col))
