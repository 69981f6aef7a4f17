"""Line deduplication that moves hashes, not text.

Each document's lines become rows (key hash, document, hash of its text, position), written once.  These are range-partitioned by
hash, document (largest first), text and position, and sorted alike, so each partition streams its keys in turn and meets the document that
keeps the key first.  Since document and position take part in the ranges, a key that a third of all lines share
spreads over as many partitions as it fills.  Only a key that may reach over a partition's edge can't be decided there;
its lines go to a second step, in which a row for each such key (at most two for each partition) holds its totals.
The result is a compressed bitmap for each document with dropped lines.

A text splits at every newline; null and empty texts have one empty line (a null text stays null).  A key is the line
without ASCII white space at its ends and with A-Z in lower case.  Rows with equal doc_id are one document when keys are counted, but each of its
texts has a bitmap of its own, so repeated rows are treated alike and rows of other texts lose only their own lines.  Rows without
doc_id keep all lines and support no key.  Further columns pass through, whatever their names, but for ``n_lines`` and ``n_dropped``,
which give way to the results.  A line of any length counts whole; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, sliced

#: Code points that a key needs, and documents that must hold it, for its lines to be dropped.
MIN_CHARS, MIN_DOCS = 20, 3

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\x0b\x0c\r"


def line_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2`` (128-bit hash of the key), ``doc_id``, ``t`` (hash of the text) and ``pos`` (from 0) of every line whose key is long enough."""

    def run(batches):
        for batch in sliced(batches, 1):
            keys, docs, own, positions = [], [], [], []
            for doc, text, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc is None or not text:
                    continue
                for pos, line in enumerate(text.encode().translate(_LOWER).split(b"\n")):
                    key = line.strip(_SPACE)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        keys.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        own.append(t)
                        positions.append(pos)
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(docs, pa.int64()), pa.array(own, pa.int64()), pa.array(positions, pa.int32())],
                names=["h1", "h2", "doc_id", "t", "pos"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, t long, pos int")


def _stream(batches, min_docs: int):
    """From sorted rows: the lines to drop (edge false), and those of the partition's first and last key (edge true)."""
    names = ["edge", "h1", "h2", "doc_id", "t", "pos"]

    def out(edge: bool, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), edge)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)), pa.array(rows[:, 4].astype(np.int32))], names=names)

    first: tuple | None = None
    carried: list[np.ndarray] = []  # rows of the last key so far, unless that is the first
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
        first = first or (rows[0, 0], rows[0, 1])
        same = (rows[:, 0] == first[0]) & (rows[:, 1] == first[1])
        if same.any():
            yield out(True, rows[same])
            rows = rows[~same]
            if not len(rows):
                continue
        if carried and (rows[-1, :2] == carried[0][0, :2]).all():
            carried.append(rows)
            continue
        rows = np.concatenate([*carried, rows])
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        if not len(cuts):
            carried = [rows]
            continue
        carried, rows = [rows[cuts[-1] :]], rows[: cuts[-1]]
        starts = np.concatenate(([0], cuts[:-1]))
        new_doc = np.ones(len(rows), dtype=np.int64)
        new_doc[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        docs, lines = np.add.reduceat(new_doc, starts), np.diff(np.append(starts, len(rows)))
        drop = np.repeat(docs >= min_docs, lines) & (rows[:, 2] != np.repeat(rows[starts, 2], lines))
        if drop.any():
            yield out(False, rows[drop])
    if carried:
        yield out(True, np.concatenate(carried))


def _bitmaps(batches):
    """From document, text and dropped positions: how many, and a compressed bitmap with a bit for each line kept up to the last one dropped."""
    for batch in batches:
        counts, maps = [], []
        for positions in batch.column(2).to_pylist():
            drop = np.unique(np.array(positions, dtype=np.int64))
            keep = np.ones((int(drop[-1]) // 8 + 1) * 8, dtype=np.uint8)  # whole bytes, so that padding means kept
            keep[drop] = 0
            counts.append(len(drop))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "t", "n_dropped", "keep"])


def keep_bitmaps(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, t, n_dropped, keep`` for each text of a document that loses lines: bit i of ``keep`` (zlib, high bits first) stands for line i; lines beyond are kept."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("doc_id").desc(), "t", "pos"]
    hashed = materialize(spark, line_rows(df, id_col, text_col, min_chars), "hashes")  # read twice, as ranges are sampled first
    lines = hashed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = materialize(spark, lines.mapInArrow(functools.partial(_stream, min_docs=min_docs), "edge boolean, h1 long, h2 long, doc_id long, t long, pos int"), "lines")
    edges = seen.where("edge")
    totals = edges.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("owner")).where(F.col("n_docs") >= min_docs)
    late = edges.join(F.broadcast(totals), ["h1", "h2"]).where(F.col("doc_id") != F.col("owner"))  # at most two keys a partition
    drops = seen.where("not edge").select("doc_id", "t", "pos").unionAll(late.select("doc_id", "t", "pos"))
    return drops.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("drops")).mapInArrow(_bitmaps, "doc_id long, t long, n_dropped long, keep binary")


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the kept lines as its text, and ``n_lines long`` (before) and ``n_dropped long``."""
    own = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    rest = F.struct(*(F.col(f"`{c}`") for c in own if c != text_col))  # a text goes through the join and to Python once
    rows = df.select(rest.alias("row"), F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    joined = rows.join(bitmaps.select("doc_id", "t", "keep"), (F.col("d") == F.col("doc_id")) & (F.col("h") == F.col("t")), "left")
    joined = joined.select("row", "keep", "text")
    schema = T.StructType([*df.select(*own).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        for batch in sliced(batches, "text"):
            kept, n_lines, n_dropped = [], [], []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
                if packed is None:
                    kept.append(text)
                    n_lines.append(1 + (text or "").count("\n"))
                    n_dropped.append(0)
                    continue
                lines = (text or "").split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))[: len(lines)]
                gone = set(np.flatnonzero(bits == 0).tolist())
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            others = iter(batch.column("row").flatten())
            columns = [pa.array(kept, pa.string()) if c == text_col else next(others) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*own, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def dedup_lines(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(df, keep_bitmaps(spark, df, id_col, text_col, min_chars, min_docs), id_col, text_col)
