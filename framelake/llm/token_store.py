"""A content-addressed store of token ids.

Layout under one folder, all Parquet, so that any file system of Spark's will do and its committer guards against lost tasks:

* ``parts/kind=chunk``  key (16-byte BLAKE2b of the ids), n_ids, width (2 or 4), data (compressed ids): each distinct chunk once
* ``recipes``           ordinal, doc_id, start, n_tokens, root (hash over the chunk hashes), chunks (in order): by ascending doc_id
* ``manifest``          level, node, n_docs, n_tokens, root: hashes over ``FAN`` nodes of the level below; the last level has one node

A rolling hash over the last ``WINDOW`` ids cuts a stream where its low bits are zero, so equal passages fall into equal
chunks wherever they stand.  Rows are taken as documents one by one: a repeated row is a document of its own (equal
doc_ids are ordered by root), a null text is empty, and a null doc_id sorts first.  Further columns are not stored, whatever
their names.  A long text is one row of many chunks; an empty table gives a store without recipes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, sliced, texts_of
from .tokenization import library_text_encoder

#: Ids that the rolling hash looks back, bits that must be zero at a cut, and the longest chunk.
WINDOW, CUT_BITS, LONGEST = 16, 10, 8192
#: Nodes under one node of the manifest.
FAN = 4096
#: Id put after each document by default.
END_ID = 1

_PART = "kind string, key binary, n_ids int, width int, data binary, doc_id long, n_tokens long, root binary, chunks array<binary>"
#: Digests that a task remembers so as not to send a chunk twice; more only means that some are sent again.
_SEEN = 500_000


def _mix(ids: np.ndarray) -> np.ndarray:
    """A 32-bit mix of each id."""
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def rolling(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the last ``WINDOW`` ids (a power of two) up to each id of streams that end at ``ends``, none looking into another.

    Mixes are rotated by their age and joined by exclusive or, so a window of twice the length takes one more step.
    """
    sizes = np.diff(ends, prepend=0)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(ends)), sizes) * (WINDOW - 1)
    h = np.zeros(len(ids) + len(ends) * (WINDOW - 1), dtype=np.uint32)  # blanks between streams
    h[at] = _mix(ids)
    width = 1
    while width < WINDOW:
        older = h[:-width]
        turned = (older << np.uint32(width)) | (older >> np.uint32(32 - width))
        h[width:] ^= turned
        width *= 2
    return h[at]


def cut_points(ids: np.ndarray, ends: np.ndarray | None = None, bits: int = CUT_BITS, longest: int = LONGEST) -> list[int]:
    """Where chunks end: after ids whose rolling hash has ``bits`` low zero bits, at the end of each stream, and every ``longest`` ids in between."""
    if not len(ids):
        return []
    ends = np.array([len(ids)]) if ends is None else ends
    found = np.flatnonzero((rolling(ids, ends) & np.uint32((1 << bits) - 1)) == 0) + 1
    out, at = [], 0
    for end in np.union1d(found, ends).tolist():
        while end - at > longest:
            at += longest
            out.append(at)
        if end > at:
            out.append(end)
            at = end
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def pack(ids: np.ndarray, compress=None) -> tuple[int, bytes]:
    """Ids of two bytes each where they suffice, else four, compressed."""
    width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    return width, (compress or zstandard.ZstdCompressor(level=3).compress)(ids.astype(f"<u{width}").tobytes())


def unpack(width: int, data: bytes, decompress=None) -> np.ndarray:
    return np.frombuffer((decompress or zstandard.ZstdDecompressor().decompress)(data), dtype=f"<u{width}").astype("<u4")


def _coded(df: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """A row for each document and, at its first sight in the task, for each chunk."""
    kinds = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    names = [x.split()[0] for x in _PART.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        encoder, task = library_text_encoder(tokenizer_path), TaskContext.get().partitionId()
        compress = zstandard.ZstdCompressor(level=3).compress
        seen: set[bytes] = set()
        ordinal = 0
        for batch in sliced(batches, 1):
            ids, ends = encoder.coded(texts_of(batch.column(1)))
            if end_id is not None:
                ids = np.insert(ids, ends, end_id).astype("<u4", copy=False)
                ends = ends + np.arange(1, len(ends) + 1)
            cuts = cut_points(ids, ends)
            rows: list[tuple] = []
            at = k = 0
            for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                start, chunks = at, []
                while at < end:
                    part = ids[at : cuts[k]]
                    at = cuts[k]
                    k += 1
                    chunks.append(h := _digest(part.tobytes()))
                    if h not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(h)
                        width, data = pack(part, compress)
                        rows.append(("chunk", h, len(part), width, data, None, None, None, None))
                own = _digest(f"{task} {ordinal}".encode())
                rows.append(("recipe", own, None, None, None, doc_id, end - start, _digest(b"".join(chunks)), chunks))
                ordinal += 1
            yield batch_of(rows)

    return df.mapInArrow(run, _PART)


def write(spark: SparkSession, df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> None:
    """Encode every text of ``df`` once and store it under ``path``, which must not exist.

    Chunks of equal hash meet after each task has dropped its own repeats, so one of many copies is no hot key.
    """
    coded = _coded(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path, end_id)
    coded.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    _order(spark, path)
    _sign(spark, path)


def _parts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_PART).parquet(f"{path}/parts").where(F.col("kind") == kind)


def _counted(batches):
    """Rows of one range in order, with the documents and ids of the range before each."""
    part, docs, ids = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        upto = ids + np.cumsum(n)
        before = [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(docs + np.arange(len(n))), pa.array(upto - n)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *before], names=[*batch.schema.names, "part", "docs_before", "ids_before"])
        if len(n):
            docs, ids = docs + len(n), int(upto[-1])


def _order(spark: SparkSession, path: str) -> None:
    """Recipes in order of doc_id, with the ids and documents before each: sums within ranges on top of the ranges' totals."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ("doc_id", "root", "key")
    recipes = _parts(spark, path, "recipe").select(*by, "n_tokens", "chunks").repartitionByRange(n, *by).sortWithinPartitions(*by)
    ranged = recipes.mapInArrow(_counted, "doc_id long, root binary, key binary, n_tokens long, chunks array<binary>, part int, docs_before long, ids_before long")
    ranged = materialize(spark, ranged, "recipes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"))  # a row for each range
    totals = totals.select("part", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids"))
    placed = ranged.join(F.broadcast(totals), "part")  # no more rows than there are shuffle partitions
    placed.select((F.col("docs") + F.col("docs_before")).alias("ordinal"), "doc_id", (F.col("ids") + F.col("ids_before")).alias("start"), "n_tokens", "root", "chunks").write.parquet(f"{path}/recipes")


def _sign(spark: SparkSession, path: str) -> None:
    """The manifest, level by level, until a single node is left."""
    level, nodes = 0, recipes(spark, path).select(F.col("ordinal").alias("node"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", F.hex("root").alias("root"))
    while True:
        nodes = _parents(nodes)
        nodes.withColumn("level", F.lit(level)).write.mode("append").parquet(f"{path}/manifest")
        nodes = manifest(spark, path).where(F.col("level") == level).drop("level")
        level += 1
        if nodes.count() <= 1:
            return


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes over at most FAN consecutive ones each."""
    return (
        nodes.groupBy((F.col("node") / FAN).cast("long").alias("node"))
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct(F.col("node").alias("at"), "root"))).alias("below"))
        .select("node", "n_docs", "n_tokens", F.sha2(F.concat_ws(" ", F.transform("below", lambda x: x["root"])), 256).alias("root"))
    )


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ordinal long, doc_id long, start long, n_tokens long, root binary, chunks array<binary>").parquet(f"{path}/recipes")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, n_docs long, n_tokens long, root string, level int").parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, doc_id, start, n_tokens, ids`` (little-endian 32-bit) of each document, put together from its chunks.

    A chunk that isn't what its hash says, a missing one and a wrong root or length end the job with an error.
    """
    refs = recipes(spark, path).select("ordinal", "doc_id", "start", "n_tokens", "root", F.size("chunks").alias("n_chunks"), F.posexplode_outer("chunks").alias("seq", "key"))
    chunks = _parts(spark, path, "chunk").select("key", "width", "data")
    rows = refs.join(chunks, "key", "left").repartition("ordinal").sortWithinPartitions("ordinal", "seq")
    names = ["ordinal", "doc_id", "start", "n_tokens", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        decompress = zstandard.ZstdDecompressor().decompress
        hashes, parts, out, held = [], [], [], 0
        for batch in sliced(batches, "data"):
            columns = (batch.column(c).to_pylist() for c in ("ordinal", "doc_id", "start", "n_tokens", "root", "n_chunks", "seq", "key", "width", "data"))
            for ordinal, doc_id, start, n_tokens, root, n_chunks, seq, key, width, data in zip(*columns, strict=True):
                if n_chunks:
                    if data is None:
                        raise ValueError(f"document {doc_id}: chunk {seq} is not in the store")
                    plain = unpack(width, data, decompress).tobytes()
                    if _digest(plain) != key:
                        raise ValueError(f"document {doc_id}: chunk {seq} is damaged")
                    hashes.append(key)
                    parts.append(plain)
                if len(hashes) < n_chunks:
                    continue
                ids = b"".join(parts)
                if len(ids) != 4 * n_tokens or _digest(b"".join(hashes)) != root:
                    raise ValueError(f"document {doc_id}: its chunks aren't those of its recipe")
                out.append((ordinal, doc_id, start, n_tokens, ids))
                hashes, parts, held = [], [], held + len(ids)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "ordinal long, doc_id long, start long, n_tokens long, ids binary")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether every node of the manifest follows from the level below it, and the first one from the recipes."""
    below, level = recipes(spark, path).select(F.col("ordinal").alias("node"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", F.hex("root").alias("root")), 0
    while True:
        want, own = _parents(below), manifest(spark, path).where(F.col("level") == level).drop("level")
        if want.exceptAll(own).unionByName(own.exceptAll(want)).limit(1).count():
            return False
        if own.count() <= 1:
            return True
        below, level = own, level + 1
