"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into short segments, and the numbers of one-bits in these form a vector.  Flipping a bit
moves one coordinate by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of the
fingerprints.  The segments form blocks with radii whose sum plus the number of blocks is above the distance searched;
two fingerprints within that distance then are within a block's radius in at least one block (else their distances
would add up to more).  That block is the cell of a grid: every fingerprint stands in its own cell and, for radius 1,
also probes the cells one step up in one coordinate.  In each cell true Hamming distances are computed.

A cell of more than ``CELL`` rows is cut into blocks, and each pair of blocks is compared by a task of its own.

Equal fingerprints are one class throughout, and a cell sends only edges that connect classes not yet connected in it, so groups
of copies cost neither pairs nor memory; what a cell compares falls away as soon as it belongs to a component.

Words are runs of anything but ASCII white space, with A-Z in lower case.  Texts of too few words are one shingle; null,
empty and blank texts have fingerprint zero and link like any other.  Rows with equal doc_id and different texts are
joined through their id; a row without doc_id takes its class's component (null if no row of its component has one).  Texts of any
length count whole; further columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, sliced
from ._graph import components

#: Words in a shingle, seed of its hash, bits in which linked fingerprints differ at most, and bits of a segment.
SHINGLE, SEED, DISTANCE, SEGMENT = 4, 42, 4, 2

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = (1 << 64) - 1
#: Rows of a cell that one task compares with each other.
CELL = 20_000
#: Pairs compared in one array operation.
_TILE = 2_000_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hash of each run of ``shingle`` words, as big-endian unsigned longs."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, last, strict=True)], dtype=">u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text: each bit is set if it is in over half of the shingle hashes."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of a text's shingle hashes, repeats included."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""

    def run(batches):
        for batch in sliced(batches, 1):
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks(distance: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, end, radius) of each block; radii are 0 or 1 and radii plus blocks make distance + 1."""
    n = distance // 2 + 1
    cuts = [bits * k // n for k in range(n + 1)]
    return [(cuts[k], cuts[k + 1], int(k < distance + 1 - n)) for k in range(n)]


def _cells(fp: np.ndarray, distance: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, index into fp, whether a probe) of every place of each fingerprint in the grid."""
    cells, rows, probes = [], [], []
    everyone = np.arange(len(fp))
    for b, (low, high, radius) in enumerate(blocks(distance)):
        code = np.full(len(fp), (b + 1) * 0x2545F4914F6CDD1D & _WORD, dtype=np.uint64)
        coordinates = []
        for at in range(low, high, segment):
            bits = min(segment, high - at)
            ones = np.bitwise_count((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint64)
            step = np.uint64((2 * (at + 64 * b) + 1) * 0x9E3779B97F4A7C15 & _WORD)  # a cell's number is linear in its coordinates; a clash only adds comparisons
            coordinates.append((ones, bits, step))
            code += ones * step
        cells.append(code)
        rows.append(everyone)
        probes.append(np.zeros(len(fp), dtype=bool))
        for ones, bits, step in coordinates if radius else ():
            up = np.flatnonzero(ones < bits)
            cells.append(code[up] + step)
            rows.append(up)
            probes.append(np.ones(len(up), dtype=bool))
    return np.concatenate(cells).view(np.int64), np.concatenate(rows), np.concatenate(probes)


def _near(a: np.ndarray, b: np.ndarray, distance: int):
    """Index pairs (into a, into b) of fingerprints within the distance, tile by tile."""
    step = max(1, _TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= distance)
        yield i + at, j


def _link(homes: np.ndarray, ids: np.ndarray, probes: np.ndarray, probe_ids: np.ndarray, distance: int):
    """Edges that connect what is within the distance in one cell: homes with homes, probes with homes."""
    label = np.arange(len(homes))
    open_ = np.arange(len(homes))
    while len(open_) > 1:  # all that a seed reaches becomes one component and is compared no more
        seed, open_ = open_[0], open_[1:]
        front = np.array([seed])
        while len(front) and len(open_):
            near = np.zeros(len(open_), dtype=bool)
            for _, j in _near(homes[front], homes[open_], distance):
                near[j] = True
            front = open_[near]
            open_ = open_[~near]
            label[front] = seed
    joined = np.flatnonzero(label != np.arange(len(homes)))
    yield ids[joined], ids[label[joined]]
    if not len(probes):
        return
    seeds = np.flatnonzero(label == np.arange(len(homes)))
    for i, j in _near(probes, homes[seeds], distance):
        yield probe_ids[i], ids[seeds[j]]
    for seed in np.unique(label[joined]):  # components of several: probes that their seed doesn't reach
        rest = np.flatnonzero(np.bitwise_count(probes ^ homes[seed]) > distance)
        members = np.flatnonzero(label == seed)
        hit = [i for i, _ in _near(probes[rest], homes[members], distance)]
        found = np.unique(np.concatenate(hit)) if hit else np.empty(0, dtype=np.int64)
        yield probe_ids[rest[found]], np.full(len(found), ids[seed])


def _edges(batches, distance: int):
    """Edges (a, b) of node ids from rows (cell, probe, fp, node) in order of cell, homes first."""
    carried: list[np.ndarray] = []

    def groups(rows: np.ndarray):
        a, b = [], []
        starts = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1))
        ends = np.append(starts[1:], len(rows))
        n_homes = np.add.reduceat(1 - rows[:, 1], starts)
        for k in np.flatnonzero((n_homes > 0) & (ends - starts > 1)):
            at, mid, end = starts[k], starts[k] + n_homes[k], ends[k]
            fp, ids = rows[at:end, 2].view(np.uint64), rows[at:end, 3]
            n = mid - at
            if (end - at) * n <= 4096:  # small cells in one operation
                i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :n]) <= distance)
                keep = i > j
                if keep.any():
                    a.append(ids[i[keep]])
                    b.append(ids[j[keep]])
                continue
            for x, y in _link(fp[:n], ids[:n], fp[n:], ids[n:], distance):
                a.append(x)
                b.append(y)
        x = np.stack((np.concatenate(a), np.concatenate(b)), axis=1) if a else np.empty((0, 2), dtype=np.int64)
        x = np.unique(np.stack((x.max(axis=1), x.min(axis=1)), axis=1), axis=0) if len(x) else x
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
        if carried and carried[0][0, 0] == rows[-1, 0]:
            carried.append(rows)
            continue
        rows = np.concatenate([*carried, rows])
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        carried = [rows[last:]]
        if last:
            yield groups(rows[:last])
    if carried:
        yield groups(np.concatenate(carried))


def links(nodes: DataFrame, distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """Edges ``a, b`` that connect the ``nodes`` (node, fp; fp distinct) within the distance, directly or over others."""

    def place(batches):
        for batch in batches:
            fp, node = (batch.column(k).to_numpy() for k in range(2))
            for at in range(0, len(fp), 10_000):
                cell, row, probe = _cells(fp[at : at + 10_000].view(np.uint64), distance, segment)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(probe.astype(np.int8)), pa.array(fp[at : at + 10_000][row]), pa.array(node[at : at + 10_000][row])], names=["cell", "probe", "fp", "node"])

    placed = nodes.select("fp", "node").mapInArrow(place, "cell long, probe tinyint, fp long, node long")
    large = placed.groupBy("cell").count().where(F.col("count") > CELL).select("cell", F.ceil(F.col("count") / CELL).cast("int").alias("blocks"))
    large = materialize(nodes.sparkSession, large, "cells")
    dealt = placed.join(large, "cell", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    group = F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least(block, "other"), F.greatest(block, "other")))
    sorted_ = dealt.select(group.alias("cell"), "probe", "fp", "node").repartition("cell").sortWithinPartitions("cell", "probe", "fp")
    return sorted_.mapInArrow(functools.partial(_edges, distance=distance), "a long, b long")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, fp, component_id``: a row for each of ``df``; the component is the smallest doc_id that links reach."""
    prints = materialize(spark, fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = materialize(spark, prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    several = prints.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    owned = prints.join(several, "doc_id", "left_semi").distinct().join(classes, "fp").select("doc_id", "node")
    same_id = owned.join(owned.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
    found = components(spark, links(classes, distance, segment).unionAll(same_id))
    placed = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(placed, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``df`` with one document of each group: that with the smallest doc_id, once; rows without doc_id stay."""
    kept = near_duplicates(spark, df, shingle=shingle, distance=distance).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*df.columns)
    one = df.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")  # of repeated ids the smallest row, written as text
    return one.unionByName(df.where("doc_id is null")).select(*df.columns)
