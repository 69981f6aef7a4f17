"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one, where order by distance is order by cosine, and cut into halves.  Each half has its
own k-means codebook, fitted on a bounded sample; a pair of codewords is a cell, and every vector is indexed in its cell.
A query walks the pairs by the sum of its squared distances to the two codewords, with a heap, until the cells seen hold
a share of all vectors.  That share is measured: for ``TESTS`` vectors the true neighbours are found by comparing with all, and the share is the one at which
``RECALL`` of them would have been seen, so data with structure take little and data without much.  Codewords grow with the root of the number
of vectors, so that a cell keeps about ``CELL`` of them, as far as the sample can tell so many apart.  These are scored exactly, in double precision, on the original vectors.

Cells larger than ``BLOCK`` are dealt over several blocks, so copies of one vector don't meet in one task.  Blocks stream
their queries past their vectors; a task keeps each query's best few.

Vectors that are null or zero, hold a null or non-finite component, or are not of the commonest length (of equally
common ones the longest) take no part; rows without an id neither.  Of repeated ids the smallest vector counts.  A
query's own id is no candidate; ties go to the smaller id.  Further columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

#: Neighbours, least codewords for each half, and vectors that these are fitted on at most.
TOP, WORDS, SAMPLE = 5, 32, 20_000
#: Vectors to a cell, about; vectors whose true neighbours are found to measure what to gather, and the share of these neighbours to reach.
CELL, TESTS, RECALL = 50, 256, 0.96
#: Vectors in a block, and queries whose best a task holds before it hands them on.
BLOCK, HELD = 4096, 100_000


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, vec`` (array<double>) of the vectors that take part, one for each id."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    sizes = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("vec") == (sizes["n"] if sizes else 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most ``k`` codewords."""
    x = np.ascontiguousarray(x)
    distinct = np.unique(x, axis=0)
    words = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = _distances(x, words).argmin(axis=1)
        n = np.bincount(own, minlength=len(words))
        sums = np.stack([np.bincount(own, x[:, d], len(words)) for d in range(x.shape[1])], axis=1)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def codebooks(vectors: DataFrame, words: int = WORDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of either half, from the ``sample`` vectors with the smallest hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
    x = unit(matrix(rows.column("vec").combine_chunks()))
    half = x.shape[1] // 2
    return k_means(x[:, :half], words) if half else np.zeros((1, 0)), k_means(x[:, half:], words)


def _cell_of(x: np.ndarray, books) -> np.ndarray:
    half = books[0].shape[1]
    return _distances(x[:, :half], books[0]).argmin(axis=1) * len(books[1]) + _distances(x[:, half:], books[1]).argmin(axis=1)


def walk(left: np.ndarray, right: np.ndarray):
    """Pairs (i, j) in ascending order of left[i] + right[j] (the multi-sequence algorithm)."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    u, v = left[a].tolist(), right[b].tolist()
    heap, open_ = [(u[0] + v[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(u) and j2 < len(v) and (i2, j2) not in open_:
                open_.add((i2, j2))
                heapq.heappush(heap, (u[i2] + v[j2], i2, j2))


def _moderate(x: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two each, which loses nothing, so that squares stay within doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with many, each summed in the same way whatever else is in the block."""
    q, x = _moderate(q), _moderate(x)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def words_for(n: int, sample: int = SAMPLE) -> int:
    """Codewords of each half for ``n`` vectors; each takes 20 vectors of the sample at least."""
    return max(WORDS, min(math.isqrt(n // CELL), sample // 20))


def gather_for(placed: DataFrame, books, held: dict[int, int], top: int = TOP, tests: int = TESTS, recall: float = RECALL) -> float:
    """The share of all vectors after which ``recall`` of the true neighbours of ``tests`` vectors are seen.

    ``placed`` has vec_id, cell and vec; each task keeps the best ``top`` for each test vector, so ``tests`` times ``top`` rows reach the driver.
    """
    chosen = placed.orderBy(F.xxhash64("vec_id", F.lit("tests")), "vec_id").limit(tests).toArrow().combine_chunks()
    ids, x = chosen.column("vec_id").to_numpy(), unit(matrix(chosen.column("vec").combine_chunks()))

    def compare(batches):
        best: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, cell = (batch.column(c).to_numpy() for c in ("vec_id", "cell"))
            near = x @ unit(matrix(batch.column("vec"))).T
            near[ids[:, None] == own[None, :]] = -2
            some = np.argsort(-near, axis=1, kind="stable")[:, :top]
            for q, places in enumerate(some):
                best[q] = heapq.nsmallest(top, [*best[q], *((-float(near[q, k]), int(own[k]), int(cell[k])) for k in places if near[q, k] > -2)])
        rows = [(q, -s, v, c) for q, found in enumerate(best) for s, v, c in found]
        q, score, vec, cell = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.float64()), pa.array(vec, pa.int64()), pa.array(cell, pa.int32())], names=["q", "score", "vec_id", "cell"])

    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = placed.select("vec_id", "cell", "vec").mapInArrow(compare, "q int, score double, vec_id long, cell int")
    wanted: dict[int, list[int]] = {}
    for r in found.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= top).select("q", "cell").collect():
        wanted.setdefault(r["q"], []).append(r["cell"])
    half, total, shares = books[0].shape[1], sum(held.values()), []
    left, right = _distances(x[:, :half], books[0]), _distances(x[:, half:], books[1])
    for q, cells in wanted.items():
        seen, left_over = 0, list(cells)
        for a, b in walk(left[q], right[q]):
            cell = a * len(books[1]) + b
            seen += held.get(cell, 0)
            shares += [seen / total] * left_over.count(cell)
            left_over = [c for c in left_over if c != cell]
            if not left_over:
                break
    return float(np.quantile(shares, recall, method="higher")) if shares else 1.0


def _rank(batches, top: int):
    """The best of each query from rows (cell, sub, kind, vec_id, vec) in this order, vectors (kind 0) before queries (1)."""
    best: dict[int, list[tuple[float, int]]] = {}
    block, ids, vecs = None, [], []
    ready = None

    def out():
        rows = [(q, v, -s) for q, found in best.items() for s, v in found]
        best.clear()
        q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, sub, kind, vec_id = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
        x = matrix(batch.column(4))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(sub) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
            if (cell[a], sub[a]) != block:
                block, ids, vecs, ready = (cell[a], sub[a]), [], [], None
            if kind[a] == 0:
                ids.append(vec_id[a:b])
                vecs.append(x[a:b])
                continue
            if not ids:
                continue
            if ready is None:
                own, raw = np.concatenate(ids), np.concatenate(vecs)
                ready = own, raw, unit(raw)
            own, raw, scaled = ready
            for at in range(a, b, 256):
                near = unit(x[at : min(b, at + 256)]) @ scaled.T
                n = min(top + 1, near.shape[1])
                floor = np.partition(near, -n, axis=1)[:, -n] - 1e-9
                for row in range(len(near)):
                    q = int(vec_id[at + row])
                    held = best.get(q, [])
                    lowest = floor[row] if len(held) < top else max(floor[row], -held[-1][0] - 1e-9)
                    found = np.flatnonzero(near[row] >= lowest)
                    found = found[own[found] != q]
                    if len(found):
                        scores = _exact(x[at + row], raw[found])
                        best[q] = heapq.nsmallest(top, [*held, *zip((-scores).tolist(), own[found].tolist(), strict=True)])
            if len(best) >= HELD:
                yield out()
    yield out()


def nearest(spark: SparkSession, df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, words: int | None = None, sample: int = SAMPLE, gather: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest found for every id for which ``is_query`` (a Column of vec_id) holds.

    ``words`` and ``gather`` follow from the vectors unless they are given.
    """
    vectors = materialize(spark, usable(df, id_col, vec_col), "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = vectors.count()
    if not n:
        return none
    books = codebooks(vectors, words or words_for(n, sample), sample)
    shared = spark.sparkContext.broadcast(books)  # words of either half

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cell = _cell_of(unit(matrix(batch.column("vec"))), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cell.astype(np.int32)), batch.column("vec")], names=["vec_id", "cell", "vec"])

    placed = materialize(spark, vectors.mapInArrow(place, "vec_id long, cell int, vec array<double>"), "cells")
    held = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most words squared
    subs = {c: -(-n // BLOCK) for c, n in held.items()}
    gather = gather_for(placed, books, held, top) if gather is None else gather
    need, wide = max(top + 1, gather * sum(held.values())), len(books[1])

    def visit(batches):
        half = shared.value[0].shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("vec")))
            left, right = _distances(x[:, :half], shared.value[0]), _distances(x[:, half:], shared.value[1])
            rows, cells, parts = [], [], []
            for i in range(len(x)):
                got = 0
                for a, b in walk(left[i], right[i]):
                    cell = a * wide + b
                    n = held.get(cell, 0)
                    if n:
                        rows += [i] * subs[cell]
                        cells += [cell] * subs[cell]
                        parts += range(subs[cell])
                        got += n
                        if got >= need:
                            break
                if len(rows) >= 5_000 or i == len(x) - 1:
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(parts, pa.int32()), pa.array([1] * len(rows), pa.int32()), part.column("vec_id"), part.column("vec")], names=["cell", "sub", "kind", "vec_id", "vec"])
                    rows, cells, parts = [], [], []

    blocks = np.ones(len(books[0]) * wide, np.int32)
    blocks[list(subs)] = list(subs.values())
    n_subs = F.get(F.lit(blocks), F.col("cell"))  # one literal, whatever the number of cells
    entries = placed.select("cell", F.pmod(F.xxhash64("vec_id"), n_subs).cast("int").alias("sub"), F.lit(0).alias("kind"), "vec_id", "vec")
    queries = placed.where(is_query).select("vec_id", "vec").mapInArrow(visit, "cell int, sub int, kind int, vec_id long, vec array<double>")
    ordered = entries.unionAll(queries).repartition("cell", "sub").sortWithinPartitions("cell", "sub", "kind", "vec_id")
    best = ordered.mapInArrow(functools.partial(_rank, top=top), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(by).alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
