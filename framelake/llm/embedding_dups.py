"""Near-duplicate embeddings by random-hyperplane signs in several tables, checked by exact cosines.

Each table cuts space by ``bits`` hyperplanes; a vector's signs are its bucket.  Two vectors at the threshold fall on the same side of a
plane with probability p = 1 - angle / pi, and meet in a table with p ** bits.  There are as many tables as it takes for a pair at the
threshold to miss all of them with probability ``MISS``; nearer pairs miss far more rarely.  ``bits`` grows with the logarithm of the
largest label, so buckets of unlike vectors stay of one size.

Vectors don't travel to every table.  First only the signs do: in each bucket the rows stay that have a partner whose signs over all tables differ
in no more bits than six deviations allow at the threshold.  Their vectors then meet in that bucket, and cosines in double precision decide.
A pair counts in the first table that it shares.  Buckets above ``BLOCK`` rows are cut into blocks, each pair of which is a group of its
own; no pair leaves a group, only the number of links of a row and a spanning forest, of which components are taken.

Equal vectors of a label are one class that goes through all this once.  Vectors link only within a label (not null) and
within a length.  Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do those without a
label.  Rows without vec_id take no part; of repeated ids the smallest usable row (label, length, digest) counts.  Further columns are ignored,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize
from ._graph import components

#: Least cosine of a link, probability that a pair at it is missed, and vectors that share a bucket by chance at most, about.
COSINE, MISS, BUCKET = 0.93, 1e-4, 256
#: Rows of a bucket that are compared in one group with each other or with as many others, and pairs in one array operation.
BLOCK, _TILE = 2048, 500_000


def tables_for(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits of a table, number of tables) where ``rows`` vectors may link."""
    same = 1 - math.acos(cosine) / math.pi
    bits = max(8, math.ceil(math.log2(max(1, rows) / BUCKET)))
    return bits, math.ceil(math.log(miss) / math.log1p(-(same**bits)))


def _read(batches):
    """Digest of each vector that may link, else null, and its components as little-endian doubles, scaled to length one."""
    for batch in batches:
        ids, labels, vectors = batch.column(0), batch.column(1), batch.column(2)
        ends = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy(zero_copy_only=False)  # nulls become NaN
        null = vectors.is_null().to_numpy(zero_copy_only=False)
        sizes, keys, data = [], [], []
        for k in range(batch.num_rows):
            x = flat[ends[k] : ends[k + 1]]
            if null[k] or not len(x) or not np.isfinite(x).all() or not x.any():
                sizes.append(None), keys.append(None), data.append(None)
                continue
            x = x + 0.0  # minus zero is zero
            sizes.append(len(x)), keys.append(hashlib.sha256(x.tobytes()).digest()), data.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "size", "digest", "data"])


def _unit(column: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles out of packed components, scaled to length one."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * size * len(column) else np.float64).reshape(len(column), size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@functools.lru_cache(maxsize=16)
def _planes(size: int, n: int) -> np.ndarray:
    return np.random.default_rng((11, size)).standard_normal((n, size)).T.copy()


def _signs(batches, bits: int, tables: int):
    """Signs of all tables, packed, behind the columns of each row."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        signs = np.zeros((batch.num_rows, bits * tables), dtype=bool)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for k in range(0, len(at), 4096):
                some = at[k : k + 4096]
                signs[some] = _unit(batch.column("data").take(pa.array(some)), int(size)) @ _planes(int(size), bits * tables) > 0
        packed = np.packbits(signs, axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in packed], pa.binary())], names=[*batch.schema.names, "signs"])


def _bits_of(column: pa.Array, n: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=n)


def _buckets(signs: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each row in each table."""
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    return signs.reshape(len(signs), -1, bits).astype(np.int64) @ weights


def _place(batches, bits: int, tables: int):
    """A row for each table."""
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            part = batch.slice(at, 10_000)
            bucket = _buckets(_bits_of(part.column("signs"), bits * tables), bits)
            row = pa.array(np.repeat(np.arange(part.num_rows), tables))
            table = np.tile(np.arange(tables, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("space").take(row), pa.array(table), pa.array(bucket.ravel()), part.column("node").take(row), part.column("signs").take(row)], names=["space", "table", "bucket", "node", "signs"])


def _groups(batches, by: tuple[str, ...]):
    """Row batches that hold whole groups, of rows sorted by ``by`` (numbers), and where each group starts."""
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0] if carried is not None and carried.num_rows else batch
        starts = _starts(batch, by)
        last = int(starts[-1])
        if last:
            yield batch.slice(0, last), starts[:-1]
        carried = batch.slice(last)
    if carried is not None and carried.num_rows:
        yield carried, _starts(carried, by)


def _starts(batch: pa.RecordBatch, by: tuple[str, ...]) -> np.ndarray:
    rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by])
    return np.concatenate(([0], np.flatnonzero((rows[:, 1:] != rows[:, :-1]).any(axis=0)) + 1))


_GROUP = ("space", "table", "bucket", "i", "j")


def _pairs(block: np.ndarray, i: int, j: int, tile):
    """Places (a, b) of the pairs of a group for which ``tile(rows, others)`` holds: a before b in block i, or a in i and b in j."""
    a = np.flatnonzero(block == i)
    b = a if i == j else np.flatnonzero(block == j)
    step = max(1, _TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        x, y = np.nonzero(tile(a[at : at + step], b))
        x = x + at
        if i == j:
            x, y = x[x < y], y[x < y]
        yield a[x], b[y]


def _first_shared(buckets: np.ndarray, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Whether the pairs share no table before ``table``."""
    return ~(buckets[a, :table] == buckets[b, :table]).any(axis=1)


def _near(batches, bits: int, tables: int, most: int):
    """Rows with a partner in their group whose signs differ in at most ``most`` bits, where no earlier table has the pair."""
    for batch, starts in _groups(batches, _GROUP):
        ends = np.append(starts[1:], batch.num_rows)
        table, i, j, block = (batch.column(c).to_numpy() for c in ("table", "i", "j", "block"))
        stays = np.zeros(batch.num_rows, dtype=bool)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            signs = _bits_of(batch.column("signs").slice(s, e - s), bits * tables)
            own = np.packbits(signs, axis=1)
            words = np.pad(own, ((0, 0), (0, -own.shape[1] % 8))).view(np.uint64)
            buckets = _buckets(signs, bits)

            def differ(x, y, words=words):
                out = np.zeros((len(x), len(y)), dtype=np.uint16)
                for w in range(words.shape[1]):
                    out += np.bitwise_count(words[x, None, w] ^ words[None, y, w])
                return out <= most

            for a, b in _pairs(block[s:e], i[s], j[s], differ):
                new = _first_shared(buckets, a, b, int(table[s]))
                stays[s + a[new]] = True
                stays[s + b[new]] = True
        kept = batch.filter(pa.array(stays))
        yield pa.RecordBatch.from_arrays([kept.column(c) for c in (*_GROUP, "block", "node")], names=[*_GROUP, "block", "node"])


def _verify(batches, bits: int, tables: int, cosine: float):
    """``node, links, root``: vectors that a row links with in its group (for the first time), and the smallest node it's joined to there."""
    for batch, starts in _groups(batches, _GROUP):
        ends = np.append(starts[1:], batch.num_rows)
        table, i, j, block, node, held, size = (batch.column(c).to_numpy() for c in ("table", "i", "j", "block", "node", "held", "size"))
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            x = _unit(batch.column("data").slice(s, e - s), int(size[s]))
            buckets = _buckets(_bits_of(batch.column("signs").slice(s, e - s), bits * tables), bits)
            label, links = np.arange(e - s), np.zeros(e - s, dtype=np.int64)
            for a, b in _pairs(block[s:e], i[s], j[s], lambda p, q, x=x: x[p] @ x[q].T >= cosine):
                new = _first_shared(buckets, a, b, int(table[s]))
                a, b = a[new], b[new]
                np.add.at(links, a, held[s:e][b])
                np.add.at(links, b, held[s:e][a])
                label = _joined(label, a, b)
            some = np.flatnonzero(links)
            out.append((node[s:e][some], links[some], node[s:e][label[some]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "links", "root"])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest place in each component) after the edges a - b."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return new
        label = new


def near_duplicates(spark: SparkSession, df: DataFrame, cosine: float = COSINE, miss: float = MISS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row for each id; a component is known by its smallest id."""
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    vec = F.col(vec_col) if kind in ("float", "double") else F.col(vec_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    read = rows.mapInArrow(_read, "vec_id long, label string, size int, digest binary, data binary")
    usable = F.when(F.col("label").isNotNull() & F.col("digest").isNotNull(), F.struct("label", "size", "digest"))
    ids = materialize(spark, read.drop("data").groupBy("vec_id").agg(F.min(usable).alias("is")), "vectors")
    classes = ids.where("is is not null").groupBy("is").agg(F.min("vec_id").alias("node"), F.count("*").alias("held"))
    classes = materialize(spark, classes, "classes")
    largest = classes.groupBy("is.label", "is.size").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, cosine, miss)
    space = F.xxhash64("label", "size").alias("space")  # labels are few; numbers in place of their names
    nodes = classes.join(read, F.col("node") == F.col("vec_id")).where(F.struct("label", "size", "digest") == F.col("is")).select("node", "held", space, "size", "data").dropDuplicates(["node"])
    kinds = "node long, held long, space long, size int, data binary, signs binary"
    nodes = materialize(spark, nodes.mapInArrow(functools.partial(_signs, bits=bits, tables=tables), kinds), "signs")

    placed = nodes.select("space", "node", "signs").mapInArrow(functools.partial(_place, bits=bits, tables=tables), "space long, table int, bucket long, node long, signs binary")
    cell = ["space", "table", "bucket"]
    large = materialize(spark, placed.groupBy(*cell).count().where(F.col("count") > block).select(*cell, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    dealt = placed.join(large, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    n, same = bits * tables, 1 - math.acos(cosine) / math.pi
    most = math.ceil(n * (1 - same) + 6 * math.sqrt(n * same * (1 - same)))
    order = [*_GROUP, "block", "node"]
    where = "space long, table int, bucket long, i int, j int, block int, node long"
    met = dealt.select(*order, "signs").repartition(*_GROUP).sortWithinPartitions(*order).mapInArrow(functools.partial(_near, bits=bits, tables=tables, most=most), where)
    vectors = met.join(nodes.drop("space"), "node").select(*order, "held", "size", "data", "signs").repartition(*_GROUP).sortWithinPartitions(*order)
    found = materialize(spark, vectors.mapInArrow(functools.partial(_verify, bits=bits, tables=tables, cosine=cosine), "node long, links long, root long"), "links")

    joined = components(spark, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = classes.join(links, "node", "left").join(joined, "node", "left").select("is", (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = ids.join(whole, "is", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
