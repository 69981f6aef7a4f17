"""Near copies by exact Jaccard similarity of word shingles.

Two texts are near copies if their sets of ``SHINGLE``-word shingles have a similarity of ``SIMILARITY`` or more; groups are
closed over such links.  Candidates come from ``simhash``: classes whose fingerprints over the same shingles meet within its distance
in its grid.  At similarity 0.8 fingerprints differ in about 10 bits, often in 14, and at such distances the grid compares nearly all
pairs; those that it leaves come from MinHash: ``BANDS`` keys of ``ROWS`` minima each.  A pair of similarity 0.8 shares no key with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million.
Each candidate pair is then verified on its whole shingle sets, so no pair below the similarity links.

Equal sets are one class throughout, so groups of copies cost no pairs.  A class that shares a key is first verified against
that one of the key's classes which shares most keys with others; what this leaves in different groups is compared in full.  Likeness is told from ``MARKS`` marks: the shingles are dealt into as many bins by hash, and a mark is a byte of
the least one in its bin.  Marks are compared where the rows of a key meet, and only pairs whose marks agree in a share of
``LIKELY`` or more (which a pair of similarity 0.8 misses with probability 3 in a million at most, being 4.5 standard errors below) go on, each
under the first key that it shares.  A key that many classes share is dealt over blocks of ``BLOCK`` classes, which meet in pairs.

Words and texts of too few words are as in ``simhash``; null, empty and blank texts are copies of one another, and a text of
any length counts whole.  Rows with equal doc_id and different texts are joined through their id; of the rows of the id that
is kept, that with the smallest hash stays.  Columns of any names pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from ._common import materialize, sliced
from ._graph import components

#: Words in a shingle, similarity from which texts are near copies (a share of two whole numbers), keys of a text, and minima in a key.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, (4, 5), 32, 5
#: Marks of a text, the share of them from which a pair is verified, classes of one key in a block, and nodes sent to every task at most.
MARKS, LIKELY, BLOCK, SENT = 512, 0.72, 4096, 1_000_000

_RNG = np.random.default_rng(20)
_FLIP, _FACTOR = _RNG.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
_FACTOR |= np.uint32(1)
#: Shingles hashed, and pairs made, in one array operation.
_TILE, _PAIRS = 1024, 100_000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, shingle).astype(np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """The class of texts with this set, as a signed long."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys under which a set meets those like it."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(x), _TILE):
        np.minimum(least, ((x[at : at + _TILE] ^ _FLIP) * _FACTOR).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def marks(shingles: np.ndarray) -> np.ndarray:
    """A byte for each bin: 0 if no shingle falls into it, else from 1 to 255 by the least one there."""
    out = np.zeros(MARKS, dtype=np.uint8)
    down = shingles[::-1]  # sorted, so that the least of a bin is written last
    out[(down % np.uint64(MARKS)).astype(np.int64)] = ((down // np.uint64(MARKS)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out


def agreement(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The share of marks that are equal, of those bins that either fills."""
    filled = np.count_nonzero((others | one) != 0, axis=1)
    return np.count_nonzero((others == one) & (others != 0), axis=1) / np.maximum(filled, 1)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in (a, b))
    x = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["a", "b"])


def _bytes(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _blocks(batches):
    """Arrays of whole blocks' rows from batches in order of key, i and j."""
    held: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy() for c in ("key", "i", "j", "side", "band", "node", "group")}
        now |= {"bands": _bytes(batch.column("bands"), BANDS, np.uint32), "marks": _bytes(batch.column("marks"), MARKS, np.uint8)}
        if held:
            now = {c: np.concatenate((held[c], x)) for c, x in now.items()}
        cuts = np.flatnonzero((np.diff(now["key"]) != 0) | (np.diff(now["i"]) != 0) | (np.diff(now["j"]) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
            yield {c: x[a:b] for c, x in now.items()}
        held = {c: x[cuts[-1] :] for c, x in now.items()} if len(cuts) else now
    if held:
        yield held


def _across(batches):
    """Likely pairs of nodes in different groups from rows of blocks in order, each under the first key that it shares."""
    a, b, n = [], [], 0
    for block in _blocks(batches):
        node, group, bands, own = block["node"], block["group"], block["bands"], block["marks"]
        if (group == group[0]).all():
            continue
        band = int(block["band"][0])
        two = block["i"][0] != block["j"][0]
        first = int(np.searchsorted(block["side"], 1)) if two else len(node) - 1
        for i in range(first):
            at = (first if two else i + 1) + np.flatnonzero(group[first if two else i + 1 :] != group[i])
            if band:
                at = at[~(bands[at, :band] == bands[i, :band]).any(axis=1)]
            if len(at):
                at = at[agreement(own[i], own[at]) >= LIKELY]
                a.append(np.full(len(at), node[i]))
                b.append(node[at])
                n += len(at)
        if n > _PAIRS:
            yield _pairs(a, b)
            a, b, n = [], [], 0
    yield _pairs(a, b)


def prints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, node, keys, marks, fp`` of rows with an id."""

    def run(batches):
        for batch in sliced(batches, 1):
            sets, fps = [], []
            for t in batch.column(1).to_pylist():
                hashes = simhash.shingle_hashes(t, shingle)
                sets.append(np.unique(hashes.astype(np.uint64)))
                fps.append(simhash.fingerprint_of(hashes))
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.empty(0, dtype=np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            columns = [batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()), listed, pa.array([marks(s).tobytes() for s in sets], pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "keys", "marks", "fp"])

    rows = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, node long, keys array<long>, marks binary, fp long")


def _sets(batches, shingle: int):
    for batch in sliced(batches, 0):
        sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
        nodes = pa.array([node_of(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])


def _few(df: DataFrame) -> DataFrame:
    """Rows of a few longs each, for every task where there are at most ``SENT``."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def verified(spark: SparkSession, df: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose sets are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = materialize(spark, classes.select("node", "doc_id").join(_few(needed), "node", "left_semi"), "chosen")
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_few(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(functools.partial(_sets, shingle=shingle), "node long, shingles array<long>")
    sets = materialize(spark, sets.join(_few(chosen.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("total"))
    part, whole = SIMILARITY
    return materialize(spark, common.where(F.col("n") * whole >= (F.col("total") - F.col("n")) * part).select("a", "b"), "similar")


def printed(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """Pairs of classes (node, fp) that SimHash links: by its grid those of different fingerprints, and those of an equal one with its least node."""
    least = materialize(spark, classes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    met = simhash.links(least.select(F.col("least").alias("node"), "fp"))
    equal = classes.select("node", "fp").join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return met.unionAll(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _starred(shared: DataFrame) -> DataFrame:
    """Pairs of the node of each key that meets most others under all its keys with the key's others."""
    rank = shared.groupBy("node").agg(F.sum("held").alias("met"))
    first = shared.join(rank, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("first"))
    pairs = shared.join(first, "key").where("node <> first")
    return pairs.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct()


def _likely(shared: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Likely pairs under keys that hold several groups."""
    grouped = shared.join(groups, "node", "left").select("key", "band", "node", "held", F.coalesce("component", "node").alias("group"))
    mixed = grouped.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("key")
    n = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = grouped.join(mixed, "key", "left_semi").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = met.withColumn("side", (F.col("own") > F.col("i")).cast("int")).join(members, "node")
    rows = rows.select("key", "i", "j", "side", "band", "node", "group", "bands", "marks").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    return rows.mapInArrow(_across, "a long, b long").distinct()


def keep_one(spark: SparkSession, df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with one document of each group of near copies: that with the smallest doc_id, once; rows without doc_id stay."""
    seen = materialize(spark, prints(df, shingle), "prints")
    classes = materialize(spark, seen.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.min("fp").alias("fp")), "classes")
    keyed = classes.select("node", F.posexplode("keys").alias("band", "key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = materialize(spark, keyed.join(several, "key").select("key", "band", "node", "held"), "shared")

    links = verified(spark, df, classes, materialize(spark, _starred(shared).unionAll(printed(spark, classes)).distinct(), "pairs"), shingle)
    twice = seen.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    links = links.unionAll(seen.join(twice, "doc_id").select("a", F.col("node").alias("b")))
    groups = materialize(spark, components(spark, links), "groups")

    low = F.transform("keys", lambda k: F.lpad(F.hex(k.bitwiseAND(0xFFFFFFFF)), 8, "0"))
    members = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.unhex(F.concat_ws("", low)).alias("bands"), "marks")
    pairs = materialize(spark, _likely(shared, members, groups), "pairs")
    if pairs.limit(1).count():
        groups = components(spark, links.unionAll(verified(spark, df, classes, pairs, shingle)))

    kept = classes.select("node", "doc_id").join(groups, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    own = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*plain).alias("h")).join(kept, "doc_id", "left_semi")
    by = Window.partitionBy("doc_id").orderBy("h")
    one = own.withColumn("nth", F.row_number().over(by)).where("nth = 1").select("row.*")
    return one.unionByName(df.where("doc_id is null")).select(*df.columns)
