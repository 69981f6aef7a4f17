"""The prefix trie of conversations, by prefix doubling.

Turns get dense names, then pairs of neighbouring blocks of equal names get one, in logarithmically many rounds: after round k every
aligned block of 2 ** k turns has a name, equal for equal turns.  A prefix of any length is cut into such blocks by the
binary digits of its length, so the names of these blocks are its key.  Equal prefixes of equal length are one node.

Sums over subtrees take no walk: a node's smallest member owns it, and what a conversation owns is one stretch at the end of its path.  So a
running sum along each path, from its end, holds what the path adds to every node on it, and a group-by adds up the paths.

No group needs to fit into a task.  Frequent turns, blocks and nodes are named by a broadcast of fewer than 1000 rows; paths, and the
turns of one conversation, may span many tasks.  Texts leave the scan as digests.  Of a node's ending members only the hash, which
nothing but a single reader can compute, streams through one task, as text put together by many.

Turns are ordered by turn (null first), then role, then digest of the text; equal rows all stay.  Null roles and texts are empty.  Rows without
conv_id take no part.  A conversation may be turnless after rebuilding; it then ends at the root.  Texts of any length count whole.  Further
columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize
from ._order import named, running

#: Consecutive ids of which the first lends its opening turns, and of how many lengths (from 0) the openings are.
FAMILY, OPENINGS = 20, 4
#: Decimal ids that make up one row of text on the way to a hash.
IDS = 50_000


def turns(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``digest`` of role and text, ``words``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), words.alias("words"), F.lit(1).cast("long").alias("one"))
    rows = materialize(spark, rows, "digests")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    return running(spark, rows, "conv_id", order, ["one"], "turns").select("conv_id", F.col("upto_one").alias("pos"), "digest", "words")


def rebuilt(spark: SparkSession, df: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, n``) and their turns (``conv_id, pos, digest, words``) behind the opening that their family's first one lends them."""
    rows = materialize(spark, turns(spark, df), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings
    base = F.col("conv_id") - F.col("conv_id") % family
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("taken", taken).withColumn("base", base)
    sizes = materialize(spark, sizes, "sizes")
    lender = sizes.where(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("lent"))
    lent = F.least("taken", F.coalesce("lent", F.lit(0)))
    convs = sizes.join(lender, "base", "left").select("conv_id", "base", "taken", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("n"))
    convs = materialize(spark, convs, "conversations")
    opening = rows.where((F.col("conv_id") == base) & (F.col("pos") < openings)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    first = convs.where("lent > 0").join(opening, "base").where("pos <= lent").select("conv_id", "pos", "digest", "words")
    kept = rows.where(F.col("pos") > taken).join(convs.select("conv_id", "lent", "taken"), "conv_id").select("conv_id", (F.col("pos") - F.col("taken") + F.col("lent")).alias("pos"), "digest", "words")
    return convs.select("conv_id", "n"), materialize(spark, first.unionByName(kept), "rebuilt")


def block_names(spark: SparkSession, rows: DataFrame) -> list[DataFrame]:
    """For each power of two ``conv_id, block`` (from 0), ``name, words`` (of the block's last turn): all whole aligned blocks."""
    level = named(spark, rows.select("conv_id", (F.col("pos") - 1).alias("block"), "digest", "words"), ["digest"], "names-0")
    out = [materialize(spark, level.drop("held"), "blocks-0")]
    longest = rows.agg(F.max("pos")).first()[0] or 0
    for k in range(1, longest.bit_length()):
        right = F.col("block") % 2 == 1
        halves = out[-1].groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(
            F.max(F.when(~right, F.col("name"))).alias("left"), F.max(F.when(right, F.col("name"))).alias("right"), F.max(F.when(right, F.col("words"))).alias("words"))
        pairs = materialize(spark, halves.where("left is not null and right is not null"), f"pairs-{k}")
        out.append(materialize(spark, named(spark, pairs, ["left", "right"], f"names-{k}").drop("held"), f"blocks-{k}"))
    return out


def paths(spark: SparkSession, convs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """``conv_id, depth, words, name`` of its node, and the node's ``held`` members and smallest one, ``own``: a row for each prefix of each conversation."""
    pieces = None
    for k, level in enumerate(blocks):
        # a prefix holds the block after its last 2 ** (k + 1) turns that end evenly, if its length has the digit k
        depth = F.explode(F.sequence(F.shiftleft(F.col("block") + 1, k), F.shiftleft(F.col("block") + 2, k) - 1))
        part = level.where("block % 2 = 0").select("conv_id", depth.alias("depth"), F.struct(F.lit(-k).alias("k"), "name").alias("piece"), F.when(F.col("depth") == F.shiftleft(F.col("block") + 1, k), F.col("words")).alias("words"))
        pieces = part if pieces is None else pieces.unionByName(part)
    lengths = convs.select("conv_id", F.col("n"))
    keyed = pieces.groupBy("conv_id", "depth").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.max("words").alias("words"))
    keyed = keyed.join(lengths, "conv_id").where("depth <= n").select("conv_id", "depth", F.transform("pieces", lambda p: p["name"]).alias("pieces"), "words")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.array().cast("array<long>").alias("pieces"), F.lit(0).cast("long").alias("words"))
    rows = materialize(spark, keyed.unionByName(root), "prefixes")
    # depth counts twice: as part of the key, and along the path
    found = named(spark, rows.withColumn("d", F.col("depth")), ["d", "pieces"], "nodes", F.min("conv_id").alias("own"))
    return materialize(spark, found, "paths")


def _joined_ids(batches):
    """Runs of one node's ids, in order, as decimal text joined by commas."""
    for batch in batches:
        nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at, out = 0, []
        while at < len(ids):
            end = at + 1
            while end < len(ids) and nodes[end] == nodes[at] and end - at < IDS:
                end += 1
            out.append((nodes[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())], names=["name", "first", "ids"])


def _hashed(batches):
    node, digest = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if name != node:
                out += [(node, digest.hexdigest())] if digest else []
                node, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["name", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])


def ends(spark: SparkSession, ended: DataFrame) -> DataFrame:
    """``name, ends_sha256`` from ``ended(name, conv_id)``: the ids of each node are put in order and joined by many tasks, then hashed as they stream by."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = ended.select("name", "conv_id").repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_joined_ids, "name long, first long, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name long, ends_sha256 string")


def trie(spark: SparkSession, df: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs, rows = rebuilt(spark, df, family, openings)
    path = paths(spark, convs, block_names(spark, rows))
    owned = path.where(F.col("own") == F.col("conv_id"))
    above = path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("own").alias("parent_conv_id"))
    nodes = materialize(spark, owned.join(above, ["conv_id", "depth"], "left"), "owned")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = materialize(spark, nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    own = nodes.select("conv_id", "depth", ((F.col("held") - 1) * F.col("words")).alias("saving"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    none = F.lit(0).cast("long")
    steps = path.select("conv_id", "depth", "name").join(own, ["conv_id", "depth"], "left").withColumn("saving", F.coalesce("saving", none)).withColumn("leaf", F.coalesce("leaf", none))
    steps = materialize(spark, steps, "own-steps")
    below = running(spark, steps, "conv_id", [F.desc("depth")], ["saving", "leaf"], "steps").groupBy("name").agg(F.sum("upto_saving").alias("saved_tokens"), F.sum("upto_leaf").alias("n_leaves"))
    last = ends(spark, path.join(convs, (path["conv_id"] == convs["conv_id"]) & (path["depth"] == convs["n"])).select("name", path["conv_id"]))
    out = nodes.join(below, "name").join(last, "name", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", F.col("held").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
