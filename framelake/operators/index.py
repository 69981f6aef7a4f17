"""Index tables, essence chunks and lookups in them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.rational import div


def edit_unit_sizes(entries: DataFrame, key: str, end: str | None = None) -> DataFrame:
    """``size``: up to the next entry's offset; for the last, up to column ``end`` (null if that is unknown or too small)."""
    w = Window.partitionBy(key).orderBy("position")
    nxt = F.lead("offset").over(w)
    last = F.when(F.col(end) >= F.col("offset"), F.col(end)) if end else F.lit(None).cast("long")
    return entries.withColumn("size", F.coalesce(nxt, last) - F.col("offset"))


def running_offsets(frames: DataFrame, key: str) -> DataFrame:
    """``offset``: the sizes of all frames before."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long")))


def constant_offsets(positions: DataFrame, start_offset: int, edit_unit_bytes: int) -> DataFrame:
    """Offsets where all edit units have one size; each is a key frame (flag 0x80)."""
    return positions.withColumns({"offset": F.lit(start_offset).cast("long") + F.col("position") * edit_unit_bytes, "flags": F.lit(0x80)})


def paired_entries(positions: DataFrame) -> DataFrame:
    """Positions in an index that has two entries (fields) for each frame: where to look, and temporal and key offsets in frames."""
    return positions.withColumns({"entry": F.col("position") * 2, "temporal": div(F.col("temporal_offset"), 2), "key": div(F.col("key_frame_offset"), 2)})


def find_segment(positions: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """The segment (start_position, duration) that holds each position, null if none does.

    Segments of one index don't overlap, so the last that starts at or before a position is the only candidate; one sort
    finds it without comparing each position with each segment.
    """
    seg = F.struct("start_position", "duration", "segment")
    left = positions.select(key, "position", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("start_position"), F.lit(None).cast("long").alias("duration"), F.lit(None).cast("long").alias("segment"))
    right = segments.select(key, F.col("start_position").alias("position"), F.lit(0).alias("_kind"), "start_position", "duration", "segment")
    w = Window.partitionBy(key).orderBy("position", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_s", F.last(F.when(F.col("_kind") == 0, seg), ignorenulls=True).over(w)).where("_kind = 1")
    hit = F.col("position") < F.col("_s.start_position") + F.col("_s.duration")
    return found.select(key, "position", F.when(hit, F.col("_s.segment")).alias("segment"))


def essence_chunks(parts: DataFrame, key: str) -> DataFrame:
    """Chunks (file_position, size) with the essence offset at which each begins."""
    w = Window.partitionBy(key).orderBy("file_position").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("essence_offset", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long")))


def file_positions(offsets: DataFrame, chunks: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """File position of essence offsets, with the columns ``keep`` of ``offsets``; null beyond the end."""
    c = F.struct("essence_offset", "file_position", "size")
    none = lambda n: F.lit(None).cast("long").alias(n)
    left = offsets.select(key, F.col("offset").alias("at"), F.lit(1).alias("_kind"), none("essence_offset"), none("file_position"), none("size"), F.struct(F.lit(0), *keep).alias("_keep"))
    right = chunks.where("size > 0").select(key, F.col("essence_offset").alias("at"), F.lit(0).alias("_kind"), "essence_offset", "file_position", "size")
    w = Window.partitionBy(key).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right, allowMissingColumns=True).withColumn("_c", F.last(F.when(F.col("_kind") == 0, c), ignorenulls=True).over(w)).where("_kind = 1")
    inside = F.col("at") - F.col("_c.essence_offset")
    return found.select(key, F.col("at").alias("offset"), F.when(inside < F.col("_c.size"), F.col("_c.file_position") + inside).alias("file_position"), *(F.col(f"_keep.{c}").alias(c) for c in keep))


def essence_offsets(positions: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Essence offset of file positions; null outside all chunks."""
    c = F.struct("file_position", "essence_offset", "size")
    none = lambda n: F.lit(None).cast("long").alias(n)
    left = positions.select(key, F.col("file_position").alias("at"), F.lit(1).alias("_kind"), none("file_position"), none("essence_offset"), none("size"))
    right = chunks.where("size > 0").select(key, F.col("file_position").alias("at"), F.lit(0).alias("_kind"), "file_position", "essence_offset", "size")
    w = Window.partitionBy(key).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_c", F.last(F.when(F.col("_kind") == 0, c), ignorenulls=True).over(w)).where("_kind = 1")
    inside = F.col("at") - F.col("_c.file_position")
    return found.select(key, F.col("at").alias("file_position"), F.when(inside < F.col("_c.size"), F.col("_c.essence_offset") + inside).alias("offset"))


def merge_variable_segments(entries: DataFrame, key: str) -> DataFrame:
    """Entries of overlapping segments (load_order): the one loaded last wins at each position."""
    return entries.groupBy(key, "position").agg(F.max_by(F.struct("offset", "load_order"), "load_order").alias("_e")).select(key, "position", "_e.offset", "_e.load_order")


def gaps(entries: DataFrame, key: str) -> DataFrame:
    """Positions after which entries are missing, and how many."""
    w = Window.partitionBy(key).orderBy("position")
    return entries.withColumn("missing", F.lead("position").over(w) - F.col("position") - 1).where("missing > 0").select(key, "position", "missing")


def _in_load_order(batches):
    """``status`` of segments (key, load_order, start, duration, ...) in order of key and load order."""
    key = end = None  # end: where the last kept one ends; -1 after one without a duration
    broken = False
    for batch in batches:
        said = []
        for k, start, duration in zip(*(batch.column(n).to_pylist() for n in ("key", "start", "duration")), strict=True):
            if end is None or k != key:
                key, end, broken = k, 0, False
            if broken:
                said.append("unread")
            elif end < 0 or start < end:
                said.append("ignored")
            elif start > end:
                said.append("sparse")
                broken = True
            else:
                said.append("kept")
                end = end + duration if duration else -1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, "status"])


def merge_constant_segments(segments: DataFrame, key: str) -> DataFrame:
    """Segments (start_position, duration, load_order) of constant edit unit size with the ``status`` that inserting them in load order gives.

    "ignored": it starts before the last kept one ends, or that one has no duration; "sparse": it starts after that (the first: after 0), which is
    an error, and the index's later ones are "unread"; else "kept".  One pass over sorted rows, with no more state than the last kept one.
    """
    rows = segments.select(F.col(key).alias("key"), "load_order", F.col("start_position").alias("start"), "duration")
    rows = rows.repartition("key").sortWithinPartitions("key", "load_order", "start", "duration")
    out = rows.mapInArrow(_in_load_order, T.StructType([*rows.schema.fields, T.StructField("status", T.StringType())]))
    return out.select(F.col("key").alias(key), "load_order", F.col("start").alias("start_position"), "duration", "status")


def split_by_size(entries: DataFrame, key: str, per_segment: int) -> DataFrame:
    """``segment``: a new one every ``per_segment`` entries."""
    w = Window.partitionBy(key).orderBy("position")
    return entries.withColumn("segment", div(F.row_number().over(w) - 1, per_segment))


def reorder_temporal(coded: DataFrame, key: str) -> DataFrame:
    """``temporal_offset`` of each display position: how far off the coded frame stands that is shown there (null if it hasn't come)."""
    shown = coded.select(key, F.col("display").alias("position"), (F.col("position") - F.col("display")).alias("temporal_offset"))
    return coded.select(key, "position").join(shown, [key, "position"], "left")


def partition_of(frames: DataFrame, interval: int) -> DataFrame:
    return frames.withColumn("partition", div(F.col("position"), interval))


def slice_deltas(elements: DataFrame, key: str) -> DataFrame:
    """Elements (slice, element, size) of a content package: ``delta`` within their slice."""
    w = Window.partitionBy(key, "slice").orderBy("element").rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn("delta", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long")))


def contiguous_runs(entries: DataFrame, key: str) -> DataFrame:
    """Maximal runs of entries that lie one after another in the file: first position, count, bytes."""
    w = Window.partitionBy(key).orderBy("position")
    starts = ~F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w) == F.col("offset"), F.lit(False))
    marked = entries.withColumn("_start", starts.cast("int")).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_run").agg(F.min("position").alias("position"), F.count("*").alias("frames"), F.sum("size").alias("bytes")).drop("_run")


def mpeg2_index(frames: DataFrame, key: str) -> DataFrame:
    """Index values from MPEG-2 frame headers (position, type, temporal_reference, gop, closed, sequence_header).

    ``key_frame_offset`` points to the key frame that decoding starts from, ``flags`` are the usual bits; the temporal
    offset of a display slot is how far the coded frame shown there stands from it.
    """
    w = Window.partitionBy(key).orderBy("position")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_key = F.col("type") == "I"
    own = F.last(F.when(is_key, F.struct("position", "temporal_reference")), ignorenulls=True).over(upto)
    with_keys = frames.withColumns({"_key": own, "_nth": F.sum(is_key.cast("int")).over(upto), "_gop": F.last(F.when(F.col("gop"), F.struct("position", "closed")), ignorenulls=True).over(upto)})
    previous = with_keys.where(is_key).select(key, (F.col("_nth") + 1).alias("_nth"), F.col("position").alias("_previous"))
    joined = with_keys.join(previous, [key, "_nth"], "left")
    leads = ~F.col("_gop.closed") & (F.col("_key.position") + F.col("_key.temporal_reference") >= F.col("position")) & F.col("_previous").isNotNull()
    offset = F.when(is_key, 0).when(leads, F.col("_previous") - F.col("position")).otherwise(F.col("_key.position") - F.col("position"))
    kind = F.when(is_key & F.col("sequence_header") & F.col("gop") & F.col("closed"), 0x80).when(F.col("type") == "P", 0x22).when(F.col("type") == "B", 0x33).otherwise(0)
    flags = F.when(F.col("sequence_header"), 0x40).otherwise(0) + kind
    display = (F.col("_gop.position") + F.col("temporal_reference")).alias("display")
    return joined.select(key, "position", "type", offset.cast("int").alias("key_frame_offset"), flags.alias("flags"), display)


def gop_statistics(frames: DataFrame, key: str) -> DataFrame:
    """Per stream: longest GOP and B run, whether B runs are of one length, all GOPs closed, and GOPs alike."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    tagged = frames.withColumns({"_g": F.sum(F.col("gop").cast("int")).over(w), "_a": F.sum((F.col("type") != "B").cast("int")).over(w)})
    runs = tagged.where(F.col("type") == "B").groupBy(key, "_a").agg(F.count("*").alias("n"))
    b = runs.groupBy(key).agg(F.max("n").alias("max_b_run"), (F.min("n") == F.max("n")).alias("constant_b"))
    types = tagged.groupBy(key, "_g").agg(F.count("*").alias("n"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("position", "type"))), lambda x: x["type"])).alias("types"), F.bool_or(F.col("gop") & F.col("closed")).alias("closed"))
    g = types.groupBy(key).agg(F.max("n").alias("max_gop"), F.bool_and("closed").alias("all_closed"), (F.count_distinct("types") == 1).alias("identical_gops"))
    return g.join(b, key, "left").select(key, F.when(F.col("max_gop") <= 65535, F.col("max_gop")).alias("max_gop"), "all_closed", "identical_gops", F.coalesce("max_b_run", F.lit(0).cast("long")).alias("max_b_run"), F.coalesce("constant_b", F.lit(True)).alias("constant_b"))


def append_entries(entries: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Entries, and plain ones for frames beyond the last indexed position, as a file that grows gets them while it is read."""
    have = entries.groupBy(key).agg((F.max("position") + 1).alias("_size"))
    new = frames.join(have, key, "left").where(F.col("position") >= F.coalesce("_size", F.lit(0)))
    plain = {c: F.lit(0) for c in ("temporal_offset", "key_frame_offset", "flags")}
    own = [key, "position", *plain, "offset"]
    return entries.select(own).unionByName(new.withColumns(plain).select(own))
