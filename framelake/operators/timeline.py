"""Alignment of sources at different rates, ordered concatenation, and range reads that include dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rational as R


def all_equal(c: Column) -> Column:
    """Aggregate: the value that every row has, else null."""
    return F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))


def min_or_unknown(c: Column) -> Column:
    """Aggregate: the least value, unknown (null) as soon as one is unknown."""
    return F.when(~F.bool_or(c.isNull()), F.min(c))


def group_summary(members: DataFrame, key: str) -> DataFrame:
    """One row for each group of members (num, den, duration, origin, start, name, complete) that play side by side.

    The lowest rate wins (compared exactly, the first of equal ones), members' durations and origins are taken to it, the
    group lasts as long as its shortest member and starts at the latest origin.
    """
    ordered = Window.partitionBy(key).orderBy(F.col("num").cast("decimal(20,0)") / F.col("den"), "member").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = members.withColumn("_num", F.first("num").over(ordered)).withColumn("_den", F.first("den").over(ordered))
    top, bottom = R.rate_factors(F.col("num"), F.col("den"), F.col("_num"), F.col("_den"))
    moved = rated.withColumn("_dur", F.when(F.col("duration").isNotNull(), R.convert_duration(F.col("duration"), top, bottom, "down")))
    moved = moved.withColumn("_org", R.convert_position(F.col("origin"), top, bottom, "up"))
    return moved.groupBy(key).agg(
        F.min("_num").alias("num"), F.min("_den").alias("den"), min_or_unknown(F.col("_dur")).alias("duration"), F.max("_org").alias("origin"),
        all_equal(F.col("start")).alias("start"), all_equal(F.col("name")).alias("name"), F.bool_and("complete").alias("complete"), F.count("*").alias("members"),
    )


def align(frames: DataFrame, key: str, cadence: Column) -> DataFrame:
    """Frames (member, position) at a higher rate as rows of the group's positions: position, member, first, samples.

    ``cadence`` is the member's cycle of edit units per group frame.
    """
    at = R.lower(F.col("position") + 1, cadence) - 1
    return frames.groupBy(key, "member", at.alias("group_position")).agg(F.min("position").alias("first"), F.count("*").alias("samples"))


def complete_rows(aligned: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Group positions with the number of members that have samples there, and whether all do."""
    n = members.groupBy(key).agg(F.count_distinct("member").alias("members"))
    have = aligned.groupBy(key, "group_position").agg(F.count_distinct("member").alias("present"), F.max("samples").alias("samples"))
    return have.join(n, key).withColumn("complete", F.col("present") == F.col("members"))


def input_groups(inputs: DataFrame) -> DataFrame:
    """Inputs (seq, material_uid, lead_filler) numbered by group in order of first sight; without a uid each is its own."""
    own = F.when(F.col("material_uid").isNull(), F.col("seq"))
    first = Window.partitionBy("material_uid", F.when(F.col("material_uid").isNotNull(), F.col("lead_filler")), own)
    return inputs.withColumn("first_seq", F.min("seq").over(first))


def concat_segments(segments: DataFrame, key: str, order: Sequence[str], to_top: int = 1, to_bottom: int = 1) -> DataFrame:
    """Segments (duration) one after another: ``offset`` in the sequence, and the ``adjustment`` from the previous one's rounding."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prior = Window.partitionBy(key).orderBy(*order)
    moved = R.convert_duration(F.col("duration"), to_top, to_bottom)
    back = F.col("duration") - R.convert_duration(moved, to_bottom, to_top)
    zero = F.lit(0).cast("long")
    return segments.withColumns({"offset": F.coalesce(F.sum(moved).over(before), zero), "adjustment": F.coalesce(F.lag(back).over(prior), zero), "moved": moved})


def locate(positions: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Each position's segment: the last whose offset isn't after it, or the first one for positions before the start.

    One sort by key and offset carries the segment along, so neither side has to be small.
    """
    cols = ["segment", "offset"]
    left = positions.select(key, "position", F.lit(1).alias("_kind"), *(F.lit(None).cast("long").alias(c) for c in cols))
    right = segments.select(key, F.col("offset").alias("position"), F.lit(0).alias("_kind"), *(F.col(c).cast("long") for c in cols))
    w = Window.partitionBy(key).orderBy("position", "_kind", "segment").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(key)
    both = left.unionByName(right)
    seen = F.last(F.when(F.col("_kind") == 0, F.struct("offset", "segment")), ignorenulls=True).over(w)
    start = F.min(F.when(F.col("_kind") == 0, F.struct("offset", "segment"))).over(first)
    return both.withColumn("_s", F.coalesce(seen, start)).where("_kind = 1").select(key, "position", F.col("_s.segment").alias("segment"), (F.col("position") - F.col("_s.offset")).alias("segment_position"))


def continuity(segments: DataFrame, key: str, order: Sequence[str], start: str, duration: str) -> DataFrame:
    """``continuous``: whether a segment starts where the previous one ended (true for the first)."""
    w = Window.partitionBy(key).orderBy(*order)
    expected = F.lag(F.col(start) + F.col(duration)).over(w)
    return segments.withColumn("continuous", F.coalesce(F.col(start) == expected, F.row_number().over(w) == 1))


def sequence_start(segments: DataFrame, key: str, order: Sequence[str], start: str, duration: str) -> DataFrame:
    """Start timecode of a sequence if known throughout and continuous, else null."""
    marked = continuity(segments, key, order, start, duration)
    return marked.groupBy(key).agg(F.when(F.bool_and("continuous") & (F.count(start) == F.count("*")), F.min_by(start, F.struct(*order))).alias("start"))


def rotate_at_midnight(segments: DataFrame, key: str, start: str, duration: str, tie: str) -> DataFrame:
    """``play_order`` from 0: by timecode, from the only discontinuity on if there is just one in the circle."""
    w = Window.partitionBy(key).orderBy(start, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.col(start) + F.col(duration)
    previous = F.coalesce(F.lag(end).over(w), F.last(end).over(whole))
    ranked = segments.withColumns({"_rank": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(key)), "_break": ~F.coalesce(previous == F.col(start), F.lit(False)), "_unknown": F.col(start).isNull()})
    all_ = Window.partitionBy(key)
    breaks, at = F.sum(F.col("_break").cast("int")).over(all_), F.max(F.when(F.col("_break"), F.col("_rank"))).over(all_)
    shift = F.when((breaks == 1) & (F.sum(F.col("_unknown").cast("int")).over(all_) == 0), at).otherwise(F.lit(0))
    return ranked.withColumn("play_order", F.pmod(F.col("_rank") - shift, F.col("_n")).cast("int")).drop("_rank", "_n", "_break", "_unknown")


def dependencies(index: DataFrame, key: str) -> DataFrame:
    """``precharge`` (<= 0) and ``rollout`` (>= 0) of each index entry (position, temporal_offset, key_frame_offset)."""
    other = index.select(key, F.col("position").alias("_at"), F.col("key_frame_offset").alias("_key"))
    joined = index.withColumn("_at", F.col("position") + F.col("temporal_offset")).join(other, [key, "_at"], "left")
    pre = F.when(F.col("temporal_offset") == 0, F.col("key_frame_offset")).when(F.col("_key").isNull(), 0).otherwise(F.col("temporal_offset") + F.col("_key"))
    return joined.withColumns({"precharge": F.least(pre, F.lit(0)), "rollout": F.greatest("temporal_offset", F.lit(0))}).drop("_at", "_key")


def available(deps: DataFrame, key: str) -> DataFrame:
    """Precharge and rollout as far as indexed positions (0 on) go."""
    last = F.max("position").over(Window.partitionBy(key))
    pre = F.greatest(F.col("position") + F.col("precharge"), F.lit(0)) - F.col("position")
    roll = F.least(F.col("position") + F.col("rollout"), last) - F.col("position")
    return deps.withColumns({"available_precharge": pre, "available_rollout": roll})


def read_range(deps: DataFrame, key: str, start: int, duration: int) -> DataFrame:
    """The window that has to be read for [start, start + duration), by key: first and last position, precharge and rollout.

    The range is clipped to what there is; a start beyond it gives no row.
    """
    size = deps.groupBy(key).agg((F.max("position") + 1).alias("size"))
    asked = size.where(F.col("size") > start).select(key, F.least(F.lit(start + duration), F.col("size")).alias("stop"))
    at = deps.join(asked, key)
    pre = F.min(F.when(F.col("position") == start, F.col("precharge")))
    roll = F.max(F.when(F.col("position") == F.col("stop") - 1, F.col("rollout")))
    return at.groupBy(key, "stop").agg(pre.alias("precharge"), roll.alias("rollout")).select(key, (F.lit(start) + F.col("precharge")).alias("first"), (F.col("stop") - 1 + F.col("rollout")).alias("last"), "precharge", "rollout", (F.col("stop") - start).alias("duration"))


def without_precharge(window: DataFrame) -> DataFrame:
    """A window that needs none: its start moves back and its duration grows by as much."""
    return window.withColumns({"start": F.col("first"), "duration": F.col("duration") - F.col("precharge")}).withColumn("precharge", F.lit(0))


def without_rollout(deps: DataFrame, key: str, start: int, duration: int) -> DataFrame:
    """The last position from the range's end on whose rollout is 0, following rollouts: a fixpoint.

    A frame's rollout points to a later position, so the chain's end is the first position q at or after the range's
    last one that no rollout from within the range passes over.
    """
    inside = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    last = start + duration - 1
    chain = deps.where(F.col("position") >= last).withColumn("_reach", F.max(F.col("position") + F.col("rollout")).over(inside))
    return chain.where(F.col("_reach") == F.col("position")).groupBy(key).agg(F.min("position").alias("last")).withColumn("duration", F.col("last") - start + 1)


def in_every_segment(tracks: DataFrame, key: str) -> DataFrame:
    """Tracks that every segment of their sequence has, with their total duration."""
    n = tracks.groupBy(key).agg(F.count_distinct("segment").alias("_n"))
    kept = tracks.groupBy(key, "track").agg(F.count_distinct("segment").alias("_has"), F.sum("duration").alias("duration"))
    return kept.join(n, key).where("_has = _n").drop("_has", "_n")


def merge_properties(tracks: DataFrame, keys: Sequence[str], properties: Sequence[str]) -> DataFrame:
    """Appended tracks as one: a property stays if all agree on it, durations add up."""
    return tracks.groupBy(*keys).agg(*(all_equal(F.col(p)).alias(p) for p in properties), F.sum("duration").alias("duration"))


def match_segments(new: DataFrame, existing: DataFrame, keys: Sequence[str], group: str | None = None) -> DataFrame:
    """First-fit pairing of a segment's tracks with a sequence's: the n-th new one with the n-th compatible existing one.

    With ``group``, rows are (group, keys, id, duration) and all pairs of a group come to one duration: that of its
    first pair, which is the first new track that any existing one is compatible with, and the first of these.
    """
    if group:
        alike = existing.groupBy(group, *keys).agg(F.min_by("duration", "old_id").alias("_d"))
        total = new.join(alike, [group, *keys]).groupBy(group).agg(F.min_by(F.col("duration") + F.col("_d"), "new_id").alias("_total"))
        new = new.join(total, group, "left").withColumn("_rest", F.col("_total") - F.col("duration"))
        existing = existing.select(group, *keys, "old_id", F.col("duration").alias("_rest"))
        keys = [group, *keys, "_rest"]
    w = lambda c: Window.partitionBy(*keys).orderBy(c)
    a = new.withColumn("_n", F.row_number().over(w("new_id")))
    b = existing.withColumn("_n", F.row_number().over(w("old_id")))
    return a.join(b, [*keys, "_n"], "left").drop("_n", "_rest", "_total")


def fill_positions(frames: DataFrame, key: str) -> DataFrame:
    """A row for every position from 0 up to the last, with 0 samples where a frame has none; frames without key or position give none, those before 0 don't count.

    Each frame brings the positions missing before it, in order, so only frames are shuffled and sorted, once, however many positions they leave.
    """
    at, none = F.col("position").cast("long"), F.lit(0).cast("long")
    there = frames.where(F.col(key).isNotNull() & (F.col("position") >= 0)).withColumn("position", at)
    before = F.coalesce(F.lag("position").over(Window.partitionBy(key).orderBy("position")), F.lit(-1).cast("long"))
    rows = there.withColumn("_from", F.least(before + 1, at)).withColumn("_at", F.explode(F.sequence("_from", "position")))  # of frames at the same position the first one brings them
    own = F.col("_at") == F.col("position")
    rest = [F.when(own, F.coalesce("samples", none)).otherwise(none).alias(c) if c == "samples" else F.when(own, F.col(c)).alias(c) for c in frames.columns if c not in (key, "position")]
    return rows.select(key, F.col("_at").alias("position"), *rest)


def misplaced_dependencies(segments: DataFrame, key: str) -> DataFrame:
    """Segments (by ``segment``) of a sequence with precharge though they aren't its first, or rollout though they aren't its last."""
    w = Window.partitionBy(key).orderBy("segment")
    first, last = F.lag("segment").over(w).isNull(), F.lead("segment").over(w).isNull()
    marked = segments.withColumns({"precharge_problem": ~first & (F.col("precharge") > 0), "rollout_problem": ~last & (F.col("rollout") > 0)})
    return marked.where("precharge_problem or rollout_problem")


def complete_sequences(inputs: DataFrame, key: str) -> DataFrame:
    """Sequences and how many of their inputs are incomplete; only those without any can be read."""
    return inputs.groupBy(key).agg(F.count_if(~F.coalesce("complete", F.lit(False))).alias("incomplete")).withColumn("readable", F.col("incomplete") == 0)


def skip_precharge(samples: DataFrame, read: str = "read", precharge: str = "precharge") -> DataFrame:
    """Samples but those of the precharge: ``read`` counts what a track has read, from 0, and begins anew after it."""
    return samples.where(F.col(read) >= F.col(precharge)).withColumn(read, F.col(read) - F.col(precharge))


def reads(tracks: DataFrame, n: int) -> DataFrame:
    """Reads of ``n`` samples each from ``start`` (below 0 in lead filler) to ``stop``: position, samples, offset of the first sample.

    Samples before position 0 aren't there, so the read that reaches it gives fewer, after an offset; those wholly before it give none.
    """
    span = tracks.where(F.col("stop") > F.greatest("start", F.lit(0))).withColumn("position", F.explode(F.expr(f"sequence(cast(start as bigint), cast(stop - 1 as bigint), {int(n)}L)")))
    skipped = F.greatest(-F.col("position"), F.lit(0).cast("long"))
    end = F.least(F.col("position") + n, F.col("stop"))
    return span.withColumns({"first_sample_offset": F.least(skipped, F.lit(n).cast("long")), "samples": F.greatest(F.lit(0).cast("long"), end - F.col("position") - skipped)})
