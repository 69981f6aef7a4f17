"""Clips, tracks and packages: selection, order, and the joins between packages."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rational import convert_position, rate_factors
from .spread import spread


#: Types that a user may declare to be D-10.
ASSUMABLE = ("Picture", "MPEG-2 Long GOP 422P@ML 576i")


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """``0-3,5`` as pairs; a range whose first is above its last is invalid."""
    out = []
    for part in text.split(","):
        first, _, last = part.strip().partition("-")
        pair = int(first), int(last or first)
        if pair[0] > pair[1]:
            raise ValueError(f"{part.strip()}: first is above last")
        out.append(pair)
    return out


def disable(tracks: DataFrame, index: str, ranges: Sequence[tuple[int, int]] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """Tracks but those of the given indexes and kinds."""
    off = F.col("kind").isin(*kinds) if kinds else F.lit(False)
    for a, b in ranges:
        off = off | F.col(index).between(a, b)
    return tracks.where(~off)


def track_order(number: str, track_id: str, kind: str | None = None) -> list[Column]:
    """Order by kind, track number and id, where 0 comes last."""
    return [*([F.col(kind)] if kind else []), F.col(number) == 0, F.col(number), F.col(track_id) == 0, F.col(track_id)]


def ranked(tracks: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return tracks.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def resolve_chain(spark: SparkSession, clips: DataFrame, wanted: str) -> DataFrame:
    """Follow source clips (id, ref, kind, num, den, origin, offset) to a package of kind ``wanted``.

    Each hop takes the offset to the next one's rate and adds its origin; a clip that refers to itself ends its chain.
    Hops are joins, so all chains advance together, until none is live; each is checkpointed, which cuts its lineage.
    A circle comes back to each of its clips, which raises ValueError.
    """
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="framelake-"))
    nodes = clips.select(F.col("id").alias("_id"), F.col("ref").alias("_ref"), F.col("kind").alias("_kind"), F.col("num").alias("_num"), F.col("den").alias("_den"), F.col("origin").alias("_origin"), F.col("offset").alias("_step"))
    live = clips.select(F.col("id").alias("start"), "id", "ref", "num", "den", F.col("offset").cast("long").alias("offset"), F.lit(0).alias("hops"))
    found, hop = None, 0
    while True:
        hop += 1
        live = live.where("ref is not null and ref <> id").join(nodes, F.col("ref") == F.col("_id"))
        top, bottom = rate_factors(F.col("num"), F.col("den"), F.col("_num"), F.col("_den"))
        live = live.select("start", F.col("_id").alias("id"), F.col("_ref").alias("ref"), F.col("_kind").alias("kind"), F.col("_num").alias("num"), F.col("_den").alias("den"), (convert_position(F.col("offset"), top, bottom) + F.col("_origin")).alias("offset"), F.lit(hop).alias("hops"))
        live = live.checkpoint()
        hit = live.where(F.col("kind") == wanted).select("start", F.col("id").alias("target"), "offset", "hops")
        found = hit if found is None else found.unionByName(hit)
        live = live.where(F.col("kind") != wanted).drop("kind")
        left, circle = live.agg(F.count("*"), F.min(F.when((F.col("id") == F.col("start")) & (F.col("ref") != F.col("id")), F.col("start")))).first()
        if circle is not None:
            raise ValueError(f"the chain of {circle} comes back to it")
        if not left:
            return found


def source_packages(clips: DataFrame, packages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source clips with the package and track they name; a clip may match several."""
    return spread(clips, *keys).join(packages, [*keys])


def essence_containers(essence: DataFrame, packages: DataFrame, uid: str) -> DataFrame:
    """Essence and its file package; ``ambiguous`` where several containers beside timed text claim one."""
    joined = essence.join(packages, uid)
    n = F.sum((F.col("kind") != "timed_text").cast("int")).over(Window.partitionBy(uid))
    return joined.withColumn("ambiguous", n > 1)


def kind_conflicts(packages: DataFrame, uid: str, kind: str) -> DataFrame:
    """Package ids that stand for packages of different kinds."""
    return packages.groupBy(uid).agg(F.count_distinct(kind).alias("kinds")).where("kinds > 1")


def segmentation(parts: DataFrame, key: str, total: str) -> DataFrame:
    """Parts (start, duration) up to the clip's end: a filler after each gap, the last part extended by column ``total``."""
    w = Window.partitionBy(key).orderBy("start")
    nxt = F.coalesce(F.lead("start").over(w), F.col(total))
    gap = nxt - F.col("start") - F.col("duration")
    own = parts.select(key, "start", "duration", F.lit(False).alias("filler"))
    fill = parts.withColumn("_gap", gap).where("_gap > 0").select(key, (F.col("start") + F.col("duration")).alias("start"), F.col("_gap").alias("duration"), F.lit(True).alias("filler"))
    return own.unionByName(fill)


def past_midnight(code: Column, start: Column, day: Column) -> Column:
    """Position of a timecode after the start, which may lie before midnight."""
    return F.when(code < start, code + day).otherwise(code) - start


def essence_kind(kinds: dict[str, str], essence: Column) -> Column:
    """Picture, sound or data by essence type."""
    made = F.lit(None).cast("string")
    for name, kind in kinds.items():
        made = F.when(essence == name, kind).otherwise(made)
    return made


def sampled(frames: DataFrame, keys: Sequence[str], n: int = 2) -> DataFrame:
    """The first ``n`` frames of each track, from which a few properties are read."""
    return frames.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).where(F.col("_n") <= n).drop("_n")


def assumed_type(essence: Column, is_mpeg_video: Column, assumed: str) -> Column:
    """Essence type by a user's word for it: generic or 576-line long-GOP pictures in an MPEG video container are ``assumed``."""
    return F.when(essence.isin(*ASSUMABLE) & is_mpeg_video, F.lit(assumed)).otherwise(essence)


def segment_totals(parts: DataFrame, key: str) -> DataFrame:
    """Segments that aren't filler, and the sum of their known durations."""
    return parts.groupBy(key).agg(F.count_if(~F.col("filler")).alias("segments"), F.coalesce(F.sum(F.when(~F.col("filler"), F.col("duration"))), F.lit(0).cast("long")).alias("duration"))


def file_ids(tracks: DataFrame, key: str, internal: bool = False) -> DataFrame:
    """Each file of a group once; with ``internal`` only files that hold their essence themselves."""
    return (tracks.where("internal") if internal else tracks).select(key, "file_id").distinct()


def text_objects(members: DataFrame, key: str) -> DataFrame:
    """Text objects of a group's members as one list: member by member in input order, numbered from 0 as ``at``."""
    return ranked(members, [key], [F.col("member"), F.col("object")]).withColumnRenamed("rank", "at")
