"""Where everything stands in a container file before a byte of it is written.

A file is a header partition, body partitions of ``interval`` edit units each, and a footer.  An edit unit is a content package: the elements
of its tracks one after another.  The index of a body partition follows in the next partition, cut into segments whose arrays
stay within what a local length can say, and temporal offsets are taken from all frames, so no entry waits for frames to come.
A random index pack ends the file.

Frames are summed up by partition, and partitions in two levels, within runs and over the runs' totals; where an element stands within its partition follows
when it is written, as a partition's elements come in order.  So a file may have any number of frames and no task sees more than a run of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rational import div

#: Positions in one run of a two-level sum.
RUN = 65_536
#: Bytes of an element's key and length; of an index entry without slices; of each slice in it; of an index segment without entries and deltas.
ELEMENT_HEAD, ENTRY, SLICE, SEGMENT, DELTA = 21, 11, 4, 119, 6
#: Most bytes of a property's value.
MOST = 65_535


def sums_before(df: DataFrame, key: str, value: str, out: str, at: str = "position", run: int = RUN) -> DataFrame:
    """``out``: the sum of ``value`` over the key's rows of smaller ``at`` (distinct within a key)."""
    cut = df.withColumn("_run", div(F.col(at), run))
    earlier = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy(key, "_run").agg(F.sum(value).alias("_all")).select(key, "_run", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(runs, [key, "_run"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_run", "_own", "_before")


def per_segment(tracks: int) -> int:
    """Entries that fit into one index segment."""
    return (MOST - 8) // (ENTRY + SLICE * (tracks - 1))


def partitions(sized: DataFrame, headers: DataFrame, key: str, interval: int, tracks: int, pack_bytes: int, most: int | None = None, head: int = ELEMENT_HEAD, part_head: int = 0) -> DataFrame:
    """Partitions (``part``: -1 for the header, then bodies, and the footer last) with ``offset``, ``index_bytes``, ``body_offset``, ``essence``, ``previous`` and ``footer``.

    ``sized`` has the size of each element (key, position, size), ``headers`` the bytes of each file's header metadata; ``head`` bytes begin an element, ``part_head`` bytes the essence of each body
    (the head of clip-wrapped essence); an index segment has ``most`` entries.  Frames are summed up by partition first; all else goes over a file's partitions.
    """
    most = min(most or per_segment(tracks), per_segment(tracks))
    bodies = sized.groupBy(key, div(F.col("position"), interval).alias("part")).agg(F.sum(F.col("size") + head).alias("units"), div(F.count("*"), tracks).alias("n"))
    begun = sums_before(bodies, key, "units", "body_offset", "part").withColumn("essence", F.col("units") + part_head)
    n = F.col("n")
    indexed = bodies.select(key, (F.col("part") + 1).alias("part"), (div(n + (most - 1), most) * (SEGMENT + 8 + DELTA * tracks + 8) + n * (ENTRY + SLICE * (tracks - 1))).alias("index_bytes"))
    count = bodies.groupBy(key).agg((F.max("part") + 1).alias("part"))
    none = F.lit(0).cast("long")
    ends = headers.select(key, F.lit(-1).cast("long").alias("part"), none.alias("essence"), none.alias("body_offset"), "header_bytes").unionByName(count.select(key, "part", none.alias("essence"), none.alias("body_offset"), none.alias("header_bytes")))
    all_ = ends.unionByName(begun.select(key, "part", "essence", "body_offset", none.alias("header_bytes"))).join(indexed, [key, "part"], "left").withColumn("index_bytes", F.coalesce("index_bytes", none))
    w = Window.partitionBy(key).orderBy("part")
    size = F.lit(pack_bytes) + F.col("header_bytes") + F.col("index_bytes") + F.col("essence")
    placed = all_.withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), none))
    file = Window.partitionBy(key)
    return placed.withColumns({"previous": F.coalesce(F.lag("offset").over(w), none), "footer": F.max("offset").over(file), "last": F.col("part") == F.max("part").over(file)})
