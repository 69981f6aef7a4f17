"""Checksums and validation."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def crc32_text(data: Column) -> Column:
    """CRC-32 as eight lower-case digits."""
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")


def digests(df: DataFrame, column: str) -> DataFrame:
    """CRC-32, MD5 and SHA-1 of each value, in one pass."""
    data = F.col(column).cast("binary")
    return df.withColumns({"crc32": crc32_text(data), "md5": F.md5(data), "sha1": F.sha1(data)})


def track_digests(frames: DataFrame, keys: Sequence[str], column: str = "payload") -> DataFrame:
    """CRC-32, MD5 and SHA-1 over each track's payloads one after another.

    Frames stream past in order; a task holds one batch and one running state, whatever a track's size.
    """
    ordered = frames.select(*keys, "position", F.col(column).cast("binary").alias("_data")).repartition(*keys).sortWithinPartitions(*keys, "position")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema)

    def run(batches):
        current, state, kinds, out = None, None, None, []

        def row():
            return (*current, f"{state[0]:08x}", state[1].hexdigest(), state[2].hexdigest())

        for batch in batches:
            kinds = [batch.column(k).type for k in keys] + [pa.string()] * 3
            for *key, data in zip(*(batch.column(k).to_pylist() for k in (*keys, "_data")), strict=True):
                if key != current:
                    if current is not None:
                        out.append(row())
                    current, state = key, [0, hashlib.md5(), hashlib.sha1()]
                if data:
                    state[0] = zlib.crc32(data, state[0])
                    state[1].update(data)
                    state[2].update(data)
        if current is not None:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*keys, "crc32", "md5", "sha1"])

    return ordered.mapInArrow(run, f"{schema}, crc32 string, md5 string, sha1 string")


def crc_check(frames: DataFrame, key: str, track: str) -> DataFrame:
    """Per track: frames, those with a stored CRC, and those whose payload's CRC differs."""
    stored, own = F.col("stored_crc"), F.crc32(F.col("payload").cast("binary"))
    return frames.groupBy(key, track).agg(F.count("*").alias("total"), F.count(stored).alias("checked"), F.sum((stored.isNotNull() & (stored != own)).cast("long")).alias("errors"))


def crc_result(counts: DataFrame, key: str, track: str) -> DataFrame:
    """FAILED, MISSING_DATA or PASSED: the last condition met in order of tracks decides; without any CRC data is missing."""
    said = F.when(F.col("checked") < F.col("total"), F.lit("MISSING_DATA")).when(F.col("errors") > 0, F.lit("FAILED"))
    last = F.max_by(said, F.when(said.isNotNull(), F.col(track)))
    none = F.sum("checked") == 0
    return counts.groupBy(key).agg(F.when(none, "MISSING_DATA").otherwise(F.coalesce(last, F.lit("PASSED"))).alias("result"))


def capped_violations(rows: DataFrame, check: str, order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` reports for each check (a report's limit), with the number there are.

    Ranks are limited before the shuffle and numbers pre-summed, so that a frequent check is no burden to one task.
    """
    ranked = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(check).orderBy(*order))).where(F.col("occurrence") <= most)
    counts = rows.groupBy(F.col(check).alias("_check")).agg(F.count("*").alias("occurrences"))
    return ranked.join(counts, F.col(check).eqNullSafe(F.col("_check"))).drop("_check")


def sane_segments(segments: DataFrame, key: str) -> DataFrame:
    """Index segments with negative durations as 0, and problems: entries missing, or constant and variable ones mixed."""
    kinds = segments.groupBy(key).agg((F.count_distinct(F.col("edit_unit_bytes") > 0) > 1).alias("mixed"))
    fixed = segments.withColumn("duration", F.greatest("duration", F.lit(0).cast("long")))
    short = (F.col("edit_unit_bytes") == 0) & (F.col("entries") < F.col("duration"))
    return fixed.join(kinds, key).withColumn("problem", F.when(F.col("mixed"), "mixed").when(short, "entries missing")).drop("mixed")


def index_covers(tracks: DataFrame) -> DataFrame:
    """Tracks and whether the index reaches their duration, and precharge what is available."""
    return tracks.withColumns({"index_ok": F.col("indexed") >= F.col("duration"), "precharge_ok": F.col("origin") + F.col("precharge") >= 0})


def size_mismatches(frames: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Content packages whose size isn't what the index says."""
    return frames.select(*keys, F.col("size").alias("read")).join(entries.select(*keys, F.col("size").alias("indexed")), [*keys]).where("read <> indexed")


def last_frame(frames: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Whether each track's last frame can be read."""
    have = frames.groupBy(key).agg(F.max("position").alias("_last"))
    return tracks.join(have, key, "left").withColumn("complete", F.coalesce(F.col("_last") == F.col("duration") - 1, F.lit(False))).drop("_last")


def unsupported(tracks: DataFrame, supported: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tracks of a type and rate that the clip type has no place for."""
    return tracks.join(supported, [*keys], "left_anti")


def header_violations(headers: DataFrame, expected: DataFrame) -> DataFrame:
    """Header fields (stream, field, value) that aren't what a profile's table (field, low, high) allows."""
    joined = headers.join(F.broadcast(expected), "field")  # a profile's few dozen rows
    return joined.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")) | F.col("value").isNull()).select("stream", "field", "value")


def excess_padding(data: Column, size: Column) -> Column:
    """Whether what lies beyond ``size`` bytes may be cut off: its first and its last four bytes are zeros, as far as there are any."""
    total = F.length(data)
    zeros = lambda at: F.hex(F.substring(data, at + 1, F.lit(4))).rlike("^0*$")
    return zeros(size) & zeros(F.greatest(size, total - 4))
