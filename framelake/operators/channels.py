"""Audio channel re-mapping: which input channel goes to which output channel, or silence."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Channels of a map that is broadcast, at most.
MOST = 4096



def _placed(tracks: DataFrame, key: str) -> DataFrame:
    """PCM tracks with channels and all others: ``_before`` and ``_others`` count the PCM channels and other tracks before each, ``_all`` the PCM channels of the key.

    Windows go over tracks; channels are made from what they tell, so a task sorts no more than its tracks.
    """
    w = Window.partitionBy(key).orderBy("track")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.when(F.col("is_pcm"), F.col("channels")).otherwise(0)
    rows = tracks.where("is_pcm is not null and (not is_pcm or channels > 0)").select(key, "track", F.col("is_pcm").alias("_pcm"), n.alias("_n"), (~F.col("is_pcm")).cast("int").alias("_other"))
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    rows = rows.withColumns({"_before": so_far("_n"), "_others": so_far("_other"), "_all": F.sum("_n").over(whole).cast("int")})
    pcm = F.col("_pcm")
    return rows.withColumns({"_held": F.last(F.when(pcm, F.col("_others")), ignorenulls=True).over(before), "_first": F.min(F.when(pcm, F.col("_others"))).over(whole)})


def _channels(placed: DataFrame) -> DataFrame:
    """A row (channel, ``_input``) for each PCM channel and each other track."""
    last = F.when(F.col("_pcm"), F.col("_n") - 1).otherwise(0)
    return placed.withColumn("channel", F.explode(F.sequence(F.lit(0), last))).withColumn("_input", F.col("_before") + F.col("channel"))


def mono_map(tracks: DataFrame, key: str) -> DataFrame:
    """An output for each PCM channel and each other track, in input order: out_track, out_channel, track, channel."""
    rows = _channels(_placed(tracks, key))
    return rows.select(key, (F.col("_input") + F.col("_others")).alias("out_track"), F.lit(0).alias("out_channel"), "track", "channel")


def stereo_map(tracks: DataFrame, key: str) -> DataFrame:
    """Pairs of PCM channels across tracks, an odd last one with silence (null track); others keep their own output.

    An output stands where the first of its pair does.
    """
    pcm, odd = F.col("_pcm"), F.col("_input") % 2
    pairs = (F.col("_input") + F.when(pcm, 0).otherwise(1)).cast("int")  # begun before, twice; an odd one is whole
    others = F.when(pcm & (odd == 1) & (F.col("channel") == 0), F.col("_held")).otherwise(F.col("_others"))  # its pair begins in the PCM track before
    out = (F.shiftright(pairs, 1) + others).alias("out_track")
    alone = pcm & (odd == 0) & (F.col("_input") == F.col("_all") - 1)
    sound = F.struct(F.when(pcm, odd).otherwise(0).alias("out_channel"), "track", "channel")
    nothing = F.struct(F.lit(1).alias("out_channel"), F.lit(None).cast(tracks.schema["track"].dataType).alias("track"), F.lit(None).cast("int").alias("channel"))
    return _channels(_placed(tracks, key)).select(key, out, F.inline(F.when(alone, F.array(sound, nothing)).otherwise(F.array(sound))))


def single_map(tracks: DataFrame, key: str) -> DataFrame:
    """All PCM channels in one output, which stands where the first of them is; others keep their own."""
    pcm = F.col("_pcm")
    out = F.when(pcm, F.col("_first")).otherwise(F.col("_others") + (F.col("_before") > 0).cast("int"))
    return _channels(_placed(tracks, key)).select(key, out.alias("out_track"), F.when(pcm, F.col("_input")).otherwise(0).alias("out_channel"), "track", "channel")


def parse_definition(text: str) -> list[dict]:
    """Groups split by ``;``: ``m`` before a group asks for mono outputs; items are inputs, ranges ``a-b``, silence ``sN``, or ``x`` for the rest."""
    groups = []
    for part in (p.strip() for p in text.split(";")):
        if not part:
            continue
        mono = part.startswith("m")
        body = part[1:] if mono else part
        items: list[tuple] = []
        if body.startswith("x"):
            items.append(("rest",))
        else:
            for item in (x.strip() for x in body.split(",")):
                if not item:
                    continue
                if m := re.fullmatch(r"s(\d+)", item):
                    items.append(("silence", int(m[1])))
                elif m := re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", item):
                    items.append(("range", int(m[1]), int(m[2] or m[1])))
                else:
                    raise ValueError(f"malformed item in a track map: {item!r}")
        if not items:
            raise ValueError("an empty group in a track map")
        groups.append({"mono": mono, "items": items})
    if not groups:
        raise ValueError("an empty track map")
    return groups


def definition_map(text: str, inputs: int) -> tuple[list[tuple[int, int, int | None]], list[int]]:
    """(output, channel, input or None for silence) for ``inputs`` PCM channels, and the inputs not used; those out of range are ignored."""
    rows, used, out = [], set(), 0
    for group in parse_definition(text):
        chosen: list[int | None] = []
        for item in group["items"]:
            if item[0] == "silence":
                chosen += [None] * item[1]
            elif item[0] == "range":
                chosen += [i for i in range(item[1], item[2] + 1) if i < inputs]
            else:
                chosen += [i for i in range(inputs) if i not in used]
            used.update(i for i in chosen if i is not None)
        if not chosen:
            continue
        for k, i in enumerate(chosen):
            rows.append((out + k, 0, i) if group["mono"] else (out, k, i))
        out += len(chosen) if group["mono"] else 1
    return rows, [i for i in range(inputs) if i not in used]


def definition_frame(spark: SparkSession, text: str, inputs: int) -> DataFrame:
    return spark.createDataFrame(definition_map(text, inputs)[0], "out_track int, out_channel int, input int")


def definition_rows(df: DataFrame, keys: Sequence[str], definition: str, inputs: str) -> DataFrame:
    """Outputs (keys, out_track, out_channel, input) of definitions that stand in a column, for as many inputs as column ``inputs`` says; a null one gives no rows."""
    schema = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string("out_track int, out_channel int, input int").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for *key, text, n in zip(*(batch.column(c).to_pylist() for c in (*keys, definition, inputs)), strict=True):
                if text is not None:
                    rows += [(*key, *r) for r in definition_map(text, n or 0)[0]]
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(*keys, definition, inputs).mapInArrow(run, schema)


def compatible(mapped: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Outputs and whether all their channels have one bit depth."""
    bits = tracks.select(key, "track", "bits")
    return mapped.where("track is not null").join(bits, [key, "track"]).groupBy(key, "out_track").agg((F.count_distinct("bits") == 1).alias("compatible"))


def deinterleave(samples: Column, channels: int, channel: int) -> Column:
    """Every ``channels``-th sample from ``channel`` on; nothing for a channel that isn't there."""
    if not 0 <= channel < channels:
        return F.slice(samples, 1, 0)
    return F.filter(samples, lambda _, i: i % channels == channel)


def interleave(parts: Sequence[Column]) -> Column:
    return F.flatten(F.transform(F.arrays_zip(*(p.alias(f"c{k}") for k, p in enumerate(parts))), lambda x: F.array(*(x[f"c{k}"] for k in range(len(parts))))))


def apply_map(samples: DataFrame, mapped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples (input, samples) re-arranged by a map (out_track, out_channel, input): interleaved arrays per output.

    Silence, and what an input lacks in length, are zeros.
    """
    if mapped.limit(MOST + 1).count() > MOST:
        raise ValueError(f"a map of over {MOST} channels")
    length = samples.groupBy(*keys).agg(F.max(F.size("samples")).alias("_n"))
    grid = length.crossJoin(F.broadcast(mapped))  # MOST channels for each row
    joined = grid.join(samples.select(*keys, "input", "samples"), [*keys, "input"], "left")
    zero = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda _: F.lit(0.0))
    have = F.coalesce("samples", F.slice(zero, 1, 0))
    full = F.concat(have.cast("array<double>"), F.slice(zero, F.lit(1), F.col("_n") - F.size(have)))
    parts = joined.select(*keys, "out_track", "_n", "out_channel", full.alias("full")).groupBy(*keys, "out_track", "_n").agg(F.sort_array(F.collect_list(F.struct("out_channel", "full"))).alias("_c"))
    woven = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.transform("_c", lambda c: F.get(c["full"], i))))
    return parts.select(*keys, "out_track", woven.alias("samples"))


def pad_samples(samples: Column, size: int) -> Column:
    """A last partial frame filled up with zeros."""
    return F.concat(samples, F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(0), F.lit(size) - F.size(samples))))


def silence(length: Column) -> Column:
    return F.array_repeat(F.lit(0).cast("float"), length)


def mark_locators(marks: DataFrame, start: int = 0) -> DataFrame:
    """Essence marks as coloured locators: red for names with a leading underscore, else green; positions count from ``start``."""
    return marks.withColumns({"color": F.when(F.col("mark").startswith("_"), "red").otherwise("green"), "position": F.col("position") - start})


def aes3_to_pcm(data: bytes, channel: int, bits: int) -> bytes:
    """One channel of an AES-3 element: a 4-byte header with the sample count and valid channels, then 8 little-endian words a sample."""
    width = (bits + 7) // 8
    if len(data) < 4:
        return b""
    count = min(int.from_bytes(data[1:3], "little"), (len(data) - 4) // 32)
    if not data[3] >> channel & 1:
        return bytes(count * width)
    words = np.frombuffer(data, dtype="<u4", count=count * 8, offset=4).reshape(count, 8)[:, channel]
    value = words >> np.uint32(4 if bits > 16 else 12)
    return value.astype("<u4").view(np.uint8).reshape(count, 4)[:, :width].tobytes()


def aes3_channels(frames: DataFrame, keys: Sequence[str], channels: int, bits: int, column: str = "payload") -> DataFrame:
    """A row (channel, pcm) for each of the first ``channels`` of AES-3 payloads."""

    def run(batches):
        for batch in batches:
            data = batch.column("_data").to_pylist()
            index = np.repeat(np.arange(len(data)), channels)
            part = batch.select(list(keys)).take(pa.array(index))
            pcm = [aes3_to_pcm(d or b"", c, bits) for d in data for c in range(channels)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(range(channels)) * len(data), pa.int32()), pa.array(pcm, pa.binary())], names=[*keys, "channel", "pcm"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema)
    return frames.select(*keys, F.col(column).alias("_data")).mapInArrow(run, f"{schema}, channel int, pcm binary")
