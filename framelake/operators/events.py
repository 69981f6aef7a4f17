"""Archive events, and dumps of frame metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters by which kinds of archive events are asked for.
EVENT_LETTERS = {"d": "digibeta_dropout", "p": "pse_failure", "t": "timecode_break", "v": "vtr_error"}
#: What stands for codes and checksums that are missing.
NO_TIMECODE, NO_CRC = "__:__:__:__", "????"
#: Columns that a dump may widen to.
MOST = 1024


def event_mask(letters: str) -> list[str]:
    unknown = set(letters) - set(EVENT_LETTERS)
    if unknown:
        raise ValueError(f"unknown kinds of events: {sorted(unknown)}")
    return [EVENT_LETTERS[x] for x in dict.fromkeys(letters)]


def with_timecodes(events: DataFrame, timecodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events with the codes (vitc, ltc) of their frames; an event without a frame stays."""
    return events.join(timecodes.select(*keys, "vitc", "ltc"), [*keys], "left")


def issue_counts(events: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    return events.groupBy(*keys, kind).agg(F.count("*").alias("issues"))


def timecode_dump(frames: DataFrame, slots: Sequence[str]) -> DataFrame:
    """A line for each frame: its codes separated by blanks, with a mark where one is missing."""
    return frames.withColumn("line", F.concat_ws(" ", *(F.coalesce(F.col(s), F.lit(NO_TIMECODE)) for s in slots)))


def crc_dump(rows: DataFrame, keys: Sequence[str], track: str, crc: str, tracks: Sequence[int] | None = None) -> DataFrame:
    """A row for each frame with a column for each track: those given, or all that occur (``MOST`` at most), in order."""
    if tracks is None:
        tracks = sorted(r[0] for r in rows.where(F.col(track).isNotNull()).select(track).distinct().limit(MOST + 1).collect())
        if len(tracks) > MOST:
            raise ValueError(f"more than {MOST} tracks make no table; name those wanted")
    wide = rows.groupBy(*keys).pivot(track, list(tracks)).agg(F.max(crc))
    return wide.select(*keys, *(F.coalesce(F.col(str(t)), F.lit(NO_CRC)).alias(f"track_{t}") for t in tracks))


def zip_crcs(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The i-th CRC of a frame's list as that of the i-th track number."""
    return frames.select(*keys, F.explode(F.arrays_zip("track_numbers", "crcs")).alias("_z")).select(*keys, F.col("_z.track_numbers").alias("track_number"), F.col("_z.crcs").alias("crc32"))


def description_text(chars: DataFrame, keys: Sequence[str], start: int = 2, end: int = 3) -> DataFrame:
    """Description text of each program from one character a frame: all non-zero ones until an end that follows a start.

    ``complete`` tells whether that end was seen. Start and end characters are part of the text.
    """
    ordered = chars.where("ch <> 0").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "ch"))), lambda x: x["ch"]).alias("_c"))
    begun = ordered.withColumn("_s", F.array_position("_c", F.lit(start).cast(chars.schema["ch"].dataType)))
    after = F.slice("_c", F.col("_s").cast("int") + 1, F.size("_c"))
    ended = begun.withColumn("_e", F.when(F.col("_s") > 0, F.array_position(after, F.lit(end).cast(chars.schema["ch"].dataType))).otherwise(F.lit(0)))
    done = F.col("_e") > 0
    kept = F.slice("_c", 1, F.when(done, F.col("_s") + F.col("_e")).otherwise(F.size("_c")).cast("int"))
    return ended.select(*keys, F.array_join(F.transform(kept, lambda c: F.char(c)), "").alias("text"), done.alias("complete"))


def static_text_char(text: str, position: Column, start: int = 2, end: int = 3) -> Column:
    """The character of a repeating description that falls to a frame: start, text, end, and again."""
    codes = F.array(F.lit(start), *(F.lit(ord(c)) for c in text), F.lit(end))
    return F.get(codes, F.pmod(position, F.lit(len(text) + 2)).cast("int"))


def index_dump(entries: DataFrame, frame: Column) -> DataFrame:
    """Frame number, track, position, size, flags, key-frame and temporal offset of each entry."""
    return entries.select(frame.alias("frame"), "track", "position", "size", F.lpad(F.lower(F.hex("flags")), 2, "0").alias("flags"), "key_frame_offset", "temporal_offset")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A file name from a template such as ``{type}-{mp_uuid}``."""
    made: Column = F.lit(template)
    for name, value in values.items():
        made = F.replace(made, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return made
