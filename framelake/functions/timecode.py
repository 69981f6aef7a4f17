"""Timecode as Column expressions: a timecode is its base, whether it drops codes, and an offset in frames.

Dropping timecode leaves out the first 2 (base 30) or 4 (base 60) codes of every minute but each tenth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rational import Number, convert_position, div, lit, rounded_base


def dropped(base: Number, drop: Column | bool) -> Column:
    """Codes left out in a minute."""
    drop = drop if isinstance(drop, Column) else F.lit(drop)
    return F.when(drop & (lit(base) == 60), F.lit(4)).when(drop & (lit(base) == 30), F.lit(2)).otherwise(F.lit(0)).cast("long")


def may_drop(num: Number, den: Number) -> Column:
    """Whether a rate has dropping timecode: 29.97 and 59.94 alone."""
    return (lit(den) == 1001) & ((lit(num) == 30000) | (lit(num) == 60000))


def day_frames(base: Number, drop: Column | bool) -> Column:
    d = dropped(base, drop)
    return (10 * (60 * lit(base) - d) + d) * 144


def fields(offset: Number, base: Number, drop: Column | bool = False) -> Column:
    """``struct<h, m, s, f>`` of an offset, which wraps at 24 hours either way."""
    base, d = lit(base), dropped(base, drop)
    minute = 60 * base - d
    ten = 10 * minute + d
    o = F.pmod(lit(offset), day_frames(base, drop))
    rest = F.pmod(o, ten)
    label = o + 9 * d * div(o, ten) + d * F.greatest(F.lit(0).cast("long"), div(rest - d, minute))
    return F.struct(
        div(label, 3600 * base).cast("int").alias("h"),
        F.pmod(div(label, 60 * base), F.lit(60)).cast("int").alias("m"),
        F.pmod(div(label, base), F.lit(60)).cast("int").alias("s"),
        F.pmod(label, base).cast("int").alias("f"),
    )


def offset(h: Number, m: Number, s: Number, f: Number, base: Number, drop: Column | bool = False) -> Column:
    """Offset of a code; one that is left out stands for the first that isn't."""
    base, d = lit(base), dropped(base, drop)
    h, m, s, f = F.pmod(lit(h), F.lit(24)), F.pmod(lit(m), F.lit(60)), F.pmod(lit(s), F.lit(60)), F.pmod(lit(f), base)
    f = F.when((s == 0) & (F.pmod(m, F.lit(10)) != 0) & (f < d), d).otherwise(f)
    minutes = 60 * h + m
    return (minutes * 60 + s) * base + f - d * (minutes - div(minutes, 10))


def add(position: Number, frames: Number, base: Number, drop: Column | bool = False) -> Column:
    """Offset after so many frames, within a day."""
    return F.pmod(lit(position) + lit(frames), day_frames(base, drop))


def add_at_rate(position: Number, frames: Number, num: Number, den: Number, base: Number, drop: Column | bool = False) -> Column:
    """Offset after frames counted at another rate, num/den."""
    return add(position, convert_position(frames, base, rounded_base(num, den)), base, drop)


def add_duration(position: Number, h: Number, m: Number, s: Number, f: Number, base: Number, drop: Column | bool, mode: Column | bool) -> Column:
    """Offset after a duration in hours, minutes, seconds and frames, added field by field in drop mode ``mode``."""
    base = lit(base)
    start = fields(position, base, mode)
    frame = start["f"] + F.pmod(lit(f), base)
    sec = start["s"] + F.pmod(lit(s), F.lit(60)) + div(frame, base)
    minute = start["m"] + F.pmod(lit(m), F.lit(60)) + div(sec, 60)
    hour = F.pmod(start["h"] + lit(h) + div(minute, 60), F.lit(24))
    return F.pmod(offset(hour, F.pmod(minute, F.lit(60)), F.pmod(sec, F.lit(60)), F.pmod(frame, base), base, mode), day_frames(base, drop))


def in_base(position: Number, base: Number, to_base: Number) -> Column:
    """An offset in frames of another base, rounded up where that is lower and down where it is higher."""
    return convert_position(position, to_base, base)


def before(a: Number, base_a: Number, b: Number, base_b: Number) -> Column:
    """Whether a timecode is earlier than another, taken to its base; one of base 0 is invalid and comes last."""
    one = F.lit(1).cast("long")
    return F.when(lit(base_a) == 0, F.lit(False)).when(lit(base_b) == 0, F.lit(True)).otherwise(lit(a) < in_base(b, F.greatest(lit(base_b), one), F.greatest(lit(base_a), one)))


def same(a: Number, base_a: Number, b: Number, base_b: Number) -> Column:
    """Whether two timecodes name one moment; all invalid ones do."""
    one = F.lit(1).cast("long")
    return F.when((lit(base_a) == 0) | (lit(base_b) == 0), (lit(base_a) == 0) & (lit(base_b) == 0)).otherwise(lit(a) == in_base(b, F.greatest(lit(base_b), one), F.greatest(lit(base_a), one)))


def _two(x: Column) -> Column:
    return F.format_string("%02d", x)


def text(code: Column, drop: Column | bool = False) -> Column:
    """``hh:mm:ss:ff``, with a semicolon before the frames of dropping timecode."""
    drop = drop if isinstance(drop, Column) else F.lit(drop)
    return F.concat(_two(code["h"]), F.lit(":"), _two(code["m"]), F.lit(":"), _two(code["s"]), F.when(drop, ";").otherwise(":"), _two(code["f"]))


def _clock(seconds: Column) -> Column:
    return F.concat(_two(div(seconds, 3600)), F.lit(":"), _two(F.pmod(div(seconds, 60), F.lit(60))), F.lit(":"), _two(F.pmod(seconds, F.lit(60))))


def duration_text(count: Number, num: Number, den: Number) -> Column:
    """``hh:mm:ss:ff`` of a count at the rounded rate; zero for a negative count."""
    count, base = lit(count), F.greatest(rounded_base(num, den), F.lit(1).cast("long"))
    return F.when((count < 0) | (lit(num) == 0), F.lit("00:00:00:00")).otherwise(F.concat(_clock(div(count, base)), F.lit(":"), _two(F.pmod(count, base))))


def generic_duration_text(count: Number, num: Number, den: Number) -> Column:
    """``hh:mm:ss.cc`` by whole milliseconds."""
    count = lit(count)
    ms = convert_position(count, 1000 * lit(den), lit(num), "down")
    return F.when((count <= 0) | (lit(num) == 0), F.lit("00:00:00.00")).otherwise(F.concat(_clock(div(ms, 1000)), F.lit("."), _two(div(100 * F.pmod(ms, F.lit(1000)), 1000))))


def rate_duration_text(count: Number, num: Number, den: Number) -> Column:
    """``hh:mm:ss:uu @rHz``."""
    count, base = lit(count), F.greatest(rounded_base(num, den), F.lit(1).cast("long"))
    unit = F.pmod(count, base)
    units = F.when(base <= 99, _two(unit)).otherwise(unit.cast("string"))
    made = F.concat(_clock(div(count, base)), F.lit(":"), units, F.lit(" @"), base.cast("string"), F.lit("Hz"))
    return F.when((count < 0) | (lit(num) == 0), F.lit("00:00:00:00")).otherwise(made)


_CODE = r"^\s*(\d{1,9}):(\d{1,9}):(\d{1,9})(.)(\d{1,9})$"


def parse(code: Column, num: Number, den: Number) -> Column:
    """``struct<base, drop, offset>`` of ``hh:mm:ss:ff``; any other separator before the frames asks for dropping. Null if malformed."""
    part = lambda k: F.nullif(F.regexp_extract(code, _CODE, k), F.lit("")).cast("long")
    drop = (F.regexp_extract(code, _CODE, 4) != ":") & may_drop(num, den)
    base = rounded_base(num, den)
    made = F.struct(base.cast("int").alias("base"), drop.alias("drop"), offset(part(1), part(2), part(3), part(5), base, drop).alias("offset"))
    return F.when(code.rlike(_CODE), made)


def parse_position(code: Column, start: Column, num: Number, den: Number) -> Column:
    """Position of a timecode after ``start`` (an offset), or of ``o`` and an offset in codes that never drop."""
    plain = parse(F.substring(code, 2, 1000), rounded_base(num, den), 1)["offset"]
    return F.when(F.substring(code, 1, 1) == "o", plain).otherwise(parse(code, num, den)["offset"] - start)


def _byte(x: Column, k: int) -> Column:
    return F.conv(F.substring(F.hex(x), 2 * k + 1, 2), 16, 10).cast("int")


def decode_smpte12m(code: Column, num: Number, den: Number) -> Column:
    """``struct<h, m, s, f, drop, field_mark>`` of binary coded decimals; above base 30 a code counts pairs of frames."""
    base = rounded_base(num, den)
    bcd = lambda k, mask: F.shiftright(_byte(code, k).bitwiseAND(F.lit(mask)), 4) * 10 + _byte(code, k).bitwiseAND(F.lit(0x0F))
    mark = ((base == 50) & (_byte(code, 3).bitwiseAND(F.lit(0x80)) != 0)) | ((base == 60) & (_byte(code, 1).bitwiseAND(F.lit(0x80)) != 0))
    return F.struct(
        bcd(3, 0x30).alias("h"), bcd(2, 0x70).alias("m"), bcd(1, 0x70).alias("s"),
        F.when(base > 30, bcd(0, 0x30) * 2).otherwise(bcd(0, 0x30)).alias("f"),
        (_byte(code, 0).bitwiseAND(F.lit(0x40)) != 0).alias("drop"), mark.alias("field_mark"),
    )


def encode_smpte12m(code: Column, base: Number, drop: Column | bool = False, mark: Column | bool = False) -> Column:
    """Eight bytes for ``struct<h, m, s, f>``, as hexadecimal digits."""
    base = lit(base)
    drop, mark = (x if isinstance(x, Column) else F.lit(x) for x in (drop, mark))
    frame = F.when(base > 30, div(code["f"], 2)).otherwise(code["f"].cast("long"))
    bcd = lambda x: div(x, 10) * 16 + F.pmod(x, F.lit(10))
    second = mark & (base > 30) & (F.pmod(code["f"], F.lit(2)) == 1)
    flag = lambda when, bit: F.when(when, F.lit(bit)).otherwise(F.lit(0))
    parts = [bcd(frame) + flag(drop, 0x40), bcd(code["s"]) + flag(second & (base == 60), 0x80), bcd(code["m"]), bcd(code["h"]) + flag(second & (base == 50), 0x80)]
    return F.concat(*(F.lpad(F.hex(x), 2, "0") for x in parts), F.lit("00000000"))


def start_timecodes(material: Column, file: Column, physical: Column) -> tuple[Column, Column]:
    """Playout (material, else file, else physical) and source (file, else physical) start offsets; 0 where none is set."""
    zero = F.lit(0).cast("long")
    return F.coalesce(material, file, physical, zero), F.coalesce(file, physical, zero)


def whole_day(spark, base: int, drop: bool):
    """Every code of a day: ``offset, code``."""
    per_minute = 60 * base - (2 if drop and base == 30 else 4 if drop and base == 60 else 0)
    n = 144 * (10 * per_minute + 60 * base - per_minute)
    return spark.range(n).select(F.col("id").alias("offset"), text(fields(F.col("id"), base, drop), drop).alias("code"))
