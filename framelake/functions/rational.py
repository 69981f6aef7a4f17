"""Exact rational-rate time as integer Column arithmetic; nothing here becomes floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The audio samples of each frame in a cycle, by (frame rate, sampling rate).
CADENCES = {
    (30000, 1001, 48000, 1): (1602, 1601, 1602, 1601, 1602),
    (60000, 1001, 48000, 1): (801, 801, 800, 801, 801),
}
#: Code of a content package rate by whole frames per second.
PACKAGE_RATES = {24: 1, 25: 2, 30: 3, 48: 4, 50: 5, 60: 6, 72: 7, 75: 8, 90: 9, 96: 10, 100: 11, 120: 12}

Number = Column | int


def lit(x: Number) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def div(a: Number, b: Number) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", lit(a), lit(b))


def fdiv(a: Number, b: Number) -> Column:
    """Integer division toward minus infinity, for b > 0."""
    return div(lit(a) - F.pmod(lit(a), lit(b)), b)


def convert_position(p: Number, top: Number, bottom: Number, rounding: str = "auto") -> Column:
    """p * top / bottom.  ``auto`` rounds up when top < bottom, else down; ``nearest`` is nearest above zero and down below."""
    p, top, bottom = lit(p), lit(top), lit(bottom)
    whole, rest = fdiv(p, bottom) * top, F.pmod(p, bottom) * top  # so that p * top needn't fit
    down, up = whole + fdiv(rest, bottom), whole - fdiv(-rest, bottom)
    if rounding == "auto":
        made = F.when(top < bottom, up).otherwise(down)
    elif rounding == "nearest":
        made = F.when(p > 0, whole + fdiv(rest + div(bottom, 2), bottom)).otherwise(down)
    else:
        made = {"up": up, "down": down}[rounding]
    return F.when((p == 0) | (top == bottom), p).otherwise(made)


def convert_duration(d: Number, top: Number, bottom: Number, rounding: str = "auto") -> Column:
    """As a position, but nothing for d <= 0, and ``auto`` rounds down when top < bottom, else up."""
    d, top, bottom = lit(d), lit(top), lit(bottom)
    if rounding == "auto":
        made = F.when(top < bottom, convert_position(d, top, bottom, "down")).otherwise(convert_position(d, top, bottom, "up"))
    else:
        made = convert_position(d, top, bottom, rounding)
    return F.when(d <= 0, F.lit(0).cast("long")).otherwise(made)


def rate_factors(from_num: Number, from_den: Number, to_num: Number, to_den: Number) -> tuple[Column, Column]:
    """(top, bottom) that take a position from one rate to another."""
    return lit(to_num) * lit(from_den), lit(to_den) * lit(from_num)


def sample_sequence(low_num: Number, low_den: Number, high_num: Number, high_den: Number) -> Column:
    """How many edit units of the higher rate fall to each of the lower, as a cycle; null where none is known."""
    a, b, c, d = map(lit, (low_num, low_den, high_num, high_den))
    top, bottom = c * b, d * a
    known = F.lit(None).cast("array<int>")
    for rates, cadence in CADENCES.items():
        hit = (a == rates[0]) & (b == rates[1]) & (c == rates[2]) & (d == rates[3])
        known = F.when(hit, F.array(*map(F.lit, cadence))).otherwise(known)
    return F.when(top == bottom, F.array(F.lit(1))).when(F.pmod(top, bottom) == 0, F.array(div(top, bottom).cast("int"))).otherwise(known)


def rotate(sequence: Column, offset: Number) -> Column:
    """The cycle as it goes on after ``offset`` elements."""
    at = F.pmod(lit(offset), F.size(sequence)).cast("int")
    return F.concat(F.slice(sequence, at + 1, F.size(sequence) - at), F.slice(sequence, F.lit(1), at))


def total(sequence: Column) -> Column:
    return F.aggregate(sequence, F.lit(0).cast("long"), lambda s, x: s + x)


def prefixes(sequence: Column) -> Column:
    """Sums of the first 0, 1, ... n elements."""
    return F.aggregate(sequence, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def higher(p: Number, sequence: Column) -> Column:
    """Position at the lower rate to the higher rate."""
    p, n = lit(p), F.size(sequence)
    return fdiv(p, n) * total(sequence) + F.get(prefixes(sequence), F.pmod(p, n).cast("int"))


def lower(p: Number, sequence: Column) -> Column:
    """Position at the higher rate to the first at the lower rate that doesn't start before it."""
    p, s = lit(p), total(sequence)
    rest = F.pmod(p, s)
    return fdiv(p, s) * F.size(sequence) + F.size(F.filter(F.slice(prefixes(sequence), F.lit(1), F.size(sequence)), lambda x: x < rest))


def whole_below(p: Number, sequence: Column) -> Column:
    """Number of units of the lower rate that end at or before a position of the higher rate."""
    p, s = lit(p), total(sequence)
    rest = F.pmod(p, s)
    return fdiv(p, s) * F.size(sequence) + F.size(F.filter(F.slice(prefixes(sequence), F.lit(2), F.size(sequence)), lambda x: x <= rest))


def duration_higher(d: Number, sequence: Column, p: Number = 0) -> Column:
    d = lit(d)
    return F.when(d <= 0, F.lit(0).cast("long")).otherwise(higher(lit(p) + d, sequence) - higher(p, sequence))


def duration_lower(d: Number, sequence: Column, p: Number = 0) -> Column:
    """Whole units of the lower rate within ``d`` units of the higher rate from ``p`` on."""
    d = lit(d)
    return F.when(d <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), whole_below(lit(p) + d, sequence) - lower(p, sequence)))


def rounded_base(num: Number, den: Number) -> Column:
    """Frames per second as a whole number."""
    return div(lit(num) + div(den, 2), den)


def gcd(a: Number, b: Number) -> Column:
    """Greatest common divisor of numbers below 2**31, by a bounded Euclid."""
    start = F.struct(F.abs(lit(a)).alias("a"), F.abs(lit(b)).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(46)), start, step, lambda s: s["a"])


def reduce_rational(num: Number, den: Number) -> Column:
    """In lowest terms with a positive denominator; 0/1 if either is 0."""
    num, den = lit(num), lit(den)
    g = F.greatest(gcd(num, den), F.lit(1).cast("long"))
    zero = (num == 0) | (den == 0)
    part = lambda x, none: F.when(zero, F.lit(none)).otherwise(div(x, g).cast("int"))
    return F.struct(part(F.when(den < 0, -num).otherwise(num), 0).alias("num"), part(F.abs(den), 1).alias("den"))


def normalize_rate(num: Number, den: Number) -> Column:
    """In lowest terms, with 2997/1000 and 2997/500 as the rates over 1001 they stand for; negative rates as they are."""
    num, den = lit(num), lit(den)
    r = reduce_rational(num, den)
    exact = lambda n: F.struct(F.lit(n).alias("num"), F.lit(1001).alias("den"))
    own = F.struct(num.cast("int").alias("num"), den.cast("int").alias("den"))
    return F.when(r["num"] < 0, own).when((r["num"] == 2997) & (r["den"] == 1000), exact(30000)).when((r["num"] == 2997) & (r["den"] == 500), exact(60000)).otherwise(r)


def package_rate_code(num: Number, den: Number) -> Column:
    """Rate code of a content package: table number doubled, plus one for rates over 1001; 0 if unknown."""
    num, den = lit(num), lit(den)
    fps = F.when(den == 1001, div(num, 1000)).otherwise(num)
    code = F.lit(0)
    for rate, number in PACKAGE_RATES.items():
        code = F.when(fps == rate, F.lit(2 * number) + F.when(den == 1001, 1).otherwise(0)).otherwise(code)
    return F.when((den == 1) | (den == 1001), code).otherwise(F.lit(0))


def fill_size(size: Number, grid: Number, length_bytes: Number = 4) -> Column:
    """Bytes of filler after ``size`` up to the next multiple of ``grid`` that leaves room for the filler's own key and length."""
    size, grid = lit(size), lit(grid)
    least, gap = lit(length_bytes) + 16, grid - F.pmod(size, grid)
    more = F.greatest(F.lit(0).cast("long"), -fdiv(-(least - gap), grid))
    return F.when(F.pmod(size, grid) == 0, F.lit(0).cast("long")).otherwise(gap + more * grid)


def parse_rate(text: Column) -> Column:
    """``n/d``, a whole number, or 23976, 2997 and 5994 for rates over 1001; null for anything else."""
    pair = F.regexp_extract(text, r"^(\d{1,9})/(\d{1,9})$", 1)
    made = lambda n, d: F.struct(n.cast("int").alias("num"), d.cast("int").alias("den"))
    out = F.when(pair != "", made(F.nullif(pair, F.lit("")), F.nullif(F.regexp_extract(text, r"^(\d{1,9})/(\d{1,9})$", 2), F.lit(""))))
    for alias, rate in (("23976", 24000), ("2997", 30000), ("5994", 60000)):
        out = out.when(text == alias, made(F.lit(rate), F.lit(1001)))
    return out.when(text.rlike(r"^\d{1,9}$"), made(F.try_to_number(text, F.lit("999999999")), F.lit(1)))


def pcm_duration(container: Number, start: Number, end: Number, sequence: Column | None = None) -> Column:
    """Samples of a track between its start and end offsets, or with a cycle of samples the whole frames in them; 0 below none."""
    kept = lit(container) - lit(start) + lit(end)
    made = duration_lower(kept, sequence) if sequence is not None else kept
    return F.when(kept <= 0, F.lit(0).cast("long")).otherwise(made)
