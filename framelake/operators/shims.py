"""Delivery rules as tables: coding limits of AS-10 shims checked on stream headers, and properties of AS-11 frameworks given their types.

Both join rows with a small table of rules and decide by Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import timecode
from ..functions.rational import rounded_base

# What a shim asks of the coding; 2 stands for either of two values, 0/0 for any rate.
SHIMS = {
    "high_hd_2014": {"bitrate": 50_000_000, "bitratedelta": 1_000_000, "isconstantbitrate": 1, "hsize": 1920, "croma": 422},
    "cnn_hd_2012": {"bitrate": 35_000_000, "bitratedelta": 0, "isconstantbitrate": 0, "hsize": 1440, "croma": 420},
    "nrk_hd_2012": {"bitrate": 50_000_000, "bitratedelta": 1_000_000, "isconstantbitrate": 1, "hsize": 1920, "croma": 422},
    "jvc_hd_35_vbr_2012": {"bitrate": 35_000_000, "bitratedelta": 0, "isconstantbitrate": 0, "hsize": 1440, "croma": 420},
    "jvc_hd_25_cbr_2012": {"bitrate": 25_000_000, "bitratedelta": 0, "isconstantbitrate": 1, "hsize": 1440, "croma": 420},
}
# What all shims ask alike.
ALIKE = {"issinglesequence": 2, "isprogressive": 2, "isuniqueresolution": 1, "vsize": 1080, "colorprimaries": 1, "istff": 1, "islowdelay": 0, "isclosedgop": 1, "isidenticalgop": 1, "maxgop": 16, "maxbframes": 2}
RATIONALS = {"aspectratio": "16/9", "samplerate": "0/0"}
# Profiles and levels by (progressive, width), with the chroma format that they stand for.
PROFILES = [(True, 1920, 0x82, 422), (True, 1920, 0x44, 420), (True, 1440, 0x44, 420), (True, 1440, 0x46, 420), (True, 1280, 0x82, 422), (True, 1280, 0x44, 420), (False, 1920, 0x82, 422), (False, 1920, 0x44, 420), (False, 1440, 0x44, 420), (False, 1440, 0x46, 420)]
NAMES = [*next(iter(SHIMS.values())), *ALIKE]


def references(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """A row for each shim with a column for each of its values; ``overrides`` (shim, name, value as text) replace some, whatever the case of their names.

    An override of another name has its row in ``unknown_references``.
    """
    rows = [(shim, name, str(value)) for shim, own in SHIMS.items() for name, value in (own | ALIKE | RATIONALS).items()]
    table = spark.createDataFrame(rows, "shim string, name string, value string")
    if overrides is not None:
        given = overrides.select("shim", F.lower(F.trim("name")).alias("name"), F.trim("value").alias("own")).groupBy("shim", "name").agg(F.max("own").alias("own"))
        table = table.join(given, ["shim", "name"], "left").select("shim", "name", F.coalesce("own", "value").alias("value"))
    number = lambda name: F.max(F.when(F.col("name") == name, F.regexp_extract("value", r"^\s*([+-]?\d+)", 1).try_cast("long"))).alias(name)
    ratio = lambda name, sep: F.max(F.when(F.col("name") == name, F.struct(F.regexp_extract("value", rf"^(\d+)[{sep}]", 1).try_cast("long").alias("num"), F.regexp_extract("value", rf"[{sep}](\d+)$", 1).try_cast("long").alias("den")))).alias(name)
    return table.groupBy("shim").agg(*map(number, NAMES), ratio("aspectratio", "/"), ratio("samplerate", ":/"))


def unknown_references(overrides: DataFrame) -> DataFrame:
    """Overrides of names that no shim has."""
    return overrides.where(~F.lower(F.trim("name")).isin(*NAMES, *RATIONALS))


def shim_violations(headers: DataFrame, refs: DataFrame, key: str, most: int = 1) -> DataFrame:
    """What headers (key, position, shim and what they hold) violate: ``check, severity, found, wanted, reported``, numbered ``nth`` by stream and check.

    A check of low severity is reported ``most`` + 1 times; beyond that some become errors, and the others go on unreported.  Headers have flags ``sequence``,
    ``extension``, ``display``, ``coding`` and ``gop`` for the parts that they hold, and the parts' fields: vbv_delay (null: none), single_sequence, aspect and rate (structs,
    null if unknown), bit_rate, width, height, low_delay, progressive, profile, chroma (0: not said), primaries (null: not said), display_width, display_height, tff, max_gop,
    closed_gop, identical_gop.  The values of a stream so far are those that its header rows carry.
    """
    h, r = (lambda c: F.col(c)), (lambda c: F.col(f"_r.{c}"))
    rows = headers.join(F.broadcast(refs.select("shim", F.struct(*[c for c in refs.columns if c != "shim"]).alias("_r"))), "shim")  # a row for each shim
    profile = F.lit(None).cast("int")
    for progressive, width, level, chroma in PROFILES:
        profile = F.when((h("progressive") == progressive) & (h("width") == width) & (h("profile") == level), chroma).otherwise(profile)
    widths = F.when(h("progressive"), h("width").isin(1920, 1440, 1280)).otherwise(h("width").isin(1920, 1440))
    sizes = (r("isuniqueresolution") == 1) & ((h("width") != r("hsize")) | (h("height") != r("vsize")))
    either = lambda name, found: (r(name) != 2) & (found.cast("int") != r(name))
    ratio = lambda c: F.concat(c["num"], F.lit("/"), c["den"])
    other = lambda a, b: (b["num"] != 0) & ((a["num"] != b["num"]) | (a["den"] != b["den"]))
    size = lambda w, ht: F.concat(w, F.lit("x"), ht)
    # name, severity (0 error, 1 reported so often, 2 so too and an error beyond that), whether violated, found, wanted
    checks = [
        ("constant bit rate", 1, (r("isconstantbitrate") == 1) & h("vbv_delay").isNull(), F.lit(None), F.lit("1")),
        ("single sequence", 1, h("sequence") & either("issinglesequence", h("single_sequence")), h("single_sequence").cast("int"), r("issinglesequence")),
        ("aspect ratio", 0, h("sequence") & other(h("aspect"), r("aspectratio")), ratio(h("aspect")), ratio(r("aspectratio"))),
        ("frame rate", 0, h("sequence") & other(h("rate"), r("samplerate")), ratio(h("rate")), ratio(r("samplerate"))),
        ("bit rate", 1, h("sequence") & (F.abs(h("bit_rate") - r("bitrate")) > r("bitratedelta")), h("bit_rate"), r("bitrate")),
        ("resolution", 0, h("sequence") & sizes, size(h("width"), h("height")), size(r("hsize"), r("vsize"))),
        ("low delay", 2, h("sequence") & either("islowdelay", h("low_delay")), h("low_delay").cast("int"), r("islowdelay")),
        ("scanning", 0, h("extension") & either("isprogressive", h("progressive")), h("progressive").cast("int"), r("isprogressive")),
        ("vertical size", 0, h("extension") & F.when(h("progressive"), ~h("height").isin(1080, 720)).otherwise(h("height") != 1080), h("height"), F.when(h("progressive"), "1080 or 720").otherwise("1080")),
        ("horizontal size", 0, h("extension") & ~widths, h("width"), F.when(h("progressive"), "1920, 1440 or 1280").otherwise("1920 or 1440")),
        ("profile and level", 0, h("extension") & widths & profile.isNull(), h("profile"), F.lit(None)),
        ("resolution of the extension", 0, h("extension") & sizes, size(h("width"), h("height")), size(r("hsize"), r("vsize"))),
        ("chroma of the profile", 0, h("extension") & (F.coalesce(profile, F.lit(420)) != r("croma")), F.coalesce(profile, F.lit(420)), r("croma")),
        ("chroma format", 0, h("extension") & (h("chroma") != 0) & (h("chroma") != r("croma")), h("chroma"), r("croma")),
        ("color primaries", 2, h("display") & h("primaries").isNotNull() & (h("primaries") != r("colorprimaries")), h("primaries"), r("colorprimaries")),
        ("display size", 2, h("display") & (r("isuniqueresolution") == 1) & ((h("display_width") != r("hsize")) | (h("display_height") != r("vsize"))), size(h("display_width"), h("display_height")), size(r("hsize"), r("vsize"))),
        ("top field first", 0, h("coding") & h("extension") & ~h("progressive") & either("istff", h("tff")), h("tff").cast("int"), r("istff")),
        ("longest GOP", 0, h("gop") & (h("max_gop") > r("maxgop")), h("max_gop"), r("maxgop")),
        ("closed GOPs", 0, h("gop") & either("isclosedgop", h("closed_gop")), h("closed_gop").cast("int"), r("isclosedgop")),
        ("identical GOPs", 0, h("gop") & (r("isidenticalgop") == 1) & ~h("identical_gop"), h("identical_gop").cast("int"), r("isidenticalgop")),
    ]
    made = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("check"), F.lit(s).alias("_s"), found.cast("string").alias("found"), wanted.cast("string").alias("wanted"))) for n, s, bad, found, wanted in checks]
    found = rows.select(key, "position", F.explode(F.array_compact(F.array(*made))).alias("_v")).select(key, "position", "_v.*")
    nth = F.row_number().over(Window.partitionBy(key, "check").orderBy("position"))
    out = found.withColumn("nth", nth)
    beyond = F.col("nth") > most + 1
    severity = F.when((F.col("_s") == 0) | ((F.col("_s") == 2) & beyond), "error").otherwise("warning")
    return out.select(key, "position", "check", severity.alias("severity"), "found", "wanted", ((F.col("_s") == 0) | ~beyond).alias("reported"), "nth")


def _leading(text: Column, signed: bool = True) -> Column:
    """The number that a text begins with, whatever follows it."""
    return F.regexp_extract(text, r"^\s*([+-]?\d{1,18})" if signed else r"^\s*\+?(\d{1,18})", 1).try_cast("long")


def typed(properties: DataFrame, rules: DataFrame, num: int | Column, den: int | Column, start: int | Column = 0) -> DataFrame:
    """Properties (framework, name, value) with what their type makes of them: ``type``, ``text``, ``number``, ``pair`` (num, den), ``moment`` and ``problem``.

    ``rules`` (framework, name, type, length) names the types: string (``length`` code points at most, 0: any number, longer ones are cut and ``truncated``), bool, uint8, uint16,
    int64, duration (edit units or h:m:s:f), position (edit units or a timecode, less the offset ``start``), timestamp (a date with or without time), rational (n/d)
    and version (a number, or two of a byte each).  Durations, positions and timecodes count at the rate num / den.  A name without a rule, and a value of another type, has a
    ``problem`` and no value.
    """
    v, kind = F.col("value"), F.col("type")
    part = lambda pattern, k: F.regexp_extract(v, pattern, k).try_cast("long")
    base = rounded_base(num, den)
    clock = r"^\s*([+-]?\d{1,9}):\s*([+-]?\d{1,9}):\s*([+-]?\d{1,9}):\s*([+-]?\d{1,9})"
    code = r"^\s*(\d{1,9}):\s*(\d{1,9}):\s*(\d{1,9})(.)\s*(\d{1,9})"
    colon = F.contains(v, F.lit(":"))
    duration = F.when(~colon, _leading(v)).otherwise(((part(clock, 1) * 60 + part(clock, 2)) * 60 + part(clock, 3)) * base + part(clock, 4))
    drop = (F.regexp_extract(v, code, 4) != ":") & timecode.may_drop(num, den)
    at = timecode.offset(part(code, 1), part(code, 2), part(code, 3), part(code, 5), base, drop) - start
    position = F.when(~colon, _leading(v)).otherwise(F.when(v.rlike(code), at))
    two = r"^\s*\+?(\d{1,9})\.\s*\+?(\d{1,9})"
    version = F.when(v.rlike(two), F.when((part(two, 1) < 256) & (part(two, 2) < 256), part(two, 1) * 256 + part(two, 2))).otherwise(F.when(_leading(v, False) < 65536, _leading(v, False)))
    truth = F.when(v.isin("true", "1"), 1).when(v.isin("false", "0"), 0).cast("long")
    below = lambda most: F.when(_leading(v, False) < most, _leading(v, False))
    number = (
        F.when(kind == "bool", truth).when(kind == "uint8", below(256)).when(kind == "uint16", below(65536)).when(kind == "int64", _leading(v)).when(kind == "duration", duration)
        .when(kind == "position", position).when(kind == "version", version)
    )
    quotient = r"^\s*([+-]?\d{1,9})/\s*([+-]?\d{1,9})"
    pair = F.when((kind == "rational") & v.rlike(quotient), F.struct(part(quotient, 1).alias("num"), part(quotient, 2).alias("den")))
    long_, short = r"^\s*(\d{1,4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})", r"^\s*(\d{1,4})-(\d{1,2})-(\d{1,2})"
    two_digits = lambda k: F.lpad(F.regexp_extract(v, long_, k), 2, "0")
    day = F.concat(F.lpad(F.regexp_extract(v, short, 1), 4, "0"), F.lit("-"), F.lpad(F.regexp_extract(v, short, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(v, short, 3), 2, "0"))
    time = F.when(v.rlike(long_), F.concat(two_digits(4), F.lit(":"), two_digits(5), F.lit(":"), two_digits(6))).otherwise("00:00:00")
    moment = F.when((kind == "timestamp") & v.rlike(short), F.concat(day, F.lit("T"), time))
    text = F.when(kind == "string", F.when(F.col("length") > 0, F.substring(v, F.lit(1), F.col("length"))).otherwise(v))
    joined = properties.join(F.broadcast(rules), ["framework", "name"], "left")  # a row for each property of the frameworks
    made = joined.select(*properties.columns, "type", text.alias("text"), number.alias("number"), pair.alias("pair"), moment.alias("moment"), "length")
    nothing = F.coalesce(F.col("text"), F.col("number").cast("string"), F.col("pair.num").cast("string"), F.col("moment")).isNull()
    problem = F.when(kind.isNull(), "no such property").when(nothing, F.concat(F.lit("not a value of type "), kind)).when(F.length("text") < F.length("value"), "truncated")
    return made.select(*properties.columns, "type", "text", "number", "pair", "moment", problem.alias("problem"))
