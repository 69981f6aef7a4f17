"""Serial audio metadata (RDD 6) that stands in packets of a frame: payloads as rows of fields, and back.

A frame's metadata are one or two sub-frames, each in a packet of its own: a sync segment, then data segments with a checksum each.  Everything is
Column expressions over bytes: segments are found by a fold over the payload, fields are cut from its bits, and payloads are put
together from sorted rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the standard: the packet's id and those of its kinds, words that begin sub-frames and end a frame.
DID, SDIDS = 0x45, range(1, 10)
FIRST, SECOND, END = 0xCFFC, 0x3FF3, 0x0A0A
# Fixed values of the standard: the bits of each field, in order, by segment; 0 is the sync segment.
FIELDS: dict[int, list[tuple[str, int]]] = {
    0: [("revision_id", 4), ("originator_id", 8), ("originator_address", 16), ("frame_count", 16), ("reserved", 12)],
    1: [("program_config", 6), ("frame_rate_code", 4), ("pitch_shift_code", 12), ("smpte_time_code", 64), ("reserved", 8)],
    2: [("program_config", 6), ("frame_rate_code", 4), ("pitch_shift_code", 12), ("reserved", 8)],
    3: [("program_id", 5), ("datarate", 5), ("bsmod", 3), ("acmod", 3), ("cmixlev", 2), ("surmixlev", 2), ("dsurmod", 2), ("lfeon", 1), ("dialnorm", 5), ("langcode", 1), ("langcod", 8), ("audprodie", 1),
        ("mixlevel", 5), ("roomtyp", 2), ("copyrightb", 1), ("origbs", 1), ("xbsi1e", 1), ("dmixmod", 2), ("ltrtcmixlev", 3), ("ltrtsurmixlev", 3), ("lorocmixlev", 3), ("lorosurmixlev", 3), ("xbsi2e", 1),
        ("dsurexmod", 2), ("dheadphonmod", 2), ("adconvtyp", 1), ("reserved_1", 8), ("reserved_2", 1), ("hpfon", 1), ("bwlpfon", 1), ("lfelpfon", 1), ("sur90on", 1), ("suratton", 1), ("rfpremphon", 1),
        ("compre", 1), ("compr1", 8), ("dynrnge", 1), ("dynrng1", 8), ("dynrng2", 8), ("dynrng3", 8), ("dynrng4", 8), ("reserved_3", 1)],
    4: [("program_id", 5), ("datarate", 5), ("bsmod", 3), ("acmod", 3), ("lfeon", 1), ("dialnorm", 5), ("compre", 1), ("compr2", 8), ("dynrnge", 1), ("dynrng5", 8), ("dynrng6", 8), ("dynrng7", 8), ("dynrng8", 8)],
    5: [("program_id", 5), ("reserved_1", 5), ("bsmod", 3), ("acmod", 3), ("cmixlev", 2), ("surmixlev", 2), ("dsurmod", 2), ("lfeon", 1), ("dialnorm", 5), ("langcode", 1), ("langcod", 8), ("audprodie", 1),
        ("mixlevel", 5), ("roomtyp", 2), ("copyrightb", 1), ("origbs", 1), ("timecod1e", 1), ("timecod1", 14), ("timecod2e", 1), ("timecod2", 14), ("hpfon", 1), ("bwlpfon", 1), ("lfelpfon", 1), ("sur90on", 1),
        ("suratton", 1), ("rfpremphon", 1), ("compre", 1), ("compr1", 8), ("dynrnge", 1), ("dynrng1", 8), ("dynrng2", 8), ("dynrng3", 8), ("dynrng4", 8), ("reserved_2", 1)],
    6: [("program_id", 5), ("datarate", 5), ("bsmod", 3), ("acmod", 3), ("lfeon", 1), ("dialnorm", 5), ("compre", 1), ("compr2", 8), ("dynrnge", 1), ("dynrng5", 8), ("dynrng6", 8), ("dynrng7", 8), ("dynrng8", 8)],
}
# Fixed values of the standard: programs and channels by the number of a program configuration.
PROGRAMS = (2, 3, 2, 3, 4, 5, 4, 5, 6, 7, 8, 1, 2, 3, 3, 4, 5, 6, 1, 2, 3, 4, 1, 1)
CHANNELS = (8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 6, 6, 6, 6, 6, 6, 6, 4, 4, 4, 4, 8, 8)
# Fixed values of the standard: fields whose values don't go as far as their bits; the last two columns name a field of the segment that has to have a value.
RANGES = [
    ("program_config", 0, 23, None, None), ("frame_rate_code", 1, 5, None, None), ("program_id", 0, 7, None, None), ("datarate", 0, 18, "datarate_given", 1), ("acmod", 1, 7, None, None),
    ("langcod", 0, 127, None, None), ("xbsi1e", 1, 1, None, None), ("xbsi2e", 1, 1, None, None), *((f"compr{k}", 0, 5, "compre", 0) for k in (1, 2)), *((f"dynrng{k}", 0, 5, "dynrnge", 0) for k in range(1, 9)),
]
#: Data segments that a sub-frame may hold, and programs and channels of one at most.
MOST, PARTS = 64, 8


def _chars(data: Column) -> Column:
    """Bytes as characters of one byte each."""
    return F.decode(data, "ISO-8859-1")


def _byte(text: Column, at: Column) -> Column:
    """The byte at a place from 1 on; null behind the end."""
    return F.when(at <= F.length(text), F.ascii(F.substring(text, at, F.lit(1))))


def _word(value: int) -> Column:
    return F.lit(chr(value >> 8) + chr(value & 0xFF))


def packet_data(packet: Column) -> Column:
    """What a packet holds behind its ids and size; empty for none, null for other ids or a size beyond its end."""
    text = _chars(packet)
    size = _byte(text, F.lit(3))
    good = (_byte(text, F.lit(1)) == DID) & _byte(text, F.lit(2)).between(SDIDS[0], SDIDS[-1]) & (size <= F.length(text) - 3)
    return F.when(packet.isNull() | (F.length(packet) <= 3), F.lit("")).when(good, F.substring(text, F.lit(4), size))


def _segments(text: Column, begin: Column) -> Column:
    """``struct<at, ok, found: array<struct<id, size, begin, checksum>>>`` of a sub-frame whose sync segment begins at ``begin``; ``ok`` if a zero id ends it."""
    kind = "struct<at:int,ok:boolean,stop:boolean,found:array<struct<id:int,size:int,begin:int,checksum:int>>>"
    first = F.struct((begin + 7).cast("int").alias("at"), F.lit(False).alias("ok"), F.lit(False).alias("stop"), F.array().cast("array<struct<id:int,size:int,begin:int,checksum:int>>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        at, id_ = state["at"], _byte(text, state["at"])
        given = _byte(text, at + 1)
        size = F.when(given == 0, 256).otherwise(given)
        whole = at + 2 + size <= F.length(text)
        one = F.struct(id_.alias("id"), size.alias("size"), (at + 2).alias("begin"), _byte(text, at + 2 + size).alias("checksum"))
        ends, broken = F.coalesce(id_ == 0, F.lit(False)), F.coalesce(~whole, F.lit(True))
        on = F.struct((at + 3 + size).alias("at"), F.lit(False).alias("ok"), F.lit(False).alias("stop"), F.concat(state["found"], F.array(one)).alias("found"))
        off = F.struct((at + 1).alias("at"), ends.alias("ok"), F.lit(True).alias("stop"), state["found"].alias("found"))
        return F.when(state["stop"], state).when(ends | broken, off.cast(kind)).otherwise(on.cast(kind))

    return F.aggregate(F.sequence(F.lit(0), F.lit(MOST)), first.cast(kind), step)


def _sums(text: Column, begin: Column, size: Column) -> Column:
    """The checksum of a segment: what its size and bytes lack to 256."""
    total = F.aggregate(F.sequence(F.lit(0), size - 1), size % 256, lambda a, k: a + F.ascii(F.substring(text, begin + k, F.lit(1))))
    return (256 - total % 256) % 256


def _bits(text: Column) -> Column:
    n = F.length(text)
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.lpad(F.bin(F.ascii(F.substring(text, k, F.lit(1)))), 8, "0")), "")


def segments(frames: DataFrame, keys: Sequence[str], first: str = "first", second: str = "second") -> DataFrame:
    """A row for each segment of each frame's two packets (binary, either null): keys, ``subframe`` (1, 2), ``segment`` (0 is the sync), ``id``, ``data``, ``intact`` (its checksum) and ``problem``.

    Sub-frames are looked for in the data of both packets one after another; the word that comes first counts, and a first sub-frame after a second replaces it.  A frame without any gives a row with its ``problem``, as does a sub-frame that doesn't end.
    """
    a, b = packet_data(F.col(first)), packet_data(F.col(second))
    rows = frames.select(*keys, F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))).alias("_t"), (a.isNull() | b.isNull()).alias("_bad"))
    t, at = F.col("_t"), lambda word, begin: F.call_function("locate", _word(word), F.col("_t"), begin)
    rows = rows.withColumns({"_f": at(FIRST, F.lit(1)), "_s": at(SECOND, F.lit(1))})
    lone = (F.col("_s") > 0) & ((F.col("_f") == 0) | (F.col("_s") < F.col("_f")))  # then what looks like the first one's word is data of the second, up to the end of the frame
    rows = rows.withColumn("_lone", F.when(lone, _segments(t, F.col("_s") + 2)))
    after = F.when((F.col("_f") > 0) & F.col("_lone").isNotNull(), at(FIRST, F.col("_lone.at")))
    ends = F.when(after > 0, at(END, F.col("_lone.at")))
    rows = rows.withColumn("_a", F.when(F.col("_lone").isNull(), F.col("_f")).when((after > 0) & ((ends == 0) | (after < ends)), after).otherwise(0))
    rows = rows.withColumn("_one", F.when(F.col("_a") > 0, _segments(t, F.col("_a") + 2)))
    rows = rows.withColumn("_b", F.when(F.col("_one").isNotNull(), at(SECOND, F.col("_one.at"))).otherwise(F.col("_s")))
    rows = rows.withColumn("_two", F.when(F.col("_one").isNull(), F.col("_lone")).when(F.col("_b") > 0, _segments(t, F.col("_b") + 2)))
    none = F.struct(F.lit(0).alias("subframe"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("struct<at:int,ok:boolean,stop:boolean,found:array<struct<id:int,size:int,begin:int,checksum:int>>>").alias("s"))
    sub = lambda n, begin, s: F.struct(F.lit(n).alias("subframe"), (F.col(begin) + 2).alias("begin"), F.col(s).alias("s"))
    some = F.filter(F.array(sub(1, "_a", "_one"), sub(2, "_b", "_two")), lambda x: x["s"].isNotNull())
    each = rows.select(*keys, "_t", "_bad", F.explode(F.when(F.size(some) > 0, some).otherwise(F.array(none))).alias("_x"))
    sync = F.struct(F.lit(0).alias("id"), F.lit(7).alias("size"), F.col("_x.begin").alias("begin"), F.lit(None).cast("int").alias("checksum"))
    all_ = F.concat(F.array(sync), F.coalesce(F.col("_x.s.found"), F.array().cast("array<struct<id:int,size:int,begin:int,checksum:int>>")))
    one = each.select(*keys, "_t", "_bad", "_x", F.posexplode(all_).alias("segment", "_g"))
    data = F.substring("_t", F.col("_g.begin"), F.col("_g.size"))
    problem = F.when(F.col("_bad"), "a packet of other ids or cut off").when(F.col("_x.begin").isNull(), "no sub-frame").when(~F.col("_x.s.ok"), "a sub-frame without end")
    intact = F.when(F.col("segment") > 0, F.col("_g.checksum") == _sums(F.col("_t"), F.col("_g.begin"), F.col("_g.size")))
    return one.select(*keys, F.col("_x.subframe").alias("subframe"), "segment", F.col("_g.id").alias("id"), data.alias("data"), intact.alias("intact"), problem.alias("problem"))


def _layout(id_: Column, bits: Column) -> Column:
    """Fields of a segment, an array of ``struct<field, at (from 1), width>``."""
    fixed = F.lit(None).cast("array<struct<field:string,at:int,width:int>>")
    for number, fields in FIELDS.items():
        at, own = 1, []
        for name, width in fields:
            own.append(F.struct(F.lit(name).alias("field"), F.lit(at).alias("at"), F.lit(width).alias("width")))
            at += width
        fixed = F.when(id_ == number, F.array(*own)).otherwise(fixed)
    config = F.conv(F.substring(bits, 1, 6), 2, 10).cast("int")
    programs, channels = (F.get(F.array(*map(F.lit, x)), config) for x in (PROGRAMS, CHANNELS))
    start = 1 + sum(w for _, w in FIELDS[1])
    many = lambda n, head, base, step: F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: k < n), lambda k: F.array(*(F.struct(F.concat(F.lit(f"{name}_"), k).alias("field"), (base + k * step + off).alias("at"), F.lit(width).alias("width")) for name, off, width in head))))
    more = F.concat(
        many(programs, (("text", 0, 8), ("text_reserved", 8, 2)), F.lit(start), 10),
        many(channels, (("first_a", 0, 4), ("first_b", 4, 1)), start + programs * 10, 5),
        many(channels, (("second_a", 0, 10), ("second_b", 10, 10)), start + programs * 10 + channels * 5, 20),
    )
    return F.when(id_ == 1, F.concat(fixed, F.coalesce(more, F.array().cast("array<struct<field:string,at:int,width:int>>")))).otherwise(fixed)


def fields(segments_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields (``field, ord, width, value``) of segments with a known id; those that reach behind the end of theirs are left out.

    ``pitch_shift_code`` is signed; a value of 64 bits is a signed long of the same bits.
    """
    own = [*keys, "subframe", "segment", "id"]
    rows = segments_.where("data is not null").withColumn("_bits", _bits(F.col("data")))
    rows = rows.select(*own, "_bits", F.posexplode(_layout(F.col("id"), F.col("_bits"))).alias("ord", "_f"))
    rows = rows.where(F.col("_f.at") + F.col("_f.width") - 1 <= F.length("_bits"))
    value = F.conv(F.substring("_bits", F.col("_f.at"), F.col("_f.width")), 2, -10).cast("long")
    value = F.when((F.col("_f.field") == "pitch_shift_code") & (value >= 2048), value - 4096).otherwise(value)
    return rows.select(*own, "ord", F.col("_f.field").alias("field"), F.col("_f.width").alias("width"), value.alias("value"))


def packets(fields_: DataFrame, keys: Sequence[str], sdid: int) -> DataFrame:
    """The reverse of ``fields``: ``first`` and ``second`` packets of each frame from its rows (subframe, segment, id, ord, width, value)."""
    bits = F.lpad(F.bin(F.col("value").cast("long")), 64, "0")
    one = F.struct("ord", F.substring(bits, 65 - F.col("width"), F.col("width")).alias("b"))
    rows = fields_.groupBy(*keys, "subframe", "segment", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["b"]), "").alias("_b"))
    n = F.length("_b")
    full = F.rpad("_b", F.call_function("div", n + 7, F.lit(8)).cast("int") * 8, "0")
    eights = lambda b: F.sequence(F.lit(0), F.call_function("div", F.length(b) - 1, F.lit(64)).cast("int"))  # noqa: E731  eight bytes at once
    word8 = lambda x: F.lpad(F.conv(x, 2, 16), F.call_function("div", F.length(x), F.lit(4)).cast("int"), "0")
    hexes = lambda b: F.array_join(F.transform(eights(b), lambda k: word8(F.substring(b, k * 64 + 1, F.lit(64)))), "")
    rows = rows.withColumn("_h", hexes(full)).withColumn("_size", F.call_function("div", F.length("_h"), F.lit(2)).cast("int"))
    text = _chars(F.unhex("_h"))
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    whole = F.when(F.col("segment") == 0, F.col("_h")).otherwise(F.concat(byte(F.col("id")), byte(F.col("_size") % 256), F.col("_h"), byte(_sums(text, F.lit(1), F.col("_size")))))
    rows = rows.withColumn("_w", whole).groupBy(*keys, "subframe").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "_w"))), lambda x: x["_w"]), "").alias("_p"))
    word = F.when(F.col("subframe") == 1, f"{FIRST:04X}").otherwise(f"{SECOND:04X}")
    body = F.concat(word, F.col("_p"), F.lit("00"), F.when(F.col("subframe") == 2, f"{END:04X}").otherwise(""))
    packet = F.unhex(F.concat(F.lit(f"{DID:02X}{sdid:02X}"), byte(F.call_function("div", F.length(body), F.lit(2)).cast("int")), body))
    rows = rows.select(*keys, "subframe", packet.alias("_k"))
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("subframe") == k, F.col("_k"))).alias(name) for k, name in ((1, "first"), (2, "second"))))


def violations(spark: SparkSession, fields_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields whose value is out of range, with the range that holds for them; a condition looks at another field of the same segment."""
    table = F.broadcast(spark.createDataFrame(RANGES, "field string, low long, high long, when_field string, when_value long"))  # a row for each range
    own = [*keys, "subframe", "segment", "id"]
    others = fields_.groupBy(*own).agg(*(F.max(F.when(F.col("field") == c, F.col("value"))).alias(f"_{c}") for c in ("compre", "dynrnge")))
    rows = fields_.join(table, "field").join(others, own)
    holds = F.when(F.col("when_field") == "compre", F.col("_compre") == F.col("when_value")).when(F.col("when_field") == "dynrnge", F.col("_dynrnge") == F.col("when_value")).when(F.col("when_field") == "datarate_given", F.col("value") != 31).otherwise(True)
    return rows.where(holds & ~F.col("value").between(F.col("low"), F.col("high"))).select(*own, "field", "value", "low", "high")
