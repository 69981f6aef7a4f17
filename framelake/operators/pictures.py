"""Display order of H.264 pictures: picture order counts (ITU-T H.264, 8.2.1), which carry state from picture to picture."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class OrderCount:
    """Runs over pictures in coding order.

    ``kind`` is the stream's order count type; ``lsb_bits`` belongs to type 0, ``frame_bits``, ``offsets`` (of a cycle of
    reference frames) and ``non_ref_offset`` to types 1 and 2.
    """

    kind: int = 0
    lsb_bits: int = 4
    frame_bits: int = 4
    offsets: Sequence[int] = ()
    non_ref_offset: int = 0
    _msb: int = field(default=0, init=False)
    _lsb: int = field(default=0, init=False)
    _frame_num: int = field(default=0, init=False)
    _frame_offset: int = field(default=0, init=False)
    _reset: bool = field(default=False, init=False)

    def next(self, idr: bool, reference: bool, frame_num: int = 0, lsb: int = 0, delta: int = 0, reset: bool = False) -> int:
        """Count of the next picture; ``reset`` if it ends with a memory reset."""
        out = self._by_lsb(idr, reference, lsb) if self.kind == 0 else self._by_number(idr, reference, frame_num, delta)
        if reset:  # the picture then counts from zero for those after it
            self._msb, self._lsb, self._frame_num, self._frame_offset = 0, 0, 0, 0
            out = 0
        self._reset = reset
        return out

    def _by_lsb(self, idr: bool, reference: bool, lsb: int) -> int:
        if idr:
            self._msb = self._lsb = 0
        size = 1 << self.lsb_bits
        msb = self._msb
        if lsb < self._lsb and self._lsb - lsb >= size // 2:
            msb += size
        elif lsb > self._lsb and lsb - self._lsb > size // 2:
            msb -= size
        if reference:
            self._msb, self._lsb = msb, lsb
        return msb + lsb

    def _by_number(self, idr: bool, reference: bool, frame_num: int, delta: int) -> int:
        if idr:
            offset = 0
        else:
            offset = (0 if self._reset else self._frame_offset) + (1 << self.frame_bits if self._frame_num > frame_num and not self._reset else 0)
        self._frame_offset, self._frame_num = offset, frame_num
        number = offset + frame_num
        if self.kind == 2:
            return 0 if idr else 2 * number - (not reference)
        if not self.offsets:
            number = 0
        if not reference and number > 0:
            number -= 1
        expected = 0
        if number > 0:
            cycles, at = divmod(number - 1, len(self.offsets))
            expected = cycles * sum(self.offsets) + sum(self.offsets[: at + 1])
        return expected + (0 if reference else self.non_ref_offset) + delta


def order_counts(pictures: DataFrame, key: str, **stream) -> DataFrame:
    """``order_count`` of pictures (position, idr, reference, frame_num, lsb, delta, reset), stream by stream in coding order."""
    kept = pictures.select(key, "position", "idr", "reference", "frame_num", "lsb", "delta", "reset")
    kind = kept.schema[key].dataType.simpleString()

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for k, _, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or k != current:
                    current, state = k, OrderCount(**stream)
                out.append(state.next(*values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[key, "position", "order_count"])

    ordered = kept.withColumn("position", F.col("position").cast("long")).repartition(key).sortWithinPartitions(key, "position")
    return ordered.mapInArrow(run, f"{key} {kind}, position long, order_count long")


class _FieldLsb:
    """Order counts of fields and frames from their low bits: state is what the last reference picture leaves."""

    def __init__(self, lsb_bits: int):
        self._size = 1 << lsb_bits
        self._msb = self._lsb = self._top = 0
        self._reset = self._bottom = False

    def next(self, idr: bool, reference: bool, field_: bool, bottom: bool, lsb: int, delta: int, reset: bool) -> tuple[int | None, int | None]:
        if idr:
            self._msb = self._lsb = 0
            self._reset = False
        elif self._reset:  # a memory reset: counts go on from the top field of the picture that had it
            self._msb, self._lsb = 0, 0 if self._bottom else self._top
        away = lsb - self._lsb
        msb = self._msb + (self._size if away <= -(self._size // 2) else -self._size if away > self._size // 2 else 0)
        top = None if field_ and bottom else msb + lsb
        below = None if field_ and not bottom else msb + lsb + (0 if field_ else delta)
        if reference:
            self._msb, self._lsb, self._top, self._reset, self._bottom = msb, lsb, top or 0, reset, bool(field_ and bottom)
        return top, below


def field_order_counts(pictures: DataFrame, key: str, kind: int, lsb_bits: int = 4, frame_bits: int = 4, offsets: Sequence[int] = (), non_ref_offset: int = 0, top_to_bottom: int = 0) -> DataFrame:
    """``top``, ``bottom`` and ``order_count`` (that of a field, the smaller one of a frame) of coded pictures in coding order, a field or a frame each.

    ``pictures`` has position, idr, reference, field, bottom, frame_num, lsb, delta0 (of the bottom field for kind 0), delta1 and reset (a memory
    reset).  Kinds 1 and 2 are window sums over the wraps of frame numbers; an instantaneous refresh with another number than 0 has null counts.  Kind 0 carries
    its state from picture to picture, a stream streaming through one task.
    """
    counted = _by_low_bits(pictures, key, lsb_bits) if kind == 0 else _by_numbers(pictures, key, kind, frame_bits, offsets, non_ref_offset, top_to_bottom)
    least = F.least("top", "bottom")  # of those that are there
    return counted.select(key, "position", "top", "bottom", least.alias("order_count"))


def _by_low_bits(pictures: DataFrame, key: str, lsb_bits: int) -> DataFrame:
    rows = pictures.select(key, F.col("position").cast("long").alias("position"), "idr", "reference", "field", "bottom", "lsb", "delta0", "reset")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for k, _, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or k != current:
                    current, state = k, _FieldLsb(lsb_bits)
                out.append(state.next(*values))
            top, below = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top, pa.int64()), pa.array(below, pa.int64())], names=[key, "position", "top", "bottom"])

    return rows.repartition(key).sortWithinPartitions(key, "position").mapInArrow(run, f"{key} {kind}, position long, top long, bottom long")


def _by_numbers(pictures: DataFrame, key: str, kind: int, frame_bits: int, offsets: Sequence[int], non_ref_offset: int, top_to_bottom: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("position")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    rows = pictures.withColumn("_wrap", (~F.col("idr") & (F.lag("frame_num", 1, 0).over(w) > F.col("frame_num"))).cast("long"))
    rows = rows.withColumn("_start", F.col("idr") | F.lag("reset", 1, False).over(w)).withColumn("_wraps", F.sum("_wrap").over(upto))
    base = F.coalesce(F.last(F.when(F.col("_start"), F.col("_wraps") - F.col("_wrap")), ignorenulls=True).over(upto), zero)
    number = (F.col("_wraps") - base) * (1 << frame_bits) + F.col("frame_num")
    field_, bottom = F.col("field"), F.col("bottom")
    if kind == 2:
        count = F.when(F.col("idr"), zero).otherwise(2 * number - (~F.col("reference")).cast("long"))
        top, below = count, count
    else:
        nth = number if offsets else zero
        nth = nth - (~F.col("reference") & (nth > 0)).cast("long")
        sums = [0]
        for x in offsets:
            sums.append(sums[-1] + x)
        n = max(1, len(offsets))
        within = F.get(F.array(*(F.lit(x).cast("long") for x in sums[1:] or [0])), ((nth - 1) % n).cast("int"))
        expected = F.when(nth > 0, F.call_function("div", nth - 1, F.lit(n).cast("long")) * sums[-1] + within).otherwise(zero) + F.when(F.col("reference"), zero).otherwise(F.lit(non_ref_offset).cast("long"))
        top = expected + F.col("delta0")
        below = F.when(field_, expected + top_to_bottom + F.col("delta0")).otherwise(top + top_to_bottom + F.col("delta1"))
    known = ~(F.col("idr") & (F.col("frame_num") != 0))
    return rows.select(key, F.col("position").cast("long").alias("position"), F.when(known & ~(field_ & bottom), top).alias("top"), F.when(known & ~(field_ & ~bottom), below).alias("bottom"))


def coding_summary(units: DataFrame, key: str) -> DataFrame:
    """What a descriptor says of a stream's access units (position, type, second_type of a second field or null, field, adaptive, idr, sps, pps).

    ``picture_type`` and ``coding_type`` as the pictures have them, ``max_gop`` (null beyond 65535), ``identical_gops``, ``closed_gops``, ``max_b_run``, ``constant_b``
    (no run that is followed by another picture is shorter than one before it), ``starts_with_i``, and for parameter sets whether ``every`` unit has them, the
    ``first`` alone, or at least each ``gop``.  A pair of fields counts as two pictures.  GOPs begin at intra pictures.
    """
    w = Window.partitionBy(key).orderBy("position")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    intra, pair = F.col("type") == "I", F.col("second_type").isNotNull()
    rows = units.withColumns({"_intra": intra, "_pair": pair, "_gop": F.sum(intra.cast("long")).over(upto)})

    pictures = rows.select(key, "position", F.posexplode(F.filter(F.array("type", "second_type"), lambda t: t.isNotNull())).alias("_sub", "_t"))
    order = Window.partitionBy(key).orderBy("position", "_sub")
    runs = pictures.withColumn("_others", F.sum((F.col("_t") != "B").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = runs.groupBy(key).agg(F.max("_others").alias("_last"))
    runs = runs.where("_t = 'B'").groupBy(key, "_others").agg(F.count("*").alias("n"))
    longest = F.max("n").over(Window.partitionBy(key).orderBy("_others").rowsBetween(Window.unboundedPreceding, 0))
    b = runs.withColumn("_longest", longest).join(last, key).groupBy(key).agg(F.max("n").alias("max_b_run"), F.bool_and((F.col("n") == F.col("_longest")) | (F.col("_others") == F.col("_last"))).alias("constant_b"))

    letters = F.concat("type", F.coalesce("second_type", F.lit("")))
    gops = rows.groupBy(key, "_gop").agg(F.count("*").alias("units"), F.max_by("_pair", "position").alias("_paired"), F.sort_array(F.collect_list(F.struct("position", letters.alias("t")))).alias("_t"))
    gops = gops.withColumn("text", F.array_join(F.transform("_t", lambda x: x["t"]), "")).withColumn("pictures", F.col("units") * (1 + F.col("_paired").cast("long")))
    begun = F.col("_gop") > 0
    shape = gops.groupBy(key).agg(F.max("pictures").alias("_most"), F.min_by(F.when(begun, F.col("text")), F.when(begun, F.col("_gop"))).alias("_model"))
    same = gops.where("_gop > 0").join(shape.select(key, "_model"), key).groupBy(key).agg(F.bool_and(F.startswith("_model", F.col("text"))).alias("_same"))

    first = lambda c: F.min_by(c, "position")
    has = lambda c: F.when(F.bool_and(c), "every").when(first(c) & (F.sum(F.col(c).cast("long")) == 1), "first").when(first(c) & first("_intra") & F.bool_and(~F.col("_intra") | F.col(c)), "gop").otherwise("some").alias(c)
    fields, frames = F.bool_and("field"), ~F.bool_or("field")
    picture_type = F.when(fields, "field").when(frames, "frame").otherwise("frame or field")
    coding = F.when(F.bool_and("field") & F.bool_and("_pair"), "field").when(F.bool_or("field"), "frame and field").when(F.bool_or("adaptive"), "adaptive").otherwise("frame")
    all_ = rows.groupBy(key).agg(picture_type.alias("picture_type"), coding.alias("coding_type"), F.bool_and(~F.col("_intra") | F.col("idr")).alias("closed_gops"), first("_intra").alias("starts_with_i"), has("sps"), has("pps"))
    out = all_.join(shape, key, "left").join(same, key, "left").join(b, key, "left")
    return out.select(
        key, "picture_type", "coding_type", F.when(F.col("_most") <= 65535, F.col("_most")).alias("max_gop"), (F.col("_same").isNull() | F.col("starts_with_i") & F.col("_same") & (F.length("_model") < 4096)).alias("identical_gops"), "closed_gops",
        F.coalesce("max_b_run", F.lit(0).cast("long")).alias("max_b_run"), F.coalesce("constant_b", F.lit(True)).alias("constant_b"), "starts_with_i", "sps", "pps",
    )


def display_positions(counted: DataFrame, key: str) -> DataFrame:
    """``display``: where each picture is shown; counts begin anew at each picture of count 0 that starts a sequence (idr)."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    marked = counted.withColumn("_s", F.sum(F.col("idr").cast("int")).over(w))
    return marked.withColumn("display", (F.row_number().over(Window.partitionBy(key).orderBy("_s", "order_count", "position")) - 1).cast("long")).drop("_s")


def avc_statistics(pictures: DataFrame, key: str) -> DataFrame:
    """Per stream: which pictures carry parameter sets, the decoding delay, and GOPs by their intra pictures.

    ``sps`` and ``pps`` are ``every``, ``first``, ``gop`` (each intra picture) or ``some``.
    """
    intra = F.col("type") == "I"

    def where(flag: str):
        has = F.col(flag)
        first = F.min_by(has, "position")
        return (
            F.when(F.bool_and(has), "every").when(first & (F.sum(has.cast("int")) == 1), "first").when(F.bool_and(has == intra), "gop").otherwise("some").alias(flag)
        )

    delay = F.max(F.col("position") - F.col("display")).alias("decoding_delay")
    return pictures.groupBy(key).agg(where("sps"), where("pps"), delay, F.sum(intra.cast("long")).alias("gops"), F.bool_and(intra | ~F.col("idr")).alias("idr_are_intra"))


def stream_bytes(ranges: DataFrame, key: str, data: DataFrame, data_key: str) -> DataFrame:
    """Bytes of streams that lie in several ranges (seq, offset, size) of files: cut, ordered and joined."""
    cut = ranges.join(data.select(F.col(data_key).alias("_file"), "content"), F.col("file") == F.col("_file"))
    piece = F.substring("content", F.col("offset").cast("int") + 1, F.col("size").cast("int"))
    rows = cut.select(key, F.struct("seq", piece.alias("b")).alias("p")).groupBy(key).agg(F.sort_array(F.collect_list("p")).alias("_p"))
    return rows.select(key, F.unhex(F.array_join(F.transform("_p", lambda x: F.hex(x["b"])), "")).alias("content"))


def external_files(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Tracks with the file that their locator names, by path or else by name; each file once."""
    known = files.select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("_name")).dropDuplicates(["path"])
    by_path = tracks.join(known.select(F.col("path").alias("_path")), F.col("locator") == F.col("_path"), "left")
    name = known.groupBy("_name").agg(F.min("path").alias("_by_name"))
    both = by_path.withColumn("_n", F.regexp_extract("locator", r"([^/\\]*)$", 1)).join(name, F.col("_n") == F.col("_name"), "left")
    return both.withColumn("resolved", F.coalesce("_path", "_by_name")).drop("_path", "_n", "_name", "_by_name")


def size_state(fields: Column, first: Column, second: Column) -> Column:
    """What is known of a picture's size (bytes of its frame or its two fields): ``null`` for 0, ``unknown`` for no value, else ``complete``."""
    of = lambda test: F.when(fields, test(first) | test(second)).otherwise(test(first))
    return F.when(of(lambda x: F.coalesce(x == 0, F.lit(False))), "null").when(of(lambda x: x.isNull()), "unknown").otherwise("complete")


def completed_size(fields: Column, first: Column, second: Column, data: Column) -> Column:
    """``struct<first, second>`` once all ``data`` bytes are there: an open frame takes them all, an open second field what the first leaves."""
    open_ = (size_state(fields, first, second) == "unknown") & (data > 0)
    pair = open_ & fields & first.isNotNull()
    whole = open_ & ~pair
    return F.struct(F.when(whole, data).otherwise(first).alias("first"), F.when(pair & (first < data), data - first).when(~whole, second).alias("second"))
