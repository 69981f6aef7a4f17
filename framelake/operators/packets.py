"""Ancillary and VBI packets: filters by class, manifests, identifiers, and the line format they travel in."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Packet classes by (DID, SDIDs), no SDIDs meaning any.
CLASSES = {
    "st2020": ((0x45, ()),),
    "st2016": ((0x41, (0x05, 0x06)),),
    "sdp": ((0x43, (0x02,)),),
    "st12": ((0x60, (0x60,)),),
    "st334": ((0x61, (0x01, 0x02)), (0x62, (0x02,))),
}
#: Payload codings of 8 bits a sample (luma, colour difference, both; the same with errors) and of 10 bits.
CODINGS_8, CODINGS_10 = (4, 5, 6, 10, 11, 12), (7, 8, 9)


def parse_filter(text: str) -> tuple[str, ...]:
    """Classes named by a comma-separated list; an item may go on after a class's name, and ``all`` stands alone."""
    out: list[str] = []
    for item in (x.strip() for x in text.split(",")):
        name = next((c for c in ("all", *CLASSES) if item.startswith(c)), None)
        if name is None:
            raise ValueError(f"unknown class of packets: {item!r}")
        if name == "all":
            return ("all",)
        out.append(name)
    return tuple(dict.fromkeys(out))


def in_class(name: str, did: Column, sdid: Column) -> Column:
    if name == "all":
        return F.lit(True)
    test = F.lit(False)
    for d, sdids in CLASSES[name]:
        test = test | ((did == d) & (sdid.isin(*sdids) if sdids else F.lit(True)))
    return test


def in_any(names: Iterable[str], did: Column, sdid: Column) -> Column:
    test = F.lit(False)
    for n in names:
        test = test | in_class(n, did, sdid)
    return test


def keeps(passed: Sequence[str], stripped: Sequence[str], did: Column, sdid: Column) -> Column:
    """Whether a packet stays: it passes (all do if only a strip set is given) and isn't stripped; nothing stays without any set."""
    passes = in_any(passed, did, sdid) if passed else F.lit(bool(stripped))
    return passes & ~in_any(stripped, did, sdid) if stripped else passes


def whole_frames(passed: Sequence[str], stripped: Sequence[str]) -> bool:
    """Whether frames go through as they are: everything passes as a class and not everything is stripped."""
    return ("all" in passed or (not passed and bool(stripped))) and "all" not in stripped


def filter_lines(frames: DataFrame, passed: Sequence[str], stripped: Sequence[str], mode: str = "packet") -> DataFrame:
    """``lines`` (array of structs with did and sdid) without the packets that don't stay.

    ``mode="reference"`` leaves frames untouched where everything passes as a class, even if some classes are stripped.
    """
    if mode == "reference" and whole_frames(passed, stripped):
        return frames
    return frames.withColumn("lines", F.filter("lines", lambda x: keeps(passed, stripped, x["did"], x["sdid"])))


def filter_tracks(tracks: DataFrame, passed: Sequence[str], stripped: Sequence[str]) -> DataFrame:
    """Tracks of whose manifest any element stays."""
    return tracks.where(F.exists("manifest", lambda x: keeps(passed, stripped, x["did"], x["sdid"])))


def manifest(lines: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Distinct elements in order of first sight: ``element`` counts from 0."""
    from pyspark.sql.window import Window

    seen = lines.groupBy(*keys, *fields).agg(F.min(F.struct("position", "line_idx")).alias("_first"))
    return seen.withColumn("element", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")


def max_element_size(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes that a frame may take: a header, and twice a full packet for each SDID seen, in 10 bits if any is."""
    ten = F.bool_or(F.col("coding").isin(*CODINGS_10))
    packet = F.when(ten, (259 + 2) // 3 * 4).otherwise(260)
    return lines.groupBy(*keys).agg((2 + F.count_distinct("sdid") * 2 * (14 + packet)).cast("long").alias("max_size"))


def _byte(payload: Column, k: int) -> Column:
    return F.conv(F.substring(F.hex(payload), 2 * k + 1, 2), 16, 10).cast("int")


def packet_ids(payload: Column, coding: Column) -> Column:
    """``struct<did, sdid>`` of a payload, 0 where it has none; 10-bit samples are packed, and their low 8 bits count."""
    b = [F.coalesce(_byte(payload, k), F.lit(0)) for k in range(3)]
    did10 = (F.shiftleft(b[0], 2) + F.shiftright(b[1], 6)).bitwiseAND(F.lit(0xFF))
    sdid10 = (F.shiftleft(b[1], 4) + F.shiftright(b[2], 4)).bitwiseAND(F.lit(0xFF))
    size = F.coalesce(F.length(payload), F.lit(0))
    did = F.when(coding.isin(*CODINGS_8) & (size > 0), b[0]).when(coding.isin(*CODINGS_10) & (size > 1), did10).otherwise(F.lit(0))
    sdid = F.when(did == 0, 0).when(coding.isin(*CODINGS_8) & (size > 1), b[1]).when(coding.isin(*CODINGS_10) & (size > 2), sdid10).otherwise(F.lit(0))
    return F.struct(did.alias("did"), sdid.alias("sdid"))


LINE = "line_number int, wrapping int, coding int, sample_count int, payload binary"


def parse_element(data: bytes) -> list[tuple[int, int, int, int, bytes]]:
    """Lines of an element: a count, then for each a header of 14 bytes and its payload (an array of single bytes)."""
    if not data:
        return []
    if len(data) < 2:
        raise ValueError("an element needs two bytes at least")
    (count,), at, out = struct.unpack_from(">H", data), 2, []
    for _ in range(count):
        if len(data) - at < 14:
            raise ValueError("a line's header is cut off")
        line, wrapping, coding, samples, n, width = struct.unpack_from(">HBBHII", data, at)
        at += 14
        if n and width != 1:
            raise ValueError(f"payload items of {width} bytes")
        if n > len(data) - at:
            raise ValueError("a line's payload is cut off")
        out.append((line, wrapping, coding, samples, data[at : at + n]))
        at += n
    return out


def build_element(lines: Iterable[tuple[int, int, int, int, bytes]]) -> bytes:
    """The reverse, with payloads padded to a multiple of four."""
    lines = list(lines)
    if len(lines) > 0xFFFF:
        raise ValueError("too many lines for one element")
    out = [struct.pack(">H", len(lines))]
    for line, wrapping, coding, samples, payload in lines:
        padded = payload + bytes(-len(payload) % 4)
        out.append(struct.pack(">HBBHII", line, wrapping, coding, samples, len(padded), 1) + padded)
    return b"".join(out)


def explode_elements(frames: DataFrame, keys: Sequence[str], column: str = "payload") -> DataFrame:
    """A row for each line of each frame's element, or one with ``error`` where it can't be read."""
    kept = frames.select(*keys, F.col(column).alias("_data"))

    def run(batches):
        for batch in batches:
            index, rows = [], []
            for i, data in enumerate(batch.column("_data").to_pylist()):
                try:
                    found = [(k, *x, None) for k, x in enumerate(parse_element(data or b""))]
                except ValueError as e:
                    found = [(None, None, None, None, None, None, str(e))]
                index += [i] * len(found)
                rows += found
            kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)]
            part = batch.select(list(keys)).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*keys, "line_idx", "line_number", "wrapping", "coding", "sample_count", "payload", "error"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema)
    return kept.mapInArrow(run, f"{schema}, line_idx int, {LINE}, error string")
