"""Frame boundaries and header fields of coded pictures, from the public standards of each format.

H.264: ITU-T H.264; JPEG 2000: ISO/IEC 15444-1; JPEG: ISO/IEC 10918-1; DV: SMPTE ST 314; VC-3: SMPTE ST 2019-1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

H264_SCHEMA = "position long, offset long, size long, nal_types array<int>, type string, idr boolean, sps boolean, pps boolean, frame_num int, profile int, level int, width int, height int, chroma int, interlaced boolean"
J2C_SCHEMA = "width int, height int, components int, bit_depth int, tile_width int, tile_height int"
JPEG_SCHEMA = "position long, offset long, size long, width int, height int"
DV_SCHEMA = "position long, offset long, size long, is_50hz boolean, sequences int, wide boolean"
VC3_SCHEMA = "position long, offset long, size long, compression_id int, width int, height int, bit_depth int, interlaced boolean"


class Bits:
    """Big-endian bits with Exp-Golomb codes."""

    def __init__(self, data: bytes):
        self._x, self._left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self._left:
            raise ValueError("the header is cut off")
        self._left -= n
        return self._x >> self._left & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.take(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("a malformed Exp-Golomb code")
        return (1 << zeros) - 1 + (self.take(zeros) if zeros else 0)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def unescaped(nal: bytes) -> bytes:
    """Payload without emulation prevention bytes."""
    return nal.replace(b"\0\0\3", b"\0\0")


def nal_units(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset of the start code, type, unit) of each unit of a byte stream."""
    marks = [m.start() for m in re.finditer(b"\0\0\1", data)]
    for k, at in enumerate(marks):
        end = marks[k + 1] if k + 1 < len(marks) else len(data)
        unit = data[at + 3 : end].rstrip(b"\0") if k + 1 < len(marks) else data[at + 3 : end]
        if unit:
            yield (at - 1 if at and data[at - 1] == 0 else at), unit[0] & 0x1F, unit


def h264_sequence(unit: bytes) -> dict:
    """Fields of a sequence parameter set."""
    b = Bits(unescaped(unit[1:]))
    profile, _, level = b.take(8), b.take(8), b.take(8)
    b.ue()
    chroma, separate = 1, 0
    if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128):
        chroma = b.ue()
        separate = b.take(1) if chroma == 3 else 0
        b.ue(), b.ue(), b.take(1)
        if b.take(1):
            for k in range(8 if chroma != 3 else 12):
                if b.take(1):
                    last = following = 8
                    for _ in range(16 if k < 6 else 64):
                        if following:
                            following = (last + b.se()) % 256
                        last = following or last
    frame_bits = b.ue() + 4
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.take(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    b.ue(), b.take(1)
    wide, high, frames_only = b.ue() + 1, b.ue() + 1, b.take(1)
    if not frames_only:
        b.take(1)
    b.take(1)
    crop = [b.ue() for _ in range(4)] if b.take(1) else [0] * 4
    x, y = (2 if chroma in (1, 2) else 1), (2 if chroma == 1 else 1) * (2 - frames_only)
    return {
        "profile": profile, "level": level, "chroma": {0: 400, 1: 420, 2: 422, 3: 444}.get(chroma), "interlaced": not frames_only, "width": 16 * wide - x * (crop[0] + crop[1]),
        "height": 16 * high * (2 - frames_only) - y * (crop[2] + crop[3]), "_frame_bits": frame_bits, "_separate": separate,
    }


def h264_frames(data: bytes) -> Iterator[dict]:
    """Access units: a new one begins at a delimiter, a parameter set or a slice that starts a picture, once a picture is in."""
    sequence: dict = {}
    unit: dict | None = None
    k = 0

    def done(end: int) -> dict:
        return unit | {"position": k, "size": end - unit["offset"], **{n: v for n, v in sequence.items() if n[0] != "_"}}

    for at, kind, nal in nal_units(data):
        slice_ = kind in (1, 5)
        first = slice_ and Bits(unescaped(nal[1:16])).ue() == 0
        if unit is None or unit["type"] is not None and (first or kind in (6, 7, 8, 9)):
            if unit is not None:
                yield done(at)
                k += 1
            unit = {"offset": at, "nal_types": [], "type": None, "idr": False, "sps": False, "pps": False}
        unit["nal_types"].append(kind)
        if kind == 7:
            sequence = h264_sequence(nal)
        unit["sps"], unit["pps"], unit["idr"] = unit["sps"] or kind == 7, unit["pps"] or kind == 8, unit["idr"] or kind == 5
        if slice_:
            b = Bits(unescaped(nal[1:32]))
            b.ue()
            name = "PBIPI"[b.ue() % 5]
            b.ue()
            if unit["type"] is None and sequence:
                if sequence["_separate"]:
                    b.take(2)
                unit["frame_num"] = b.take(sequence["_frame_bits"])
            rank = "IPB"
            unit["type"] = name if unit["type"] is None else rank[max(rank.index(name), rank.index(unit["type"]))]
    if unit is not None:
        yield done(len(data))


def j2c_info(data: bytes) -> dict:
    if data[:4] != b"\xff\x4f\xff\x51" or len(data) < 43:
        raise ValueError("not a JPEG 2000 codestream")
    n = lambda at: int.from_bytes(data[at : at + 4], "big")
    return {"width": n(8) - n(16), "height": n(12) - n(20), "tile_width": n(24), "tile_height": n(28), "components": int.from_bytes(data[40:42], "big"), "bit_depth": (data[42] & 0x7F) + 1}


def jpeg_frames(data: bytes) -> Iterator[dict]:
    """Pictures from start to end marker; markers inside segments don't count."""
    at, k = data.find(b"\xff\xd8"), 0
    while at >= 0:
        p, size = at + 2, {}
        while p + 4 <= len(data) and data[p] == 0xFF and data[p + 1] != 0xD9:
            code, n = data[p + 1], int.from_bytes(data[p + 2 : p + 4], "big")
            if code in (0xC0, 0xC1, 0xC2):
                size = {"height": int.from_bytes(data[p + 5 : p + 7], "big"), "width": int.from_bytes(data[p + 7 : p + 9], "big")}
            p += 2 + n
            if code == 0xDA:  # entropy-coded data up to a marker that is neither stuffing nor a restart
                m = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, p)
                p = m.start() if m else len(data)
        if data[p : p + 2] != b"\xff\xd9":
            return
        yield {"position": k, "offset": at, "size": p + 2 - at, **size}
        at, k = data.find(b"\xff\xd8", p + 2), k + 1


def dv_frames(data: bytes) -> Iterator[dict]:
    """Frames of 10 or 12 sequences of 150 blocks of 80 bytes for each channel of 25 Mbit/s."""
    at, k = 0, 0
    while at + 480 <= len(data):
        if data[at] >> 5 != 0:
            raise ValueError(f"no header block at {at}")
        is_50 = bool(data[at + 3] & 0x80)
        per = 12000 * (12 if is_50 else 10)
        channels = 1
        while at + per * (channels + 1) <= len(data) and data[at + per * channels] >> 5 == 0 and data[at + per * channels + 1] & 0x0C != 0x04:  # no first channel
            channels += 1
        if at + per * channels > len(data):
            return
        wide = next((data[at + 240 + 80 * v + 3 + 5 * p + 2] & 0x07 == 2 for v in range(3) for p in range(15) if at + 480 <= len(data) and data[at + 240 + 80 * v + 3 + 5 * p] == 0x61), False)
        yield {"position": k, "offset": at, "size": per * channels, "is_50hz": is_50, "sequences": (12 if is_50 else 10) * channels, "wide": wide}
        at, k = at + per * channels, k + 1


def vc3_frames(data: bytes) -> Iterator[dict]:
    """Coding units, each of which begins with its header prefix on a 4-byte boundary."""
    starts = [m.start() for m in re.finditer(rb"\x00\x00\x02\x80[\x01\x02\x03]", data) if m.start() % 4 == 0]
    for k, at in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(data)
        if at + 44 > len(data):
            raise ValueError("a coding unit's header is cut off")
        n = lambda o, s, at=at: int.from_bytes(data[at + o : at + o + s], "big")
        yield {"position": k, "offset": at, "size": end - at, "compression_id": n(40, 4), "height": n(24, 2), "width": n(26, 2), "bit_depth": {1: 8, 2: 10, 3: 12}.get(data[at + 33] >> 5), "interlaced": bool(data[at + 5] & 0x02)}
