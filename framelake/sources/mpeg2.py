"""Frame headers of MPEG-2 video (ISO/IEC 13818-2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Frame rates and aspect ratios by their codes, and chroma formats.
RATES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}
ASPECTS = {2: (4, 3), 3: (16, 9)}
CHROMA = {1: 420, 2: 422, 3: 444}

SCHEMA = "position long, offset long, size long, type string, temporal_reference int, vbv_delay int, sequence_header boolean, gop boolean, closed boolean, width int, height int, rate_num int, rate_den int, aspect_num int, aspect_den int, bit_rate long, profile_level int, progressive boolean, chroma int, low_delay boolean"
_START = re.compile(rb"\x00\x00\x01(.)", re.DOTALL)


def bits(data: bytes, at: int, first: int, count: int) -> int:
    """``count`` bits from bit ``first`` on after byte ``at``; missing bytes count as zero."""
    a, b = at + first // 8, at + (first + count + 7) // 8
    x = int.from_bytes(data[a:b].ljust(b - a, b"\0"), "big")
    return x >> (8 * (b - at) - first - count) & ((1 << count) - 1)


def frame_info(data: bytes) -> dict:
    """What the headers before and of the first picture say."""
    out: dict = {"sequence_header": False, "gop": False, "closed": False}
    for m in _START.finditer(data):
        code, at = m[1][0], m.end()
        if code == 0xB3:
            rate, aspect = RATES.get(bits(data, at, 28, 4)), ASPECTS.get(bits(data, at, 24, 4))
            out |= {"sequence_header": True, "width": bits(data, at, 0, 12), "height": bits(data, at, 12, 12), "bit_rate": bits(data, at, 32, 18)}
            if rate:
                out |= {"rate_num": rate[0], "rate_den": rate[1]}
            if aspect:
                out |= {"aspect_num": aspect[0], "aspect_den": aspect[1]}
        elif code == 0xB5 and bits(data, at, 0, 4) == 1 and out["sequence_header"]:
            out |= {"profile_level": bits(data, at, 4, 8), "progressive": bool(bits(data, at, 12, 1)), "chroma": CHROMA.get(bits(data, at, 13, 2)), "low_delay": bool(bits(data, at, 40, 1))}
            out["width"] |= bits(data, at, 15, 2) << 12
            out["height"] |= bits(data, at, 17, 2) << 12
            out["bit_rate"] |= bits(data, at, 19, 12) << 18
            if "rate_num" in out:
                out["rate_num"] *= bits(data, at, 41, 2) + 1
                out["rate_den"] *= bits(data, at, 43, 5) + 1
        elif code == 0xB8:
            out |= {"gop": True, "closed": bool(bits(data, at, 25, 1))}
        elif code == 0x00:
            out |= {"temporal_reference": bits(data, at, 0, 10), "type": {1: "I", 2: "P", 3: "B"}.get(bits(data, at, 10, 3)), "vbv_delay": bits(data, at, 13, 16)}
            break
    return out


def split(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, size) of each frame: from a sequence, group or picture header that follows a picture to the next such."""
    start, seen = None, False
    for m in _START.finditer(data):
        if m[1][0] in (0x00, 0xB3, 0xB8):
            if start is None:
                start = m.start()
            elif seen:
                yield start, m.start() - start
                start, seen = m.start(), False
            seen = seen or m[1][0] == 0x00
    if start is not None and seen:
        yield start, len(data) - start


def frames(data: bytes) -> Iterator[dict]:
    for k, (at, size) in enumerate(split(data)):
        yield {"position": k, "offset": at, "size": size, **frame_info(data[at : at + size])}


def with_aspect(data: bytes, code: int) -> bytes:
    """A frame with another aspect ratio code in its sequence header, if it has one before its picture."""
    for m in _START.finditer(data):
        if m[1][0] == 0x00:
            break
        if m[1][0] == 0xB3:
            at = m.end() + 3
            return data[:at] + bytes([code << 4 | data[at] & 0x0F]) + data[at + 1 :]
    return data
