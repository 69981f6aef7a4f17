"""Key-length-value packets: 16-byte keys and BER lengths."""

from __future__ import annotations

from collections.abc import Iterator

SCHEMA = "key string, offset long, value_offset long, size long, value binary"


def length(data: bytes, at: int) -> tuple[int, int] | None:
    """(value length, bytes it takes) of a BER length, None if it is cut off."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, 1
    n = first & 0x7F
    if not 0 < n <= 8:
        raise ValueError(f"a length of {n} bytes")
    if at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), 1 + n


class Parser:
    """Takes bytes as they come and gives packets that are whole; ``position`` is where the first one that isn't begins."""

    def __init__(self, position: int = 0):
        self.position, self._rest = position, b""

    def push(self, data: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
        """(key, offset, offset of the value, value) of each packet that ``data`` completes."""
        rest = self._rest = self._rest + data if self._rest else data
        at, here, end = 0, self.position, len(rest)
        try:
            while end - at >= 17:
                first = rest[at + 16]
                n = first & 0x7F if first & 0x80 else 0
                start = at + 17 + n
                if n > 8 or first == 0x80:
                    raise ValueError(f"a length of {n} bytes")
                if start > end:
                    break
                until = start + (int.from_bytes(rest[at + 17 : start], "big") if n else first)
                if until > end:
                    break
                key, value = rest[at : at + 16], rest[start:until]
                offset, at = at, until
                yield key, here + offset, here + start, value
        finally:
            self._rest, self.position = rest[at:], here + at


def parse(data: bytes) -> Iterator[dict]:
    p = Parser()
    for key, offset, start, value in p.push(data):
        yield {"key": key.hex(), "offset": offset, "value_offset": start, "size": len(value), "value": value}
    if p._rest:
        raise ValueError(f"an incomplete packet at {p.position}")


def build(key: bytes, value: bytes, length_bytes: int = 4) -> bytes:
    if len(key) != 16:
        raise ValueError("a key has 16 bytes")
    return key + bytes([0x80 | length_bytes]) + len(value).to_bytes(length_bytes, "big") + value


def values(data: bytes, prefix: bytes) -> bytes:
    """All values whose keys start so, one after another: essence unwrapped from its packets."""
    return b"".join(v for k, _, _, v in Parser().push(data) if k.startswith(prefix))


def track_number(key: bytes) -> int | None:
    """The track number in an essence element key; None for other keys."""
    return int.from_bytes(key[12:16], "big") if key.startswith(bytes.fromhex("060e2b34")) and key[4:6] == b"\x01\x02" and key[8:12] == bytes.fromhex("0d010301") else None


def find_track(data: bytes, number: int) -> Iterator[bytes]:
    return (v for k, _, _, v in Parser().push(data) if track_number(k) == number)


def fixed_frames(data: bytes, size: int) -> Iterator[dict]:
    """Frames of one size; a rest that is too short is left out."""
    for k in range(len(data) // size):
        yield {"position": k, "offset": k * size, "payload": data[k * size : (k + 1) * size]}
