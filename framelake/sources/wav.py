"""Wave files: RIFF and RF64, with broadcast and channel allocation chunks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

INFO = "channels int, sampling_rate int, bits int, block_align int, data_offset long, data_size long, samples long, chunks array<string>, description string, originator string, time_reference long, origination string"
FRAMES = "position long, channel int, samples array<int>"


def chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(id, offset, size) of each chunk; sizes of RF64 come from ds64, and a size beyond the end stops there."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, long_sizes = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
        if name == "ds64" and at + 36 <= len(data):
            _, long_sizes["data"], _, n = struct.unpack_from("<QQQI", data, at + 8)
            for k in range(n):
                if at + 36 + 12 * (k + 1) <= len(data):
                    long_sizes[data[at + 36 + 12 * k :][:4].decode("latin-1")] = int.from_bytes(data[at + 40 + 12 * k : at + 48 + 12 * k], "little")
        if size == 0xFFFFFFFF:
            size = long_sizes.get(name, size)
        size = min(size, len(data) - at - 8)
        yield name, at + 8, size
        at += 8 + size + size % 2


def _text(data: bytes) -> str:
    return data.split(b"\0")[0].decode("latin-1")


def info(data: bytes) -> dict:
    found = {}
    names = []
    for name, at, size in chunks(data):
        names.append(name)
        found.setdefault(name, (at, size))
    if "fmt " not in found or "data" not in found:
        raise ValueError("a wave file needs a format and data")
    _, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", data, found["fmt "][0])
    if not channels or not align:
        raise ValueError("a wave file without channels")
    at, size = found["data"]
    out = {"channels": channels, "sampling_rate": rate, "bits": bits, "block_align": align, "data_offset": at, "data_size": size, "samples": size // align, "chunks": names}
    if "bext" in found and found["bext"][1] >= 346:
        b = data[found["bext"][0] :][:346]
        out |= {"description": _text(b[:256]), "originator": _text(b[256:288]), "origination": f"{_text(b[320:330])} {_text(b[330:338])}", "time_reference": int.from_bytes(b[338:346], "little")}
    return out


def allocation(data: bytes) -> Iterator[dict]:
    """Entries of the channel allocation chunk: track_index, uid, track_ref, pack_ref."""
    for name, at, size in chunks(data):
        if name == "chna":
            for k in range(min(int.from_bytes(data[at + 2 : at + 4], "little"), (size - 4) // 40)):
                e = data[at + 4 + 40 * k :][:40]
                yield {"track_index": int.from_bytes(e[:2], "little"), "uid": _text(e[2:14]), "track_ref": _text(e[14:28]), "pack_ref": _text(e[28:39])}


def samples(data: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Samples (one row each, a column per channel) of a range."""
    i = info(data)
    width = i["block_align"] // i["channels"]
    end = i["samples"] if count is None else min(i["samples"], start + count)
    raw = np.frombuffer(data, dtype=np.uint8, offset=i["data_offset"], count=i["samples"] * i["block_align"]).reshape(-1, i["channels"], width)[start:end]
    wide = np.zeros((*raw.shape[:2], 4), dtype=np.uint8)
    wide[:, :, 4 - width :] = raw
    out = wide.view("<i4")[:, :, 0] >> (8 * (4 - width))
    return (wide.view("<u4")[:, :, 0] >> 24).astype(np.int32) - 128 if width == 1 else out


def frames(data: bytes, sequence: tuple[int, ...] = (1920,)) -> Iterator[dict]:
    """Each channel's samples by frame, whose numbers of samples follow a cycle; the last frame may be short."""
    x, at, k = samples(data), 0, 0
    while at < len(x):
        n = sequence[k % len(sequence)]
        for c in range(x.shape[1]):
            yield {"position": k, "channel": c, "samples": x[at : at + n, c].tolist()}
        at, k = at + n, k + 1


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def build(pcm: np.ndarray, rate: int, bits: int = 16, bext: dict | None = None, audio_ids: list[dict] = (), extra: dict[str, bytes] | None = None, rf64: bool = False) -> bytes:
    """A file of samples (rows) by channels (columns)."""
    width = (bits + 7) // 8
    body = np.ascontiguousarray(pcm.astype("<i4")).view(np.uint8).reshape(*pcm.shape, 4)[:, :, :width].tobytes()
    parts = [_chunk(b"fmt ", struct.pack("<HHIIHH", 1, pcm.shape[1], rate, rate * width * pcm.shape[1], width * pcm.shape[1], bits))]
    if bext is not None:
        fixed = lambda x, n: x.encode("latin-1")[:n].ljust(n, b"\0")
        date, _, time = bext.get("origination", "").partition(" ")
        head = fixed(bext.get("description", ""), 256) + fixed(bext.get("originator", ""), 32) + fixed(bext.get("reference", ""), 32) + fixed(date, 10) + fixed(time, 8)
        parts.append(_chunk(b"bext", head + bext.get("time_reference", 0).to_bytes(8, "little") + bytes(256)))
    if audio_ids:
        rows = b"".join(x["track_index"].to_bytes(2, "little") + x["uid"].encode().ljust(12, b"\0") + x["track_ref"].encode().ljust(14, b"\0") + x["pack_ref"].encode().ljust(11, b"\0") + b"\0" for x in audio_ids)
        parts.append(_chunk(b"chna", len({x["track_index"] for x in audio_ids}).to_bytes(2, "little") + len(audio_ids).to_bytes(2, "little") + rows))
    parts += [_chunk(k.encode("latin-1").ljust(4), v) for k, v in (extra or {}).items()]
    if not rf64:
        whole = b"".join(parts) + _chunk(b"data", body)
        return b"RIFF" + (4 + len(whole)).to_bytes(4, "little") + b"WAVE" + whole
    data = b"data\xff\xff\xff\xff" + body + b"\0" * (len(body) % 2)
    rest = b"".join(parts) + data
    ds64 = _chunk(b"ds64", struct.pack("<QQQI", 4 + 36 + len(rest), len(body), len(pcm), 0))
    return b"RF64\xff\xff\xff\xffWAVE" + ds64 + rest


def chunk_ids(text: str) -> tuple[bool, set[str]]:
    """(whether all are meant, ids filled up to four characters) of a list such as ``ubxt,axml``."""
    ids = [x.strip() for x in text.split(",") if x.strip()]
    if not ids:
        raise ValueError("a list of chunk ids can't be empty")
    return ("all" in ids, set()) if "all" in ids else (False, {x.ljust(4)[:4] for x in ids})
