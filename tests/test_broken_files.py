"""Parsers on every prefix of a file, and with bits flipped: what they raise is what ``files.scan`` turns into a status."""

import random
import struct

import numpy as np
import pytest

from framelake.operators import channels, events
from framelake.plans.container_queries import container
from framelake.sources import codecs, containers, files, klv, mpeg2, wav

KNOWN = (ValueError, LookupError, ArithmeticError, struct.error)
MARK = klv.build(next(iter(containers.MARKS)), b"mark")
SYSTEM = (
    containers.build_partition("header") + klv.build(containers.SYSTEM_PACK, bytes([0x30, 4]) + bytes(55))
    + klv.build(containers.PACKAGE_ITEM + b"\0", b"\x83" + struct.pack(">H", 32) + bytes(32) + b"\x88" + struct.pack(">H", len(MARK)) + MARK)
    + containers.build_local(containers.SYSTEM_SCHEME + b"\x01\x00", [(0x0102, containers.batch([bytes(8)] * 3, 8))])
)
WAVE = wav.build(np.arange(24, dtype=np.int32).reshape(-1, 2), 48000, audio_ids=[{"track_index": 1, "uid": "u", "track_ref": "t", "pack_ref": "p"}])
MPEG = bytes.fromhex("000001b3 2d0240 33 ffffe0 18 000001b8 00080040 00000100 000f fff8 00000101 1122 00000100 0057 fff8 000001b7".replace(" ", ""))
H264 = bytes.fromhex("00000001 674d401e 9a7402802dd0 00000001 68ee3c80 00000001 6588840a 00000001 419a2411".replace(" ", ""))
PARSERS = [
    (containers.partitions, container(7, [5, 6])), (containers.properties, container(7, [5, 6, 3])), (containers.index_segments, container(7, [5, 6])), (containers.elements, container(7, [5, 6])),
    (containers.system_items, SYSTEM), (klv.parse, klv.build(bytes(16), b"abc") * 3), (lambda d: [wav.info(d)], WAVE), (wav.allocation, WAVE), (lambda d: wav.samples(d).tolist(), WAVE),
    (mpeg2.frames, MPEG), (codecs.h264_frames, H264), (codecs.vc3_frames, bytes.fromhex("000002800103") + bytes(700)), (codecs.dv_frames, bytes.fromhex("1f0700bf") + bytes(12000)),
    (codecs.jpeg_frames, bytes.fromhex("ffd8ffc0001108024002d003012200021101031101ffd9") * 2), (lambda d: [codecs.j2c_info(d)], bytes.fromhex("ff4fff51002f") + bytes(60)),
]


@pytest.mark.parametrize("parse,data", PARSERS, ids=lambda x: getattr(x, "__name__", ""))
def test_parsers_raise_what_scan_knows(parse, data):
    rng = random.Random(7)
    cuts = range(len(data)) if len(data) < 3000 else sorted(rng.sample(range(len(data)), 400))
    broken = [data[:k] for k in cuts]
    for _ in range(600):
        b = bytearray(data)
        for _ in range(rng.choice([1, 1, 2, 8])):
            b[rng.randrange(len(b))] ^= 1 << rng.randrange(8)
        broken.append(bytes(b))
    broken += [rng.randbytes(rng.randrange(200)) for _ in range(100)]
    for b in broken:
        try:
            list(parse(b))
        except KNOWN:
            pass


def test_scan_goes_on_behind_broken_files(spark, tmp_path):
    """Each of these used to end the job, or does so only where asked."""
    cut = containers.build_partition("header") + klv.build(containers.PACKAGE_ITEM + b"\0", b"\x83")
    batch = containers.build_partition("header") + klv.build(containers.SYSTEM_SCHEME + b"\x01\x00", struct.pack(">HH", 0x0102, 3) + b"abc")
    for name, data in (("good", SYSTEM), ("cut", cut), ("batch", batch)):
        (tmp_path / f"{name}.mxf").write_bytes(data)
    rows = files.scan(spark, str(tmp_path), containers.system_items, containers.SYSTEM).collect()
    status = {r.path.rsplit("/", 1)[1]: r.status for r in rows}
    assert status["good.mxf"] == "OK" and all(status[f"{n}.mxf"] != "OK" for n in ("cut", "batch")) and sum(r.status == "OK" for r in rows) == 3
    with pytest.raises(Exception, match="error|unpack|header"):
        files.scan(spark, str(tmp_path), containers.system_items, containers.SYSTEM, mode="FAILFAST").count()


def test_maps_and_dumps_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(channels, "MOST", 2)
    samples = spark.createDataFrame([(1, 0, [1.0])], "k int, input int, samples array<double>")
    assert channels.apply_map(samples, channels.definition_frame(spark, "0,s1", 1), ["k"]).count() == 1
    with pytest.raises(ValueError, match="channels"):
        channels.apply_map(samples, channels.definition_frame(spark, "0,s2", 1), ["k"])
    monkeypatch.setattr(events, "MOST", 2)
    rows = spark.createDataFrame([(1, t, "c") for t in range(3)], "k int, track int, crc string")
    assert events.crc_dump(rows.where("track < 2"), ["k"], "track", "crc").columns == ["k", "track_0", "track_1"]
    assert len(events.crc_dump(rows, ["k"], "track", "crc", [0, 1, 2]).columns) == 4
    with pytest.raises(ValueError, match="tracks"):
        events.crc_dump(rows, ["k"], "track", "crc")


def test_definitions_of_a_column(spark):
    df = spark.createDataFrame([(1, "0-1; m2,s1", 4), (2, None, 3), (3, "x", 2), (4, "5", 2)], "k int, d string, n int")
    got = sorted(tuple(r) for r in channels.definition_rows(df, ["k"], "d", "n").na.fill(-1).collect())
    assert got == [(1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 0, 2), (1, 2, 0, -1), (3, 0, 0, 0), (3, 0, 1, 1)]
    with pytest.raises(Exception, match="malformed"):
        channels.definition_rows(spark.createDataFrame([(1, "0-;", 2)], df.schema), ["k"], "d", "n").count()
