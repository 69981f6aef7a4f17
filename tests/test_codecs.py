import pytest
from pyspark.sql import functions as F

from framelake.operators import reports
from framelake.sources import codecs, files


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}"
        return self

    def ue(self, value):
        x = bin(value + 1)[2:]
        self.bits += "0" * (len(x) - 1) + x
        return self

    def bytes(self):
        whole = self.bits + "1"
        whole += "0" * (-len(whole) % 8)
        return int(whole, 2).to_bytes(len(whole) // 8, "big")


def nal(kind, body):
    return b"\0\0\0\1" + bytes([0x60 | kind]) + body.replace(b"\0\0\1", b"\0\0\3\1").replace(b"\0\0\0", b"\0\0\3\0")


def sps():
    w = Writer().put(122, 8).put(0x10, 8).put(41, 8).ue(0).ue(2).ue(2).ue(2).put(0, 1).put(0, 1)
    w.ue(4).ue(0).ue(4).ue(2).put(0, 1).ue(119).ue(33).put(0, 1).put(0, 1).put(1, 1).put(1, 1).ue(0).ue(0).ue(0).ue(4).put(0, 1)
    return nal(7, w.bytes())


def slice_(kind, type_, number, first=0):
    return nal(kind, Writer().ue(first).ue(type_).ue(0).put(number, 8).put(0x55AA, 16).bytes())


def test_h264(spark, tmp_path):
    stream = nal(9, b"\x10") + sps() + nal(8, b"\xce\x38\x80") + slice_(5, 7, 0) + slice_(5, 7, 0, 9) + nal(9, b"\x30") + slice_(1, 5, 1) + slice_(1, 6, 1, 5) + slice_(1, 2, 2)
    (tmp_path / "a.264").write_bytes(stream)
    rows = sorted(files.scan(spark, str(tmp_path), codecs.h264_frames, codecs.H264_SCHEMA).collect(), key=lambda r: r.position)
    assert [(r.type, r.frame_num, r.idr, r.sps, r.pps) for r in rows] == [("I", 0, True, True, True), ("B", 1, False, False, False), ("I", 2, False, False, False)]
    assert [list(r.nal_types) for r in rows] == [[9, 7, 8, 5, 5], [9, 1, 1], [1]]
    assert (rows[0].width, rows[0].height, rows[0].profile, rows[0].level, rows[0].chroma, rows[0].interlaced) == (1920, 1080, 122, 41, 422, True)
    assert sum(r["size"] for r in rows) == len(stream)


def test_exp_golomb():
    w = Writer()
    for v in range(300):
        w.ue(v)
    b = codecs.Bits(w.bytes())
    assert [b.ue() for _ in range(300)] == list(range(300))
    b = codecs.Bits(Writer().ue(3).ue(4).ue(0).bytes())
    assert (b.se(), b.se(), b.se()) == (2, -2, 0)
    with pytest.raises(ValueError):
        codecs.Bits(b"").take(1)


def test_j2c():
    size = b"\xff\x4f\xff\x51\0\x2f\0\0" + b"".join(x.to_bytes(4, "big") for x in (1930, 1090, 10, 10, 512, 256, 0, 0)) + b"\0\3" + bytes([9]) * 9
    assert codecs.j2c_info(size) == {"width": 1920, "height": 1080, "tile_width": 512, "tile_height": 256, "components": 3, "bit_depth": 10}
    with pytest.raises(ValueError):
        codecs.j2c_info(b"x" * 60)


def test_jpeg():
    one = b"\xff\xd8\xff\xe0\0\6\xff\xd9ab\xff\xc0\0\x0b\x08\x01\x20\x02\xd0\x01\x01\x11\0\xff\xda\0\4\1\1data\xff\0more\xff\xd0x\xff\xd9"
    rows = list(codecs.jpeg_frames(one + b"junk" + one + one[:20]))
    assert [(r["offset"], r["size"], r["width"], r["height"]) for r in rows] == [(0, len(one), 720, 288), (len(one) + 4, len(one), 720, 288)]


def test_dv_and_vc3():
    head = lambda c, fifty: bytes([0x1F, c, 0, 0x80 if fifty else 0])
    frame = lambda fifty, channels=1: b"".join(head(0x07 | c << 3, fifty).ljust(12000 * (12 if fifty else 10), b"\0") for c in range(channels))
    rows = list(codecs.dv_frames(frame(True) * 2 + frame(True)[:500]))
    assert [(r["offset"], r["size"], r["is_50hz"]) for r in rows] == [(0, 144000, True), (144000, 144000, True)]
    assert [(r["offset"], r["size"], r["sequences"]) for r in codecs.dv_frames(frame(False, 2) * 2)] == [(0, 240000, 20), (240000, 240000, 20)]
    unit = (b"\0\0\2\x80\1\2" + bytes(18) + (540).to_bytes(2, "big") + (1920).to_bytes(2, "big") + bytes(5) + bytes([2 << 5]) + bytes(6) + (1241).to_bytes(4, "big")).ljust(640, b"\x11")
    rows = list(codecs.vc3_frames(unit * 3))
    assert [(r["size"], r["compression_id"], r["width"], r["height"], r["bit_depth"], r["interlaced"]) for r in rows] == [(640, 1241, 1920, 540, 10, True)] * 3


def test_reports(spark):
    clips = spark.createDataFrame([(1, "a"), (2, "b")], "clip int, name string")
    tracks = spark.createDataFrame([(1, 1, "snd"), (1, 0, "pic")], "clip int, track int, kind string")
    got = {r.clip: r.report for r in reports.clip_report(clips, tracks, "clip", ["track"]).collect()}
    assert got[1] == '{"clip":1,"name":"a","tracks":[{"track":0,"kind":"pic"},{"track":1,"kind":"snd"}]}' and got[2] == '{"clip":2,"name":"b","tracks":[]}'
    assert reports.sections(clips, ["clip"], ["name"]).orderBy("clip").first().report == "name : a"
    assert spark.range(1).select(reports.packet_name(F.lit(0x60), F.lit(0x60))).first()[0] == "timecode"
