import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.operators import channels, events, index, integrity, labels, packets, timeline, tracks


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 65535), st.integers(0, 255), st.integers(0, 255), st.integers(0, 65535), st.binary(max_size=40)), max_size=6))
def test_elements_come_back(lines):
    back = packets.parse_element(packets.build_element(lines))
    assert [x[:4] for x in back] == [x[:4] for x in lines]
    assert all(b[4][: len(a[4])] == a[4] and len(b[4]) % 4 == 0 and not any(b[4][len(a[4]) :]) for a, b in zip(lines, back, strict=True))


@pytest.mark.parametrize("data", [b"\0", b"\0\1", packets.build_element([(9, 1, 4, 7, b"abcd")])[:-1], packets.build_element([(9, 1, 4, 7, b"abcd")]).replace(b"\0\0\0\1", b"\0\0\0\2")])
def test_broken_elements(spark, data):
    with pytest.raises(ValueError):
        packets.parse_element(data)
    r = packets.explode_elements(spark.createDataFrame([(1, bytearray(data))], "id long, payload binary"), ["id"]).first()
    assert r.id == 1 and r.error and r.line_number is None


def test_pass_and_strip(spark):
    every = [(d, s) for d in (0x41, 0x43, 0x45, 0x60, 0x61, 0x62, 0) for s in (0, 1, 2, 5, 6, 0x60)]
    df = spark.createDataFrame(every, "did int, sdid int")
    keep = lambda p, s: {tuple(r) for r in df.where(packets.keeps(p, s, F.col("did"), F.col("sdid"))).collect()}
    for name in packets.CLASSES:
        assert keep((name,), ()) | keep((), (name,)) == set(every) and not keep((name,), (name,))
    assert keep((), ()) == set() and keep(("all",), ("st2020",)) == keep((), ("st2020",))
    assert packets.parse_filter("st2020x, sdp,st2020") == ("st2020", "sdp") and packets.parse_filter("sdp,all") == ("all",)
    with pytest.raises(ValueError):
        packets.parse_filter("st1")
    frames = spark.createDataFrame([(1, [(0x45, 1), (0x43, 2)])], "id int, lines array<struct<did:int,sdid:int>>")
    assert len(packets.filter_lines(frames, (), ("st2020",), "reference").first().lines) == 2
    assert len(packets.filter_lines(frames, (), ("st2020",)).first().lines) == 1


def test_track_maps():
    rows, unused = channels.definition_map("0,2-3; s2; m1", 6)
    assert rows == [(0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, None), (1, 1, None), (2, 0, 1)] and unused == [4, 5]
    assert channels.definition_map("mx", 2)[0] == [(0, 0, 0), (1, 0, 1)]
    for bad in ("", ";", "a", "m", "1,,x"):
        with pytest.raises(ValueError):
            channels.parse_definition(bad)


def test_mapped_samples(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (1, 1, [4.0])], "k int, input int, samples array<double>")
    got = {r.out_track: r.samples for r in channels.apply_map(df, channels.definition_frame(spark, "1,0;s1", 2), ["k"]).collect()}
    assert got == {0: [4.0, 1.0, 0.0, 2.0, 0.0, 3.0], 1: [0.0, 0.0, 0.0]}
    r = spark.range(1).select(channels.interleave([F.array(F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(4))]).alias("a"), channels.pad_samples(F.array(F.lit(1.0).cast("float")), 3).alias("b")).first()
    assert r.a == [1, 2, 3, 4] and r.b == [1.0, 0.0, 0.0]


def test_aes3(spark):
    words = b"".join((((c + 1) << 12 | 0x80000000) if c < 7 else 0).to_bytes(4, "little") for c in range(8)) * 2
    data = bytes([0, 2, 0, 0b01111111]) + words
    assert channels.aes3_to_pcm(data, 2, 16) == (3).to_bytes(2, "little") * 0 + ((3 << 12 | 0x80000000) >> 12 & 0xFFFF).to_bytes(2, "little") * 2
    assert channels.aes3_to_pcm(data, 7, 24) == bytes(6) and channels.aes3_to_pcm(b"", 0, 16) == b""
    rows = channels.aes3_channels(spark.createDataFrame([(5, bytearray(data))], "k int, payload binary"), ["k"], 8, 16).collect()
    assert [(r.k, r.channel, len(r.pcm)) for r in rows] == [(5, c, 4) for c in range(8)]


def test_streamed_digests_equal_whole_ones(spark):
    import hashlib
    import zlib

    rng = random.Random(1)
    parts = [(t, p, bytearray(rng.randbytes(rng.randint(0, 50)))) for t in range(5) for p in range(300)] + [(9, 0, None)]
    shuffled = rng.sample(parts, len(parts))
    got = {r.track: (r.crc32, r.md5, r.sha1) for r in integrity.track_digests(spark.createDataFrame(shuffled, "track int, position int, payload binary"), ["track"]).collect()}
    for t in (*range(5), 9):
        whole = b"".join(bytes(x) for k, _, x in parts if k == t and x)
        assert got[t] == (f"{zlib.crc32(whole):08x}", hashlib.md5(whole).hexdigest(), hashlib.sha1(whole).hexdigest())


def test_crc_of_the_check_value(spark):
    assert spark.range(1).select(integrity.crc32_text(F.lit("123456789"))).first()[0] == "cbf43926"


def test_label_files():
    rows = list(labels.parse_labels("# all\n0\nchL, chan=0, name=a\\,b # c\nsgST\n\n1\nchR, chan=1\n"))
    assert rows == [{"track": 0, "tag": "chL", "props": {"chan": "0", "name": "a,b"}}, {"track": 0, "tag": "sgST", "props": {}}, {"track": 1, "tag": "chR", "props": {"chan": "1"}}]
    for bad in ("chL\n", "0\nchL, chan\n"):
        with pytest.raises(ValueError):
            list(labels.parse_labels(bad))


def test_segments_without_a_place(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 1, 5), (2, 0, 3)], "k int, segment int, duration long")
    s = timeline.concat_segments(s, "k", ["segment"])
    p = spark.createDataFrame([(1, -4), (1, 0), (1, 9), (1, 10), (1, 99), (2, 1)], "k int, position long")
    assert [(r.segment, r.segment_position) for r in timeline.locate(p, s, "k").orderBy("k", "position").collect()] == [(0, -4), (0, 0), (0, 9), (1, 0), (1, 89), (0, 1)]


def test_unknown_durations(spark):
    m = spark.createDataFrame([(1, 1, 25, 1, 100, 0, 5, "a", True), (1, 2, 50, 1, None, 3, 5, "a", True), (2, 3, 50, 1, 9, 1, 5, "a", False), (2, 4, 25, 1, 9, 0, None, "b", True)], "k int, member int, num long, den long, duration long, origin long, start int, name string, complete boolean")
    a, b = timeline.group_summary(m, "k").orderBy("k").collect()
    assert (a.num, a.duration, a.origin, a.start, a.name, a.complete) == (25, None, 2, 5, "a", True)
    assert (b.num, b.duration, b.origin, b.start, b.name, b.complete) == (25, 4, 1, None, None, False)


def test_last_size_and_gaps(spark):
    e = spark.createDataFrame([(1, 0, 0, 50), (1, 1, 20, 50), (2, 0, 60, 50)], "k int, position long, offset long, end long")
    assert [r["size"] for r in index.edit_unit_sizes(e, "k", "end").orderBy("k", "position").collect()] == [20, 30, None]


def test_ranges_and_masks():
    assert tracks.parse_ranges("0-3, 5") == [(0, 3), (5, 5)]
    with pytest.raises(ValueError):
        tracks.parse_ranges("3-1")
    assert events.event_mask("vd") == ["vtr_error", "digibeta_dropout"]
    with pytest.raises(ValueError):
        events.event_mask("x")
