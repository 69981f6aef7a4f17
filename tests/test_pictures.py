from framelake.operators import pictures as P


def test_counts_by_lsb_wrap():
    o = P.OrderCount(kind=0, lsb_bits=4)
    got = [o.next(k == 0, True, lsb=2 * k % 16) for k in range(40)]
    assert got == [2 * k for k in range(40)]
    o = P.OrderCount(kind=0, lsb_bits=4)
    assert [o.next(*x) for x in ((True, True, 0, 0), (False, True, 1, 8), (False, False, 2, 4), (False, True, 2, 0), (False, False, 3, 12), (True, True, 0, 0))] == [0, 8, 4, 16, 12, 0]


def test_counts_by_frame_number():
    o = P.OrderCount(kind=2, frame_bits=4)
    assert [o.next(k == 0, True, frame_num=k % 16) for k in range(20)] == [2 * k for k in range(20)]
    o = P.OrderCount(kind=2)
    assert [o.next(True, True, 0), o.next(False, False, 1), o.next(False, True, 1)] == [0, 1, 2]
    o = P.OrderCount(kind=1, offsets=(4, 6), non_ref_offset=-2)
    assert [o.next(True, True, 0), o.next(False, True, 1), o.next(False, False, 2), o.next(False, True, 2), o.next(False, True, 3, delta=1)] == [0, 4, 2, 10, 15]


def test_memory_reset():
    o = P.OrderCount(kind=0)
    assert [o.next(True, True, lsb=0), o.next(False, True, lsb=6, reset=True), o.next(False, True, lsb=2)] == [0, 0, 2]


def test_streams(spark):
    pattern = [("I", 0, True), ("P", 6, True), ("B", 2, False), ("B", 4, False)]
    rows = []
    for s in range(3):
        for k in range(60):
            kind, lsb, ref = pattern[k % 4]
            rows.append((s, k, k == 0, ref, 0, (k // 4 * 8 + lsb) % 16, 0, False, kind, k == 0, k % 4 == 0))
    df = spark.createDataFrame(rows[::-1], "stream int, position long, idr boolean, reference boolean, frame_num int, lsb int, delta int, reset boolean, type string, sps boolean, pps boolean")
    counted = P.order_counts(df, "stream", kind=0, lsb_bits=4)
    shown = P.display_positions(df.join(counted, ["stream", "position"]), "stream")
    got = {r.position: (r.order_count, r.display) for r in shown.where("stream = 1").collect()}
    assert all(got[k] == (k // 4 * 8 + pattern[k % 4][1], k // 4 * 4 + pattern[k % 4][1] // 2) for k in range(60))
    stats = P.avc_statistics(shown, "stream").where("stream = 0").first()
    assert (stats.sps, stats.pps, stats.decoding_delay, stats.gops) == ("first", "gop", 1, 15)


def test_ranges_and_locators(spark):
    data = spark.createDataFrame([("/a/x.bin", bytearray(b"0123456789"))], "path string, content binary")
    ranges = spark.createDataFrame([(1, "/a/x.bin", 1, 5, 2), (1, "/a/x.bin", 0, 0, 3), (2, "/a/x.bin", 0, 9, 9)], "stream int, file string, seq int, offset long, size long")
    assert {r.stream: bytes(r.content) for r in P.stream_bytes(ranges, "stream", data, "path").collect()} == {1: b"01256", 2: b"9"}
    tracks = spark.createDataFrame([(1, "/a/x.bin"), (2, "D:\\old\\x.bin"), (3, "/b/y.bin")], "track int, locator string")
    assert {r.track: r.resolved for r in P.external_files(tracks, data).collect()} == {1: "/a/x.bin", 2: "/a/x.bin", 3: None}
