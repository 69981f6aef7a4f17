import random

import pytest

from framelake.operators import audio_metadata as A
from framelake.operators import pictures as P

SCHEMA = "frame int, subframe int, segment int, id int, ord int, field string, width int, value long"


def rows_of(frame, subframe, ids, rng, config=11):
    """Random fields of segments ``ids`` of a sub-frame."""
    out = []
    for segment, id_ in enumerate([0, *ids]):
        names = list(A.FIELDS[id_])
        if id_ == 1:
            names += [x for k in range(A.PROGRAMS[config]) for x in ((f"text_{k}", 8), (f"text_reserved_{k}", 2))]
            names += [x for k in range(A.CHANNELS[config]) for x in ((f"first_a_{k}", 4), (f"first_b_{k}", 1))]
            names += [x for k in range(A.CHANNELS[config]) for x in ((f"second_a_{k}", 10), (f"second_b_{k}", 10))]
        for k, (name, width) in enumerate(names):
            value = config if name == "program_config" else rng.getrandbits(width)
            value = value - (1 << 64) if value >> 63 else value
            out.append((frame, subframe, segment, id_, k, name, width, value))
    return out


def signed(r):
    return r[7] - 4096 if r[5] == "pitch_shift_code" and r[7] >= 2048 else r[7]


def test_fields_to_packets_and_back(spark):
    """All segments and program configurations; frames with either sub-frame alone."""
    rng = random.Random(1)
    rows = []
    for config in range(24):
        rows += rows_of(config, 1, [1, 3, 5], rng, config) + rows_of(config, 2, [2, 4, 6], rng, config)
    rows += rows_of(30, 1, [1, 5], rng) + rows_of(31, 2, [4], rng)
    # bytes that look like the word of the second sub-frame must not be taken for it
    rows = [(*r[:7], 0x3FF3) if r[5] == "originator_address" and r[0] == 3 else r for r in rows]
    packets = A.packets(spark.createDataFrame(rows, SCHEMA), ["frame"], 4)
    made = {r.frame: r for r in packets.collect()}
    assert made[30].second is None and made[31].first is None and all(bytes(r.first or r.second)[:2] == b"\x45\x04" for r in made.values())
    one = bytes(made[31].second)
    assert one[2] == len(one) - 3 and one[3:5] == b"\x3f\xf3" and one[-3:] == b"\x00\x0a\x0a" and (one[13] + sum(one[14:-4]) + one[-4]) % 256 == 0
    found = A.segments(packets, ["frame"])
    assert {(r.problem, r.intact) for r in found.collect()} == {(None, None), (None, True)}
    got = sorted((r.frame, r.subframe, r.segment, r.id, r.ord, r.field, r.width, r.value) for r in A.fields(found, ["frame"]).collect())
    assert got == sorted((*r[:7], signed(r)) for r in rows)


def test_broken_packets(spark):
    rng = random.Random(2)
    rows = rows_of(0, 2, [2, 4], rng)
    good = bytes(A.packets(spark.createDataFrame(rows, SCHEMA), ["frame"], 1).first().second)
    wrong = bytearray(good)
    wrong[16] ^= 1
    cases = [
        (0, None, good), (1, None, bytes(wrong)), (2, None, b"\x44" + good[1:]), (3, None, good[:1] + b"\x0a" + good[2:]), (4, None, good[:-9]), (5, None, None), (6, b"", b"\x45"),
        (7, None, good[:2] + bytes([len(good) - 12]) + good[3:]), (8, None, bytes([0x45, 1, 4, 0, 0, 0, 0])),
    ]
    found = A.segments(spark.createDataFrame(cases, "frame int, first binary, second binary"), ["frame"]).collect()
    by = {n: [r for r in found if r.frame == n] for n in range(9)}
    assert [(r.problem, r.intact) for r in sorted(by[0], key=lambda r: r.segment)] == [(None, None), (None, True), (None, True)]
    assert [r.intact for r in sorted(by[1], key=lambda r: r.segment)] == [None, False, True]
    for n in (2, 3, 4):
        assert {r.problem for r in by[n]} == {"a packet of other ids or cut off"}
    for n in (5, 6, 8):
        assert {r.problem for r in by[n]} == {"no sub-frame"} and len(by[n]) == 1
    assert {r.problem for r in by[7]} == {"a sub-frame without end"}


def test_violations(spark):
    rng = random.Random(3)
    rows = [(*r[:7], 0 if r[5] not in ("acmod", "frame_rate_code", "xbsi1e", "xbsi2e") else 1) for r in rows_of(0, 1, [1, 3], rng)]
    change = {"datarate": 31, "program_config": 24, "compr1": 6, "dynrng2": 6, "langcod": 128, "xbsi2e": 0}
    rows = [(*r[:7], change.get(r[5], r[7])) for r in rows]
    of = lambda rows: {(r.field, r.value) for r in A.violations(spark, spark.createDataFrame(rows, SCHEMA), ["frame"]).collect()}
    assert of(rows) == {("program_config", 24), ("compr1", 6), ("dynrng2", 6), ("langcod", 128), ("xbsi2e", 0)}
    free = [(*r[:7], 1 if r[5] in ("compre", "dynrnge") else 19 if r[5] == "datarate" else r[7]) for r in rows]
    assert of(free) == {("program_config", 24), ("langcod", 128), ("xbsi2e", 0), ("datarate", 19)}


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_field_pairs_and_frames_agree(spark, kind):
    """A pair of fields has the counts of the frame that it makes up, where its bottom delta is that of the frame."""
    frames = [(0, k, k == 0, True, False, False, k % 16, 2 * k % 16, 1 if kind == 0 else 0, 0, False) for k in range(40)]
    pairs = [(1, 2 * k + b, k == 0 and b == 0, True, True, b == 1, k % 16, (2 * k + b) % 16, 0, 0, False) for k in range(40) for b in (0, 1)]
    df = spark.createDataFrame(frames + pairs, "s int, position long, idr boolean, reference boolean, field boolean, bottom boolean, frame_num int, lsb int, delta0 int, delta1 int, reset boolean")
    got = {(r.s, r.position): r for r in P.field_order_counts(df, "s", kind, lsb_bits=4, frame_bits=4, offsets=(2,), top_to_bottom=1).collect()}
    for k in range(1, 40):
        top, bottom = got[1, 2 * k], got[1, 2 * k + 1]
        assert (top.bottom, bottom.top) == (None, None) and (top.top, bottom.bottom) == (got[0, k].top, got[0, k].bottom) and got[0, k].order_count == got[0, k].top == 2 * k


def test_numbers_of_refreshes_and_resets(spark):
    rows = [(0, True, 0, False), (1, False, 15, True), (2, False, 3, False), (3, False, 2, False), (4, True, 5, False)]
    df = spark.createDataFrame([(0, p, idr, True, False, False, n, 0, 0, 0, reset) for p, idr, n, reset in rows], "s int, position long, idr boolean, reference boolean, field boolean, bottom boolean, frame_num int, lsb int, delta0 int, delta1 int, reset boolean")
    got = [r.order_count for r in P.field_order_counts(df, "s", 2).orderBy("position").collect()]
    assert got == [0, 30, 2 * (16 + 3), 2 * (32 + 2), None]


def test_coding_of_short_streams(spark):
    schema = "s int, position long, type string, second_type string, field boolean, adaptive boolean, idr boolean, sps boolean, pps boolean"
    rows = [(0, 0, "P", None, False, False, False, False, False), (1, 0, "I", None, False, False, True, True, True), (1, 1, "B", None, False, False, False, False, False), (1, 2, "B", None, False, False, False, False, False),
            (1, 3, "I", None, False, True, False, True, False), (1, 4, "B", None, False, False, False, False, False), (1, 5, "P", None, False, False, False, False, False)]
    got = {r.s: r for r in P.coding_summary(spark.createDataFrame(rows, schema), "s").collect()}
    assert (got[0].identical_gops, got[0].starts_with_i, got[0].max_b_run, got[0].constant_b, got[0].max_gop, got[0].sps) == (True, False, 0, True, 1, "some")
    assert (got[1].coding_type, got[1].max_gop, got[1].identical_gops, got[1].closed_gops, got[1].max_b_run, got[1].constant_b, got[1].sps, got[1].pps) == ("adaptive", 3, False, False, 2, False, "gop", "first")
