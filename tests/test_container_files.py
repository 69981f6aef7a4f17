import random
import struct

import pytest
from pyspark.sql import functions as F

from framelake.operators import index, layout
from framelake.plans.container_queries import container
from framelake.sources import container_files as C
from framelake.sources import containers as X
from framelake.sources import klv

SIZES = {"alpha": [(5 + p % 7, 3 + p % 2) for p in range(23)], "beta": [(40, 1)], "gamma": [(p, 0) for p in range(10)]}


def payload(name, position, track):
    return bytes([ord(name[0]), position, track]) * 50


def made(spark):
    rows = [(n, p, t, payload(n, p, t)[:size], p % 3 - 1, -(p % 5), 0x80 if p % 5 == 0 else 0x22) for n, units in SIZES.items() for p, unit in enumerate(units) for t, size in enumerate(unit)]
    random.Random(1).shuffle(rows)
    frames = spark.createDataFrame(rows, "clip string, position long, track int, payload binary, temporal_offset int, key_frame_offset int, flags int")
    headers = spark.createDataFrame([(n, X.build_primer({1: bytes(16)}) * k) for k, n in enumerate(SIZES)], "clip string, metadata binary")
    return frames, headers


class Log:
    """A file that says which of its bytes were read."""

    def __init__(self, data):
        self.data, self.size, self.read = data, len(data), []

    def read_at(self, size, offset):
        self.read.append((offset, min(self.size, offset + size)))
        return self.data[offset : offset + size]

    def touched(self):
        return {k for a, b in self.read for k in range(a, b)}


@pytest.fixture(scope="module", params=[True, False], ids=["in place", "in order"])
def files(spark, tmp_path_factory, request):
    folder = str(tmp_path_factory.mktemp("files"))
    frames, headers = made(spark)
    out = C.write(spark, frames, headers, "clip", folder, 2, 4, in_place=request.param, most=3)
    assert {r.name: r.bytes for r in out.collect()} == {n: len(open(f"{folder}/{n}.mxf", "rb").read()) for n in SIZES}
    return folder


def test_written_files_by_the_whole_file_parsers(files):
    for name, units in SIZES.items():
        data = open(f"{files}/{name}.mxf", "rb").read()
        packs = list(X.partitions(data))
        assert [p["kind"] for p in packs] == ["header", *["body"] * -(-len(units) // 4), "footer"]
        assert all(p["this_partition"] == p["offset"] and p["footer"] == packs[-1]["offset"] for p in packs)
        assert [p["previous"] for p in packs] == [0, *(p["offset"] for p in packs[:-1])]
        segments = list(X.index_segments(data))
        assert all("problem" not in s and len(s["entries"]) <= 3 for s in segments)
        entries = {s["start"] + k: e for s in segments for k, e in enumerate(s["entries"])}
        elements = list(X.elements(data))
        assert [e["size"] for e in elements] == [size for unit in units for size in unit]
        assert [entries[p]["stream_offset"] for p in range(len(units))] == [e["stream_offset"] for e in elements[::2]]
        assert [entries[p]["slice_offsets"] for p in range(len(units))] == [[21 + a] for a, _ in units]
        assert [(entries[p]["temporal_offset"], entries[p]["key_frame_offset"], entries[p]["flags"]) for p in range(len(units))] == [(p % 3 - 1, -(p % 5), 0x80 if p % 5 == 0 else 0x22) for p in range(len(units))]
        bodies = [p for p in packs if p["kind"] == "body"]
        assert [p["body_offset"] for p in bodies] == [e["stream_offset"] for e in elements[::8]]
        assert data[e["offset"] + 21 :][: e["size"]] == payload(name, len(units) - 1, 1)[: e["size"]] if (e := elements[-1]) else None
        random_index = data[-int.from_bytes(data[-4:], "big") :]
        assert random_index.startswith(C.RANDOM_INDEX) and [x for x in struct.iter_unpack(">IQ", random_index[21:-4])] == [(p["body_sid"], p["offset"]) for p in packs]


def test_frames_read_back(spark, files):
    rows = C.frames(spark, files, splitBytes=300).collect()
    want = {(n, p, 0x15010500 + t): (payload(n, p, t)[:size], p % 3 - 1, -(p % 5)) for n, units in SIZES.items() for p, unit in enumerate(units) for t, size in enumerate(unit)}
    got = {(r.path.rsplit("/", 1)[1][:-4], r.position, r.track_number): (bytes(r.payload), r.temporal_offset, r.key_frame_offset) for r in rows}
    assert len(rows) == len(want) and got == want and {r.status for r in rows} == {"OK"}
    for r in rows:
        assert open(r.path, "rb").read()[r.offset :][: r.size] == bytes(r.payload)


def test_filters_reach_the_files(spark, files):
    some = C.frames(spark, files).where("position >= 3 and position < 6 and track_number = 352388353")
    assert sorted((r.path.rsplit("/", 1)[1][:-4], r.position) for r in some.collect()) == [(n, p) for n in ("alpha", "gamma") for p in (3, 4, 5)]
    one = C.frames(spark, files, payload=False).where(F.col("position").isin(0, 9) & F.col("path").endswith("beta.mxf"))
    assert "payload" not in one.columns and [(r.position, r.size) for r in one.orderBy("track_number").collect()] == [(0, 40), (0, 1)]
    ends = C.frames(spark, files, payload=False, sample=3).where("track_number = 352388352").select("path", "position").collect()
    assert sorted((r.path.rsplit("/", 1)[1][:-4], r.position) for r in ends) == [("alpha", 0), ("alpha", 11), ("alpha", 22), ("beta", 0), ("gamma", 0), ("gamma", 4), ("gamma", 9)]


def test_bytes_outside_the_ranges_are_never_read(files):
    data = open(f"{files}/alpha.mxf", "rb").read()
    elements = [e for e in X.elements(data)]
    spans = [(k // 2, k % 2, range(e["offset"], e["offset"] + 21 + e["size"])) for k, e in enumerate(elements)]
    inside = {b for _, _, r in spans for b in r}
    f = Log(data)
    known = C.open_layout(f)
    assert len(f.touched() & inside) <= 25  # the head of the first element
    f.read.clear()
    want = C.Wanted(low=5, high=9, tracks=frozenset([0x15010501]))
    got = list(C.read_frames(f, "x", (0, len(data)), want, True, made=known))
    assert [(r["position"], r["payload"]) for r in got] == [(p, payload("alpha", p, 1)[: SIZES["alpha"][p][1]]) for p in range(5, 10)]
    first = {b for p, _, r in spans if p == 0 for b in r}
    allowed = {b for p, t, r in spans if 5 <= p <= 9 and t == 1 for b in r} | first
    assert f.touched() & inside <= allowed | {b + k for b in allowed for k in range(25)} and {b for p, t, r in spans if 5 <= p <= 9 and t == 1 for b in r} <= f.touched()
    f.read.clear()
    list(C.read_frames(f, "x", (0, len(data)), want, False, made=known))
    assert len(f.touched()) <= 25 * 7


def clip_wrapped(sizes=None, unit=0, n=0, broken=False):
    """One element with all of a track, in two partitions."""
    units = sizes or [unit] * n
    half = len(units) // 2
    values = [b"".join(bytes([k % 251]) * units[k] for k in r) for r in (range(half), range(half, len(units)))]
    entries = [(0, 0, 0x80, sum(units[:k])) for k in range(len(units))]
    at = X.build_index(25, 1, 0, len(units), 1, 2, unit_bytes=unit) if unit else X.build_index(25, 1, 0, len(units), 1, 2, entries=entries)
    key = C.ELEMENT + bytes.fromhex("16010200")
    out = X.build_partition("header")
    out += X.build_partition("body", body_sid=2) + klv.build(key, values[0], 8)
    out += X.build_partition("body", body_sid=2, body_offset=len(values[0])) + klv.build(key, values[1], 8)
    foot = X.build_partition("footer", index_sid=1, index_bytes=len(at))
    return out + foot + at, units


@pytest.mark.parametrize("case", [{"sizes": [3, 5, 8, 2, 9, 1, 4]}, {"unit": 6, "n": 11}])
def test_clip_wrapped(spark, tmp_path, case):
    data, units = clip_wrapped(**case)
    (tmp_path / "clip.mxf").write_bytes(data)
    rows = C.frames(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, bytes(r.payload), r.track_number) for r in rows] == [(k, bytes([k]) * n, 0x16010200) for k, n in enumerate(units)]
    f = Log(data)
    known = C.open_layout(f)
    f.read.clear()
    (r,) = C.read_frames(f, "x", (0, len(data)), C.Wanted(positions=frozenset([4])), True, made=known)
    assert len(f.touched()) == units[4] and f.touched() == set(range(r["offset"], r["offset"] + r["size"]))
    assert list(C.read_frames(f, "x", (0, len(data)), C.Wanted(tracks=frozenset([1])), True, made=known)) == []


def test_other_layouts(spark, tmp_path):
    """A run-in, no random index pack, an unreadable segment, an index without slices over several tracks."""
    (tmp_path / "a.mxf").write_bytes(container(7, [5, 6, 300]))
    rows = C.frames(spark, str(tmp_path)).orderBy("track_number").collect()
    assert [(r.position, r.track_number, bytes(r.payload)) for r in rows] == [(k, 0x15010500 + k, bytes([k]) * n) for k, n in enumerate([5, 6, 300])]


def test_unreadable_files(spark, tmp_path, files):
    good = open(f"{files}/alpha.mxf", "rb").read()
    rng = random.Random(2)
    (tmp_path / "good.mxf").write_bytes(good)
    for k in range(60):
        cut = bytearray(good[: rng.randrange(len(good))] if k % 2 else good)
        if k % 2 == 0:
            cut[rng.randrange(len(cut))] ^= 1 << rng.randrange(8)
        (tmp_path / f"bad{k}.mxf").write_bytes(bytes(cut))
    (tmp_path / "empty.mxf").write_bytes(b"")
    rows = C.frames(spark, str(tmp_path)).collect()
    assert sum(r.path.endswith("good.mxf") for r in rows) == 46
    assert {r.status for r in rows if r.path.endswith("good.mxf")} == {"OK"} and any(r.status != "OK" for r in rows)
    with pytest.raises(Exception, match="PythonException|no header|packet|file"):
        C.frames(spark, str(tmp_path), mode="FAILFAST").count()


def test_gaps_are_noticed(spark, tmp_path):
    rows = [("a", 0, b"xx"), ("a", 3, b"y")]
    with pytest.raises(Exception, match="missing or there twice|no piece ends"):
        C.write_pieces(spark, spark.createDataFrame(rows, "k string, at long, data binary"), "k", str(tmp_path))


def test_offsets_and_chunks_both_ways(spark, files):
    chunks = C.essence_chunks(spark, files)
    whole = C.frames(spark, files, payload=False).where("track_number = 352388352").select("path", (F.col("offset") - 21).alias("file_position"))
    there = index.essence_offsets(whole, chunks, "path")
    back = index.file_positions(there.select("path", "offset"), chunks, "path")
    assert sorted(map(tuple, back.select("path", "file_position").collect())) == sorted(map(tuple, whole.collect()))
    out = index.essence_offsets(spark.createDataFrame([("x", 5)], "path string, file_position long").unionByName(whole.limit(1).select("path", F.lit(3).cast("long").alias("file_position"))), chunks, "path")
    assert [r.offset for r in out.collect()] == [None, None]


def test_files_dealt_to_tasks():
    files = [("a", 10), ("b", 200 << 20), ("c", 0), ("d", 30)]
    for split, tasks in ((64 << 20, 1), (64 << 20, 8), (5 << 20, 3)):
        got = C.dealt(files, split, tasks)
        for p, n in files:
            mine = sorted(x[1:] for g in got for x in g if x[0] == p)
            assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))
        assert all(sum(x[2] - x[1] for x in g) <= split for g in got)
    assert C.dealt([], 5, 1) == [[]]


def test_layout_over_runs(spark):
    rows = [("a", p, p % 7) for p in range(50)] + [("b", p, 1) for p in range(3)]
    got = layout.sums_before(spark.createDataFrame(rows, "k string, position long, v long"), "k", "v", "s", run=8).collect()
    assert all(r.s == sum(v for k, p, v in rows if k == r.k and p < r.position) for r in got) and len(got) == 53


def test_payloads_are_shuffled_once(spark):
    """Besides that, only packs and their offsets are: what grows with frames goes through one exchange."""
    frames, headers = made(spark)
    stored = lambda df, name: spark.createDataFrame(df.collect(), df.schema)
    plan = C.pieces(frames, headers, "clip", 2, 4, most=3, keep=stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_gaps_between_stretches_are_noticed(spark, tmp_path):
    for k, rows in enumerate(([("a", 0, b"xx"), ("a", 3, b"y")], [("a", 0, b"xx"), ("a", 1, b"y")], [("a", 1, b"xx")])):
        with pytest.raises(Exception, match="no piece ends"):
            C.write_pieces(spark, spark.createDataFrame(rows, "k string, at long, data binary").coalesce(1), "k", str(tmp_path / str(k)), stretches=True)
    whole = spark.createDataFrame([("a", 2, b"y"), ("b", 0, b"zz"), ("a", 0, b"xx")], "k string, at long, data binary").coalesce(1)
    assert sorted((r.name, r.bytes) for r in C.write_pieces(spark, whole, "k", str(tmp_path / "w"), stretches=True).collect()) == [("a", 3), ("b", 2)]
    assert (tmp_path / "w" / "a.mxf").read_bytes() == b"xxy"


def test_many_heads_at_once():
    data = [klv.build(C.CLIP_KEY, bytes(n), w) for n, w in ((0, 4), (5, 1), (200, 2), (70_000, 8))] + [C.CLIP_KEY, C.CLIP_KEY + b"\x84\0\0"]
    n, h = C._heads(data)
    assert n.tolist() == [0, 5, 200, 70_000, -1, -1] and [klv.length(x, 16) for x in data[:4]] == [(a, b - 16) for a, b in zip(n.tolist(), h.tolist(), strict=True)][:4]


def test_file_positions_keep_columns(spark):
    chunks = spark.createDataFrame([(1, 0, 100, 10), (1, 10, 300, 5)], "f long, essence_offset long, file_position long, size long")
    out = index.file_positions(spark.createDataFrame([(1, 3, "a"), (1, 12, "b"), (1, 15, "c")], "f long, offset long, own string"), chunks, "f", keep=["own"])
    assert sorted(map(tuple, out.collect())) == [(1, 3, 103, "a"), (1, 12, 302, "b"), (1, 15, None, "c")]
