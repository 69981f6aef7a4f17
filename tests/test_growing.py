import pytest

from framelake.sources import container_files as C
from framelake.sources import containers as X
from framelake.sources import klv
from framelake.streaming import growing

from .test_container_files import Log, made


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    frames, headers = made(spark)
    C.write(spark, frames, headers, "clip", folder, 2, 4, most=3)
    return {n: open(f"{folder}/{n}.mxf", "rb").read() for n in ("alpha", "gamma")}


def wanted(whole):
    out = {}
    for name, data in whole.items():
        for k, e in enumerate(X.elements(data)):
            out[name, k // 2, e["track_number"]] = (e["offset"], e["size"], e["stream_offset"])
    return out


def run(df, where, table, checkpoint):
    query = df.writeStream.format("parquet").option("path", f"{where}/{table}").option("checkpointLocation", f"{where}/{checkpoint}").outputMode("append").start()
    query.processAllAvailable()
    batches = len(query.recentProgress)
    query.stop()
    return batches


def name_of(r):
    return r.path.rsplit("/", 1)[1][:-4]


@pytest.mark.parametrize("kept", [True, False])
def test_growing_in_steps_with_restarts(spark, tmp_path, whole, kept):
    """Files grow in three steps, cut inside packets; each step is a new query from the same checkpoint, and equals the parser of whole files at the end."""
    source = tmp_path / "in"
    source.mkdir()
    done = 0
    for k, share in enumerate((0.4, 0.4, 0.77, 1.0)):
        for name, data in whole.items():
            if name == "alpha" or k > 1:
                (source / f"{name}.mxf").write_bytes(data[: int(len(data) * share) + 3])
        df = growing.append_index(growing.packets(spark, str(source), bytesPerTrigger=400, splitBytes=200, **({"progress": f"{tmp_path}/progress.json"} if kept else {}))).drop("value")
        run(df, tmp_path, "index", "ck")
        rows = spark.read.schema(df.schema).parquet(f"{tmp_path}/index").collect()
        assert len(rows) == done if k == 1 else len(rows) > done  # nothing twice, nothing lost
        done = len(rows)
    got = {(name_of(r), r.position, r.track_number): (r.offset, r.size, r.stream_offset) for r in rows}
    assert len(got) == len(rows) and got == wanted(whole)


def test_rate_and_packets(spark, tmp_path, whole):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "alpha.mxf").write_bytes(whole["alpha"])
    batches = run(growing.packets(spark, str(tmp_path / "in"), bytesPerTrigger=500, progress=f"{tmp_path}/progress.json"), tmp_path, "packets", "ck")
    assert batches >= len(whole["alpha"]) // 800
    rows = spark.read.parquet(f"{tmp_path}/packets").orderBy("offset").collect()
    assert [(r.key, r.offset, bytes(r.value)) for r in rows] == [(k.hex(), at, v) for k, at, _, v in klv.Parser().push(whole["alpha"])]


def test_packages_wait_for_all_tracks(spark, tmp_path, whole):
    """The second track comes in a file of its own, later; elements stay back until both are there."""
    rows = [("a", e["offset"] // 10**6, k // 2, e["track_number"], e["offset"], e["size"], b"v") for k, e in enumerate(X.elements(whole["gamma"]))]
    schema = "path string, z long, position long, track_number long, offset long, size long, value binary"
    first, second = [r for r in rows if r[3] % 2 == 0], [r for r in rows if r[3] % 2 == 1]
    seen = []
    for k, part in enumerate((first[:6], second[3:], first[6:] + second[:3])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        df = growing.hold_packages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2)
        run(df, tmp_path, "out", "ck")
        seen.append(sorted({r.position for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()}))
    assert seen == [[], [3, 4, 5], list(range(10))]
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_only_heads_are_read_to_find_the_end(whole):
    f = Log(whole["alpha"][:-5])
    ends = growing.whole_until(f, 0, every=300)
    assert all(b - a <= 25 for a, b in f.read) and ends[-1] == len(whole["alpha"]) - int.from_bytes(whole["alpha"][-4:], "big")
    starts = {at for _, at, _, _ in klv.Parser().push(whole["alpha"])}
    assert set(ends) <= starts and all(b - a >= 300 for a, b in zip([0, *ends], ends[:-1], strict=False))
    assert growing.whole_until(Log(b""), 0) == [] and growing.whole_until(Log(whole["alpha"][:30]), 0) == []


def test_many_files_of_small_packets(spark, tmp_path, whole):
    """Small packets' heads are read in long stretches, offsets of many files stay short, and payloads needn't go into the index; growth as before."""
    data = whole["alpha"]
    f = Log(data)
    assert growing.whole_until(f, 0, ahead=1 << 20) == growing.whole_until(Log(data), 0) and len(f.read) <= 3
    assert growing.whole_until(Log(data), 0, every=300, ahead=1 << 20) == growing.whole_until(Log(data), 0, every=300)
    assert [growing.whole_until(Log(data[:n]), 0, None, 90, 4000) for n in range(300)] == [growing.whole_until(Log(data[:n]), 0, None, 90) for n in range(300)]
    offset = {f"/a/folder/{k}.mxf": k for k in range(5000)}
    kept = growing.packed(offset)
    assert len(str(kept)) < 100_000 and growing.unpacked(kept) == offset and kept == growing.packed(dict(sorted(offset.items(), key=str)))
    assert growing.packed({"a": 1}) == growing.unpacked({"a": 1}) == {"a": 1}

    (tmp_path / "in").mkdir()
    done = {}
    for share in (0.3, 1.0):
        for name, x in whole.items():
            (tmp_path / "in" / f"{name}.mxf").write_bytes(x[: int(len(x) * share)])
        df = growing.append_index(growing.packets(spark, str(tmp_path / "in"), bytesPerTrigger=700, progress=f"{tmp_path}/progress.json").drop("value"))
        with growing.dealt_by_cores(spark):
            run(df, tmp_path, "index", "ck")
        rows = spark.read.schema(df.schema).parquet(f"{tmp_path}/index").collect()
        assert len(rows) > len(done)
        done = {(name_of(r), r.position, r.track_number): (r.offset, r.size, r.stream_offset) for r in rows}
    assert "value" not in df.columns and len(done) == len(rows) and done == wanted(whole)
