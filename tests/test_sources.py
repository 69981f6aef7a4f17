import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import files, klv, mpeg2, texts, wav
from framelake.sources.files import register

KEY = bytes.fromhex("060e2b34010201010d01030115010500")


def test_klv_round_trip_in_any_pieces():
    data = b"".join(klv.build(KEY[:15] + bytes([k]), bytes(range(k)), 1 + k % 8) for k in range(40))
    want = list(klv.parse(data))
    assert [r["size"] for r in want] == list(range(40))
    p, got = klv.Parser(), []
    for k in range(0, len(data), 7):
        got += [(key.hex(), value) for key, _, _, value in p.push(data[k : k + 7])]
    assert got == [(r["key"], r["value"]) for r in want] and p.position == len(data)
    assert klv.track_number(KEY) == 0x15010500 and klv.track_number(bytes(16)) is None
    assert klv.values(data, KEY[:15]) == b"".join(r["value"] for r in want)
    with pytest.raises(ValueError, match="incomplete"):
        list(klv.parse(data[:-1]))
    with pytest.raises(ValueError, match="length"):
        list(klv.parse(KEY + b"\x89" + bytes(20)))


def test_files_scan_and_sink(spark, tmp_path):
    register(spark)
    rows = [(f"clip_{k:03d}.klv", b"".join(klv.build(KEY, bytes([k]) * n) for n in range(3))) for k in range(5)] + [("bad.klv", b"x" * 20)]
    spark.createDataFrame(rows, "name string, content binary").write.format("media_files").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(n for n, _ in rows)
    found = files.scan(spark, str(tmp_path / "out"), klv.parse, klv.SCHEMA)
    assert found.where("status = 'OK'").count() == 15 and found.where("status <> 'OK'").count() == 1
    with pytest.raises(Exception, match="incomplete|length"):
        files.scan(spark, str(tmp_path / "out"), klv.parse, klv.SCHEMA, mode="FAILFAST").collect()
    assert sorted(r.number for r in files.numbered(found.select("path").distinct()).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(("bits", "rf64"), [(16, False), (24, False), (24, True)])
def test_wave_round_trip(spark, tmp_path, bits, rf64):
    rng = np.random.default_rng(bits)
    pcm = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (5000, 3))
    ids = [{"track_index": 1, "uid": "ATU_00000001", "track_ref": "AT_00010001_01", "pack_ref": "AP_00010002"}]
    data = wav.build(pcm, 48000, bits, {"description": "d", "originator": "o", "origination": "2020-01-02 03:04:05", "time_reference": 7}, ids, {"axml": b"<x/>"}, rf64)
    i = wav.info(data)
    assert (i["channels"], i["sampling_rate"], i["bits"], i["samples"], i["time_reference"], i["origination"]) == (3, 48000, bits, 5000, 7, "2020-01-02 03:04:05")
    assert (wav.samples(data) == pcm).all() and (wav.samples(data, 10, 5) == pcm[10:15]).all()
    assert list(wav.allocation(data)) == ids
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(data[:40])
    got = files.scan(spark, str(tmp_path), lambda x: [wav.info(x)], wav.INFO)
    assert {r.path[-5:]: r.samples for r in got.collect()} == {"a.wav": 5000, "b.wav": None}
    frames = files.scan(spark, str(tmp_path / "a.wav"), lambda x: wav.frames(x, (1602, 1601)), wav.FRAMES)
    sizes = {r.position: r.n for r in frames.where("channel = 0").select("position", F.size("samples").alias("n")).collect()}
    assert sizes == {0: 1602, 1: 1601, 2: 1602, 3: 195}


def picture(kind, reference):
    return b"\0\0\1\0" + ((reference << 22 | kind << 19 | 0xFFFF << 3) & 0xFFFFFFFF).to_bytes(4, "big") + b"\x55" * 9


def test_mpeg2_headers(spark, tmp_path):
    sequence = b"\0\0\1\xb3" + (1920 << 20 | 1080 << 8 | 3 << 4 | 3).to_bytes(4, "big") + (12345 << 14).to_bytes(4, "big")
    extension = b"\0\0\1\xb5" + (1 << 44 | 0x82 << 36 | 0 << 35 | 2 << 33).to_bytes(6, "big")
    group = b"\0\0\1\xb8" + (1 << 6).to_bytes(4, "big")
    stream = sequence + extension + group + picture(1, 0) + picture(2, 3) + picture(3, 1) + group + picture(1, 2)
    (tmp_path / "v.m2v").write_bytes(stream)
    rows = sorted(files.scan(spark, str(tmp_path), mpeg2.frames, mpeg2.SCHEMA).collect(), key=lambda r: r.position)
    assert [(r.type, r.temporal_reference, r.gop, r.sequence_header) for r in rows] == [("I", 0, True, True), ("P", 3, False, False), ("B", 1, False, False), ("I", 2, True, False)]
    first = rows[0]
    assert (first.width, first.height, first.rate_num, first.rate_den, first.aspect_num, first.bit_rate, first.chroma, first.closed, first.vbv_delay) == (1920, 1080, 25, 1, 16, 12345, 422, True, 0xFFFF)
    assert sum(r["size"] for r in rows) == len(stream)
    assert mpeg2.frame_info(mpeg2.with_aspect(stream, 2))["aspect_num"] == 4 and mpeg2.with_aspect(picture(1, 0), 2) == picture(1, 0)


def test_texts(spark, tmp_path):
    (tmp_path / "chna.txt").write_text("track_index: 1\nuid: A\ntrack_ref: T1\npack_ref: P\n\n\ntrack_index: 2\nuid: B\ntrack_ref: T2\npack_ref: P\n")
    got = texts.audio_ids(texts.lines(spark, str(tmp_path / "chna.txt"))).orderBy("block").collect()
    assert [(r.track_index, r.uid, r.track_ref) for r in got] == [(1, "A", "T1"), (2, "B", "T2")]
    (tmp_path / "m.txt").write_text("# c\nfile: x.xml\nprofile: p\nencoding: UTF-8\nlanguages: en, fr")
    r = texts.timed_text_manifest(texts.lines(spark, str(tmp_path / "m.txt"))).first()
    assert (r.file, r.profile, r.languages) == ("x.xml", "p", ["en", "fr"])
    (tmp_path / "s.txt").write_text("1/2\t09:58:00:12 00:00:00:05\r\n2/2\t09:58:00:19 00:00:00:03\n")
    assert [(r.part, r.total, r.start) for r in texts.segmentation(texts.lines(spark, str(tmp_path / "s.txt"))).orderBy("number").collect()] == [(1, 2, "09:58:00:12"), (2, 2, "09:58:00:19")]


def test_growing_file(spark, tmp_path):
    register(spark)
    path, packets = tmp_path / "live.klv", [klv.build(KEY, bytes([k]) * 50) for k in range(24)]
    whole = b"".join(packets)
    query = None
    for cut in (0, 30, 500, 777, len(whole)):
        path.write_bytes(whole[:cut])
        stream = spark.readStream.format("growing_klv").option("path", str(path)).option("batchBytes", "300").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "rows")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        got = sorted(r.offset for r in spark.read.schema("key string, offset long, size long, value binary").parquet(str(tmp_path / "rows")).collect()) if (tmp_path / "rows").exists() else []
        assert got == [k * len(packets[0]) for k in range(cut // len(packets[0]))]
