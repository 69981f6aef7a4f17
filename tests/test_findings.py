"""Cases that findings on whole results and on growth were about."""

from framelake.operators import audio_metadata as A
from framelake.operators import timeline


def test_positions_are_filled_without_shuffling_them(spark):
    rows = [("a", 2, 5, "x"), ("a", 2, 6, "y"), ("a", 4, None, "z"), ("b", -3, 1, "n"), ("c", 0, 7, "o"), (None, 1, 1, "q"), ("d", None, 1, "r")]
    df = spark.createDataFrame(rows, "k string, position long, samples long, t string")
    out = timeline.fill_positions(df, "k")
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == [("a", 0, 0, None), ("a", 1, 0, None), ("a", 2, 5, "x"), ("a", 2, 6, "y"), ("a", 3, 0, None), ("a", 4, 0, "z"), ("c", 0, 7, "o")]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan  # positions only stream past


def test_frames_are_read_and_dealt_once_to_be_filled(spark):
    """A track's positions come out in order from one pass over its frames, other columns are null where there is no frame."""
    df = spark.createDataFrame([("a", 3, 1, "x"), ("a", 0, None, "y"), ("b", 2, 4, None), ("a", 3, 2, "z")], "k string, position int, samples long, t string")
    out = timeline.fill_positions(df, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("Exchange") == 1
    rows = [tuple(r) for r in out.collect()]
    assert [r[:3] for r in rows if r[0] == "a"][:4] == [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 3, rows[[r[:2] for r in rows].index(("a", 3))][2])]
    assert sorted(rows, key=str) == sorted([("a", 0, 0, "y"), ("a", 1, 0, None), ("a", 2, 0, None), ("a", 3, 1, "x"), ("a", 3, 2, "z"), ("b", 0, 0, None), ("b", 1, 0, None), ("b", 2, 4, None)], key=str)
    assert out.dtypes == [("k", "string"), ("position", "bigint"), ("samples", "bigint"), ("t", "string")]


def test_words_inside_a_lone_second_sub_frame(spark):
    """CF FC in the data of a second sub-frame begins no first one; a first one behind a second without an end does."""
    sync = "3FF3" + "00" * 7
    inside = bytes.fromhex(sync + "05" + "04" + "CFFC0102" + "00" + "00" + "0A0A")
    turned = bytes.fromhex(sync + "00" + "CFFC" + "00" * 7 + "00")
    wrap = lambda b: bytearray(bytes([0x45, 4, len(b)]) + b)
    found = A.segments(spark.createDataFrame([(1, None, wrap(inside)), (2, wrap(turned), None)], "n int, first binary, second binary"), ["n"]).collect()
    assert sorted((r.n, r.subframe, r.segment) for r in found) == [(1, 2, 0), (1, 2, 1), (2, 1, 0)]
    assert all(r.problem is None for r in found)


def test_sets_in_whole_rows_give_the_tracks_of_their_properties(spark):
    from framelake.operators import packages as H
    from framelake.plans import container_queries as Q
    from framelake.sources import containers as X

    files = {n: Q.container(n, sizes) for n, sizes in ((7, [3]), (8, [4, 5, 6]), (9, [1, 2, 3, 4, 5, 6, 50]))}
    one, all_ = ([{"file": n, **r} for n, data in files.items() for r in parse(data)] for parse in (X.properties, X.sets))
    one = spark.createDataFrame([tuple(r[c] for c in ("file", "partition", "kind", "instance", "tag", "item", "value")) for r in one], f"file long, {X.PROPERTIES}")
    all_ = spark.createDataFrame([(r["file"], r["partition"], r["kind"], r["instance"], dict(r["values"])) for r in all_], f"file long, {X.SET_ROWS}")
    a, b = (sorted(map(str, H.metadata_tracks(df, "file").collect())) for df in (one, all_))
    assert a == b and len(a) == 11
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_set_given_again_counts_as_last_given(spark):
    from framelake.sources import containers as X

    made = [X.build_partition(kind) + X.build_set("track", bytes(16), [(0x4801, bytes([k]))]) for k, kind in enumerate(("header", "footer"))]
    assert [r["values"] for r in X.sets(b"".join(made))] == [[(0x4801, b"\1")]]


def test_containers_from_pieces_made_once():
    """The bytes that the builder gave before pieces were kept."""
    import hashlib

    from framelake.plans import container_queries as Q

    made = b"".join(Q.container(order, list(range(order % 50 + 1, order % 50 + 2 + order % 7))) for order in range(1, 300))
    assert hashlib.md5(made).hexdigest() == "2a4b3866327a4b87cf9baa7c12156d45" and Q._track.cache_info().hits > 300


def test_channel_maps_sort_tracks_not_channels(spark):
    """An odd pair across other tracks, a clip of other tracks alone, PCM without channels; and no sort below the explode sees channels."""
    from framelake.operators import channels as C

    rows = [(1, 0, True, 1), (1, 1, False, 9), (1, 2, True, 2), (1, 3, False, 1), (1, 4, True, 0), (2, 0, False, 1), (2, 1, False, 1), (3, 5, True, 3), (3, 6, None, 1)]
    t = spark.createDataFrame(rows, "clip int, track int, is_pcm boolean, channels int")
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert of(C.stereo_map(t, "clip")) == sorted([(1, 0, 0, 0, 0), (1, 0, 1, 2, 0), (1, 1, 0, 1, 0), (1, 2, 0, 2, 1), (1, 2, 1, None, None), (1, 3, 0, 3, 0), (2, 0, 0, 0, 0), (2, 1, 0, 1, 0), (3, 0, 0, 5, 0), (3, 0, 1, 5, 1), (3, 1, 0, 5, 2), (3, 1, 1, None, None)], key=str)
    assert of(C.single_map(t, "clip")) == sorted([(1, 0, 0, 0, 0), (1, 0, 1, 2, 0), (1, 0, 2, 2, 1), (1, 1, 0, 1, 0), (1, 2, 0, 3, 0), (2, 0, 0, 0, 0), (2, 1, 0, 1, 0), (3, 0, 0, 5, 0), (3, 0, 1, 5, 1), (3, 0, 2, 5, 2)], key=str)
    for make in (C.mono_map, C.stereo_map, C.single_map):
        plan = make(t, "clip")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("Generate explode") < plan.index("Window")


def test_large_inputs_are_spread(spark):
    from framelake.operators.spread import spread

    assert spread(spark.range(100), "id", rows=10).rdd.getNumPartitions() == 10
    assert spread(spark.range(100), "id").rdd.getNumPartitions() == spark.range(100).rdd.getNumPartitions()


def test_tracks_followed_in_a_file_equal_those_by_joins(spark):
    """Packages, tracks, clips and descriptors that are missing, doubled, repeated or of the wrong kind."""
    import random

    from framelake.operators import packages as H
    from framelake.sources import containers as X

    t, one = H.TAGS, lambda k: bytes(15) + bytes([k])
    four, eight = lambda n: n.to_bytes(4, "big"), lambda n: n.to_bytes(8, "big", signed=True)
    label = lambda k: bytes.fromhex("060e2b3404010101" + ("0103020201", "0103020202", "ffffffffff")[k] + "000000")

    def file(r):
        some = lambda lo, hi, n: X.batch([one(r.randint(lo, hi)) for _ in range(r.randint(0, n))])
        maybe = lambda *items: [x for x in items if r.random() < 0.85]
        made = [X.build_set(kind, one(k), maybe((t["package_uid"], bytes(31) + bytes([r.randint(1, 2)])), (t["tracks"], some(10, 16, 4)), (t["descriptor"], one(r.randint(40, 47))))) for k, kind in ((1, "material package"), (2, "source package"), (3, "source package"), (4, "material package"))]
        made += [X.build_set("track", one(k), maybe((t["track_id"], four(r.randint(1, 3))), (t["track_number"], four(k)), (t["edit_rate"], four(25) + four(1)), (t["origin"], eight(-k)), (t["sequence"], one(r.randint(20, 33))))) for k in range(10, 16)]
        made += [X.build_set("sequence", one(k), maybe((t["definition"], label(k % 3)), (t["components"], some(26, 34, 4)))) for k in range(20, 26)]
        made += [X.build_set("source clip" if r.random() < 0.6 else "filler", one(k), maybe((t["definition"], label(k % 3)), (t["start"], eight(k)), (t["duration"], eight(k)), (t["source_uid"], bytes(31) + bytes([r.randint(1, 2)])), (t["source_track"], four(r.randint(1, 3))))) for k in range(28, 34)]
        made += [X.build_set("multiple descriptor" if k < 42 else ("wave descriptor", "cdci descriptor")[k % 2], one(k), maybe((t["descriptors"], some(41, 47, 4)), (t["linked_track"], four(r.randint(1, 3))), (t["width"], four(k)), (t["sampling_rate"], four(48000) + four(1)), (t["container"], one(k)))) for k in range(40, 46)]
        again = r.sample(made, 3)
        return X.build_partition("header") + b"".join(made) + X.build_partition("footer") + b"".join(again)

    files = {n: file(random.Random(n)) for n in range(400)}
    rows = [tuple({"file": n, **p}[c] for c in ("file", "partition", "kind", "instance", "tag", "item", "value")) for n, data in files.items() for p in X.properties(data)]
    joined = H.metadata_tracks(spark.createDataFrame(rows, f"file long, {X.PROPERTIES}"), "file")
    followed = spark.createDataFrame([{"file": n, **x} for n, data in files.items() for x in H.tracks_of(X.sets(data))], f"file long, {H.TRACKS}")
    a, b = sorted(map(str, joined.collect())), sorted(map(str, followed.collect()))
    assert joined.columns == followed.columns and len(a) > 300
    assert a == b


def test_tracks_of_parsed_files_are_not_joined(spark):
    from framelake.plans import container_queries as Q

    plan = Q.s3_tracks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan and "sets-" not in plan
