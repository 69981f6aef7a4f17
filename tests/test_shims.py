from framelake.operators import shims

HEAD = {"stream": 1, "position": 0, "shim": "high_hd_2014", "sequence": True, "extension": True, "display": True, "coding": True, "gop": True, "vbv_delay": 9000, "single_sequence": True, "aspect": (16, 9), "rate": (25, 1), "bit_rate": 50_000_000,
        "width": 1920, "height": 1080, "low_delay": False, "progressive": False, "profile": 0x82, "chroma": 422, "primaries": 1, "display_width": 1920, "display_height": 1080, "tff": True, "max_gop": 12, "closed_gop": True, "identical_gop": True}
SCHEMA = ("stream int, position long, shim string, sequence boolean, extension boolean, display boolean, coding boolean, gop boolean, vbv_delay int, single_sequence boolean, aspect struct<num: int, den: int>, rate struct<num: int, den: int>, bit_rate long, "
          "width int, height int, low_delay boolean, progressive boolean, profile int, chroma int, primaries int, display_width int, display_height int, tff boolean, max_gop int, closed_gop boolean, identical_gop boolean")  # fmt: skip


def found(spark, changes, overrides=None, most=1):
    rows = [tuple((HEAD | {"position": k} | c).values()) for k, c in enumerate(changes)]
    over = None if overrides is None else spark.createDataFrame(overrides, "shim string, name string, value string")
    out = shims.shim_violations(spark.createDataFrame(rows, SCHEMA), shims.references(spark, over), "stream", most).collect()
    return sorted((r.position, r.check, r.severity, r.reported) for r in out)


def test_a_good_stream_and_each_part_alone(spark):
    assert found(spark, [{}]) == []
    bad = {"vbv_delay": None, "low_delay": True, "width": 1440, "primaries": 2, "tff": False, "max_gop": 17, "closed_gop": False, "identical_gop": False, "aspect": None, "bit_rate": 51_000_001}
    parts = {"sequence": False, "extension": False, "display": False, "coding": False, "gop": False}
    assert {c for _, c, _, _ in found(spark, [bad | parts])} == {"constant bit rate"}
    assert {c for _, c, _, _ in found(spark, [bad | parts | {"sequence": True}])} == {"constant bit rate", "bit rate", "resolution", "low delay"}
    assert {c for _, c, _, _ in found(spark, [bad | parts | {"extension": True}])} == {"constant bit rate", "profile and level", "resolution of the extension", "chroma of the profile"}
    assert {c for _, c, _, _ in found(spark, [bad | parts | {"gop": True}])} == {"constant bit rate", "longest GOP", "closed GOPs", "identical GOPs"}
    assert {c for _, c, _, _ in found(spark, [bad | parts | {"coding": True}])} == {"constant bit rate"}
    assert found(spark, [{"shim": "no such"}]) == []


def test_warnings_turn_into_errors_or_fall_silent(spark):
    got = found(spark, [{"low_delay": True, "bit_rate": 1}] * 4)
    assert [x for x in got if x[1] == "low delay"] == [(k, "low delay", "warning" if k < 2 else "error", k < 2) for k in range(4)]
    assert [x for x in got if x[1] == "bit rate"] == [(k, "bit rate", "warning", k < 2) for k in range(4)]


def test_overrides(spark):
    over = [("high_hd_2014", " MaxGOP ", "20"), ("high_hd_2014", "sampleRate", "30000:1001"), ("high_hd_2014", "isLowDelay", "2"), ("high_hd_2014", "colour", "1"), ("cnn_hd_2012", "maxgop", "5")]
    got = found(spark, [{"max_gop": 20, "low_delay": True}, {"max_gop": 21, "rate": (30000, 1001)}], over)
    assert got == [(0, "frame rate", "error", True), (1, "longest GOP", "error", True)]
    assert [r.name for r in shims.unknown_references(spark.createDataFrame(over, "shim string, name string, value string")).collect()] == ["colour"]


def test_typed_values(spark):
    rules = [("f", t, t, n) for t, n in (("string", 4), ("bool", 0), ("uint8", 0), ("duration", 0), ("position", 0), ("timestamp", 0), ("rational", 0), ("version", 0), ("int64", 0))]
    cases = [
        ("string", "abcd", ("abcd", None)), ("string", "éabcdef", ("éabc", "truncated")), ("bool", "1", (1, None)), ("bool", "TRUE", (None, "not a value of type bool")), ("uint8", " 255 ", (255, None)), ("uint8", "-1", (None, "not a value of type uint8")),
        ("duration", "1:0:0:0", (90000, None)), ("duration", "1:0:0", (None, "not a value of type duration")), ("position", "10:00:00:05", (5, None)), ("position", "09:59:59:24", (-1, None)), ("timestamp", "2020-1-2 3", ("2020-01-02T00:00:00", None)),
        ("rational", "-1/ 25", ((-1, 25), None)), ("version", "1.2", (258, None)), ("version", "256.0", (None, "not a value of type version")), ("version", "7", (7, None)), ("int64", "x", (None, "not a value of type int64")), ("string", None, (None, "not a value of type string")),
    ]
    props = spark.createDataFrame([(k, "f", n, v) for k, (n, v, _) in enumerate(cases)] + [(99, "f", "other", "v"), (98, None, "string", "v")], "k int, framework string, name string, value string")
    out = {r.k: r for r in shims.typed(props, spark.createDataFrame(rules, "framework string, name string, type string, length int"), 25, 1, 900_000).collect()}
    for k, (name, value, (want, problem)) in enumerate(cases):
        r = out[k]
        got = next((x for x in (r.text, r.number, tuple(r.pair) if r.pair else None, r.moment) if x is not None), None)
        assert (got, r.problem) == (want, problem), (name, value)
    assert out[99].problem == out[98].problem == "no such property"
