import pytest
from pyspark.sql import functions as F

from framelake.functions import identifiers as B
from framelake.functions import rational as R
from framelake.functions import timecode as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(("base", "drop", "frames"), [(24, False, 2073600), (25, False, 2160000), (30, False, 2592000), (30, True, 2589408), (50, False, 4320000), (60, True, 5178816)])
def test_every_code_of_a_day_comes_back(spark, base, drop, frames):
    day = spark.range(frames).select("id", T.fields(F.col("id"), base, drop).alias("c"))
    back = day.select("id", "c", T.offset(F.col("c.h"), F.col("c.m"), F.col("c.s"), F.col("c.f"), base, drop).alias("o"))
    r = back.agg(F.sum((F.col("id") != F.col("o")).cast("int")).alias("wrong"), F.count_distinct("c").alias("codes"), F.max("c.h").alias("h")).first()
    assert (r.wrong, r.codes, r.h) == (0, frames, 23)


def test_known_codes(spark):
    r = one(
        spark, a=T.text(T.fields(F.lit(1799), 30, True), True), b=T.text(T.fields(F.lit(1800), 30, True), True), c=T.text(T.fields(F.lit(17982), 30, True), True),
        d=T.text(T.fields(F.lit(-1), 25)), e=T.text(T.fields(F.lit(3600), 60, True), True), f=T.offset(0, 1, 0, 0, 30, True), g=T.offset(10, 11, 12, 13, 25),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("00:00:59;29", "00:01:00;02", "00:10:00;00", "23:59:59:24", "00:01:00;04", 1800, 916813)


def test_conversions_round_as_said(spark):
    p = F.col("id") - 60
    df = spark.range(120).select(p.alias("p"), *(R.convert_position(p, 3, 7, r).alias(r) for r in ("up", "down", "nearest", "auto")), R.convert_position(p, 7, 3).alias("more"), R.convert_duration(p, 3, 7).alias("d"))
    for r in df.collect():
        exact = r.p * 3
        assert r.down == exact // 7 and r.up == -(-exact // 7) and r.auto == r.up and r.more == r.p * 7 // 3
        assert r.nearest == ((exact + 3) // 7 if r.p > 0 else exact // 7)
        assert r.d == (max(0, exact) // 7 if r.p > 0 else 0)


def test_large_positions_dont_overflow(spark):
    p = 10**15 + 1
    r = one(spark, a=R.convert_position(F.lit(p), 48048000, 30000, "down"), b=R.convert_position(F.lit(-p), 48048000, 30000, "down"))
    assert (r.a, r.b) == (p * 48048000 // 30000, -p * 48048000 // 30000)


def test_cadence_against_a_walk(spark):
    s = (1602, 1601, 1602, 1601, 1602)
    at = [0]
    for k in range(100):
        at.append(at[-1] + s[k % 5])
    seq = F.array(*map(F.lit, s))
    rows = spark.range(0, 60000, 37).select(F.col("id"), R.lower(F.col("id"), seq).alias("low"), R.whole_below(F.col("id"), seq).alias("whole")).collect()
    for r in rows:
        assert r.low == next(k for k, x in enumerate(at) if x >= r.id) and r.whole == max(k for k, x in enumerate(at) if x <= r.id)
    for r in spark.range(-40, 40).select("id", R.lower(R.higher(F.col("id"), seq), seq).alias("back"), R.higher(F.lit(-5), seq).alias("five")).collect():
        assert r.back == r.id and r.five == -8008


def test_sequences(spark):
    q = lambda a, b, c, d: R.sample_sequence(*map(F.lit, (a, b, c, d)))
    r = one(spark, a=q(25, 1, 48000, 1), b=q(30000, 1001, 48000, 1), c=q(30000, 1001, 44100, 1), d=q(25, 1, 25, 1), e=R.rotate(q(60000, 1001, 48000, 1), 2))
    assert (r.a, r.b, r.c, r.d, r.e) == ([1920], [1602, 1601, 1602, 1601, 1602], None, [1], [800, 801, 801, 801, 801])


def test_rates_and_sizes(spark):
    n = lambda a, b: R.normalize_rate(F.lit(a), F.lit(b))
    r = one(spark, a=n(2997, 1000), b=n(50, 2), c=n(0, 5), d=n(-6, 4), e=R.fill_size(500, 512, 4), f=R.fill_size(512, 512, 4), g=R.fill_size(1, 16, 4), h=R.package_rate_code(30000, 1001), i=R.parse_rate(F.lit("2997")), j=R.parse_rate(F.lit("x")))
    assert (tuple(r.a), tuple(r.b), tuple(r.c), tuple(r.d)) == ((30000, 1001), (25, 1), (0, 1), (-6, 4))
    assert (r.e, r.f, r.g, r.h, tuple(r.i), r.j) == (524, 0, 31, 7, (30000, 1001), None)


def test_parsing(spark):
    r = one(spark, a=T.parse(F.lit("01:02:03;04"), F.lit(30000), F.lit(1001)), b=T.parse(F.lit("01:02:03;04"), 25, 1), c=T.parse(F.lit("1:2"), 25, 1), d=T.parse_position(F.lit("o00:00:01:00"), F.lit(9), 30000, 1001), e=T.parse_position(F.lit("00:00:02:00"), F.lit(9), 25, 1))
    assert (r.a["drop"], r.a["offset"]) == (True, 3723 * 30 + 4 - 2 * (62 - 6)) and r.b["drop"] is False and r.c is None and (r.d, r.e) == (30, 41)


def test_smpte_12m(spark):
    code = F.struct(F.lit(12).alias("h"), F.lit(34).alias("m"), F.lit(56).alias("s"), F.lit(49).alias("f"))
    h = T.encode_smpte12m(code, 50, False, True)
    r = one(spark, hex=h, back=T.decode_smpte12m(F.unhex(h), 50, 1))
    assert r.hex == "2456349200000000" and tuple(r.back) == (12, 34, 56, 48, False, True)


def test_identifiers(spark):
    import uuid

    r = one(spark, u=B.name_uuid(uuid.NAMESPACE_URL.bytes, F.lit("http://x")), p=B.split_text(F.lit(" a ; ;b"), ";"), q=B.split_text(F.lit("a;;b"), ";", empty=True), x=B.xml_encoding(F.lit('<?xml version="1.0" encoding="utf-16"?>')), m=B.is_xml_mime(F.lit("application/ttml+xml")), s=B.size_text(F.lit("3k")), n=B.parse_umid(F.lit("zz")))
    assert r.u == str(uuid.uuid3(uuid.NAMESPACE_URL, "http://x"))
    assert (r.p, r.q, r.x, r.m, r.s, r.n) == (["a", "b"], ["a", "", "b"], "UTF-16", True, 3072, None)
