import pytest
from pyspark.sql import functions as F

from framelake.functions import identifiers as B
from framelake.operators import timeline as S
from framelake.sources import wav
from framelake.streaming.tail import pace

# Examples of the generic syntax's standard, as seen from http://a/b/c/d;p?q
BASE = "http://a/b/c/d;p?q"
RESOLVED = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", "": BASE, ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
}


def test_addresses(spark):
    rows = spark.createDataFrame(list(RESOLVED.items()), "r string, want string").withColumn("base", F.lit(BASE))
    got = rows.select("r", "want", B.absolute_uri(F.col("r"), F.col("base")).alias("got")).collect()
    assert [(r.r, r.got) for r in got] == [(r.r, r.want) for r in got]
    back = rows.where("want like 'http://a/%'").withColumn("rel", B.relative_uri(F.col("want"), F.col("base"))).select("want", "rel", B.absolute_uri(F.col("rel"), F.col("base")).alias("again"))
    for r in back.where("want <> base").collect():
        assert r.again == r.want and not r.rel.startswith("http"), r


def test_null_and_plain_addresses(spark):
    x = spark.createDataFrame([(None,), ("",), ("a b",), ("/x/ü?#",)], "p string")
    got = [tuple(r) for r in x.select(B.file_uri(F.col("p")).alias("u")).select("u", B.uri_path(F.col("u")), F.size(B.uri_segments(F.col("u")))).collect()]
    assert got[1:] == [("", "", 0), ("a%20b", "a b", 1), ("file:///x/%C3%BC%3F%23", "/x/ü?#", 2)]
    assert got[0][:2] == (None, None)
    assert spark.range(1).select(B.absolute_uri(F.lit("x"), F.lit("y/z"))).first()[0] is None


def first_fit(new, old):
    """Pairs by the rule as it is told: track by track, each to the first free and compatible one of the same total."""
    out, free, total = {}, sorted(old), None
    for n, key, d in sorted(new):
        for o in free:
            if o[1] == key and (total is None or d + o[2] == total):
                total = d + o[2]
                out[n] = o[0]
                free.remove(o)
                break
    return out


def test_first_fit(spark):
    import random

    r = random.Random(5)
    make = lambda n: [(g, k, r.choice("ab"), r.randrange(3)) for g in range(30) for k in range(r.randrange(n))]
    new, old = make(9), make(9)
    a = spark.createDataFrame(new, "g int, new_id int, kind string, duration int")
    b = spark.createDataFrame(old, "g int, old_id int, kind string, duration int")
    got = {(x.g, x.new_id): x.old_id for x in S.match_segments(a, b, ["kind"], "g").collect()}
    want = {}
    for g in range(30):
        pairs = first_fit([x[1:] for x in new if x[0] == g], [x[1:] for x in old if x[0] == g])
        want |= {(g, x[1]): pairs.get(x[1]) for x in new if x[0] == g}
    assert got == want
    assert S.match_segments(a.limit(0), b, ["kind"], "g").count() == 0


def test_chunk_ids():
    assert wav.chunk_ids("axml, ubx,chnax") == (False, {"axml", "ubx ", "chna"}) and wav.chunk_ids("axml,all") == (True, set())
    with pytest.raises(ValueError):
        wav.chunk_ids(" , ")


def test_pace():
    assert pace(25, 25, 1) == "1000 milliseconds" and pace(30, 30000, 1001, 2.0) == "500 milliseconds"
    with pytest.raises(ValueError):
        pace(25, 25, 1, 0)
