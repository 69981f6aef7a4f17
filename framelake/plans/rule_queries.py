"""Rules on tracks, sequences, sizes, names and addresses, over stand-ins derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as B
from ..functions import rational as R
from ..operators import channels as C
from ..operators import events as V
from ..operators import index as X
from ..operators import integrity as G
from ..operators import labels as L
from ..operators import pictures as Q
from ..operators import shims as M
from ..operators import timeline as S
from ..operators import tracks as K
from ..sources import wav
from .frame_queries import _FRAMES, frames, table
from .time_queries import CADENCE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id")


def _of(values, of):
    return F.get(F.array(*map(F.lit, values)), F.pmod(of, F.lit(len(values))).cast("int"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS track, l_linenumber AS position FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 OR l_linenumber = 6")
def f10_positions(spark, sf_dir):
    test = F.lit(False)
    for a, b in K.parse_ranges("2-4,6"):
        test = test | F.col("l_linenumber").between(a, b)
    return table(spark, sf_dir, "lineitem").where(test).select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("position"))


@query("SELECT event_id, ['digibeta_dropout', 'pse_failure', 'timecode_break', 'vtr_error'][event_id % 4 + 1] AS kind FROM events WHERE event_id % 4 IN (1, 3)")
def f11_event_mask(spark, sf_dir):
    kind = _of(list(V.EVENT_LETTERS.values()), F.col("event_id"))
    return events(spark, sf_dir).select("event_id", kind.alias("kind")).where(F.col("kind").isin(*V.event_mask("pv")))


@query("SELECT event_id, ['axml', 'ubx ', 'chna', 'md5 ', 'list'][event_id % 5 + 1] AS chunk FROM events WHERE event_id % 5 NOT IN (1, 2)")
def f12_chunks(spark, sf_dir):
    every, ids = wav.chunk_ids("ubx, chna")
    e = events(spark, sf_dir).select("event_id", _of(("axml", "ubx ", "chna", "md5 ", "list"), F.col("event_id")).alias("chunk"))
    return e.where(F.lit(not every) & ~F.col("chunk").isin(*ids))


@query(f"WITH {_FRAMES} SELECT track, position - track % 3 AS \"read\", size FROM f WHERE position >= track % 3")
def f13_skip_precharge(spark, sf_dir):
    f = frames(spark, sf_dir).select("track", F.col("position").alias("read"), "size", (F.col("track") % 3).alias("precharge"))
    return S.skip_precharge(f).drop("precharge")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 5 IN (0, 2) THEN 'D-10' ELSE ['Picture', 'WAVE PCM', 'MPEG-2 Long GOP 422P@ML 576i', 'AVC', 'D-10'][event_id % 5 + 1] END AS type FROM events")
def f14_assumed(spark, sf_dir):
    kind = _of(("Picture", "WAVE PCM", "MPEG-2 Long GOP 422P@ML 576i", "AVC", "D-10"), F.col("event_id"))
    return events(spark, sf_dir).select("event_id", K.assumed_type(kind, F.col("event_id") % 2 == 0, "D-10").alias("type"))


# --- tracks and sequences --------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS clip, count(*) FILTER (l_linenumber % 3 > 0) AS segments, CAST(coalesce(sum(CASE WHEN l_linenumber % 5 > 0 THEN l_partkey END) FILTER (l_linenumber % 3 > 0), 0) AS BIGINT) AS duration FROM lineitem GROUP BY 1")
def a10_segment_totals(spark, sf_dir):
    line = F.col("l_linenumber")
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), (line % 3 == 0).alias("filler"), F.when(line % 5 > 0, F.col("l_partkey").cast("long")).alias("duration"))
    return K.segment_totals(parts, "clip")


@query("SELECT DISTINCT l_orderkey AS clip, l_suppkey AS file_id FROM lineitem WHERE l_linenumber % 2 = 1")
def a13_file_ids(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_suppkey").alias("file_id"), (F.col("l_linenumber") % 2 == 1).alias("internal"))
    return K.file_ids(t, "clip", internal=True)


@query("SELECT conv_id, md5(text) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) - 1 AS at FROM conversations")
def u4_text_objects(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("member"), F.col("turn").alias("object"), F.md5(F.col("text").cast("binary")).alias("content"))
    return K.text_objects(c, "conv_id").select("conv_id", "content", "at")


@query("SELECT o_custkey AS sequence, o_orderkey AS segment, o_orderkey > lo AND o_orderkey % 5 = 0 AS precharge_problem, o_orderkey < hi AND o_orderkey % 7 = 0 AS rollout_problem FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS lo, max(o_orderkey) OVER (PARTITION BY o_custkey) AS hi FROM orders) WHERE (o_orderkey > lo AND o_orderkey % 5 = 0) OR (o_orderkey < hi AND o_orderkey % 7 = 0)")
def w11_misplaced(spark, sf_dir):
    key = F.col("o_orderkey")
    s = orders(spark, sf_dir).select(F.col("o_custkey").alias("sequence"), key.alias("segment"), (key % 5 == 0).cast("int").alias("precharge"), (key % 7 == 0).cast("int").alias("rollout"))
    return S.misplaced_dependencies(s, "sequence").drop("precharge", "rollout")


@query("SELECT o_custkey AS sequence, count(*) FILTER (o_orderstatus = 'O') AS incomplete, bool_and(o_orderstatus <> 'O') AS readable FROM orders GROUP BY 1")
def v8_complete(spark, sf_dir):
    return S.complete_sequences(orders(spark, sf_dir).select(F.col("o_custkey").alias("sequence"), (F.col("o_orderstatus") != "O").alias("complete")), "sequence")


@query("""WITH t AS (SELECT o_orderkey AS track, o_orderkey % 30 - 10 AS start, o_orderkey % 90 AS stop FROM orders), r AS (SELECT track, stop, unnest(range(start, stop, 8)) AS position FROM t WHERE stop > greatest(start, 0))
SELECT track, position, CASE WHEN position < 0 THEN least(-position, 8) ELSE 0 END AS first_sample_offset, greatest(0, least(position + 8, stop) - greatest(position, 0)) AS samples FROM r""")
def o6_reads(spark, sf_dir):
    key = F.col("o_orderkey").cast("long")
    return S.reads(orders(spark, sf_dir).select(key.alias("track"), (key % 30 - 10).alias("start"), (key % 90).alias("stop")), 8).drop("start", "stop")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey % 50 AS number, o_orderstatus AS kind, o_orderkey % 3 AS duration, o_orderkey // 400 AS clip, o_orderkey % 2 AS old FROM orders),
a AS (SELECT * FROM o WHERE old = 0), b AS (SELECT * FROM o WHERE old = 1),
head AS (SELECT a.clip, a.duration + b.duration AS total FROM a JOIN b USING (clip, number, kind) QUALIFY row_number() OVER (PARTITION BY a.clip ORDER BY a.id, b.id) = 1),
x AS (SELECT a.*, total - duration AS rest, row_number() OVER (PARTITION BY clip, number, kind, total - duration ORDER BY id) AS n FROM a LEFT JOIN head USING (clip)),
y AS (SELECT *, row_number() OVER (PARTITION BY clip, number, kind, duration ORDER BY id) AS n FROM b)
SELECT x.id AS new_id, y.id AS old_id FROM x LEFT JOIN y ON x.clip = y.clip AND x.number = y.number AND x.kind = y.kind AND x.rest = y.duration AND x.n = y.n""")
def j13_match_durations(spark, sf_dir):
    key = F.col("o_orderkey")
    o = orders(spark, sf_dir).select(key, (F.col("o_custkey") % 50).alias("number"), F.col("o_orderstatus").alias("kind"), (key % 3).alias("duration"), F.floor(key / 400).alias("clip"))
    new, old = (o.where(key % 2 == k).withColumnRenamed("o_orderkey", n) for k, n in ((0, "new_id"), (1, "old_id")))
    return S.match_segments(new, old, ["number", "kind"], "clip").select("new_id", "old_id")


@query("SELECT o_orderkey AS track, o_orderkey % 50 >= o_orderkey % 40 AS index_ok, o_orderkey % 9 - o_orderkey % 12 >= 0 AS precharge_ok FROM orders")
def v2_index_covers(spark, sf_dir):
    key = F.col("o_orderkey")
    t = orders(spark, sf_dir).select(key.alias("track"), (key % 50).alias("indexed"), (key % 40).alias("duration"), (key % 9).alias("origin"), (-(key % 12)).alias("precharge"))
    return G.index_covers(t).select("track", "index_ok", "precharge_ok")


@query(f"""WITH {_FRAMES} SELECT track, position, CASE WHEN position <= track % 4 THEN 128 ELSE 0 END AS flags, position * 100 AS "offset" FROM f""")
def r2_append_entries(spark, sf_dir):
    f = frames(spark, sf_dir).select("track", "position", (F.col("position") * 100).alias("offset"))
    entries = f.where(F.col("position") <= F.col("track") % 4).withColumns({"temporal_offset": F.lit(0), "key_frame_offset": F.lit(0), "flags": F.lit(128)})
    return X.append_entries(entries, f, "track").select("track", "position", "flags", "offset")


# --- sizes and samples -----------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE c(k, pos) AS (SELECT 0, 0 UNION ALL SELECT k + 1, pos + [{", ".join(map(str, CADENCE))}][k % {len(CADENCE)} + 1] FROM c WHERE k < 70),
e AS (SELECT event_id, event_id * 101 % 100000 - event_id % 3000 + event_id % 17 AS kept FROM events)
SELECT event_id, greatest(kept, 0) AS samples, CASE WHEN kept <= 0 THEN 0 ELSE (SELECT max(k) FROM c WHERE pos <= kept) END AS frames FROM e""")
def t21_pcm_duration(spark, sf_dir):
    n = F.col("event_id")
    args = (F.pmod(n * 101, F.lit(100000)), n % 3000, n % 17)
    cycle = F.array(*map(F.lit, CADENCE))
    return events(spark, sf_dir).select("event_id", R.pcm_duration(*args).alias("samples"), R.pcm_duration(*args, cycle).alias("frames"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN true ELSE event_id % 6 >= event_id % 9 END AS excess FROM events""")
def b14_padding(spark, sf_dir):
    """Ones up to a size, then zeros: nothing but zeros lies beyond a target at or above that size; a sixth of them hold zeros alone."""
    n = F.col("event_id")
    data = F.unhex(F.concat(F.expr("repeat('01', cast(if(event_id % 6 = 0, 0, event_id % 9) as int))"), F.lit("00" * 12)))
    return events(spark, sf_dir).select("event_id", G.excess_padding(data, (n % 6).cast("int")).alias("excess"))


@query("""SELECT event_id, CASE WHEN f AND (a = 0 OR b = 0) OR NOT f AND a = 0 THEN 'null' WHEN f AND (a IS NULL OR b IS NULL) OR NOT f AND a IS NULL THEN 'unknown' ELSE 'complete' END AS state,
CASE WHEN NOT f AND a IS NULL OR f AND a IS NULL AND (b IS NULL OR b <> 0) THEN 100 ELSE a END AS first, CASE WHEN f AND a > 0 AND b IS NULL THEN CASE WHEN a < 100 THEN 100 - a END WHEN f AND a IS NULL AND (b IS NULL OR b <> 0) OR NOT f AND a IS NULL THEN NULL ELSE b END AS second
FROM (SELECT event_id, event_id % 2 = 0 AS f, [0, 40, NULL, 120][event_id // 2 % 4 + 1] AS a, [0, 30, NULL][event_id % 3 + 1] AS b FROM events)""")
def b12_size_state(spark, sf_dir):
    n = F.col("event_id")
    pick = lambda values, of: F.get(F.expr(f"array({values})"), of.cast("int"))
    args = (n % 2 == 0, pick("0, 40, null, 120", F.floor(n / 2) % 4), pick("0, 30, null", n % 3))
    made = Q.completed_size(*args, F.lit(100))
    return events(spark, sf_dir).select("event_id", Q.size_state(*args).alias("state"), made["first"].alias("first"), made["second"].alias("second"))


@query("SELECT vec_id, md5(string_agg(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT), ',' ORDER BY i)) AS padded, 64 AS longer, vec_id % 7 AS quiet FROM (SELECT vec_id, unnest(embedding || [CAST(0 AS FLOAT) FOR k IN range(6)]) AS x, generate_subscripts(embedding || [CAST(0 AS FLOAT) FOR k IN range(6)], 1) AS i FROM embeddings) GROUP BY vec_id")
def m7_pad(spark, sf_dir):
    """Vectors of 64 samples filled up to frames of 70, and to 60, which they exceed."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", C.pad_samples(F.col("embedding"), 70).alias("p"), F.size(C.pad_samples(F.col("embedding"), 60)).alias("longer"), C.silence((F.col("vec_id") % 7).cast("int")).alias("s"))
    digits = F.array_join(F.transform("p", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",")
    return e.select("vec_id", F.md5(digits.cast("binary")).alias("padded"), "longer", F.size(F.filter("s", lambda x: x == 0)).cast("long").alias("quiet"))


# --- names and addresses ---------------------------------------------------------------------------------------------


@query("""SELECT event_id, ['V', 'A', 'D', 'T', 'M', 'X'][event_id % 6 + 1] || event_id AS name, event_id // 2 % 128 // 8 AS wide_code, event_id // 2 % 8 >= 4 AS wide,
CASE WHEN event_id // 2 % 128 < 32 THEN event_id // 2 % 16 ELSE event_id // 2 % 128 // 8 END AS old_code, event_id // 2 % 128 // 4 * 4 AS again, 'é' || event_id AS text FROM events""")
def b21_names(spark, sf_dir):
    n = F.col("event_id")
    afd = (F.floor(n / 2) % 128).cast("int")
    new, old = B.decode_afd(afd, F.lit(False)), B.decode_afd(afd, F.lit(True))
    kind = _of(("picture", "sound", "data", "timecode", "descriptive", "other"), n)
    text = F.concat(F.encode(F.concat(F.lit("é"), n.cast("string")), "UTF-16BE"), F.lit(b"\0\0\0x"))
    return events(spark, sf_dir).select(
        "event_id", B.track_name(kind, n).alias("name"), new["code"].alias("wide_code"), new["wide"].alias("wide"), old["code"].alias("old_code"),
        B.encode_afd(new["code"], new["wide"]).alias("again"), B.utf16_text(text).alias("text"),
    )


@query("SELECT event_id, ['UTF-8', 'UTF-16BE', 'UTF-16LE', 'ISO-8859-1', 'UTF-8'][event_id % 5 + 1] AS encoding FROM events")
def b18_encodings(spark, sf_dir):
    heads = (b"\xef\xbb\xbf<a/>", b"\xfe\xff\0<", b"\xff\xfe<\0", b"<?xml version='1.0' encoding='iso-8859-1'?>", b"<a/>")
    return events(spark, sf_dir).select("event_id", B.text_encoding(_of(heads, F.col("event_id"))).alias("encoding"))


@query("""SELECT event_id, ['file:///a/b' || n || '/x', 'file:///a/x', 'file:///x', 'http://h/p/' || n, 'file:///a/b' || n || '/c?q', 'file:///a/b' || n || '/x/'][n % 6 + 1] AS absolute,
['c', '../x' || n, '../../y/z', './', 'http://h/q', 'd/e?k'][n % 6 + 1] AS relative, CASE WHEN n % 6 <> 4 THEN '/a/f ' || n || '+.mxf' END AS path, CASE WHEN n % 6 = 4 THEN 2 ELSE 2 END AS segments FROM (SELECT event_id, event_id AS n FROM events)""")
def b19_addresses(spark, sf_dir):
    n = F.col("event_id").cast("string")
    base = F.concat(F.lit("file:///a/b"), n, F.lit("/c"))
    made = lambda *xs: F.get(F.array(*(F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in x)) for x in xs)), (F.col("event_id") % 6).cast("int"))
    reference = made(("x",), ("./../x",), ("/../x",), ("HTTP://h/p/q/../", n), ("?q",), ("x/y/..",))
    target = made((base,), ("file:///a/x", n), ("file:///y/z",), ("file:///a/b", n, "/"), ("http://h/q",), ("file:///a/b", n, "/d/e?k"))
    name = F.concat(F.lit("/a/f "), n, F.lit("+.mxf"))
    address = F.when(F.col("event_id") % 6 == 4, F.concat(F.lit("http://h/a/"), n)).otherwise(B.file_uri(name))
    return events(spark, sf_dir).select("event_id", B.absolute_uri(reference, base).alias("absolute"), B.relative_uri(target, base).alias("relative"), B.uri_path(address).alias("path"), F.size(B.uri_segments(address)).alias("segments"))


# --- delivery rules ----------------------------------------------------------------------------------------------------

_HEADERS = """h AS (SELECT user_id AS stream, event_id AS position, ['high_hd_2014', 'cnn_hd_2012', 'nrk_hd_2012', 'jvc_hd_35_vbr_2012', 'jvc_hd_25_cbr_2012'][user_id % 5 + 1] AS shim,
  event_id % 2 = 0 AS seq, event_id % 3 > 0 AS ext, event_id % 5 = 0 AS dis, event_id % 7 > 2 AS cod, event_id % 4 = 1 AS gop, event_id % 11 > 0 AS vbv, event_id % 3 = 0 AS low, event_id % 13 < 3 AS prog,
  [1920, 1440, 1280, 720][event_id % 9 % 4 + 1] AS w, [1080, 1080, 720][event_id % 8 % 3 + 1] AS ht, [130, 68, 70][event_id % 10 % 3 + 1] AS prof, [422, 420, 0][event_id % 6 % 3 + 1] AS chroma,
  CASE WHEN event_id % 15 > 0 THEN event_id % 10 // 5 + 1 END AS prim, 24500000 + event_id % 60 * 500000 AS bits, event_id % 17 < 3 AS narrow, event_id % 19 > 9 AS tff, 10 + event_id % 12 AS longest, event_id % 23 > 4 AS closed, event_id % 29 > 4 AS same FROM events),
r AS (SELECT h.*, CASE WHEN shim IN ('high_hd_2014', 'nrk_hd_2012') THEN 50000000 WHEN shim = 'jvc_hd_25_cbr_2012' THEN 25000000 ELSE 35000000 END AS rate,
  CASE WHEN shim IN ('high_hd_2014', 'nrk_hd_2012') THEN 1000000 ELSE 0 END AS delta, shim NOT IN ('cnn_hd_2012', 'jvc_hd_35_vbr_2012') AS steady, CASE WHEN shim IN ('high_hd_2014', 'nrk_hd_2012') THEN 1920 ELSE 1440 END AS rw,
  CASE WHEN shim IN ('high_hd_2014', 'nrk_hd_2012') THEN 422 ELSE 420 END AS rc, CASE WHEN w = 1440 THEN CASE WHEN prof IN (68, 70) THEN 420 END WHEN w = 1920 OR (w = 1280 AND prog) THEN CASE prof WHEN 130 THEN 422 WHEN 68 THEN 420 END END AS pc FROM h)"""
_CHECKS = [
    ("constant bit rate", 1, "steady AND NOT vbv", "NULL", "'1'"), ("aspect ratio", 0, "seq AND narrow", "'4/3'", "'16/9'"), ("bit rate", 1, "seq AND abs(bits - rate) > delta", "bits", "rate"),
    ("resolution", 0, "seq AND (w <> rw OR ht <> 1080)", "w || 'x' || ht", "rw || 'x1080'"), ("low delay", 2, "seq AND low", "1", "0"), ("vertical size", 0, "ext AND NOT prog AND ht <> 1080", "ht", "1080"),
    ("horizontal size", 0, "ext AND (w = 720 OR w = 1280 AND NOT prog)", "w", "CASE WHEN prog THEN '1920, 1440 or 1280' ELSE '1920 or 1440' END"),
    ("profile and level", 0, "ext AND NOT (w = 720 OR w = 1280 AND NOT prog) AND pc IS NULL", "prof", "NULL"), ("resolution of the extension", 0, "ext AND (w <> rw OR ht <> 1080)", "w || 'x' || ht", "rw || 'x1080'"),
    ("chroma of the profile", 0, "ext AND coalesce(pc, 420) <> rc", "coalesce(pc, 420)", "rc"), ("chroma format", 0, "ext AND chroma <> 0 AND chroma <> rc", "chroma", "rc"), ("color primaries", 2, "dis AND prim <> 1", "prim", "1"),
    ("display size", 2, "dis AND (w <> rw OR ht <> 1080)", "w || 'x' || ht", "rw || 'x1080'"), ("top field first", 0, "cod AND ext AND NOT prog AND NOT tff", "0", "1"), ("longest GOP", 0, "gop AND longest > 16", "longest", "16"),
    ("closed GOPs", 0, "gop AND NOT closed", "0", "1"), ("identical GOPs", 0, "gop AND NOT same", "0", "1"),
]


@query(f"WITH {_HEADERS}, v AS (" + " UNION ALL ".join(f"SELECT stream, position, '{n}' AS check_, {s} AS s, CAST({found} AS VARCHAR) AS found, CAST({wanted} AS VARCHAR) AS wanted FROM r WHERE {bad}" for n, s, bad, found, wanted in _CHECKS) + """),
n AS (SELECT *, row_number() OVER (PARTITION BY stream, check_ ORDER BY position) AS nth FROM v)
SELECT stream, position, check_ AS "check", CASE WHEN s = 0 OR (s = 2 AND nth > 3) THEN 'error' ELSE 'warning' END AS severity, found, wanted, s = 0 OR nth <= 3 AS reported FROM n""")
def v5_shim_checks(spark, sf_dir):
    """Headers of all shims; the first three of each warning are reported."""
    e = F.col("event_id")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    whole = lambda n: F.when(n, F.struct(F.lit(4).alias("num"), F.lit(3).alias("den"))).otherwise(F.struct(F.lit(16).alias("num"), F.lit(9).alias("den")))
    width, height = pick((1920, 1440, 1280, 720), e % 9 % 4), pick((1080, 1080, 720), e % 8 % 3)
    h = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), e.alias("position"), pick(list(M.SHIMS), F.col("user_id") % 5).alias("shim"), (e % 2 == 0).alias("sequence"), (e % 3 > 0).alias("extension"), (e % 5 == 0).alias("display"),
        (e % 7 > 2).alias("coding"), (e % 4 == 1).alias("gop"), F.when(e % 11 > 0, 9000).alias("vbv_delay"), F.lit(True).alias("single_sequence"), whole(e % 17 < 3).alias("aspect"),
        F.struct(F.lit(25).alias("num"), F.lit(1).alias("den")).alias("rate"), (e % 60 * 500_000 + 24_500_000).alias("bit_rate"), width.alias("width"), height.alias("height"), (e % 3 == 0).alias("low_delay"),
        (e % 13 < 3).alias("progressive"), pick((130, 68, 70), e % 10 % 3).alias("profile"), pick((422, 420, 0), e % 6 % 3).alias("chroma"), F.when(e % 15 > 0, F.floor(e % 10 / 5) + 1).alias("primaries"),
        width.alias("display_width"), height.alias("display_height"), (e % 19 > 9).alias("tff"), (e % 12 + 10).alias("max_gop"), (e % 23 > 4).alias("closed_gop"), (e % 29 > 4).alias("identical_gop"),
    )
    return M.shim_violations(h, M.references(spark), "stream", most=2).drop("nth")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 AS t, o_orderkey % 7 AS x FROM orders),
p AS (SELECT k, t, ['string', 'bool', 'uint8', 'uint16', 'int64', 'duration', 'position', 'timestamp', 'rational', 'version', NULL][t + 1] AS type,
  CASE t WHEN 0 THEN 'Ærø ' || k WHEN 1 THEN ['true', 'false', '1', '0', 'yes', 'True', ''][x + 1] WHEN 2 THEN CAST(k % 300 AS VARCHAR) WHEN 3 THEN k || 'x' WHEN 4 THEN '-' || k WHEN 5 THEN CASE WHEN x < 3 THEN CAST(k AS VARCHAR) ELSE k % 24 || ':59:' || x || ':3' END
  WHEN 6 THEN CASE WHEN x < 2 THEN CAST(k AS VARCHAR) WHEN x < 6 THEN '10:' || x || ':00' || CASE WHEN x < 4 THEN ':' ELSE ';' END || '12' ELSE '10:00' END WHEN 7 THEN CASE WHEN x < 3 THEN '2014-3-' || (x + 1) WHEN x < 6 THEN '2014-12-0' || x || 'T1:02:' || (x + 10) || 'Z' ELSE 'today' END
  WHEN 8 THEN CASE WHEN x < 5 THEN k || '/' || x ELSE '16:9' END WHEN 9 THEN CASE WHEN x < 3 THEN x || '.' || k % 300 ELSE CAST(k % 70000 AS VARCHAR) END ELSE 'v' END AS value, x FROM o),
q AS (SELECT *, CASE WHEN t = 0 THEN left(value, 8) END AS text,
  CASE t WHEN 1 THEN CASE WHEN x IN (0, 2) THEN 1 WHEN x IN (1, 3) THEN 0 END WHEN 2 THEN CASE WHEN k % 300 < 256 THEN k % 300 END WHEN 3 THEN CASE WHEN k < 65536 THEN k END WHEN 4 THEN -k
  WHEN 5 THEN CASE WHEN x < 3 THEN k ELSE ((k % 24 * 60 + 59) * 60 + x) * 30 + 3 END
  WHEN 6 THEN CASE WHEN x < 2 THEN k WHEN x < 4 THEN ((600 + x) * 60) * 30 + 12 WHEN x < 6 THEN ((600 + x) * 60) * 30 + 12 - 2 * (600 + x - (600 + x) // 10) END - CASE WHEN x BETWEEN 2 AND 5 THEN 107892 ELSE 0 END
  WHEN 9 THEN CASE WHEN x < 3 THEN CASE WHEN k % 300 < 256 THEN x * 256 + k % 300 END WHEN k % 70000 < 65536 THEN k % 70000 END END AS number,
  CASE WHEN t = 8 AND x < 5 THEN k END AS num, CASE WHEN t = 8 AND x < 5 THEN x END AS den,
  CASE WHEN t = 7 AND x < 3 THEN '2014-03-0' || (x + 1) || 'T00:00:00' WHEN t = 7 AND x < 6 THEN '2014-12-0' || x || 'T01:02:' || (x + 10) END AS moment FROM p)
SELECT k, type, text, CAST(number AS BIGINT) AS number, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, moment,
  CASE WHEN t = 10 THEN 'no such property' WHEN text IS NULL AND number IS NULL AND num IS NULL AND moment IS NULL THEN 'not a value of type ' || type WHEN length(text) < length(value) THEN 'truncated' END AS problem FROM q""")
def b22_typed_properties(spark, sf_dir):
    """A property of each order, of each type in turn, with good and bad values, at 29.97 frames a second from 01:00:00;00."""
    k = F.col("o_orderkey")
    t, x, own = k % 11, k % 7, k.cast("string")
    case = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    value = (
        F.when(t == 0, case("Ærø ", own)).when(t == 1, F.get(F.array(*map(F.lit, ("true", "false", "1", "0", "yes", "True", ""))), x.cast("int"))).when(t == 2, (k % 300).cast("string")).when(t == 3, case(own, "x"))
        .when(t == 4, case("-", own)).when(t == 5, F.when(x < 3, own).otherwise(case(k % 24, ":59:", x, ":3"))).when(t == 6, F.when(x < 2, own).when(x < 6, case("10:", x, ":00", F.when(x < 4, ":").otherwise(";"), "12")).otherwise("10:00"))
        .when(t == 7, F.when(x < 3, case("2014-3-", x + 1)).when(x < 6, case("2014-12-0", x, "T1:02:", x + 10, "Z")).otherwise("today")).when(t == 8, F.when(x < 5, case(own, "/", x)).otherwise("16:9"))
        .when(t == 9, F.when(x < 3, case(x, ".", k % 300)).otherwise((k % 70000).cast("string"))).otherwise("v")
    )
    p = table(spark, sf_dir, "orders").select(k.alias("k"), F.lit("core").alias("framework"), case("p", t).alias("name"), value.alias("value"))
    types = ("string", "bool", "uint8", "uint16", "int64", "duration", "position", "timestamp", "rational", "version")
    rules = spark.createDataFrame([("core", f"p{i}", n, 8 if n == "string" else 0) for i, n in enumerate(types)], "framework string, name string, type string, length int")
    out = M.typed(p, rules, 30000, 1001, 107892)
    return out.select("k", "type", "text", "number", F.col("pair.num").alias("num"), F.col("pair.den").alias("den"), "moment", "problem")


_LABELS = """o AS (SELECT o_custkey AS file, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS track FROM orders),
l AS (SELECT file, track, o_orderkey * 100 + l_linenumber AS seq, ['chL', 'chR', 'sgST', 'ggMPg', 'chC', 'sgM', 'ggAPg'][l_linenumber] AS tag, l_linenumber AS n, o_orderkey AS k,
  CASE l_linenumber WHEN 3 THEN 's' || o_orderkey % 3 WHEN 4 THEN CASE WHEN o_orderkey % 4 > 0 THEN 'g' END WHEN 7 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'g' END END AS id,
  o_orderkey % 7 > 1 AS again, CASE WHEN l_linenumber = 4 AND o_orderkey % 6 < 4 THEN 't' || o_orderkey % 2 END AS title FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN o ON o_orderkey = l_orderkey)"""


@query(f"""WITH {_LABELS}, k AS (SELECT *, CASE WHEN n IN (1, 2, 5) THEN 'ch' WHEN n IN (3, 6) THEN 'sg' ELSE 'gg' END AS kind, CASE WHEN id IS NULL THEN 'n' || seq ELSE CASE WHEN n IN (3, 6) THEN 'sg' ELSE 'gg' END || id END AS own FROM l),
f AS (SELECT *, first_value(seq) OVER w AS label, first_value(tag) OVER w AS tag1, first_value(title) OVER w AS title1, first_value(track) OVER w AS track1, row_number() OVER (PARTITION BY file, own, track ORDER BY seq) AS nth FROM k WINDOW w AS (PARTITION BY file, own ORDER BY seq)),
d AS (SELECT f.file, f.track, f.seq, (SELECT min(x.seq) FROM f x WHERE x.file = f.file AND x.track = f.track AND x.kind = 'sg' AND x.seq > f.seq) AS next_sg,
  (SELECT coalesce(max(x.seq), 0) FROM f x WHERE x.file = f.file AND x.track = f.track AND x.kind = 'sg' AND x.seq < f.seq) AS last_sg, (SELECT coalesce(max(x.seq), 0) FROM f x WHERE x.file = f.file AND x.track = f.track AND x.kind = 'ch' AND x.seq < f.seq) AS last_ch FROM f),
b AS (SELECT f.file, f.seq AS gg, f.label, x.seq FROM f JOIN d USING (file, seq) JOIN f x ON x.file = f.file AND x.track = f.track AND x.kind = 'sg' AND x.seq < f.seq AND x.seq > d.last_ch WHERE f.kind = 'gg'),
g AS (SELECT file, seq, list_sort(list(DISTINCT label)) AS groups FROM b GROUP BY ALL)
SELECT f.file, f.track, f.seq, f.kind, f.label, f.label = f.seq OR (f.again AND f.nth = 1 AND f.track1 <> f.track) AS stored, CASE WHEN f.kind = 'ch' THEN CASE f.n WHEN 5 THEN 1 ELSE f.n END END AS channel_id,
  CASE WHEN f.kind = 'ch' THEN y.label END AS "group", CASE WHEN f.kind = 'sg' THEN coalesce(list_aggregate(CASE WHEN f.label = f.seq THEN g.groups ELSE g1.groups END, 'string_agg', ','), '') END AS groups, f.title1 AS title,
  CASE WHEN f.tag1 <> f.tag THEN 'one id for different labels' WHEN f.label <> f.seq AND f.title IS NOT NULL AND f.title IS DISTINCT FROM f.title1 THEN 'other properties than the first of its id'
    WHEN f.kind = 'sg' AND f.label <> f.seq AND g.groups IS NOT NULL AND g.groups IS DISTINCT FROM g1.groups THEN 'other groups than the first of its id' WHEN f.kind = 'sg' AND d.last_ch <= d.last_sg THEN 'no channels in a soundfield group'
    WHEN f.kind = 'gg' AND NOT EXISTS (FROM b WHERE b.file = f.file AND b.gg = f.seq) THEN 'no soundfield group before it' END AS problem
FROM f JOIN d ON d.file = f.file AND d.seq = f.seq LEFT JOIN f y ON y.file = f.file AND y.seq = d.next_sg LEFT JOIN g ON g.file = f.file AND g.seq = f.seq LEFT JOIN g g1 ON g1.file = f.file AND g1.seq = f.label""")
def b23_inserted_labels(spark, sf_dir):
    """Labels of the orders of a customer, a track each: two soundfields with their channels, and groups that share ids from track to track."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("track"))
    n, k = F.col("l_linenumber"), F.col("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct().join(o, "o_orderkey")
    tag = F.get(F.array(*map(F.lit, ("chL", "chR", "sgST", "ggMPg", "chC", "sgM", "ggAPg"))), n - 1)
    id_ = F.when(n == 3, F.concat(F.lit("s"), k % 3)).when((n == 4) & (k % 4 > 0), "g").when((n == 7) & (k % 5 == 0), "g")
    props = F.when((n == 4) & (k % 6 < 4), F.create_map(F.lit("title"), F.concat(F.lit("t"), k % 2))).otherwise(F.create_map().cast("map<string,string>"))
    lines = li.select("file", "track", (k * 100 + n).alias("seq"), tag.alias("tag"), id_.alias("id"), (k % 7 > 1).alias("repeat"), F.when(n == 5, 0).otherwise(n - 1).alias("channel"), props.alias("props"))
    symbols = spark.createDataFrame([("chL", "ch", "Left"), ("chR", "ch", "Right"), ("chC", "ch", "Center"), ("sgST", "sg", "Standard Stereo"), ("sgM", "sg", "Monoaural"), ("ggMPg", "gg", "Main Program"), ("ggAPg", "gg", "Alternative Program")], "tag string, kind string, name string")
    out = L.insert_labels(lines, symbols, "file")
    return out.select("file", "track", "seq", "kind", "label", "stored", "channel_id", "group", F.array_join("groups", ",").alias("groups"), F.element_at("inherited", "title").alias("title"), "problem")
