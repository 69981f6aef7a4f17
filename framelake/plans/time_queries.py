"""Time and timecode functions over ``events``: positions, rates and codes are stand-ins derived from event_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rational as R
from ..functions import timecode as T

CADENCE = (1602, 1601, 1602, 1601, 1602)
#: Rates by event_id modulo 7.
RATES = ((24, 1), (25, 1), (30000, 1001), (50, 1), (60000, 1001), (24000, 1001), (30, 1))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")


def ID() -> Column:
    return F.col("event_id")


def _pick(values, of: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.pmod(of, F.lit(len(values))).cast("int"))


def _seq() -> Column:
    return F.array(*(F.lit(x) for x in CADENCE))


def _rate(part: int, shift: int = 0) -> Column:
    return _pick([r[part] for r in RATES], F.col("event_id") + shift)


def _sql_rate(part: int, shift: int = 0) -> str:
    return f"CAST([{', '.join(str(r[part]) for r in RATES)}][(event_id + {shift}) % 7 + 1] AS BIGINT)"


def _fdiv(a: str, b: str) -> str:
    return f"((({a}) - (((({a}) % ({b})) + ({b})) % ({b}))) // ({b}))"


def _mod(a: str, b: str) -> str:
    return f"(((({a}) % ({b})) + ({b})) % ({b}))"


def t1_convert_position(spark, sf_dir):
    p = ID() * 37 - 50000
    top, bottom = _pick((48000 * 1001, 30000, 1), ID()), _pick((30000, 48000 * 1001, 3), ID())
    return events(spark, sf_dir).select("event_id", *(R.convert_position(p, top, bottom, r).alias(r) for r in ("auto", "up", "down", "nearest")))


_P = "(event_id * 37 - 50000)"
_TOP, _BOTTOM = "CAST([48048000, 30000, 1][event_id % 3 + 1] AS BIGINT)", "CAST([30000, 48048000, 3][event_id % 3 + 1] AS BIGINT)"
_UP, _DOWN = f"(-{_fdiv(f'-p * {_TOP}', _BOTTOM)})", _fdiv(f"p * {_TOP}", _BOTTOM)
T1 = f"""SELECT event_id, CASE WHEN {_TOP} < {_BOTTOM} THEN {_UP} ELSE {_DOWN} END AS "auto", {_UP} AS up, {_DOWN} AS down,
CASE WHEN p > 0 THEN {_fdiv(f"p * {_TOP} + {_BOTTOM} // 2", _BOTTOM)} ELSE {_DOWN} END AS nearest
FROM (SELECT event_id, {_P} AS p FROM events)"""


def t2_convert_duration(spark, sf_dir):
    d = ID() * 37 - 50000
    top, bottom = _pick((48000 * 1001, 30000, 1), ID()), _pick((30000, 48000 * 1001, 3), ID())
    return events(spark, sf_dir).select("event_id", R.convert_duration(d, top, bottom).alias("auto"), R.convert_duration(d, top, bottom, "up").alias("up"))


T2 = f"""SELECT event_id, CASE WHEN p <= 0 THEN 0 WHEN {_TOP} < {_BOTTOM} THEN {_DOWN} ELSE {_UP} END AS "auto", CASE WHEN p <= 0 THEN 0 ELSE {_UP} END AS up
FROM (SELECT event_id, {_P} AS p FROM events)"""


def t3_sample_sequence(spark, sf_dir):
    a, b = _rate(0), _rate(1)
    to = _pick((48000, 44100, 96000), ID())
    return events(spark, sf_dir).select("event_id", F.array_join(R.sample_sequence(a, b, to, F.lit(1).cast("long")).cast("array<string>"), ",").alias("samples"))


T3 = f"""SELECT event_id, CASE WHEN r % q = 0 THEN CAST(r // q AS VARCHAR) WHEN n = 30000 AND t = 48000 THEN '1602,1601,1602,1601,1602'
WHEN n = 60000 AND t = 48000 THEN '801,801,800,801,801' END AS samples
FROM (SELECT event_id, {_sql_rate(0)} AS n, [48000, 44100, 96000][event_id % 3 + 1] AS t, [48000, 44100, 96000][event_id % 3 + 1] * {_sql_rate(1)} AS r, {_sql_rate(0)} AS q FROM events)"""

#: SQL: a frame of the cycle as (first sample, end), and those frames over enough cycles to search in.
_CYCLE = "(SELECT k, 8008 * (k // 5 - 60) + [0, 1602, 3203, 4805, 6406][k % 5 + 1] AS pos FROM (SELECT unnest(range(600)) AS k))"


def t4_rotate(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.array_join(R.rotate(_seq(), ID() - 500).cast("array<string>"), ",").alias("cycle"), R.total(R.rotate(_seq(), ID())).alias("samples"))


T4 = f"""SELECT event_id, array_to_string([[1602, 1601, 1602, 1601, 1602][(o + k) % 5 + 1] FOR k IN range(5)], ',') AS cycle, CAST(8008 AS BIGINT) AS samples
FROM (SELECT event_id, {_mod("event_id - 500", "5")} AS o FROM events)"""


def t5_cadence_position(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", R.higher(F.pmod(ID(), F.lit(900)) - 200, _seq()).alias("higher"), R.lower(F.pmod(ID() * 101, F.lit(300000)) - 100000, _seq()).alias("lower"))


T5 = f"""WITH c AS {_CYCLE}, e AS (SELECT event_id, event_id % 900 - 200 AS p, event_id * 101 % 300000 - 100000 AS q FROM events)
SELECT event_id, 8008 * {_fdiv("p", "5")} + [0, 1602, 3203, 4805, 6406][{_mod("p", "5")} + 1] AS higher, (SELECT min(k) - 300 FROM c WHERE pos >= q) AS lower FROM e"""


def t6_cadence_duration(spark, sf_dir):
    d, p = F.pmod(ID() * 101, F.lit(90000)) - 5000, F.pmod(ID() * 7, F.lit(40000))
    return events(spark, sf_dir).select("event_id", R.duration_lower(d, _seq(), p).alias("lower"), R.duration_higher(F.pmod(ID(), F.lit(50)) - 5, _seq(), F.pmod(ID(), F.lit(13))).alias("higher"))


T6 = f"""WITH c AS {_CYCLE}, e AS (SELECT event_id, event_id * 101 % 90000 - 5000 AS d, event_id * 7 % 40000 AS p, event_id % 50 - 5 AS n, event_id % 13 AS q FROM events)
SELECT event_id, CASE WHEN d <= 0 THEN 0 ELSE (SELECT greatest(0, max(k) FILTER (pos <= p + d) - min(k) FILTER (pos >= p)) FROM c) END AS lower,
CASE WHEN n <= 0 THEN 0 ELSE (SELECT max(pos) FILTER (k = 300 + q + n) - max(pos) FILTER (k = 300 + q) FROM c) END AS higher FROM e"""

_DROPS = ((24, False), (25, False), (30, False), (30, True), (50, False), (60, False), (60, True))
_BASE = lambda: _pick([b for b, _ in _DROPS], ID())
_DROP = lambda: _pick([int(d) for _, d in _DROPS], ID()) == 1
_SQL_BASE = "CAST([24, 25, 30, 30, 50, 60, 60][event_id % 7 + 1] AS BIGINT)"
_SQL_D = "CAST([0, 0, 0, 2, 0, 0, 4][event_id % 7 + 1] AS BIGINT)"


def _sql_fields(rows: str, keep: str = "event_id") -> str:
    """h, m, s, f of column o with base b and d dropped codes, from minute and frame within it."""
    return f"""SELECT {keep}, b, d, n // 60 % 24 AS h, n % 60 AS m, x // b AS s, x % b AS f FROM (
SELECT *, t * 10 + CASE WHEN r < 60 * b THEN 0 ELSE 1 + (r - 60 * b) // (60 * b - d) END AS n,
CASE WHEN r < 60 * b THEN r ELSE d + (r - 60 * b) % (60 * b - d) END AS x FROM (
SELECT *, w // (600 * b - 9 * d) AS t, w % (600 * b - 9 * d) AS r FROM (SELECT *, {_mod("o", "144 * (600 * b - 9 * d)")} AS w FROM ({rows}))))"""


_TEXT = "printf('%02d:%02d:%02d%s%02d', h, m, s, CASE WHEN d > 0 THEN ';' ELSE ':' END, f)"


def t7_timecode(spark, sf_dir):
    code = T.fields(ID() * 9973 - 1000000, _BASE(), _DROP())
    return events(spark, sf_dir).select("event_id", code.alias("c"), T.text(code, _DROP()).alias("code")).select("event_id", "c.h", "c.m", "c.s", "c.f", "code")


T7 = f"SELECT event_id, h, m, s, f, {_TEXT} AS code FROM ({_sql_fields(f'SELECT event_id, event_id * 9973 - 1000000 AS o, {_SQL_BASE} AS b, {_SQL_D} AS d FROM events')})"


def t8_offset(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", T.offset(F.pmod(ID(), F.lit(26)), F.pmod(ID() * 7, F.lit(60)), F.pmod(ID(), F.lit(3)), F.pmod(ID() * 5, F.lit(24)), _BASE(), _DROP()).alias("offset"))


T8 = f"""SELECT event_id, (h * 3600 + m * 60 + s) * b + CASE WHEN s = 0 AND m % 10 > 0 AND f < d THEN d ELSE f END - d * (h * 54 + m - m // 10) AS "offset"
FROM (SELECT event_id, event_id % 26 % 24 AS h, event_id * 7 % 60 AS m, event_id % 3 AS s, event_id * 5 % 24 AS f, {_SQL_BASE} AS b, {_SQL_D} AS d FROM events)"""


def t9_add(spark, sf_dir):
    o = F.pmod(ID() * 9973, F.lit(2000000))
    return events(spark, sf_dir).select(
        "event_id",
        T.add(o, ID() - 3000, _BASE(), _DROP()).alias("moved"),
        T.add_at_rate(o, ID() * 13, 50, 1, _BASE(), _DROP()).alias("at_rate"),
        T.add_duration(o, 1, F.pmod(ID(), F.lit(60)), F.pmod(ID() * 3, F.lit(60)), F.pmod(ID(), F.lit(24)), _BASE(), _DROP(), F.lit(False)).alias("later"),
    )


_DAY = "144 * (600 * b - 9 * d)"
T9 = f"""SELECT event_id, {_mod("o + event_id - 3000", _DAY)} AS moved,
{_mod(f"o + CASE WHEN event_id = 0 OR b = 50 THEN event_id * 13 WHEN b < 50 THEN -{_fdiv('-event_id * 13 * b', '50')} ELSE {_fdiv('event_id * 13 * b', '50')} END", _DAY)} AS at_rate,
{_mod(f"{_mod('o', '86400 * b')} + b * (3600 + event_id % 60 * 60 + event_id * 3 % 60) + event_id % 24", "86400 * b")} % ({_DAY}) AS later
FROM (SELECT event_id, event_id * 9973 % 2000000 AS o, {_SQL_BASE} AS b, {_SQL_D} AS d FROM events)"""


def t10_compare(spark, sf_dir):
    a, b, n = _pick((0, 24, 25, 50), ID()), _pick((25, 0, 50, 24, 60), ID()), F.pmod(ID() * 31, F.lit(1000))
    return events(spark, sf_dir).select("event_id", T.before(n, a, F.pmod(ID() * 17, F.lit(2000)), b).alias("before"), T.same(n, a, F.pmod(ID() * 17, F.lit(2000)), b).alias("same"))


_MOVED = f"CASE WHEN a = b OR y = 0 THEN y WHEN a < b THEN -{_fdiv('-y * a', 'b')} ELSE {_fdiv('y * a', 'b')} END"
T10 = f"""SELECT event_id, CASE WHEN a = 0 THEN false WHEN b = 0 THEN true ELSE x < {_MOVED} END AS "before",
CASE WHEN a = 0 OR b = 0 THEN a = 0 AND b = 0 ELSE x = {_MOVED} END AS same
FROM (SELECT event_id, [0, 24, 25, 50][event_id % 4 + 1] AS a, [25, 0, 50, 24, 60][event_id % 5 + 1] AS b, event_id * 31 % 1000 AS x, event_id * 17 % 2000 AS y FROM events)"""


def t13_texts(spark, sf_dir):
    c, n, d = ID() * 1009 - 2000, _rate(0), _rate(1)
    return events(spark, sf_dir).select("event_id", R.rounded_base(n, d).alias("base"), T.duration_text(c, n, d).alias("frames"), T.generic_duration_text(c, n, d).alias("generic"), T.rate_duration_text(c, n, d).alias("at_rate"), T.may_drop(n, d).alias("may_drop"))


T13 = f"""SELECT event_id, b AS base,
CASE WHEN c < 0 THEN '00:00:00:00' ELSE printf('%02d:%02d:%02d:%02d', c // b // 3600, c // b // 60 % 60, c // b % 60, c % b) END AS frames,
CASE WHEN c <= 0 THEN '00:00:00.00' ELSE printf('%02d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 10) END AS generic,
CASE WHEN c < 0 THEN '00:00:00:00' ELSE printf('%02d:%02d:%02d:%02d @%dHz', c // b // 3600, c // b // 60 % 60, c // b % 60, c % b, b) END AS at_rate,
d = 1001 AND n IN (30000, 60000) AS may_drop
FROM (SELECT *, (n + d // 2) // d AS b, c * 1000 * d // n AS ms FROM (SELECT event_id, event_id * 1009 - 2000 AS c, {_sql_rate(0)} AS n, {_sql_rate(1)} AS d FROM events))"""


def t14_normalize(spark, sf_dir):
    n = F.when(ID() % 4 == 0, 2997 * (ID() % 5 + 1)).when(ID() % 4 == 1, ID() % 97 - 20).otherwise(ID() % 1000)
    d = F.when(ID() % 4 == 0, _pick((1000, 500), ID()) * (ID() % 5 + 1)).otherwise(ID() % 48)
    return events(spark, sf_dir).select("event_id", R.normalize_rate(n, d).alias("r")).select("event_id", F.col("r.num").alias("num"), F.col("r.den").alias("den"))


T14 = """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2997 * (event_id % 5 + 1) WHEN 1 THEN event_id % 97 - 20 ELSE event_id % 1000 END AS n,
CASE WHEN event_id % 4 = 0 THEN [1000, 500][event_id % 2 + 1] * (event_id % 5 + 1) ELSE event_id % 48 END AS d FROM events),
r AS (SELECT event_id, n, d, CASE WHEN n = 0 OR d = 0 THEN 0 ELSE n // gcd(n, d) END AS a, CASE WHEN n = 0 OR d = 0 THEN 1 ELSE d // gcd(n, d) END AS b FROM e)
SELECT event_id, CASE WHEN a < 0 THEN n WHEN a = 2997 AND b = 1000 THEN 30000 WHEN a = 2997 AND b = 500 THEN 60000 ELSE a END AS num,
CASE WHEN a < 0 THEN d WHEN a = 2997 AND b IN (1000, 500) THEN 1001 ELSE b END AS den FROM r"""


def t15_smpte12m(spark, sf_dir):
    base = _pick((25, 30, 50, 60), ID())
    code = T.fields(ID() * 9973, base)
    bytes_ = events(spark, sf_dir).select("event_id", base.alias("base"), T.encode_smpte12m(code, base, ID() % 2 == 0, F.lit(True)).alias("hex"))
    return bytes_.select("event_id", "hex", T.decode_smpte12m(F.unhex("hex"), F.col("base"), F.lit(1).cast("long")).alias("c")).select("event_id", "hex", "c.h", "c.m", "c.s", "c.f", F.col("c.drop").alias("dropping"), "c.field_mark")


T15 = f"""SELECT event_id, printf('%02X%02X%02X%02X00000000', g // 10 * 16 + g % 10 + CASE WHEN event_id % 2 = 0 THEN 64 ELSE 0 END,
s // 10 * 16 + s % 10 + CASE WHEN mark AND b = 60 THEN 128 ELSE 0 END, m // 10 * 16 + m % 10, h // 10 * 16 + h % 10 + CASE WHEN mark AND b = 50 THEN 128 ELSE 0 END) AS hex,
h, m, s, CASE WHEN b > 30 THEN g * 2 ELSE g END AS f, event_id % 2 = 0 AS dropping, mark AS field_mark
FROM (SELECT *, CASE WHEN b > 30 THEN f // 2 ELSE f END AS g, b > 30 AND f % 2 = 1 AS mark FROM ({_sql_fields("SELECT event_id, event_id * 9973 AS o, CAST([25, 30, 50, 60][event_id % 4 + 1] AS BIGINT) AS b, CAST(0 AS BIGINT) AS d FROM events")}))"""


def t16_rate_code(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", R.package_rate_code(_rate(0), _rate(1)).alias("code"), R.fill_size(ID() * 13, 512).alias("fill"))


T16 = """SELECT event_id, [2, 4, 7, 10, 13, 3, 6][event_id % 7 + 1] AS code,
CASE WHEN n % 512 = 0 THEN 0 WHEN 512 - n % 512 < 20 THEN 1024 - n % 512 ELSE 512 - n % 512 END AS fill FROM (SELECT event_id, event_id * 13 AS n FROM events)"""


def t18_parse(spark, sf_dir):
    code = F.format_string("%02d:%02d:%02d%s%02d", ID() % 24, ID() % 60, ID() % 7, F.when(ID() % 2 == 0, ";").otherwise(":"), ID() % 30)
    text = F.when(ID() % 11 == 0, F.lit("1:2")).otherwise(code)
    rate = F.when(ID() % 3 == 0, F.lit("2997")).when(ID() % 3 == 1, F.concat(ID().cast("string"), F.lit("/7"))).otherwise(F.lit("x"))
    return events(spark, sf_dir).select("event_id", T.parse(text, F.lit(30000).cast("long"), F.lit(1001).cast("long")).alias("c"), R.parse_rate(rate).alias("r")).select("event_id", F.col("c.offset").alias("offset"), F.col("c.drop").alias("dropping"), F.col("r.num").alias("num"), F.col("r.den").alias("den"))


T18 = """SELECT event_id, CASE WHEN event_id % 11 > 0 THEN (h * 3600 + m * 60 + s) * 30 + CASE WHEN s = 0 AND m % 10 > 0 AND f < d THEN d ELSE f END - d * (h * 54 + m - m // 10) END AS "offset",
CASE WHEN event_id % 11 > 0 THEN d > 0 END AS dropping, CASE event_id % 3 WHEN 0 THEN 30000 WHEN 1 THEN event_id END AS num, CASE event_id % 3 WHEN 0 THEN 1001 WHEN 1 THEN 7 END AS den
FROM (SELECT event_id, event_id % 24 AS h, event_id % 60 AS m, event_id % 7 AS s, event_id % 30 AS f, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS d FROM events)"""


def t19_whole_day(spark, sf_dir):
    day = T.whole_day(spark, 30, True)
    return day.groupBy(F.substring("code", 1, 5).alias("minute")).agg(F.count("*").alias("codes"), F.min("code").alias("first"), F.max("code").alias("last"), F.min("offset").alias("offset"))


T19 = """SELECT printf('%02d:%02d', h, m) AS minute, 1800 - d AS codes, printf('%02d:%02d:00;%02d', h, m, d) AS "first", printf('%02d:%02d:59;29', h, m) AS "last",
(h * 60 + m) * 1800 + d - 2 * (h * 54 + m - m // 10) AS "offset" FROM (SELECT h, m, CASE WHEN m % 10 > 0 THEN 2 ELSE 0 END AS d FROM (SELECT unnest(range(24)) AS h), (SELECT unnest(range(60)) AS m))"""


def t20_start(spark, sf_dir):
    pick = lambda k: F.when(ID() % k == 0, ID() * k)
    playout, source = T.start_timecodes(pick(2), pick(3), pick(5))
    return events(spark, sf_dir).select("event_id", playout.alias("playout"), source.alias("source"))


T20 = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 2 WHEN event_id % 3 = 0 THEN event_id * 3 WHEN event_id % 5 = 0 THEN event_id * 5 ELSE 0 END AS playout,
CASE WHEN event_id % 3 = 0 THEN event_id * 3 WHEN event_id % 5 = 0 THEN event_id * 5 ELSE 0 END AS source FROM events"""

QUERIES = {f.__name__: f for f in (t1_convert_position, t2_convert_duration, t3_sample_sequence, t4_rotate, t5_cadence_position, t6_cadence_duration, t7_timecode, t8_offset, t9_add, t10_compare, t13_texts, t14_normalize, t15_smpte12m, t16_rate_code, t18_parse, t19_whole_day, t20_start)}
ORACLES = dict(zip(QUERIES, (T1, T2, T3, T4, T5, T6, T7, T8, T9, T10, T13, T14, T15, T16, T18, T19, T20), strict=True))
