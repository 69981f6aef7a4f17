"""Parsers of bytes, on files made up from rows of the driver's tables: each file is built, read again, and compared by SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import channels as C
from ..operators import pictures as Q
from ..sources import codecs, klv, mpeg2, wav
from .frame_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = bytes.fromhex("060e2b34010201010d01030115010500")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def each(df: DataFrame, make: Callable[[tuple], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``make`` gives for each row of ``df``, in batches of a bounded number of rows."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            rows = (out for at in range(0, batch.num_rows, 64) for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True) for out in make(row))
            while some := list(islice(rows, 1000)):
                yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return df.mapInArrow(run, fields)


@query("""SELECT doc_id, CAST(k * (octet_length(encode(text)) + 21) AS BIGINT) AS "offset", CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS md5, 352388352 AS track FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), (SELECT unnest([0, 1]) AS k)""")
def s22_klv(spark, sf_dir):
    def parse(row):
        data = klv.build(KEY, row[1].encode()) * 2
        for r in klv.parse(data):
            yield {"doc_id": row[0], "offset": r["offset"], "size": r["size"], "value": r["value"], "track": klv.track_number(bytes.fromhex(r["key"]))}

    out = each(table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit(""))), parse, "doc_id long, offset long, size long, value binary, track long")
    return out.select("doc_id", "offset", "size", F.md5("value").alias("md5"), "track")


@query("""SELECT vec_id, c AS channel, 32 AS samples, CAST(list_sum([CAST(round(CAST(embedding[i * 2 + c + 1] AS DOUBLE) * 1000) AS BIGINT) * (i + 1) FOR i IN range(32)]) AS BIGINT) AS checksum, 48000 AS rate FROM embeddings, (SELECT unnest([0, 1]) AS c)""")
def s16_wave(spark, sf_dir):
    def parse(row):
        data = wav.build(np.rint(np.array(row[1], dtype=np.float64) * 1000).astype(np.int64).reshape(-1, 2), 48000, 24)
        for r in wav.frames(data, (32,)):
            yield {"vec_id": row[0], "channel": r["channel"], "samples": len(r["samples"]), "checksum": sum((i + 1) * x for i, x in enumerate(r["samples"])), "rate": wav.info(data)["sampling_rate"]}

    return each(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), parse, "vec_id long, channel int, samples int, checksum long, rate int")


@query("SELECT doc_id, position, md5(array_slice(data, position * 64 + 1, position * 64 + 64)) AS md5 FROM (SELECT doc_id, encode(text) AS data, unnest(range(octet_length(encode(text)) // 64)) AS position FROM documents WHERE text IS NOT NULL)")
def s18_fixed_frames(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    out = each(docs, lambda row: ({"doc_id": row[0], "position": r["position"], "payload": r["payload"]} for r in klv.fixed_frames(row[1], 64)), "doc_id long, position long, payload binary")
    return out.select("doc_id", "position", F.md5("payload").alias("md5"))


@query("SELECT doc_id, md5(array_slice(data, 1, n // 3) || array_slice(data, n // 2 + 1, n)) AS md5, n // 3 + n - n // 2 AS bytes FROM (SELECT doc_id, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, ''))) AS n FROM documents)")
def s13_stream_ranges(spark, sf_dir):
    """The first third and the second half of each whole text, the later one listed first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    n = F.length("content").cast("long")
    half, third = F.floor(n / 2), F.floor(n / 3)
    part = lambda seq, offset, size: F.struct(F.lit(seq).alias("seq"), offset.alias("offset"), size.alias("size"))
    ranges = docs.select("doc_id", F.col("doc_id").alias("file"), F.explode(F.array(part(1, half, n - half), part(0, F.lit(0).cast("long"), third))).alias("p")).select("doc_id", "file", "p.*")
    out = Q.stream_bytes(ranges, "doc_id", docs.withColumnRenamed("doc_id", "id"), "id")
    return out.select("doc_id", F.md5("content").alias("md5"), F.length("content").cast("long").alias("bytes"))


@query("""SELECT event_id, c AS channel, printf('%02X%02X', v % 256, v // 256) || printf('%02X%02X', w % 256, w // 256) AS pcm
FROM (SELECT event_id, c, CASE WHEN c = 7 THEN 0 ELSE event_id * (c + 1) % 65536 END AS v, CASE WHEN c = 7 THEN 0 ELSE event_id * 3 * (c + 1) % 65536 END AS w FROM events, (SELECT unnest(range(8)) AS c))""")
def b1_aes3(spark, sf_dir):
    def build(row):
        words = [(row[0] * f * (c + 1) % 65536) << 12 | 0x5 for f in (1, 3) for c in range(8)]
        yield {"event_id": row[0], "payload": bytes([0, 2, 0, 0x7F]) + b"".join(x.to_bytes(4, "little") for x in words)}

    out = C.aes3_channels(each(table(spark, sf_dir, "events").select("event_id"), build, "event_id long, payload binary"), ["event_id"], 8, 16)
    return out.select("event_id", "channel", F.hex("pcm").alias("pcm"))


@query("SELECT event_id, ['I', 'P', 'B'][event_id % 3 + 1] AS type, event_id % 1024 AS temporal_reference, event_id * 7 % 65536 AS vbv_delay, event_id % 2 = 0 AS gop, event_id % 4 = 0 AS closed FROM events")
def b9_mpeg2(spark, sf_dir):
    def build(row):
        n = row[0]
        group = b"\0\0\1\xb8" + ((n % 4 == 0) << 6).to_bytes(4, "big") if n % 2 == 0 else b""
        head = n % 1024 << 22 | (n % 3 + 1) << 19 | (n * 7 % 65536) << 3
        yield {"event_id": n, **mpeg2.frame_info(group + b"\0\0\1\0" + head.to_bytes(4, "big") + b"\x80")}

    return each(table(spark, sf_dir, "events").select("event_id"), build, "event_id long, type string, temporal_reference int, vbv_delay int, gop boolean, closed boolean")


@query("SELECT event_id, event_id AS ue, (event_id + 1) // 2 * CASE WHEN event_id % 2 = 1 THEN 1 ELSE -1 END AS se FROM events")
def b8_exp_golomb(spark, sf_dir):
    def read(row):
        x = bin(row[0] + 1)[2:]
        code = "0" * (len(x) - 1) + x
        data = int(code + "1" + "0" * (-(len(code) + 1) % 8), 2).to_bytes((len(code) + 8) // 8, "big")
        yield {"event_id": row[0], "ue": codecs.Bits(data).ue(), "se": codecs.Bits(data).se()}

    return each(table(spark, sf_dir, "events").select("event_id"), read, "event_id long, ue long, se long")


@query("WITH p AS (SELECT event_id // 600 AS track, event_id % 600 AS position, event_id % 600 // 4 * 8 + [0, 6, 2, 4][event_id % 600 % 4 + 1] AS order_count FROM events) SELECT *, row_number() OVER (PARTITION BY track ORDER BY order_count) - 1 AS display FROM p")
def w19_order_count(spark, sf_dir):
    at = F.col("event_id") % 600
    p = table(spark, sf_dir, "events").select(
        (F.col("event_id") / 600).cast("int").alias("track"), at.alias("position"), (at == 0).alias("idr"), (at % 4 < 2).alias("reference"), F.lit(0).alias("frame_num"),
        ((F.floor(at / 4) * 8 + F.get(F.array(*map(F.lit, (0, 6, 2, 4))), (at % 4).cast("int"))) % 16).cast("int").alias("lsb"), F.lit(0).alias("delta"), F.lit(False).alias("reset"),
    )
    counted = Q.order_counts(p, "track", kind=0, lsb_bits=4)
    return Q.display_positions(p.join(counted, ["track", "position"]), "track").select("track", "position", "order_count", "display")


#: Coded pictures: every third stream frames, the others fields; refreshes, memory resets, and numbers that wrap at odd places.
_PICTURES = """p AS (SELECT event_id // 600 AS track, event_id % 600 AS position, event_id % 120 = 0 AS idr, event_id % 4 < 2 OR event_id % 120 = 0 AS reference, event_id // 600 % 3 > 0 AS field,
  event_id // 600 % 3 > 0 AND event_id % 2 = 1 AS bottom, CASE WHEN event_id % 120 = 0 THEN 0 ELSE (event_id * 5 + event_id // 7) % 16 END AS num, (event_id * 3 + event_id // 11) % 16 AS lsb,
  event_id % 3 - 1 AS d0, event_id % 5 - 2 AS d1, event_id % 37 = 4 AND event_id % 4 < 2 AS reset FROM events)"""


def coded_pictures(spark, sf_dir):
    e = F.col("event_id")
    fields, idr = (F.floor(e / 600) % 3) > 0, e % 120 == 0
    return table(spark, sf_dir, "events").select(
        F.floor(e / 600).alias("track"), (e % 600).alias("position"), idr.alias("idr"), ((e % 4 < 2) | idr).alias("reference"), fields.alias("field"), (fields & (e % 2 == 1)).alias("bottom"),
        F.when(idr, 0).otherwise((e * 5 + F.floor(e / 7)) % 16).cast("int").alias("frame_num"), ((e * 3 + F.floor(e / 11)) % 16).cast("int").alias("lsb"),
        (e % 3 - 1).cast("int").alias("delta0"), (e % 5 - 2).cast("int").alias("delta1"), ((e % 37 == 4) & (e % 4 < 2)).alias("reset"),
    )


def _counts(state: str, step: str, top: str, bottom: str) -> str:
    """SQL that goes from picture to picture: ``state`` are the first values of (a, b, c, d, e), ``step`` what a picture makes of them."""
    return f"""WITH RECURSIVE {_PICTURES},
r AS (SELECT DISTINCT track, -1::BIGINT AS position, {state}, NULL::BIGINT AS top, NULL::BIGINT AS bottom FROM p
  UNION ALL SELECT track, position, a, b, c, d, e, CASE WHEN field AND bottom_ THEN NULL ELSE {top} END, CASE WHEN field AND NOT bottom_ THEN NULL ELSE {bottom} END
  FROM (SELECT p.track, p.position, p.field, p.bottom AS bottom_, p.idr, p.reference, p.num, p.lsb, p.d0, p.d1, p.reset, {step} FROM r JOIN p ON p.track = r.track AND p.position = r.position + 1))
SELECT track, position, top, bottom, CASE WHEN top IS NULL THEN bottom WHEN bottom IS NULL THEN top ELSE least(top, bottom) END AS order_count FROM r WHERE position >= 0"""


_PREVIOUS = "CASE WHEN p.idr THEN 0 WHEN r.c = 1 THEN CASE WHEN r.d = 1 THEN 0 ELSE r.e END ELSE r.b END"
_MSB = f"(CASE WHEN p.idr OR r.c = 1 THEN 0 ELSE r.a END + CASE WHEN p.lsb < {_PREVIOUS} AND {_PREVIOUS} - p.lsb >= 8 THEN 16 WHEN p.lsb > {_PREVIOUS} AND p.lsb - {_PREVIOUS} > 8 THEN -16 ELSE 0 END)"
_KEPT = lambda new, old: f"CASE WHEN p.reference THEN {new} WHEN p.idr THEN 0 ELSE {old} END"
_OFFSET = "(CASE WHEN p.idr THEN 0 ELSE CASE WHEN r.c = 1 THEN 0 ELSE r.a END + CASE WHEN r.b > p.num THEN 16 ELSE 0 END END)"
_FIRST = "0::BIGINT AS a, 0::BIGINT AS b, 0 AS c, 0 AS d, 0::BIGINT AS e"


@query(_counts(_FIRST, f"{_KEPT(_MSB, 'r.a')} AS a, {_KEPT('p.lsb', 'r.b')} AS b, {_KEPT('p.reset::INT', 'r.c')} AS c, {_KEPT('p.bottom::INT', 'r.d')} AS d, {_KEPT(f'CASE WHEN p.bottom THEN 0 ELSE {_MSB} + p.lsb END', 'r.e')} AS e, {_MSB} AS msb",
               "msb + lsb", "msb + lsb + CASE WHEN field THEN 0 ELSE d0 END"))
def w19_counts_by_lsb(spark, sf_dir):
    return Q.field_order_counts(coded_pictures(spark, sf_dir), "track", 0, lsb_bits=4)


_NTH = "(a + num - CASE WHEN NOT reference AND a + num > 0 THEN 1 ELSE 0 END)"
_CYCLE = f"(CASE WHEN {_NTH} > 0 THEN ({_NTH} - 1) // 3 * 8 + [4, 10, 8][({_NTH} - 1) % 3 + 1] ELSE 0 END - CASE WHEN reference THEN 0 ELSE 3 END + d0)"
_BY_NUMBER = f"{_OFFSET} AS a, p.num AS b, p.reset::INT AS c, 0 AS d, 0::BIGINT AS e"


@query(_counts(_FIRST, _BY_NUMBER, _CYCLE, f"{_CYCLE} + 1 + CASE WHEN field THEN 0 ELSE d1 END"))
def w19_counts_by_cycle(spark, sf_dir):
    return Q.field_order_counts(coded_pictures(spark, sf_dir), "track", 1, frame_bits=4, offsets=(4, 6, -2), non_ref_offset=-3, top_to_bottom=1)


_TWICE = "CASE WHEN idr THEN 0 ELSE 2 * (a + num) - CASE WHEN reference THEN 0 ELSE 1 END END"


@query(_counts(_FIRST, _BY_NUMBER, _TWICE, _TWICE))
def w19_counts_by_number(spark, sf_dir):
    return Q.field_order_counts(coded_pictures(spark, sf_dir), "track", 2, frame_bits=4)


_UNITS = """u AS (SELECT event_id // 240 AS track, event_id % 240 AS position, CASE WHEN (event_id % 240 + event_id // 240 % 5 // 4 * 3) % 12 = 0 THEN 'I' WHEN event_id % 240 % (3 + event_id // 240 % 5 % 2 * (event_id % 240 // 120)) = 0 THEN 'P' ELSE 'B' END AS type,
  event_id // 240 % 5 IN (1, 2) AND (event_id // 240 % 5 = 1 OR event_id % 2 = 0) AS field, event_id // 240 % 5 = 3 AND event_id % 7 = 0 AS adaptive, event_id % 240 % (12 * (1 + event_id // 240 % 2)) = 0 AS idr,
  event_id % (1 + event_id // 240 % 3) = 0 AS sps, event_id % 240 = 0 AS pps FROM events),
v AS (SELECT *, CASE WHEN field THEN CASE type WHEN 'I' THEN 'P' ELSE type END END AS second_type FROM u)"""


@query(f"""WITH {_UNITS},
g AS (SELECT *, sum(CASE type WHEN 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY position) AS gop FROM v),
l AS (SELECT track, gop, string_agg(type || coalesce(second_type, ''), '' ORDER BY position) AS t, count(*) * (1 + CAST(max_by(second_type IS NOT NULL, position) AS INTEGER)) AS n FROM g GROUP BY ALL),
m AS (SELECT track, max(n) AS most, min_by(t, gop) FILTER (gop > 0) AS model FROM l GROUP BY track),
s AS (SELECT track, bool_and(starts_with(model, t)) AS same FROM l JOIN m USING (track) WHERE gop > 0 GROUP BY track),
b AS (SELECT track, [len(x) FOR x IN regexp_extract_all(string_agg(type || coalesce(second_type, ''), '' ORDER BY position), 'B+')] AS runs, max_by(coalesce(second_type, type), position) = 'B' AS open FROM v GROUP BY track),
a AS (SELECT track, CASE WHEN bool_and(field) THEN 'field' WHEN NOT bool_or(field) THEN 'frame' ELSE 'frame or field' END AS picture_type,
  CASE WHEN bool_and(field AND second_type IS NOT NULL) THEN 'field' WHEN bool_or(field) THEN 'frame and field' WHEN bool_or(adaptive) THEN 'adaptive' ELSE 'frame' END AS coding_type,
  bool_and(type <> 'I' OR idr) AS closed_gops, min_by(type = 'I', position) AS starts_with_i,
  CASE WHEN bool_and(sps) THEN 'every' WHEN min_by(sps, position) AND count(*) FILTER (sps) = 1 THEN 'first' WHEN min_by(sps AND type = 'I', position) AND bool_and(type <> 'I' OR sps) THEN 'gop' ELSE 'some' END AS sps,
  CASE WHEN bool_and(pps) THEN 'every' WHEN min_by(pps, position) AND count(*) FILTER (pps) = 1 THEN 'first' WHEN min_by(pps AND type = 'I', position) AND bool_and(type <> 'I' OR pps) THEN 'gop' ELSE 'some' END AS pps FROM v GROUP BY track)
SELECT track, picture_type, coding_type, most AS max_gop, same IS NULL OR (starts_with_i AND same) AS identical_gops, closed_gops, CAST(coalesce(list_max(runs), 0) AS BIGINT) AS max_b_run,
coalesce(list_bool_and([runs[i] = list_max(runs[1:i]) FOR i IN range(1, len(runs) + 1 - CAST(open AS INTEGER))]), true) AS constant_b, starts_with_i, sps, pps FROM a JOIN m USING (track) LEFT JOIN s USING (track) JOIN b USING (track)""")
def w22_coding_summary(spark, sf_dir):
    e = F.col("event_id")
    track, at = F.floor(e / 240), e % 240
    kind = track % 5
    is_i = (at + F.floor(kind / 4) * 3) % 12 == 0
    type_ = F.when(is_i, "I").when(at % (3 + kind % 2 * F.floor(at / 120)) == 0, "P").otherwise("B")
    fields = kind.isin(1, 2) & ((kind == 1) | (e % 2 == 0))
    u = table(spark, sf_dir, "events").select(
        track.alias("track"), at.alias("position"), type_.alias("type"), fields.alias("field"), ((kind == 3) & (e % 7 == 0)).alias("adaptive"),
        (at % (12 * (1 + track % 2)) == 0).alias("idr"), (e % (1 + track % 3) == 0).alias("sps"), (at == 0).alias("pps"),
    )
    return Q.coding_summary(u.withColumn("second_type", F.when(F.col("field"), F.when(F.col("type") == "I", "P").otherwise(F.col("type")))), "track")


@query("SELECT l_orderkey AS track, 'f' || l_orderkey % 50 AS locator, CASE WHEN l_orderkey % 50 < 20 THEN '/m/f' || l_orderkey % 50 END AS resolved FROM lineitem")
def s12_external_files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("locator"))
    return Q.external_files(li, spark.range(20).select(F.concat(F.lit("/m/f"), F.col("id")).alias("path")))
