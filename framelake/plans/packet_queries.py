"""Packets, channels, checksums, events, labels and tracks, over stand-ins derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as B
from ..operators import audio_metadata as A
from ..operators import channels as C
from ..operators import events as V
from ..operators import integrity as G
from ..operators import labels as L
from ..operators import packets as P
from ..operators import reports as R
from ..operators import tracks as K
from .frame_queries import _FRAMES, frames, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: CRC-32 in SQL, byte by byte over the table for one byte.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""


def crc_hex(data: str) -> str:
    """Eight hexadecimal digits of the CRC-32 of ``data``, a list of BIGINTs from 0 to 255."""
    return f"printf('%08x', xor(list_reduce({data}, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295))"




def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark, sf_dir):
    """Packets of the classes that filters know, and others, by event."""
    did = F.get(F.array(*map(F.lit, (0x45, 0x41, 0x43, 0x60, 0x61, 0x62, 0x50))), (F.col("event_id") % 7).cast("int"))
    sdid = F.get(F.array(*map(F.lit, (1, 2, 5, 6, 0x60))), (F.col("event_id") % 5).cast("int"))
    coding = F.when(F.col("user_id") % 3 == 0, 7).otherwise(4)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.floor(F.col("event_id") / 10)).alias("position"), (F.col("event_id") % 10).alias("line_idx"), did.alias("did"), sdid.alias("sdid"), coding.alias("coding"), "event_id")


_LINES = """l AS (SELECT user_id AS track, event_id // 10 AS position, event_id % 10 AS line_idx, [69, 65, 67, 96, 97, 98, 80][event_id % 7 + 1] AS did, [1, 2, 5, 6, 96][event_id % 5 + 1] AS sdid,
CASE WHEN user_id % 3 = 0 THEN 7 ELSE 4 END AS coding, event_id FROM events)"""
_CLASS = {"st2020": "did = 69", "st2016": "(did = 65 AND sdid IN (5, 6))", "sdp": "(did = 67 AND sdid = 2)", "st12": "(did = 96 AND sdid = 96)", "st334": "(did = 97 AND sdid IN (1, 2) OR did = 98 AND sdid = 2)"}


@query(f"WITH {_LINES} SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _CLASS.items()) + f", ({_CLASS['st2016']} OR {_CLASS['st334']}) AS passed, NOT {_CLASS['st2020']} AS stripped, ({_CLASS['st334']} AND NOT {_CLASS['st12']}) AS both, false AS neither FROM l")
def f5_classes(spark, sf_dir):
    did, sdid = F.col("did"), F.col("sdid")
    return lines(spark, sf_dir).select(
        "event_id", *(P.in_class(n, did, sdid).alias(n) for n in P.CLASSES),
        P.keeps(P.parse_filter("st2016, st334"), (), did, sdid).alias("passed"), P.keeps((), ("st2020",), did, sdid).alias("stripped"),
        P.keeps(("st334",), ("st12",), did, sdid).alias("both"), P.keeps((), (), did, sdid).alias("neither"),
    )


def elements(spark, sf_dir):
    one = F.struct("line_idx", "did", "sdid")
    return lines(spark, sf_dir).groupBy("position").agg(F.sort_array(F.collect_list(one)).alias("lines"))


@query(f"WITH {_LINES} SELECT position, coalesce(string_agg(did || '/' || sdid, ' ' ORDER BY line_idx) FILTER (did <> 69 AND NOT {_CLASS['st334']}), '') AS kept, count(*) AS untouched FROM l GROUP BY position")
def f8_filter_lines(spark, sf_dir):
    e = elements(spark, sf_dir).withColumn("untouched", F.size(F.col("lines")).cast("long"))
    kept = P.filter_lines(e, ("all",), ("st2020", "st334"))
    return kept.select("position", F.array_join(F.transform("lines", lambda x: F.concat_ws("/", x["did"], x["sdid"])), " ").alias("kept"), "untouched")


@query(f"WITH {_LINES} SELECT position FROM l GROUP BY position HAVING bool_or({_CLASS['sdp']})")
def f7_filter_tracks(spark, sf_dir):
    return P.filter_tracks(elements(spark, sf_dir).withColumnRenamed("lines", "manifest"), ("sdp",), ()).select("position")


@query(f"""WITH {_LINES}, s AS (SELECT track, did, sdid, min(position * 10 + line_idx) AS seen FROM l GROUP BY ALL)
SELECT track, did, sdid, row_number() OVER (PARTITION BY track ORDER BY seen) - 1 AS element FROM s""")
def a8_manifest(spark, sf_dir):
    return P.manifest(lines(spark, sf_dir), ["track"], ["did", "sdid"])


@query(f"WITH {_LINES} SELECT track, 2 + count(DISTINCT sdid) * 2 * (14 + CASE WHEN bool_or(coding = 7) THEN 348 ELSE 260 END) AS max_size FROM l GROUP BY track")
def a9_max_size(spark, sf_dir):
    return P.max_element_size(lines(spark, sf_dir), ["track"])


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN a ELSE (a * 4 + b // 64) % 256 END AS did,
CASE WHEN event_id % 2 = 0 THEN CASE WHEN a = 0 THEN 0 ELSE b END WHEN (a * 4 + b // 64) % 256 = 0 THEN 0 ELSE (b * 16 + c // 16) % 256 END AS sdid
FROM (SELECT event_id, event_id % 256 AS a, event_id * 7 % 256 AS b, event_id * 11 % 256 AS c FROM events)""")
def b4_packet_ids(spark, sf_dir):
    digits = F.concat(*(F.lpad(F.hex(F.col("event_id") * k % 256), 2, "0") for k in (1, 7, 11)))
    e = table(spark, sf_dir, "events").select("event_id", F.unhex(digits).alias("payload"), F.when(F.col("event_id") % 2 == 0, 4).otherwise(7).alias("coding"))
    return e.select("event_id", P.packet_ids(F.col("payload"), F.col("coding")).alias("i")).select("event_id", "i.did", "i.sdid")


@query("SELECT doc_id, 0 AS line_idx, 9 AS line_number, CAST(doc_id % 4 AS INTEGER) AS coding, octet_length(encode(text)) + (4 - octet_length(encode(text)) % 4) % 4 AS bytes, text || repeat(chr(0), CAST((4 - octet_length(encode(text)) % 4) % 4 AS INTEGER)) AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def b3_element_round_trip(spark, sf_dir):
    """Texts as payloads of one line each, built and parsed again."""
    import pyarrow as pa

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def build(batches):
        for batch in batches:
            made = [P.build_element([(9, 1, i % 4, 8, t.encode())]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "payload"])

    out = P.explode_elements(docs.mapInArrow(build, "doc_id long, payload binary"), ["doc_id"])
    return out.select("doc_id", "line_idx", "line_number", "coding", F.length("payload").cast("long").alias("bytes"), F.decode("payload", "UTF-8").alias("text"))


# --- channels --------------------------------------------------------------------------------------------------------


def audio_tracks(spark, sf_dir):
    return frames(spark, sf_dir).select(F.col("track").alias("clip"), F.col("position").cast("int").alias("track"), (F.col("size") % 3 > 0).alias("is_pcm"), (F.col("size") % 4 + 1).cast("int").alias("channels"), F.when(F.col("size") % 5 == 0, 16).otherwise(24).alias("bits"))


_AUDIO = f"""{_FRAMES}, t AS (SELECT track AS clip, CAST(position AS INTEGER) AS track, size % 3 > 0 AS is_pcm, CAST(size % 4 + 1 AS INTEGER) AS channels, CASE WHEN size % 5 = 0 THEN 16 ELSE 24 END AS bits FROM f),
p AS (SELECT clip, track, channel, row_number() OVER (PARTITION BY clip ORDER BY track, channel) - 1 AS input FROM (SELECT clip, track, unnest(range(channels)) AS channel FROM t WHERE is_pcm)),
o AS (SELECT clip, track FROM t WHERE NOT is_pcm)"""


@query(f"WITH {_AUDIO} SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY track, channel) - 1 AS out_track, 0 AS out_channel, track, channel FROM (SELECT clip, track, channel FROM p UNION ALL SELECT clip, track, 0 FROM o)")
def m1_mono(spark, sf_dir):
    return C.mono_map(audio_tracks(spark, sf_dir), "clip")


@query(f"""WITH {_AUDIO}, q AS (SELECT clip, input // 2 AS pair, track, channel FROM p WHERE input % 2 = 0 UNION ALL SELECT clip, NULL, track, 0 FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY track, channel) - 1 AS out_track FROM q), e AS (SELECT clip, max(input) + 1 AS input FROM p GROUP BY clip HAVING max(input) % 2 = 0)
SELECT s.clip, out_track, s.input % 2 AS out_channel, s.track, s.channel FROM (SELECT clip, input, track, channel FROM p UNION ALL SELECT clip, input, NULL, NULL FROM e) s JOIN r ON r.clip = s.clip AND r.pair = s.input // 2
UNION ALL SELECT clip, out_track, 0, track, 0 FROM r WHERE pair IS NULL""")
def m2_stereo(spark, sf_dir):
    return C.stereo_map(audio_tracks(spark, sf_dir), "clip")


@query(f"""WITH {_AUDIO}, q AS (SELECT clip, min(track) AS track, true AS pcm FROM p GROUP BY clip UNION ALL SELECT clip, track, false FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY track) - 1 AS out_track FROM q)
SELECT p.clip, out_track, input AS out_channel, p.track, channel FROM p JOIN r ON r.clip = p.clip AND r.pcm UNION ALL SELECT clip, out_track, 0, track, 0 FROM r WHERE NOT pcm""")
def m3_single(spark, sf_dir):
    return C.single_map(audio_tracks(spark, sf_dir), "clip")


@query("""WITH o AS (SELECT o_orderkey AS clip, o_orderkey % 4 AS a, 5 + o_orderkey % 3 AS m, 8 + o_orderkey % 5 AS inputs FROM orders),
g AS (SELECT clip, 0 AS out_track, k AS out_channel, a + k AS input FROM o, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT clip, 1, 0, m FROM o UNION ALL SELECT clip, t, 0, NULL FROM o, (SELECT unnest([2, 3]) AS t)
      UNION ALL SELECT clip, 4, row_number() OVER (PARTITION BY clip ORDER BY i) - 1, i FROM o, (SELECT unnest(range(12)) AS i) WHERE i < inputs AND i NOT IN (a, a + 1, m))
SELECT clip, CAST(out_track AS INTEGER) AS out_track, CAST(out_channel AS INTEGER) AS out_channel, CAST(input AS INTEGER) AS input FROM g""")
def m4_definition(spark, sf_dir):
    """Definitions that stand in a column, one for each order: a range, a mono group with silence, and the inputs left."""
    k = F.col("o_orderkey")
    text = F.concat(k % 4, F.lit("-"), k % 4 + 1, F.lit("; m"), k % 3 + 5, F.lit(",s2; x"))
    o = table(spark, sf_dir, "orders").select(k.alias("clip"), text.alias("definition"), (k % 5 + 8).cast("int").alias("inputs"))
    return C.definition_rows(o, ["clip"], "definition", "inputs")


@query(f"WITH {_AUDIO}, q AS (SELECT clip, input // 2 AS pair, track, channel FROM p WHERE input % 2 = 0 UNION ALL SELECT clip, NULL, track, 0 FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY track, channel) - 1 AS out_track FROM q), "
       "m AS (SELECT p.clip, out_track, p.track FROM p JOIN r ON r.clip = p.clip AND r.pair = input // 2 UNION ALL SELECT clip, out_track, track FROM r WHERE pair IS NULL) "
       "SELECT m.clip, out_track, count(DISTINCT bits) = 1 AS compatible FROM m JOIN t ON t.clip = m.clip AND t.track = m.track GROUP BY ALL")  # fmt: skip
def m5_compatible(spark, sf_dir):
    t = audio_tracks(spark, sf_dir)
    return C.compatible(C.stereo_map(t, "clip"), t, "clip")


def samples(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("all"))
    parts = F.array(*(F.struct(F.lit(c).alias("input"), C.deinterleave(F.col("all"), 4, c).alias("samples")) for c in range(4)))
    return e.select("vec_id", F.explode(parts).alias("p")).select("vec_id", "p.*")


@query("SELECT vec_id, input, list_sum([CAST(embedding[i * 4 + input + 1] AS DOUBLE) * 0 + CAST(round(CAST(embedding[i * 4 + input + 1] AS DOUBLE) * 1000) AS BIGINT) * (i + 1) FOR i IN range(16)]) AS checksum FROM embeddings, (SELECT unnest(range(4)) AS input)")
def b2_deinterleave(spark, sf_dir):
    code = F.aggregate(F.transform("samples", lambda x, i: F.round(x * 1000).cast("long") * (i + 1)), F.lit(0).cast("double"), lambda a, x: a + x)
    return samples(spark, sf_dir).select("vec_id", F.col("input").cast("long").alias("input"), code.alias("checksum"))


@query("""SELECT vec_id, t AS out_track, CAST(len(embedding) // 4 * [2, 1][t + 1] AS BIGINT) AS n, CASE t WHEN 0 THEN CAST(embedding[4] AS DOUBLE) ELSE 0.0 END AS first_sample,
CASE t WHEN 0 THEN CAST(embedding[61] AS DOUBLE) ELSE 0.0 END AS last_sample FROM embeddings, (SELECT unnest(range(2)) AS t)""")
def m6_apply(spark, sf_dir):
    mapped = C.definition_frame(spark, "3,0; s1", 4)
    out = C.apply_map(samples(spark, sf_dir), mapped, ["vec_id"])
    return out.select("vec_id", F.col("out_track").cast("long").alias("out_track"), F.size("samples").cast("long").alias("n"), F.get("samples", F.lit(0)).alias("first_sample"), F.element_at("samples", -1).alias("last_sample"))


@query("""SELECT vec_id, t AS out_track, CASE t WHEN 0 THEN flatten([[CAST(embedding[i * 4 + 4] AS DOUBLE), CAST(embedding[i * 4 + 1] AS DOUBLE)] FOR i IN range(len(embedding) // 4)]) ELSE [0.0::DOUBLE FOR i IN range(len(embedding) // 4)] END AS samples
FROM embeddings, (SELECT unnest(range(2)) AS t)""")
def m6_samples(spark, sf_dir):
    """Every sample of the outputs, in order."""
    out = C.apply_map(samples(spark, sf_dir), C.definition_frame(spark, "3,0; s1", 4), ["vec_id"])
    return out.select("vec_id", F.col("out_track").cast("long").alias("out_track"), "samples")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'red' ELSE 'green' END AS color, event_id - 25 AS position FROM events")
def m9_locators(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "_mark").otherwise("mark").alias("mark"), F.col("event_id").alias("position"))
    return C.mark_locators(e, 25).drop("mark")


# --- integrity -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def a3_digests(spark, sf_dir):
    return G.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "md5", "sha1")


@query(f"WITH {CRC_TABLE} SELECT doc_id, " + crc_hex("CASE WHEN text <> '' THEN [('0x' || p)::BIGINT FOR p IN regexp_extract_all(hex(encode(text)), '..')] WHEN text IS NOT NULL THEN []::BIGINT[] END") + " AS crc32 FROM documents, crc_table")
def a3_crc32(spark, sf_dir):
    return G.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "crc32")


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS md5, sha1(string_agg(text, '' ORDER BY turn)) AS sha1 FROM conversations GROUP BY conv_id")
def a1_track_digests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("text").alias("payload"))
    return G.track_digests(c, ["conv_id"]).drop("crc32")


@query(f"WITH {CRC_TABLE}, c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id) SELECT conv_id, " + crc_hex("CASE WHEN text <> '' THEN [('0x' || p)::BIGINT FOR p IN regexp_extract_all(hex(encode(text)), '..')] ELSE []::BIGINT[] END") + " AS crc32 FROM c, crc_table")
def a1_track_crc(spark, sf_dir):
    """The CRC that runs on from frame to frame."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("text").alias("payload"))
    return G.track_digests(c, ["conv_id"]).select("conv_id", "crc32")


def stored(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 97).alias("clip"), F.col("turn").alias("track"), F.col("text").alias("payload"), "conv_id")
    own = F.crc32(F.col("payload").cast("binary"))
    return c.withColumn("stored_crc", F.when(F.col("conv_id") % 5 != 0, own + F.when(F.col("conv_id") % 31 == 0, 1).otherwise(0)))


_STORED = "c AS (SELECT conv_id % 97 AS clip, turn AS track, count(*) AS total, count(*) FILTER (conv_id % 5 <> 0) AS checked, count(*) FILTER (conv_id % 5 <> 0 AND conv_id % 31 = 0) AS errors FROM conversations GROUP BY ALL)"


@query(f"WITH {_STORED} SELECT * FROM c")
def a5_crc_check(spark, sf_dir):
    return G.crc_check(stored(spark, sf_dir), "clip", "track")


@query(f"""WITH {_STORED}, s AS (SELECT *, CASE WHEN checked < total THEN 'MISSING_DATA' WHEN errors > 0 THEN 'FAILED' END AS said FROM c)
SELECT clip, CASE WHEN sum(checked) = 0 THEN 'MISSING_DATA' ELSE coalesce(arg_max(said, track) FILTER (said IS NOT NULL), 'PASSED') END AS result FROM s GROUP BY clip""")
def a5_crc_result(spark, sf_dir):
    return G.crc_result(G.crc_check(stored(spark, sf_dir), "clip", "track"), "clip", "track")


@query("SELECT event_type, event_id, occurrence, occurrences FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS occurrence, count(*) OVER (PARTITION BY event_type) AS occurrences FROM events) WHERE occurrence <= 25")
def a14_capped(spark, sf_dir):
    return G.capped_violations(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"], 25)


@query("""SELECT n, greatest(d, 0) AS duration, CASE WHEN m > 1 THEN 'mixed' WHEN b = 0 AND e < greatest(d, 0) THEN 'entries missing' END AS problem FROM
(SELECT o_orderkey AS n, o_orderkey % 23 - 3 AS d, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 64 ELSE 0 END AS b, o_orderkey % 17 AS e, o_custkey AS c FROM orders)
JOIN (SELECT o_custkey AS c, count(DISTINCT CASE WHEN o_custkey % 3 = 0 OR o_custkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 64 ELSE 0 END) AS m FROM orders GROUP BY 1) USING (c)""")
def v4_sane_segments(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 23 - 3).alias("duration"), F.when((F.col("o_custkey") % 3 == 0) | (F.col("o_custkey") % 7 == 0) & (F.col("o_orderkey") % 2 == 0), 64).otherwise(0).alias("edit_unit_bytes"), (F.col("o_orderkey") % 17).alias("entries"))
    return G.sane_segments(o, "track").select("n", "duration", "problem")


@query(f"WITH {_FRAMES} SELECT track, position, size AS read, size + 1 AS indexed FROM f WHERE track % 10 = 0")
def v3_size_mismatches(spark, sf_dir):
    f = frames(spark, sf_dir)
    return G.size_mismatches(f, f.withColumn("size", F.col("size") + F.when(F.col("track") % 10 == 0, 1).otherwise(0)), ["track", "position"])


@query(f"WITH {_FRAMES} SELECT o_orderkey AS track, coalesce((SELECT max(position) FROM f WHERE track = o_orderkey) = o_orderkey % 5, false) AS complete FROM orders")
def v1_last_frame(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track"), (F.col("o_orderkey") % 5 + 1).alias("duration"))
    return G.last_frame(frames(spark, sf_dir), t, "track").select("track", "complete")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 4 < 2 OR o_orderstatus = 'O' AND o_custkey % 4 = 3)")
def v7_unsupported(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("essence"), (F.col("o_custkey") % 4).alias("rate"))
    allowed = spark.createDataFrame([("F", 0), ("F", 1), ("O", 3)], "essence string, rate long")
    return G.unsupported(t, allowed, ["essence", "rate"]).select("o_orderkey")


@query("SELECT event_id AS stream, event_type AS field, event_id % 50 AS value FROM events WHERE event_type = 'view' AND event_id % 50 NOT BETWEEN 5 AND 40 OR event_type = 'click' AND event_id % 50 <> 7")
def v5_header_violations(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.col("event_id").alias("stream"), F.col("event_type").alias("field"), (F.col("event_id") % 50).alias("value"))
    return G.header_violations(h, spark.createDataFrame([("view", 5, 40), ("click", 7, 7)], "field string, low long, high long"))


# --- events ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, CASE WHEN event_id % 3 > 0 THEN 'v' || event_id END AS vitc, CASE WHEN event_id % 3 > 0 THEN 'l' || event_id % 9 END AS ltc FROM events WHERE event_type IN ('error', 'click')")
def j9_event_timecodes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tc = e.where("event_id % 3 > 0").select("event_id", F.concat(F.lit("v"), "event_id").alias("vitc"), F.concat(F.lit("l"), F.col("event_id") % 9).alias("ltc"))
    return V.with_timecodes(e.where(F.col("event_type").isin("error", "click")).select("event_id", "event_type"), tc, ["event_id"])


@query("SELECT user_id, event_type, count(*) AS issues FROM events GROUP BY ALL")
def a16_issue_counts(spark, sf_dir):
    return V.issue_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'a' || event_id END, '__:__:__:__') || ' ' || coalesce(CASE WHEN event_id % 3 = 0 THEN 'b' END, '__:__:__:__') AS line FROM events")
def k11_timecode_dump(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a"), "event_id")).alias("vitc"), F.when(F.col("event_id") % 3 == 0, F.lit("b")).alias("ltc"))
    return V.timecode_dump(e, ["vitc", "ltc"]).select("event_id", "line")


@query("SELECT k.conv_id, string_agg(coalesce(c.crc, '????'), ' ' ORDER BY t.turn) AS line FROM (SELECT DISTINCT conv_id FROM conversations) k CROSS JOIN (SELECT DISTINCT turn FROM conversations) t LEFT JOIN (SELECT conv_id, turn, max(md5(text)) AS crc FROM conversations GROUP BY 1, 2) c ON c.conv_id = k.conv_id AND c.turn = t.turn GROUP BY 1")
def k12_crc_dump(spark, sf_dir):
    """A line for each conversation with the digests of all turns that occur."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("crc"))
    wide = V.crc_dump(c, ["conv_id"], "turn", "crc")
    return wide.select("conv_id", F.concat_ws(" ", *wide.columns[1:]).alias("line"))


@query("SELECT vec_id, i + 100 AS track_number, CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS BIGINT) AS crc32 FROM embeddings, (SELECT unnest(range(64)) AS i)")
def j10_zip_crcs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i + 100).cast("array<long>").alias("track_numbers"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x * 1000).cast("long")).alias("crcs"))
    return V.zip_crcs(e, ["vec_id"])


@query("""WITH c AS (SELECT user_id AS program, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE row_number() OVER (PARTITION BY user_id ORDER BY event_id) WHEN 4 THEN 2 WHEN 20 THEN CASE WHEN user_id % 3 = 0 THEN 65 ELSE 3 END ELSE 65 + event_id % 26 END AS ch FROM events)
SELECT program, string_agg(chr(CAST(ch AS INTEGER)), '' ORDER BY n) FILTER (program % 3 = 0 OR n <= 20) AS text, program % 3 > 0 AS complete FROM c GROUP BY program""")
def a12_description(spark, sf_dir):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("program"), "event_id", n.alias("position"))
    ch = F.when(F.col("position") == 4, 2).when((F.col("position") == 20), F.when(F.col("program") % 3 == 0, 65).otherwise(3)).otherwise(65 + F.col("event_id") % 26)
    return V.description_text(e.withColumn("ch", ch.cast("int")), ["program"])


@query("SELECT event_id, [2, 77, 65, 73, 78, 3][event_id % 6 + 1] AS ch FROM events")
def b7_static_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.static_text_char("MAIN", F.col("event_id")).alias("ch"))


@query(f"WITH {_FRAMES} SELECT position + 10 AS frame, track, position, size, CASE WHEN position = 0 THEN 'c0' ELSE '22' END AS flags, -position AS key_frame_offset, 0 AS temporal_offset FROM f")
def k10_index_dump(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"flags": F.when(F.col("position") == 0, 0xC0).otherwise(0x22), "key_frame_offset": -F.col("position"), "temporal_offset": F.lit(0)})
    return V.index_dump(f, F.col("position") + 10)


@query("SELECT doc_id, 'v_' || lang || '-' || doc_id || '.{x}' AS name FROM documents")
def k14_template(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.fill_template("v_{type}-{id}.{x}", {"type": F.col("lang"), "id": F.col("doc_id")}).alias("name"))


# --- labels and tracks -----------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS label, n_regionkey * 2 AS group_id FROM nation WHERE n_regionkey * 2 NOT IN (SELECT r_regionkey FROM region)")
def j11_broken_links(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), (F.col("n_regionkey") * 2).alias("group_id"))
    return L.broken_links(n, "group_id", table(spark, sf_dir, "region"), "r_regionkey").select("label", "group_id")


@query("SELECT r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey * 2 FROM nation)")
def j12_referenced(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 2).alias("link"))
    return L.referenced(table(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey", n, "link")


@query("SELECT o_custkey AS label_id, count(DISTINCT o_orderstatus) AS dict_ids, count(DISTINCT o_orderpriority) AS properties FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1")
def b25_identity(spark, sf_dir):
    return L.identity_problems(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("label_id"), F.col("o_orderstatus").alias("dict_id"), F.col("o_orderpriority").alias("props")))


@query("SELECT min(o_orderkey) AS seq, o_custkey % 50 AS track, o_orderstatus AS label_id FROM orders GROUP BY 2, 3")
def b25_once_per_track(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("track"), F.col("o_orderstatus").alias("label_id"))
    return L.once_per_track(o)


@query("""WITH RECURSIVE h AS (SELECT o_orderkey AS start, o_orderkey AS id, o_orderkey // 3 AS ref, CAST(o_orderkey % 10 AS BIGINT) AS off, 0 AS hops FROM orders
UNION ALL SELECT start, ref, ref // 3, CASE WHEN off = 0 OR (ref % 2 = id % 2) THEN off WHEN ref % 2 = 0 THEN -((-off * 25) // 50) ELSE off * 50 // 25 END + ref % 4, hops + 1 FROM h WHERE ref <> id AND NOT (hops > 0 AND id < 30) AND hops < 32),
f AS (SELECT start, id, CASE WHEN start = id THEN off ELSE off END AS off, hops FROM h WHERE hops > 0 AND id < 30)
SELECT start, id AS target, hops FROM f""")
def j2_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 3").alias("ref"), F.when(F.col("o_orderkey") < 30, "tape").otherwise("file").alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, 25).otherwise(50).cast("long").alias("num"), F.lit(1).cast("long").alias("den"), (F.col("o_orderkey") % 4).alias("origin"), (F.col("o_orderkey") % 10).alias("offset"))
    return K.resolve_chain(spark, o, "tape").select("start", "target", "hops")


@query("""WITH RECURSIVE h AS (SELECT o_orderkey AS start, o_orderkey AS id, o_orderkey // 3 AS ref, CAST(o_orderkey % 10 AS BIGINT) AS off, 0 AS hops FROM orders
UNION ALL SELECT start, o_orderkey, o_orderkey // 3, CASE WHEN o_orderkey % 2 = id % 2 THEN off WHEN o_orderkey % 2 = 0 THEN off // 2 + off % 2 ELSE off * 2 END + o_orderkey % 4, hops + 1 FROM h JOIN orders ON o_orderkey = ref WHERE ref <> id AND NOT (hops > 0 AND id < 30))
SELECT start, id AS target, hops, off AS "offset" FROM h WHERE hops > 0 AND id < 30""")
def j2_offsets(spark, sf_dir):
    """Chains with the offset that each hop converts and moves, however long they are."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.expr("o_orderkey div 3").alias("ref"), F.when(k < 30, "tape").otherwise("file").alias("kind"), F.when(k % 2 == 0, 25).otherwise(50).cast("long").alias("num"), F.lit(1).cast("long").alias("den"), (k % 4).alias("origin"), (k % 10).alias("offset"))
    return K.resolve_chain(spark, o, "tape").select("start", "target", "hops", "offset")


@query("SELECT o_custkey AS uid, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def j14_conflicts(spark, sf_dir):
    return K.kind_conflicts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("kind")), "uid", "kind")


@query("SELECT l_orderkey, l_linenumber, count(*) AS clips, max(o_custkey) AS owner FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def j1_source_packages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_linenumber")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), "o_custkey")
    return K.source_packages(li, o, ["uid"]).groupBy(F.col("uid").alias("l_orderkey"), "l_linenumber").agg(F.count("*").alias("clips"), F.max("o_custkey").alias("owner"))


@query("SELECT o_orderkey, count(*) FILTER (o_orderstatus <> 'P') OVER (PARTITION BY o_custkey) > 1 AS ambiguous FROM orders JOIN customer ON c_custkey = o_custkey")
def j3_containers(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), F.when(F.col("o_orderstatus") == "P", "timed_text").otherwise("clip").alias("kind"))
    return K.essence_containers(e, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")), "uid").select("o_orderkey", "ambiguous")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey BETWEEN 0 AND 3 OR o_orderkey = 5 OR o_orderkey BETWEEN 100 AND 200 OR o_orderstatus IN ('P'))")
def f1_disable(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"))
    return K.disable(t, "o_orderkey", K.parse_ranges("0-3,5,100-200"), ["P"]).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey % 3 = 0, o_orderkey % 3, o_orderkey = 0, o_orderkey) - 1 AS rank FROM orders")
def o1_track_order(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 3).alias("number"))
    return K.ranked(t, ["o_custkey"], K.track_order("number", "o_orderkey", "kind")).select("o_orderkey", "rank")


@query(f"""WITH {_FRAMES}, p AS (SELECT track, position * 60 AS start, size AS duration, count(*) OVER (PARTITION BY track) * 60 AS total FROM f)
SELECT track, start, duration, false AS filler FROM p UNION ALL SELECT track, start + duration, 60 - duration, true FROM p WHERE duration < 60""")
def w17_segmentation(spark, sf_dir):
    from pyspark.sql.window import Window

    p = frames(spark, sf_dir).select("track", (F.col("position") * 60).alias("start"), F.col("size").alias("duration"), (F.count("*").over(Window.partitionBy("track")) * 60).alias("total"))
    return K.segmentation(p, "track", "total")


@query("SELECT event_id, CASE WHEN event_id * 7 % 1000 < 500 THEN event_id * 7 % 1000 + 1500 ELSE event_id * 7 % 1000 - 500 END AS position FROM events")
def w18_midnight(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.past_midnight(F.col("event_id") * 7 % 1000, F.lit(500), F.lit(2000)).alias("position"))


@query(f"WITH {_FRAMES} SELECT track, position, size FROM f WHERE position < 2")
def s9_sampled(spark, sf_dir):
    return K.sampled(frames(spark, sf_dir), ["track"])


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'picture' WHEN 'fr' THEN 'sound' WHEN 'de' THEN 'data' END AS kind FROM documents")
def f15_kind(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.essence_kind({"en": "picture", "fr": "sound", "de": "data"}, F.col("lang")).alias("kind"))


# --- identifiers -----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS uuid,
'urn:smpte:ul:' || substr(h, 1, 8) || '.' || substr(h, 9, 8) || '.' || substr(h, 17, 8) || '.' || substr(h, 25) AS ul, h || h AS parsed FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)""")
def b15_identifiers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("id"))
    umid = B.umid_urn(F.concat("id", "id"))
    return d.select("doc_id", B.uuid_text(F.col("id")).alias("uuid"), B.ul_urn(F.col("id")).alias("ul"), F.lower(F.hex(B.parse_umid(umid))).alias("parsed"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21) AS uuid
FROM (SELECT doc_id, md5('space' || source) AS h FROM documents)""")
def b16_name_uuid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", B.name_uuid(b"space", F.col("source")).alias("uuid"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, array_to_string(list_filter([trim(x) FOR x IN string_split(url, '/')], lambda x: x <> ''), '|') AS parts FROM pages""")
def b17_strings(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", B.file_name(F.col("url")).alias("name"), F.array_join(B.split_text(F.col("url"), "/"), "|").alias("parts"))


# --- reports ---------------------------------------------------------------------------------------------------------


_REGISTRY = "t (did, sdid, name) AS (VALUES " + ", ".join([*(f"({d}, NULL, '{n}')" for d, n in R.TYPE_1), *(f"({d}, {x}, '{n}')" for d, x, n in R.TYPE_2)]) + ")"


@query(f"""WITH {_REGISTRY}, l AS (SELECT event_id, event_id % 256 AS did, CASE WHEN event_id % 3 = 0 THEN event_id % 256 ELSE event_id // 256 % 16 END AS sdid FROM events)
SELECT event_id, name FROM l LEFT JOIN t ON t.did = l.did AND (l.did >= 128 OR t.sdid = l.sdid)""")
def b5_packet_names(spark, sf_dir):
    did = F.col("event_id") % 256
    sdid = F.when(F.col("event_id") % 3 == 0, did).otherwise(F.floor(F.col("event_id") / 256) % 16)
    return table(spark, sf_dir, "events").select("event_id", R.packet_name(did, sdid).alias("name"))


@query("""SELECT conv_id, '<Manifest><FileList>' || string_agg('<File><Name>&lt;' || turn || '&gt;&amp;</Name><Size>' || octet_length(encode(text)) || '</Size><Checksum type="md5">' || md5(text) || '</Checksum></File>', '' ORDER BY turn) || '</FileList></Manifest>' AS manifest FROM conversations GROUP BY conv_id""")
def k4_manifest(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<"), F.col("turn"), F.lit(">&")).alias("name"), F.octet_length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("md5"))
    return R.manifest_xml(c, "conv_id", "turn")


@query("""SELECT conv_id, '{"conv_id":' || conv_id || ',"turns":' || count(*) || ',"tracks":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']}' AS report FROM conversations GROUP BY conv_id""")
def k8_clip_report(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return R.clip_report(c.groupBy("conv_id").agg(F.count("*").alias("turns")), c, "conv_id", ["turn"])


@query("SELECT doc_id, 'lang   : ' || lang || chr(10) || 'source : ' || source AS report FROM documents")
def k7_sections(spark, sf_dir):
    return R.sections(table(spark, sf_dir, "documents"), ["doc_id"], ["lang", "source"])


# --- audio metadata ----------------------------------------------------------------------------------------------------

#: Fields of a second sub-frame (sync, Dolby E essential, Dolby Digital essential) by segment, place and width.
_ESSENTIAL = [(segment, id_, k, name, width) for segment, id_ in ((0, 0), (1, 2), (2, 4)) for k, (name, width) in enumerate(A.FIELDS[id_])]
_VALUE = "CASE field WHEN 'program_config' THEN event_id % 24 ELSE (event_id * 7 + ord * 13 + segment * 5) % (1 << width) END"
_SERIAL = f"""l AS (SELECT unnest([{", ".join(f"{{'segment': {s}, 'id': {i}, 'ord': {k}, 'field': '{n}', 'width': {w}}}" for s, i, k, n, w in _ESSENTIAL)}]) AS x),
s AS (SELECT event_id, x.segment AS segment, x.id AS id, x.ord AS ord, x.field AS field, x.width AS width, {_VALUE.replace("field", "x.field").replace("ord *", "x.ord *").replace("segment *", "x.segment *").replace("<< width", "<< x.width")} AS value FROM events, l)"""


def serial_fields(spark, sf_dir):
    layout = F.array(*(F.struct(F.lit(s).alias("segment"), F.lit(i).alias("id"), F.lit(k).alias("ord"), F.lit(n).alias("field"), F.lit(w).alias("width")) for s, i, k, n, w in _ESSENTIAL))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(2).alias("subframe"), F.inline(layout))
    value = F.when(F.col("field") == "program_config", F.col("event_id") % 24).otherwise((F.col("event_id") * 7 + F.col("ord") * 13 + F.col("segment") * 5) % F.pow(F.lit(2), F.col("width")).cast("long"))
    return rows.withColumn("value", value)


@query(f"""WITH {_SERIAL}, b AS (SELECT event_id, segment, id, string_agg(lpad(bin(value), CAST(width AS INTEGER), '0'), '' ORDER BY ord) AS bits FROM s GROUP BY ALL),
h AS (SELECT event_id, segment, id, [('0b' || x)::INTEGER FOR x IN regexp_extract_all(rpad(bits, CAST((len(bits) + 7) // 8 * 8 AS INTEGER), '0'), '.{{8}}')] AS bytes FROM b),
w AS (SELECT event_id, segment, list_concat(CASE segment WHEN 0 THEN []::INTEGER[] ELSE [id, len(bytes)] END, bytes, CASE segment WHEN 0 THEN []::INTEGER[] ELSE [(256 - (len(bytes) + list_sum(bytes)) % 256) % 256] END) AS bytes FROM h),
p AS (SELECT event_id, list_concat([63, 243], flatten(list(bytes ORDER BY segment)), [0, 10, 10]) AS bytes FROM w GROUP BY event_id)
SELECT event_id, list_aggregate([printf('%02X', x) FOR x IN list_concat([69, 4, len(bytes)], bytes)], 'string_agg', '') AS packet FROM p""")
def b6_packets(spark, sf_dir):
    """Packets of second sub-frames put together from rows of fields."""
    return A.packets(serial_fields(spark, sf_dir), ["event_id"], 4).select("event_id", F.hex("second").alias("packet"))


@query(f"WITH {_SERIAL} SELECT event_id, segment, ord, field, CAST(CASE WHEN field = 'pitch_shift_code' AND value >= 2048 THEN value - 4096 ELSE value END AS BIGINT) AS value, CASE WHEN segment > 0 THEN true END AS intact FROM s")
def b6_fields(spark, sf_dir):
    """The fields of these packets as they are read again."""
    p = A.packets(serial_fields(spark, sf_dir), ["event_id"], 4)
    found = A.segments(p, ["event_id"])
    rows = A.fields(found, ["event_id"]).join(found.select("event_id", "segment", "intact"), ["event_id", "segment"])
    return rows.select("event_id", "segment", "ord", "field", "value", "intact")


@query(f"""WITH {_SERIAL}, c AS (SELECT event_id, max(value) FILTER (field = 'compre') AS compre, max(value) FILTER (field = 'dynrnge') AS dynrnge FROM s WHERE segment = 2 GROUP BY event_id)
SELECT event_id, segment, field, CAST(value AS BIGINT) AS value FROM s JOIN c USING (event_id) WHERE field = 'frame_rate_code' AND value NOT BETWEEN 1 AND 5 OR field = 'program_id' AND value > 7 OR field = 'datarate' AND value > 18 AND value <> 31
OR field = 'acmod' AND value = 0 OR field = 'compr2' AND compre = 0 AND value > 5 OR field LIKE 'dynrng_' AND field <> 'dynrnge' AND dynrnge = 0 AND value > 5""")
def v9_violations(spark, sf_dir):
    return A.violations(spark, serial_fields(spark, sf_dir), ["event_id"]).select("event_id", "segment", "field", "value")
