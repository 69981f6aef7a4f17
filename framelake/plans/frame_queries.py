"""Operators on frames, indexes, packets, channels and tracks, over stand-ins derived from the driver's tables.

The stand-ins only give rows of the right shape: users are sources, orders are tracks with line items as frames, and
embeddings are interleaved samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import index as X
from ..operators import timeline as S
from ..operators.spread import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, position (from 0, without gaps), size."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("position"), F.col("l_quantity").cast("long").alias("size"))


_FRAMES = """f AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS position,
CAST(l_quantity AS BIGINT) AS size FROM lineitem)"""


def members(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = e.groupBy(F.col("user_id").alias("member")).agg(F.count("*").alias("duration"), F.min("event_id").alias("origin"))
    n = F.get(F.array(F.lit(24), F.lit(25), F.lit(30000)), (F.col("member") % 3).cast("int")).cast("long")
    d = F.get(F.array(F.lit(1), F.lit(1), F.lit(1001)), (F.col("member") % 3).cast("int")).cast("long")
    return u.select(
        (F.col("member") % 40).alias("clip"), "member", n.alias("num"), d.alias("den"), F.when(F.col("member") % 50 != 0, F.col("duration")).alias("duration"), "origin",
        (F.col("member") % 80).alias("start"), F.concat(F.lit("n"), (F.col("member") % 120).cast("string")).alias("name"), (F.col("member") % 7 != 0).alias("complete"),
    )


_MEMBERS = """m AS (SELECT member % 40 AS clip, member, CAST([24, 25, 30000][member % 3 + 1] AS BIGINT) AS num, CAST([1, 1, 1001][member % 3 + 1] AS BIGINT) AS den,
CASE WHEN member % 50 <> 0 THEN duration END AS duration, origin, member % 80 AS start, 'n' || member % 120 AS name, member % 7 <> 0 AS complete
FROM (SELECT user_id AS member, count(*) AS duration, min(event_id) AS origin FROM events GROUP BY 1))"""


@query(f"""WITH {_MEMBERS}, r AS (SELECT *, first_value(num) OVER w AS tn, first_value(den) OVER w AS td FROM m WINDOW w AS (PARTITION BY clip ORDER BY CAST(num AS DOUBLE) / den, member)),
c AS (SELECT *, duration * tn * den // (td * num) AS d, -((-origin * tn * den) // (td * num)) AS o0 FROM r)
SELECT clip, min(tn) AS num, min(td) AS den, CASE WHEN bool_or(d IS NULL) THEN NULL ELSE min(d) END AS duration,
max(CASE WHEN origin = 0 OR tn * den = td * num THEN origin ELSE (origin * tn * den + td * num - 1) // (td * num) END) AS origin,
CASE WHEN min(start) = max(start) THEN min(start) END AS start, CASE WHEN min(name) = max(name) THEN min(name) END AS name, bool_and(complete) AS complete, count(*) AS members
FROM c GROUP BY clip""")
def j4_group_summary(spark, sf_dir):
    return S.group_summary(members(spark, sf_dir), "clip")


@query("""WITH e AS (SELECT user_id % 10 AS clip, user_id AS member, event_id % 4000 AS position FROM events),
c AS (SELECT k, 1602 * k - [0, 0, 1, 1, 2][k % 5 + 1] - 2 * (k // 5) AS pos FROM (SELECT unnest(range(12)) AS k)),
a AS (SELECT clip, member, (SELECT max(k) FROM c WHERE pos <= position) AS group_position, position FROM e),
g AS (SELECT clip, member, group_position, count(*) AS samples FROM a GROUP BY ALL)
SELECT clip, group_position, count(DISTINCT member) AS present, max(samples) AS samples, (SELECT count(DISTINCT member) FROM e WHERE e.clip = g.clip) AS members,
count(DISTINCT member) = (SELECT count(DISTINCT member) FROM e WHERE e.clip = g.clip) AS complete FROM g GROUP BY clip, group_position""")
def j5_align(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("clip"), F.col("user_id").alias("member"), (F.col("event_id") % 4000).alias("position"))
    aligned = S.align(e, "clip", F.array(*map(F.lit, (1602, 1601, 1602, 1601, 1602))))
    return S.complete_rows(aligned, "clip", e)


@query("""SELECT seq, min(seq) OVER (PARTITION BY coalesce(uid, -1 - seq), CASE WHEN uid IS NOT NULL THEN lead END) AS first_seq
FROM (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS uid, o_orderkey % 3 AS lead FROM orders)""")
def a11_input_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("material_uid"), (F.col("o_orderkey") % 3).alias("lead_filler"))
    return S.input_groups(o).select("seq", "first_seq")


def segments(spark, sf_dir):
    return frames(spark, sf_dir).select("track", F.col("position").alias("segment"), F.col("size").alias("duration"))


@query(f"""WITH {_FRAMES}, s AS (SELECT track, position AS segment, size AS duration, CASE WHEN size <= 0 THEN 0 ELSE size * 2 // 5 END AS moved FROM f),
b AS (SELECT *, duration - CASE WHEN moved <= 0 THEN 0 ELSE -((-moved * 5) // 2) END AS back0, duration - CASE WHEN moved <= 0 THEN 0 ELSE (moved * 5 + 1) // 2 END AS back FROM s)
SELECT track, segment, duration, moved, CAST(coalesce(sum(moved) OVER (PARTITION BY track ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
coalesce(lag(back) OVER (PARTITION BY track ORDER BY segment), 0) AS adjustment FROM b""")
def u1_concat(spark, sf_dir):
    return S.concat_segments(segments(spark, sf_dir), "track", ["segment"], 2, 5)


@query(f"""WITH {_FRAMES}, s AS (SELECT track, position AS segment, CAST(coalesce(sum(size) OVER (PARTITION BY track ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM f),
p AS (SELECT DISTINCT track, q - 7 AS position FROM (SELECT track, unnest([0, 7, 30, 64, 120]) AS q FROM f)),
j AS (SELECT p.track, p.position, max(s.segment) AS segment FROM p LEFT JOIN s ON s.track = p.track AND s.start <= p.position GROUP BY ALL)
SELECT j.track, j.position, coalesce(j.segment, 0) AS segment, j.position - s.start AS segment_position FROM j JOIN s ON s.track = j.track AND s.segment = coalesce(j.segment, 0)""")
def j8_locate(spark, sf_dir):
    s = S.concat_segments(segments(spark, sf_dir), "track", ["segment"])
    p = s.select("track").distinct().select("track", F.explode(F.array(*(F.lit(x).cast("long") for x in (-7, 0, 23, 57, 113)))).alias("position"))
    return S.locate(p, s, "track")


def timed(spark, sf_dir):
    """Segments with start timecodes that go on, but for every seventh clip."""
    s = S.concat_segments(segments(spark, sf_dir), "track", ["segment"])
    return s.select("track", "segment", "duration", (F.col("offset") + F.col("track") % 100 + F.when((F.col("track") % 7 == 0) & (F.col("segment") == 2), 5).otherwise(0)).alias("start"))


_TIMED = f"""{_FRAMES}, t AS (SELECT track, position AS segment, size AS duration,
CAST(coalesce(sum(size) OVER (PARTITION BY track ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + track % 100 + CASE WHEN track % 7 = 0 AND position = 2 THEN 5 ELSE 0 END AS start FROM f)"""


@query(f"""WITH {_TIMED} SELECT track, segment, coalesce(start = lag(start + duration) OVER (PARTITION BY track ORDER BY segment), segment = 0) AS continuous FROM t""")
def w8_continuity(spark, sf_dir):
    return S.continuity(timed(spark, sf_dir), "track", ["segment"], "start", "duration").select("track", "segment", "continuous")


@query(f"""WITH {_TIMED}, c AS (SELECT *, coalesce(start = lag(start + duration) OVER (PARTITION BY track ORDER BY segment), segment = 0) AS ok FROM t)
SELECT track, CASE WHEN bool_and(ok) THEN min(start) END AS start FROM c GROUP BY track""")
def w9_sequence_start(spark, sf_dir):
    return S.sequence_start(timed(spark, sf_dir), "track", ["segment"], "start", "duration")


_CLOCK = "(start + 86400 - track % 3 * 40) % 86400"


@query(f"""WITH {_TIMED}, w AS (SELECT track, segment, duration, {_CLOCK} AS tc FROM t),
r AS (SELECT *, row_number() OVER v - 1 AS k, count(*) OVER (PARTITION BY track) AS n, coalesce(lag(tc + duration) OVER v, last_value(tc + duration) OVER (PARTITION BY track ORDER BY tc, segment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) <> tc AS brk
FROM w WINDOW v AS (PARTITION BY track ORDER BY tc, segment)),
b AS (SELECT *, CASE WHEN count(*) FILTER (brk) OVER (PARTITION BY track) = 1 THEN max(k) FILTER (brk) OVER (PARTITION BY track) ELSE 0 END AS shift FROM r)
SELECT track, segment, (k - shift + n) % n AS play_order FROM b""")
def w10_midnight(spark, sf_dir):
    t = timed(spark, sf_dir).withColumn("tc", (F.col("start") + 86400 - F.col("track") % 3 * 40) % 86400)
    return S.rotate_at_midnight(t, "track", "tc", "duration", "segment").select("track", "segment", "play_order")


def gop_index(spark, sf_dir):
    """Index entries of a stream with GOPs of five in coded order: I B B P B."""
    at = F.col("event_id") % 5
    key = F.when(at == 0, 0).otherwise(-at)
    temporal = F.get(F.array(*map(F.lit, (2, -1, -1, 1, -1))), at.cast("int"))
    return table(spark, sf_dir, "events").select((F.col("event_id") / 500).cast("int").alias("track"), (F.col("event_id") % 500).alias("position"), temporal.alias("temporal_offset"), key.cast("int").alias("key_frame_offset"))


_GOP = """i AS (SELECT event_id // 500 AS track, event_id % 500 AS position, [2, -1, -1, 1, -1][event_id % 5 + 1] AS temporal_offset, -(event_id % 5) AS key_frame_offset FROM events),
d AS (SELECT i.*, least(0, CASE WHEN i.temporal_offset = 0 THEN i.key_frame_offset WHEN o.position IS NULL THEN 0 ELSE i.temporal_offset + o.key_frame_offset END) AS precharge, greatest(i.temporal_offset, 0) AS rollout
FROM i LEFT JOIN i o ON o.track = i.track AND o.position = i.position + i.temporal_offset)"""


@query(f"""WITH {_GOP} SELECT track, position, precharge, rollout, greatest(position + precharge, 0) - position AS available_precharge,
least(position + rollout, max(position) OVER (PARTITION BY track)) - position AS available_rollout FROM d""")
def w6_dependencies(spark, sf_dir):
    return S.available(S.dependencies(gop_index(spark, sf_dir), "track"), "track").select("track", "position", "precharge", "rollout", "available_precharge", "available_rollout")


@query(f"""WITH {_GOP}, z AS (SELECT track, least(48, max(position) + 1) AS stop FROM d GROUP BY track HAVING max(position) >= 18)
SELECT d.track, 18 + min(precharge) FILTER (position = 18) AS "first", min(stop) - 1 + max(rollout) FILTER (position = stop - 1) AS "last",
min(precharge) FILTER (position = 18) AS precharge, max(rollout) FILTER (position = stop - 1) AS rollout, min(stop) - 18 AS duration FROM d JOIN z USING (track) GROUP BY d.track""")
def f3_read_range(spark, sf_dir):
    return S.read_range(S.dependencies(gop_index(spark, sf_dir), "track"), "track", 18, 30)


@query(f"""WITH {_GOP}, c AS (SELECT track, position, max(position + rollout) OVER (PARTITION BY track ORDER BY position) AS reach FROM d WHERE position >= 45)
SELECT track, min(position) AS "last", min(position) - 17 AS duration FROM c WHERE reach = position GROUP BY track""")
def f4_without_rollout(spark, sf_dir):
    return S.without_rollout(S.dependencies(gop_index(spark, sf_dir), "track"), "track", 18, 28)


@query("""WITH t AS (SELECT DISTINCT o_custkey AS seq, o_orderkey % 3 AS track, o_orderkey // 3 % 2 AS segment, 1 AS one FROM orders),
d AS (SELECT seq, track, segment, 10 + track AS duration FROM t), n AS (SELECT seq, count(DISTINCT segment) AS n FROM d GROUP BY seq)
SELECT seq, track, CAST(sum(duration) AS BIGINT) AS duration FROM d JOIN n USING (seq) GROUP BY seq, track, n HAVING count(DISTINCT segment) = n""")
def u3_in_every_segment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seq"), (F.col("o_orderkey") % 3).alias("track"), (F.floor(F.col("o_orderkey") / 3) % 2).alias("segment")).distinct()
    return S.in_every_segment(o.withColumn("duration", 10 + F.col("track")), "seq")


@query("""SELECT o_custkey AS track, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS status, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) END AS priority,
CAST(sum(o_orderkey) AS BIGINT) AS duration FROM orders GROUP BY 1""")
def u2_merge_properties(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("duration"))
    return S.merge_properties(o, ["track"], ["status", "priority"])


@query("""WITH a AS (SELECT o_orderkey AS new_id, o_orderstatus AS kind, o_custkey % 50 AS number, row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_orderkey AS old_id, o_orderstatus AS kind, o_custkey % 50 AS number, row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1)
SELECT new_id, old_id FROM a LEFT JOIN b USING (kind, number, n)""")
def j13_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 50).alias("number"))
    new, old = (o.where(F.col("o_orderkey") % 2 == k).select(F.col("o_orderkey").alias(n), "kind", "number") for k, n in ((0, "new_id"), (1, "old_id")))
    return S.match_segments(new, old, ["kind", "number"]).select("new_id", "old_id")


@query("""WITH f AS (SELECT user_id AS track, event_id // 150 AS position, count(*) AS samples FROM events GROUP BY ALL), p AS (SELECT track, unnest(range(max(position) + 1)) AS position FROM f GROUP BY track)
SELECT track, position, coalesce(samples, 0) AS samples FROM p LEFT JOIN f USING (track, position)""")
def u5_fill(spark, sf_dir):
    f = table(spark, sf_dir, "events").select("user_id", "event_id").repartition("user_id").groupBy(F.col("user_id").alias("track"), F.floor(F.col("event_id") / 150).alias("position")).agg(F.count("*").alias("samples"))
    return S.fill_positions(f, "track")


# --- index -----------------------------------------------------------------------------------------------------------

_OFFSETS = f"{_FRAMES}, o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY track ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM f)"


@query(f'WITH {_OFFSETS} SELECT track, position, start AS "offset" FROM o')
def w2_running_offset(spark, sf_dir):
    return X.running_offsets(frames(spark, sf_dir), "track").select("track", "position", "offset")


@query(f"WITH {_OFFSETS} SELECT track, position, size FROM o")
def w1_edit_unit_size(spark, sf_dir):
    o = X.running_offsets(frames(spark, sf_dir), "track")
    end = F.max(F.col("offset") + F.col("size")).over(Window.partitionBy("track"))
    return X.edit_unit_sizes(o.withColumn("end", end).drop("size"), "track", "end").select("track", "position", "size")


@query("SELECT event_id AS position, 4096 + event_id * 1920 AS \"offset\", 128 AS flags FROM events")
def w3_constant(spark, sf_dir):
    return X.constant_offsets(table(spark, sf_dir, "events").select(F.col("event_id").alias("position")), 4096, 1920)


@query("SELECT event_id AS position, event_id * 2 AS entry, CAST((event_id % 9 - 4) // 2 AS BIGINT) AS temporal, CAST(-(event_id % 7) // 2 AS BIGINT) AS key FROM events")
def w4_paired(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), (F.col("event_id") % 9 - 4).alias("temporal_offset"), (-(F.col("event_id") % 7)).alias("key_frame_offset"))
    return X.paired_entries(e).select("position", "entry", "temporal", "key")


@query(f"""WITH {_OFFSETS}, s AS (SELECT track, start AS a, start + size - 5 AS b, position AS segment FROM o), p AS (SELECT DISTINCT track, unnest([0, 3, 20, 44, 90, 150, 900]) AS position FROM o)
SELECT p.track, p.position, s.segment FROM p LEFT JOIN s ON s.track = p.track AND p.position >= s.a AND p.position < s.b""")
def j6_find_segment(spark, sf_dir):
    o = X.running_offsets(frames(spark, sf_dir), "track")
    s = o.select("track", F.col("offset").alias("start_position"), (F.col("size") - 5).alias("duration"), F.col("position").alias("segment"))
    p = o.select("track").distinct().select("track", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 3, 20, 44, 90, 150, 900)))).alias("position"))
    return X.find_segment(p, s, "track")


@query(f"""WITH {_OFFSETS}, c AS (SELECT track, start, size, start + position * 64 AS file FROM o), p AS (SELECT DISTINCT track, unnest([0, 3, 20, 44, 90, 150, 900]) AS at_ FROM o)
SELECT p.track, p.at_ AS "offset", c.file + p.at_ - c.start AS file_position FROM p LEFT JOIN c ON c.track = p.track AND p.at_ >= c.start AND p.at_ < c.start + c.size""")
def j7_chunks(spark, sf_dir):
    o = X.running_offsets(frames(spark, sf_dir), "track").select("track", (F.col("offset") + F.col("position") * 64).alias("file_position"), "size")
    p = o.select("track").distinct().select("track", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 3, 20, 44, 90, 150, 900)))).alias("offset"))
    return X.file_positions(p, X.essence_chunks(o, "track"), "track")


@query("SELECT l_suppkey AS track, l_linenumber * 3 + l_partkey % 3 AS position, max_by(l_extendedprice, l_orderkey * 1000000 + l_partkey) AS price, max(l_orderkey * 1000000 + l_partkey) AS load_order FROM (SELECT l_suppkey, l_linenumber, l_partkey, l_orderkey, CAST(max(l_quantity) AS BIGINT) AS l_extendedprice FROM lineitem GROUP BY ALL) GROUP BY 1, 2")
def w14_merge_variable(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_partkey", "l_orderkey").agg(F.max("l_quantity").cast("long").alias("offset"))
    e = li.select(F.col("l_suppkey").alias("track"), (F.col("l_linenumber") * 3 + F.col("l_partkey") % 3).alias("position"), "offset", (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("load_order"))
    return X.merge_variable_segments(e, "track").withColumnRenamed("offset", "price")


@query("""SELECT track, position, missing FROM (SELECT user_id AS track, event_id AS position, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id - 1 AS missing FROM events) WHERE missing > 0""")
def w14_gaps(spark, sf_dir):
    return X.gaps(table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("position")), "track")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS track, o_orderkey AS load_order, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT *, greatest(n - 1 - load_order % 2, 0) * 10 + CASE WHEN load_order % 61 = 0 THEN 40 ELSE 0 END AS a, CASE WHEN load_order % 53 = 0 THEN 0 ELSE 10 + load_order % 3 // 2 * 10 END AS d FROM o),
r AS (SELECT track, 0 AS n, CAST(NULL AS BIGINT) AS load_order, CAST(0 AS BIGINT) AS last_end, CAST(1 AS BIGINT) AS last_dur, 'kept' AS status FROM (SELECT DISTINCT track FROM s)
UNION ALL
SELECT s.track, s.n, s.load_order,
  CASE WHEN r.status NOT IN ('sparse', 'unread') AND r.last_dur > 0 AND s.a = r.last_end THEN s.a + s.d ELSE r.last_end END,
  CASE WHEN r.status NOT IN ('sparse', 'unread') AND r.last_dur > 0 AND s.a = r.last_end THEN s.d ELSE r.last_dur END,
  CASE WHEN r.status IN ('sparse', 'unread') THEN 'unread' WHEN r.last_dur = 0 OR s.a < r.last_end THEN 'ignored' WHEN s.a <> r.last_end THEN 'sparse' ELSE 'kept' END
FROM r JOIN s ON s.track = r.track AND s.n = r.n + 1)
SELECT track, load_order, status FROM r WHERE n > 0""")
def w15_merge_constant(spark, sf_dir):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("load_order"), n.alias("n"))
    k = F.col("load_order")
    start = F.greatest(F.col("n") - 1 - k % 2, F.lit(0)) * 10 + F.when(k % 61 == 0, 40).otherwise(0)
    s = o.select("track", "load_order", start.alias("start_position"), F.when(k % 53 == 0, 0).otherwise(10 + F.floor(k % 3 / 2) * 10).alias("duration"))
    return X.merge_constant_segments(s, "track").select("track", "load_order", "status")


@query(f"WITH {_FRAMES} SELECT track, position, position // 3 AS segment, position // 4 AS partition FROM f")
def w12_split(spark, sf_dir):
    return X.partition_of(X.split_by_size(frames(spark, sf_dir), "track", 3), 4).select("track", "position", "segment", "partition")


@query("""WITH c AS (SELECT event_id // 500 AS track, event_id % 500 AS position, event_id % 500 + [2, -1, -1, 1, -1][event_id % 5 + 1] AS display FROM events)
SELECT a.track, a.position, b.position - b.display AS temporal_offset FROM c a LEFT JOIN c b ON b.track = a.track AND b.display = a.position""")
def w13_reorder(spark, sf_dir):
    c = gop_index(spark, sf_dir).select("track", "position", (F.col("position") + F.col("temporal_offset")).alias("display"))
    return X.reorder_temporal(c, "track")


@query("""WITH e AS (SELECT l_orderkey AS track, l_linenumber % 2 AS slice, l_linenumber * 1000000 + l_partkey AS element, CAST(max(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY ALL)
SELECT track, slice, element, CAST(coalesce(sum(size) OVER (PARTITION BY track, slice ORDER BY element ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS delta FROM e""")
def w23_slices(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), (F.col("l_linenumber") % 2).alias("slice"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("element")).agg(F.max("l_quantity").cast("long").alias("size"))
    return X.slice_deltas(e, "track").select("track", "slice", "element", "delta")


@query(f"""WITH {_OFFSETS}, g AS (SELECT *, start + position // 2 * 100 AS off FROM o), m AS (SELECT *, coalesce(lag(off + size) OVER (PARTITION BY track ORDER BY position) = off, false) AS ok FROM g),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY position) AS run FROM m) SELECT track, min(position) AS position, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY track, run""")
def s7_runs(spark, sf_dir):
    o = X.running_offsets(frames(spark, sf_dir), "track").withColumn("offset", F.expr("offset + position div 2 * 100"))
    return X.contiguous_runs(o, "track")


def coded(spark, sf_dir):
    at = F.col("event_id") % 6
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") / 600).cast("int").alias("track"), (F.col("event_id") % 600).alias("position"), F.get(F.array(*map(F.lit, ("I", "B", "B", "P", "B", "B"))), at.cast("int")).alias("type"),
        F.get(F.array(*map(F.lit, (2, 0, 1, 5, 3, 4))), at.cast("int")).alias("temporal_reference"), (at == 0).alias("gop"), (F.col("event_id") % 12 == 0).alias("closed"), (at == 0).alias("sequence_header"),
    )


_CODED = """c AS (SELECT event_id // 600 AS track, event_id % 600 AS p, event_id % 6 AS a, event_id % 600 - event_id % 6 AS k, event_id % 12 < 6 AS closed FROM events)"""


@query(f"""WITH {_CODED} SELECT track, p AS position, ['I', 'B', 'B', 'P', 'B', 'B'][a + 1] AS type, CASE WHEN a = 0 THEN 0 WHEN NOT closed AND k + 2 >= p AND k > 0 THEN k - 6 - p ELSE k - p END AS key_frame_offset,
CASE WHEN a = 0 THEN 64 + CASE WHEN closed THEN 128 ELSE 0 END WHEN a = 3 THEN 34 ELSE 51 END AS flags, k + [2, 0, 1, 5, 3, 4][a + 1] AS display FROM c""")
def w20_mpeg2_index(spark, sf_dir):
    return X.mpeg2_index(coded(spark, sf_dir), "track")


@query(f"""WITH {_CODED}, g AS (SELECT track, k, count(*) AS n, bool_or(closed) AS closed FROM c GROUP BY ALL)
SELECT track, max(n) AS max_gop, bool_and(closed) AS all_closed, min(n) = max(n) AS identical_gops, CASE WHEN max(n) > 1 THEN least(2, max(n) - 1) ELSE 0 END AS max_b_run, min(n) NOT IN (2, 5) AS constant_b FROM g GROUP BY track""")
def w21_statistics(spark, sf_dir):
    return X.gop_statistics(coded(spark, sf_dir), "track")
