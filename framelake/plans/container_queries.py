"""Container files made up from orders (a file each, line items as tracks and as frames): built, parsed, joined, and compared by SQL."""

from __future__ import annotations

import functools
import itertools
import struct

from pyspark.sql import functions as F

from ..operators import packages as H
from ..sources import containers as X
from ..sources import klv
from .byte_queries import each
from .frame_queries import _FRAMES, frames, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_KINDS = ("0103020201", "0103020202", "0103020203")
_RUN_IN = b"run-in"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def files(spark, sf_dir):
    """track, sizes: the frames' sizes in order (a few line items an order)."""
    f = frames(spark, sf_dir).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("position", "size"))).alias("f"))
    return f.select("track", F.col("f.size").alias("sizes"))


#: Stands for the order's number in pieces of files that are made once and filled in.
_MARK = bytes.fromhex("f1d2c3b4a5968778")
_LABELS = [bytes.fromhex("060e2b3404010101" + k + "000000") for k in _KINDS]


def _label(k: int) -> bytes:
    return _LABELS[k % 3]


def _one(kind: int, k: int = 0) -> bytes:
    return _MARK + struct.pack(">II", kind, k)


def _uid(kind: int) -> bytes:
    return bytes(12) + _one(kind) + bytes(4)


@functools.lru_cache(maxsize=1024)
def _packages(n: int) -> bytes:
    """The sets that stand for a whole file of ``n`` tracks."""
    t = H.TAGS
    made = [
        X.build_primer({t["package_uid"]: bytes(16)}),
        X.build_set("preface", _one(1), []),
        X.build_set("material package", _one(2), [(t["package_uid"], _uid(2)), (t["tracks"], X.batch([_one(3, k) for k in range(n)]))]),
        X.build_set("source package", _one(4), [(t["package_uid"], _uid(4)), (t["tracks"], X.batch([_one(5, k) for k in range(n)])), (t["descriptor"], _one(6, 0 if n > 1 else 1))]),
    ]
    if n > 1:
        made.append(X.build_set("multiple descriptor", _one(6), [(t["descriptors"], X.batch([_one(6, k + 1) for k in range(n)]))]))
    return b"".join(made)


@functools.lru_cache(maxsize=4096)
def _track(k: int, size: int) -> bytes:
    """The sets of a track."""
    t, rate = H.TAGS, struct.pack(">ii", 25, 1)
    at, i4 = struct.pack(">q", k), lambda x: struct.pack(">I", x)
    shape = [(t["width"], i4(size)), (t["height"], i4(576))] if k % 3 == 0 else [(t["sampling_rate"], struct.pack(">ii", 48000, 1)), (t["channels"], i4(size))] if k % 3 == 1 else []
    kind = ("cdci descriptor", "wave descriptor", "data descriptor")[k % 3]
    parts = [_one(8, k)] * (size % 2 == 0) + [_one(9, k)]
    return b"".join([
        X.build_set(kind, _one(6, k + 1), [(t["linked_track"], i4(k + 1)), *shape]),
        X.build_set("track", _one(3, k), [(t["track_id"], i4(100 + k)), (t["track_number"], i4(0)), (t["edit_rate"], rate), (t["origin"], struct.pack(">q", 0)), (t["sequence"], _one(7, k))]),
        X.build_set("track", _one(5, k), [(t["track_id"], i4(k + 1)), (t["track_number"], i4(0x15010500 + k)), (t["edit_rate"], rate), (t["origin"], at), (t["sequence"], _one(10, k))]),
        X.build_set("sequence", _one(7, k), [(t["definition"], _label(k)), (t["components"], X.batch(parts))]),
        X.build_set("filler", _one(8, k), [(t["duration"], struct.pack(">q", size))]),
        X.build_set("source clip", _one(9, k), [(t["definition"], _label(k)), (t["start"], at), (t["duration"], struct.pack(">q", -1 if k == 2 else size)), (t["source_uid"], _uid(4)), (t["source_track"], i4(k + 1 if k < 5 else 99))]),
    ])


@functools.lru_cache(maxsize=4096)
def _element(k: int, size: int) -> bytes:
    return klv.build(bytes.fromhex("060e2b34010201010d010301") + (0x15010500 + k).to_bytes(4, "big"), bytes([k]) * size)


def container(order: int, sizes: list[int]) -> bytes:
    """A file with a material and a source package of one track for each frame, an index, essence, and a footer.

    A track has lead filler if its frame's size is even, and a descriptor among several if there are several tracks.  Sets and elements of the same content are made
    once and filled in with the order's number.
    """
    n = range(len(sizes))
    header = b"".join([_packages(len(sizes)), *(_track(k, size) for k, size in enumerate(sizes))]).replace(_MARK, struct.pack(">Q", order))
    at = [0, *itertools.accumulate(size + 21 for size in sizes)]
    index = X.build_index(25, 1, 0, len(sizes), 1, 2, entries=[(0, -k, 0x80 if k == 0 else 0, at[k]) for k in n]) + klv.build(X.INDEX, b"broken")
    essence = b"".join([_element(k, size) for k, size in enumerate(sizes)])
    pack = dict(pattern=_label(0), essence=[_label(0), _label(1)])
    body_at = len(_RUN_IN) + _PACK_BYTES + len(header)
    body = X.build_partition("body", this=body_at, index_sid=1, index_bytes=len(index), body_sid=2, **pack)
    foot_at = body_at + len(body) + len(index) + len(essence)
    head = X.build_partition("header", footer=foot_at, header_bytes=len(header), **pack)
    return _RUN_IN + head + header + body + index + essence + X.build_partition("footer", this=foot_at, previous=body_at, footer=foot_at, **pack)


_PACK_BYTES = len(X.build_partition("header", essence=[bytes(16)] * 2))


def parsed(spark, sf_dir, parse, schema):
    def run(row):
        return ({"track": row[0], **r} for r in parse(container(row[0], row[1])))

    return each(files(spark, sf_dir), run, f"track long, {schema}")


@query(f"""WITH {_FRAMES}, n AS (SELECT track, count(*) AS n, sum(size) AS bytes FROM f GROUP BY track)
SELECT track, kind, CASE kind WHEN 'body' THEN 2 ELSE 0 END AS body_sid, CASE kind WHEN 'body' THEN 1 ELSE 0 END AS index_sid, 2 AS containers,
CASE kind WHEN 'body' THEN 150 + 11 * n ELSE 0 END AS index_bytes, CASE kind WHEN 'footer' THEN 141 + 150 + 32 * n + bytes ELSE 0 END AS since FROM n, (SELECT unnest(['header', 'body', 'footer']) AS kind)""")
def s1_partitions(spark, sf_dir):
    """Partition packs; ``since`` is how far a footer lies behind the partition that it names as the previous one."""
    p = parsed(spark, sf_dir, X.partitions, X.PACKS)
    since = F.when(F.col("kind") == "footer", F.col("this_partition") - F.col("previous")).otherwise(F.lit(0).cast("long"))
    return p.select("track", "kind", "body_sid", "index_sid", F.size("containers").cast("long").alias("containers"), "index_bytes", since.alias("since"))


@query(f"""WITH {_FRAMES} SELECT track, position AS at, position + 100 AS track_id, ['picture', 'sound', 'data'][position % 3 + 1] AS kind, 25 AS num, position AS start, CASE WHEN position = 2 THEN -1 ELSE size END AS duration,
CASE WHEN size % 2 = 0 THEN size ELSE 0 END AS lead, CASE WHEN position < 5 THEN 352388352 + position END AS file_track_number, CASE WHEN position < 5 THEN position END AS file_origin,
CASE WHEN position < 5 AND position % 3 = 0 THEN size END AS width, CASE WHEN position < 5 AND position % 3 = 1 THEN size END AS channels, CASE WHEN position < 5 AND position % 3 = 1 THEN 48000 END AS sampling_rate FROM f""")
def s3_tracks(spark, sf_dir):
    """Sets are followed where they are parsed, so none is shuffled or stored."""
    t = parsed(spark, sf_dir, lambda data: H.tracks_of(X.sets(data)), H.TRACKS)
    return t.select("track", F.col("at").cast("long").alias("at"), "track_id", "kind", F.col("edit_rate.num").alias("num"), "start", "duration", "lead", "file_track_number", "file_origin", "width", "channels", F.col("sampling_rate.num").alias("sampling_rate"))


@query(f"""WITH {_FRAMES} SELECT track, position, -position AS key_frame_offset, CASE WHEN position = 0 THEN 128 ELSE 0 END AS flags,
coalesce(sum(size + 21) OVER (PARTITION BY track ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stream_offset FROM f""")
def s11_index(spark, sf_dir):
    e = H.index_entries(parsed(spark, sf_dir, X.index_segments, X.SEGMENTS), ["track"])
    return e.select("track", "position", "key_frame_offset", "flags", "stream_offset")


@query(f"""WITH {_FRAMES} SELECT track, 352388352 + position AS track_number, 2 AS body_sid, size,
coalesce(sum(size + 21) OVER (PARTITION BY track ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stream_offset FROM f""")
def s5_elements(spark, sf_dir):
    return parsed(spark, sf_dir, X.elements, X.ELEMENTS).select("track", "track_number", "body_sid", "size", "stream_offset")


@query("""SELECT event_id, CASE n WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 25 ELSE 30000 END END AS num, CASE n WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE 1001 END END AS den,
CASE WHEN n = 0 AND event_id % 3 > 0 THEN printf('%016X', event_id) END AS creation, CASE WHEN n = 0 AND event_id % 3 = 1 THEN printf('%016X', event_id + 1) END AS user,
CASE n WHEN 2 THEN event_id % 4 END AS timecodes, CASE n WHEN 1 THEN 'mark é' || event_id END AS mark, CASE n WHEN 1 THEN event_id % 2 * 32 + 32 END AS umid
FROM events, (SELECT unnest([0, 1, 2]) AS n)""")
def s26_system(spark, sf_dir):
    """A system pack, package metadata and an array of codes for each event; stamps are there by flags, which a third lacks."""

    def parse(row):
        n = row[0]
        stamp = lambda x: b"\x81" + x.to_bytes(8, "big") + bytes(8)
        flags, rate = (0x00, 0x10, 0x20)[n % 3], 2 << 1 if n % 2 == 0 else 3 << 1 | 1
        pack = bytes([flags, rate]) + bytes(21) + stamp(n) + stamp(n + 1)
        key, coding = list(X.MARKS.items())[n % 2]
        mark = klv.build(key, f"mark é{n}".encode(coding))
        items = b"\x83" + struct.pack(">H", 32 + 32 * (n % 2)) + bytes(32 + 32 * (n % 2)) + b"\x88" + struct.pack(">H", len(mark)) + mark
        codes = X.build_local(X.SYSTEM_SCHEME + b"\x01\x00", [(0x0101, bytes(4)), (0x0102, X.batch([bytes(8)] * (n % 4), 8))])
        data = X.build_partition("header") + klv.build(X.SYSTEM_PACK, pack) + klv.build(X.PACKAGE_ITEM + b"\x00", items) + codes
        return ({"event_id": n, **r} for r in X.system_items(data))

    e = each(table(spark, sf_dir, "events").select("event_id"), parse, f"event_id long, {X.SYSTEM}")
    return e.select("event_id", "num", "den", F.hex("creation").alias("creation"), F.hex("user").alias("user"), F.when(F.col("timecodes").isNotNull(), F.size("timecodes")).cast("long").alias("timecodes"), "mark", F.length("umid").cast("long").alias("umid"))


def with_events(customer: int, orders: list[tuple[int, str]]) -> bytes:
    """A file with a timecode track (dropping for every third customer) that refers to its component directly, an event track with an event for each order, and a static track."""
    one = lambda kind, k=0: struct.pack(">QII", customer, kind, k)
    t, i4, i8 = H.TAGS, lambda x: struct.pack(">I", x), lambda x: struct.pack(">q", x)
    wide = lambda x: x.encode("utf-16-be") + b"\0\0"
    base, drop = (30, 1) if customer % 3 == 0 else (25, 0)
    made = [
        X.build_primer({t["package_uid"]: bytes(16)}),
        X.build_set("material package", one(1), [(t["package_uid"], bytes(24) + i8(customer)), (t["tracks"], X.batch([one(2), one(3), one(4)]))]),
        X.build_set("track", one(2), [(t["track_id"], i4(901)), (t["edit_rate"], struct.pack(">ii", 30000 if drop else 25, 1001 if drop else 1)), (t["origin"], i8(2)), (t["sequence"], one(5))]),
        X.build_set("timecode", one(5), [(t["duration"], i8(-1)), (t["tc_start"], i8(customer * 7)), (t["tc_base"], struct.pack(">H", base)), (t["tc_drop"], bytes([drop]))]),
        X.build_set("event track", one(3), [(t["track_id"], i4(902)), (t["event_rate"], struct.pack(">ii", 25, 1)), (t["event_origin"], i8(0)), (t["sequence"], one(6))]),
        X.build_set("sequence", one(6), [(t["components"], X.batch([one(7, k) for k in range(len(orders))]))]),
        *(X.build_set("dm segment", one(7, k), [(t["duration"], i8(1)), (t["event_start"], i8(order)), (t["event_comment"], wide(name))]) for k, (order, name) in enumerate(orders)),
        X.build_set("static track", one(4), [(t["track_id"], i4(903)), (t["sequence"], one(8))]),
        X.build_set("sequence", one(8), [(t["components"], X.batch([one(9)]))]),
        X.build_set("dm segment", one(9), [(t["event_comment"], wide("static"))]),
    ]
    header = b"".join(made)
    return X.build_partition("header", header_bytes=len(header)) + header


@query("""WITH o AS (SELECT o_custkey AS file, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders), c AS (SELECT DISTINCT o_custkey AS file FROM orders)
SELECT file, 0 AS at, 901 AS track_id, 'track' AS form, CASE WHEN file % 3 = 0 THEN 30000 ELSE 25 END AS num, 2 AS origin, 0 AS n, 'timecode' AS part, file * 7 AS start, -1 AS duration, CASE WHEN file % 3 = 0 THEN 30 ELSE 25 END AS base, file % 3 = 0 AS drop_, NULL AS comment FROM c
UNION ALL SELECT file, 1, 902, 'event track', 25, 0, n, 'dm segment', o_orderkey, 1, NULL, NULL, o_orderpriority FROM o UNION ALL SELECT file, 2, 903, 'static track', NULL, NULL, 0, 'dm segment', NULL, NULL, NULL, NULL, 'static' FROM c""")
def s3_other_tracks(spark, sf_dir):
    """Timecode, event and static tracks; an event for each order of a customer."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o"))
    rows = o.select("o_custkey", F.transform("o", lambda x: F.struct(x["o_orderkey"].alias("k"), x["o_orderpriority"].alias("p"))).alias("o"))
    parse = lambda row: ({"file": row[0], **r} for r in X.properties(with_events(row[0], [(x["k"], x["p"]) for x in row[1]])))
    t = H.other_tracks(each(rows, parse, f"file long, {X.PROPERTIES}"), "file")
    return t.select("file", F.col("at").cast("long").alias("at"), "track_id", "form", F.col("rate.num").alias("num"), "origin", F.col("n").cast("long").alias("n"), "part", "start", "duration", "base", F.col("drop").alias("drop_"), "comment")
