import datetime

from framelake.operators import events
from framelake.streaming import tail, text


def feed(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def test_description_text_over_batches(spark, tmp_path):
    schema = "program long, position long, ch int"
    said = [2, *map(ord, "MAIN"), 0, 3, ord("X")]
    rows = [(p, k, c) for p in (1, 2) for k, c in enumerate(said if p == 1 else said[:4])]
    for k in range(0, len(said), 3):
        feed(spark, tmp_path / "in", k, [r for r in rows if k <= r[1] < k + 3] or [(9, 0, 0)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = text.description_stream(stream).writeStream.format("memory").queryName("described").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    want = {r.program: (r.text, r.complete) for r in events.description_text(spark.createDataFrame(rows, schema), ["program"]).collect()}
    got = {p: max(((r.text, r.complete) for r in spark.table("described").where(f"program = {p}").collect()), key=lambda x: len(x[0])) for p in (1, 2)}
    assert got == want == {1: ("\x02MAIN\x03", True), 2: ("\x02MAI", False)}


def test_crc_counters_and_packages(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "clip int, position long, track int, payload string, stored_crc long, ts timestamp"
    rows = [(1, p, t, f"{p}", None if p == 3 else 0, at + datetime.timedelta(seconds=p)) for p in range(6) for t in (0, 1) if (p, t) != (4, 1)]
    for p in range(6):
        feed(spark, tmp_path / "in", p, [r for r in rows if r[1] == p], schema)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = tail.crc_counters(read(), "clip", "track").writeStream.format("memory").queryName("counters").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("counters").collect()) == [(1, 0, 6, 5, 5), (1, 1, 5, 4, 4)]
    joined = tail.join_package(read().where("track = 0"), read().where("track = 1"), "clip").selectExpr("a.position as position")
    query = joined.writeStream.format("memory").queryName("packages").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.position for r in spark.table("packages").collect()) == [0, 1, 2, 3, 5]
