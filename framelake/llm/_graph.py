"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges for each task of a round, so that a small graph leaves few files.
EDGES = 100_000


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, component`` (both long) for every end of ``edges(a, b)``: the smallest node that can be reached.

    Large-star and small-star steps in turn (Kiveris et al., 2014): the number of rounds follows the logarithm of the
    component size, no step holds more rows than there are edges, and each round is checkpointed, so a lost executor
    costs one round.  Nothing but row counts and checksums reaches the driver.
    """
    from ._common import shared_dir

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before, tasks = None, -(-max(1, now.count()) // EDGES)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = small.where("a <> b").distinct().coalesce(tasks).checkpoint()
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
