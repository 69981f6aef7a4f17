"""Text inputs: property files, manifests, audio ids and segmentation lists, read line by line in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, number, line`` (from 0) of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n", -1).alias("_l"))
    return whole.select("path", F.posexplode("_l").alias("number", "line"))


def properties(text: DataFrame) -> DataFrame:
    """``name: value`` lines; a ``#`` at the start makes a comment, and a value goes to the line's end."""
    named = text.where(F.col("line").rlike(r"^\s*[^#\s:][^:]*:"))
    return named.select("path", "number", F.trim(F.regexp_extract("line", r"^([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))


def blocks(text: DataFrame) -> DataFrame:
    """Lines with the number of their block; blank lines part blocks."""
    blank = F.trim("line") == ""
    w = Window.partitionBy("path").orderBy("number")
    starts = (~blank & F.coalesce(F.lag(blank).over(w), F.lit(True))).cast("int")
    return text.withColumn("_s", starts).withColumn("block", F.sum("_s").over(w) - 1).where(~blank).drop("_s")


def audio_ids(text: DataFrame) -> DataFrame:
    """Blocks of track_index, uid, track_ref and pack_ref as rows."""
    named = blocks(text).join(properties(text), ["path", "number"])
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    rows = named.groupBy("path", "block").agg(*map(value, ("track_index", "uid", "track_ref", "pack_ref")))
    return rows.withColumn("track_index", F.expr("try_cast(track_index as int)"))


def timed_text_manifest(text: DataFrame) -> DataFrame:
    """One row per file: file, profile, encoding, languages."""
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    rows = properties(text).groupBy("path").agg(*map(value, ("file", "profile", "encoding", "languages")))
    return rows.withColumn("languages", F.transform(F.split("languages", ","), lambda x: F.trim(x)))


def segmentation(text: DataFrame) -> DataFrame:
    """``part/total  start  duration`` lines."""
    pattern = r"^\s*(\d{1,9})/(\d{1,9})\s+(\S+)\s+(\S+)\s*$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    hits = text.where(F.col("line").rlike(pattern))
    return hits.select("path", "number", part(1).cast("int").alias("part"), part(2).cast("int").alias("total"), part(3).alias("start"), part(4).alias("duration"))
