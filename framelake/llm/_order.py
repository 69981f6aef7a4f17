"""Running sums and dense names over groups of any size: no group has to fit into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import materialize

#: A key is frequent that holds over one in so many of all rows, so fewer than these are.
FREQUENT = 1000


def running(spark: SparkSession, df: DataFrame, group: str, order: list[Column], values: list[str], label: str) -> DataFrame:
    """``df`` with ``upto_<value>`` for each of ``values`` (longs, none null): its sum over the rows of ``group`` (a long) up to this one.

    Rows are dealt by ranges of group and order, so a large group spans many tasks; ranges are drawn from a sample first, so ``df`` is read twice and should be stored if
    it is costly.  Sums within a range come first; then
    those groups that reach into a further range get the totals of the ranges before, a row or two for each range.
    """
    names = [f"upto_{v}" for v in values]
    schema = T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in names)])

    def run(batches):
        part, last, held = TaskContext.get().partitionId(), None, np.zeros(len(values), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(group).to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1))
            sizes, out = np.diff(np.append(starts, len(groups))), []
            for k, v in enumerate(values):
                upto = np.cumsum(batch.column(v).to_numpy())
                before = np.concatenate(([0], upto))[starts]
                before[0] -= held[k] if groups[0] == last else 0
                out.append(upto - np.repeat(before, sizes))
            last, held = groups[-1], np.array([x[-1] for x in out])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(groups), part, dtype=np.int32)), *map(pa.array, out)], names=schema.names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    stored = materialize(spark, ranged.mapInArrow(run, schema), label)
    first = stored.groupBy("range").agg(F.min(group).alias(group)).select(group).distinct()  # no more rows than there are ranges
    totals = stored.join(F.broadcast(first), group).groupBy(group, "range").agg(*(F.sum(v).alias(f"all_{v}") for v in values))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(group, "range", *(F.sum(f"all_{v}").over(earlier).alias(f"before_{v}") for v in values)).where(F.col(f"before_{values[0]}").isNotNull())
    placed = stored.join(F.broadcast(before), [group, "range"], "left")  # a row or two for each range
    return placed.select(*df.columns, *((F.col(f"upto_{v}") + F.coalesce(f"before_{v}", F.lit(0))).alias(f"upto_{v}") for v in values))


def named(spark: SparkSession, rows: DataFrame, keys: list[str], label: str, *more: Column) -> DataFrame:
    """``rows`` without ``keys`` but with ``name`` (longs from 0 without gaps, one for each distinct key), ``held`` (its rows) and the aggregates ``more``.

    ``rows`` should be stored, as they are read three times.  Keys are counted before they are shuffled; names of frequent keys are
    broadcast (fewer than ``FREQUENT``), so that the shuffle for the others meets no hot key.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("held"), *more)
    schema = T.StructType([*counted.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n))], names=schema.names)
            at += n

    stored = materialize(spark, counted.mapInArrow(number, schema), label)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    names = stored.join(F.broadcast(parts), "part").withColumn("name", F.col("start") + F.col("at")).drop("part", "at", "start")  # a row for each partition
    total = stored.agg(F.sum("held")).first()[0] or 0
    frequent = F.col("held") * FREQUENT > total
    hot = F.broadcast(names.where(frequent))
    often = rows.join(hot, keys)
    seldom = rows.join(hot.select(*keys), keys, "left_anti").join(names.where(~frequent), keys)
    return often.unionByName(seldom).drop(*keys)
