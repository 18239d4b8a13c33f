"""A relative-error histogram for quantiles: buckets between powers of GAMMA.

Bucket counts add up, so histograms merge by sums: over partitions, over
groups, over batches of a stream.  A bucket's middle is within 1 % of all
its values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAMMA = 1.01 / 0.99
LEAST, MOST = -400, 799
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def bucket(value: Column) -> Column:
    """Bucket number; null for values that are not positive and finite."""
    v = value.cast("double")
    number = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.log(v) / math.log(GAMMA)).cast("int")))
    return F.when((v > 0) & (v < F.lit(float("inf"))), number)


def bucket_value(number: Column) -> Column:
    return F.pow(F.lit(GAMMA), number - 0.5)


def quantile_bucket(histogram: Column, q: float) -> Column:
    """The bucket of quantile q in a sorted array of struct(bucket, n): the first whose running count exceeds q * (n - 1).

    At most MOST - LEAST + 1 buckets; null for an empty histogram.
    """
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda s, h: s + h["n"])
    if q >= 1:
        return F.try_element_at(histogram, F.lit(-1))["bucket"]
    target = F.lit(float(max(q, 0.0))) * (total - 1)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"), target.alias("target"))

    def step(s: Column, h: Column) -> Column:
        seen = s["seen"] + h["n"]
        found = F.when(s["at"].isNotNull(), s["at"]).when(seen > s["target"], h["bucket"])
        return F.struct(seen.alias("seen"), found.alias("at"), s["target"].alias("target"))

    return F.aggregate(histogram, start, step)["at"]


def quantile(histogram: Column, q: float) -> Column:
    """The quantile's value, 0 for an empty histogram."""
    return F.coalesce(bucket_value(quantile_bucket(histogram, q)), F.lit(0.0))


def exact_quantile(values: Column, q: float) -> Column:
    """From an array of all values, by the same rank rule; for small groups and tests."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(q * (F.size(values) - 1)).cast("int"))


def exact_quantiles(rows: DataFrame, by: str, value: str, folder: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """`by` and the exact p50, ... of each group's values by the same rank rule, null for a group without values.

    No group gathers in a task: values are counted, the counts are dealt out
    in order of group and value, and a wanted rank is sought only in the part
    of its group where running sums over parts place it.  The ordered counts
    are written to `folder`, so that both passes see the same parts.
    """
    counts = rows.groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count(value).alias("n"))
    counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()).write.parquet(folder)
    placed = rows.sparkSession.read.parquet(folder)
    group = Window.partitionBy("g")
    parts = placed.groupBy("g", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "part", "n", before.alias("before"), F.sum("n").over(group).alias("total"))
    ranks = {f"p{round(q * 100)}": F.floor(F.lit(q) * (F.col("total") - 1)) for q in quantiles}

    def inside(rank: Column) -> Column:
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))

    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | inside(rank)
    found = parts.where(wanted).select(F.col("g").alias("g2"), F.col("part").alias("part2"), F.col("before").alias("first"), "total")
    near = placed.join(found, F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2"))).select("g", "part", "v", "n", "first", "total")
    running = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("before", F.col("first") + running - F.col("n"))
    chosen = near.groupBy("g").agg(*(F.max(F.when(inside(rank), F.col("v"))).alias(name) for name, rank in ranks.items()))
    empty = parts.where(F.col("total") == 0).select("g", *(F.lit(None).cast(rows.schema[value].dataType).alias(name) for name in ranks)).distinct()
    return chosen.unionByName(empty).withColumnRenamed("g", by)
