"""A latency histogram as one stored column: struct(version, first, counts).

`counts` holds the numbers of the buckets first, first + 1, ... of
functions/histogram.py, without empty ones at either end; at most MOST - LEAST
+ 1 of them, so a sketch has a bound whatever it has counted.  Sketches are
made from bucket counts, merged (two by an expression, a group by sums), and
asked for quantiles.  An empty one has first null and no counts.  A stored
sketch of another version is refused by `checked`: its buckets would mean other
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import histogram

#: Changes with the bounds of buckets (histogram.GAMMA, LEAST, MOST).
VERSION = 1
TYPE = "struct<version: int, first: int, counts: array<bigint>>"


def _made(first: Column, counts: Column) -> Column:
    return F.struct(F.lit(VERSION).alias("version"), first.cast("int").alias("first"), counts.cast("array<bigint>").alias("counts"))


def checked(sketch: Column) -> Column:
    """The sketch, if it has this version; else the job fails."""
    return F.when(sketch["version"] == VERSION, sketch).when(sketch.isNotNull(), F.raise_error(F.concat(F.lit("a sketch of version "), sketch["version"].cast("string"))).cast(TYPE))


def of_cells(cells: Column) -> Column:
    """From a sorted array of struct(bucket, n), each bucket once."""
    first, zero = F.get(cells, 0)["bucket"], F.lit(0).cast("bigint")
    gap = lambda c, k: c["bucket"] - F.coalesce(F.get(cells, k - 1)["bucket"], first - 1) - 1
    one = F.transform(cells, lambda c: c["n"].cast("bigint"))  # of one cell, as most groups of a long tail have
    dense = F.flatten(F.transform(cells, lambda c, k: F.concat(F.array_repeat(zero, gap(c, k)), F.array(c["n"].cast("bigint")))))
    return F.when(F.size(cells) == 1, _made(first, one)).when(F.size(cells) > 0, _made(first, dense)).otherwise(_made(F.lit(None), F.array()))


def cells(sketch: Column) -> Column:
    """The sorted array of struct(bucket, n) of buckets that have counted."""
    pairs = F.transform(sketch["counts"], lambda n, k: F.struct((sketch["first"] + k).alias("bucket"), n.alias("n")))
    return F.filter(pairs, lambda c: c["n"] > 0)


def merge(a: Column, b: Column) -> Column:
    """Both counted together."""
    low, high = F.least(a["first"], b["first"]), F.greatest(a["first"] + F.size(a["counts"]), b["first"] + F.size(b["counts"])) - 1
    zero = F.lit(0).cast("bigint")
    at = lambda s, k: F.coalesce(F.get(s["counts"], k - s["first"]), zero)
    both = _made(low, F.transform(F.sequence(low, high), lambda k: at(a, k) + at(b, k)))
    return F.when(F.size(a["counts"]) == 0, b).when(F.size(b["counts"]) == 0, a).otherwise(both)


def count(sketch: Column) -> Column:
    return F.aggregate(sketch["counts"], F.lit(0).cast("bigint"), lambda s, n: s + n)


def quantile(sketch: Column, q: float) -> Column:
    """As histogram.quantile: within 1 % of the exact value of its rank, 0 for an empty sketch."""
    return histogram.quantile(cells(sketch), q)


def aggregate(rows: DataFrame, keys: list[str], buckets: str = "bucket", n: str = "n", name: str = "sketch") -> DataFrame:
    """One sketch for each key from rows of bucket counts (null buckets count nothing): partial sums before the shuffle."""
    counted = rows.groupBy(*keys, F.col(buckets).alias("_b")).agg(F.sum(n).alias("_n"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct(F.col("_b").alias("bucket"), F.col("_n").alias("n")))))
    return counted.groupBy(*keys).agg(of_cells(pairs).alias(name))


def merge_groups(rows: DataFrame, keys: list[str], name: str = "sketch") -> DataFrame:
    """One sketch for each key from rows of sketches; a group's sketches are added up bucket by bucket, never gathered."""
    flat = rows.select(*keys, F.explode_outer(cells(checked(F.col(name)))).alias("_c"))
    return aggregate(flat.select(*keys, F.col("_c.bucket").alias("_bucket"), F.col("_c.n").alias("_count")), keys, "_bucket", "_count", name)
