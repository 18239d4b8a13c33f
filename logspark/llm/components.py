"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import cut

#: Parts of one key's rows in a join, and the rows from which a node's links are cut into parts.
SPREAD, HUB = 64, 100_000


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """rows beside the one row of side with the same key, where a key may have very many rows.

    Each key's rows are cut into `spread` parts by the hash of `by`; side goes to the parts that exist, so no part of
    the work has much more than that share of a key's rows.
    """
    cut_rows = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(spread)))
    parts = cut_rows.select(key, "_part").distinct().join(side, key)
    return cut_rows.join(parts, [key, "_part"], how).drop("_part")


def gathered(df: DataFrame, n: int, rows: int = 50_000) -> DataFrame:
    """df, of n rows, in fewer partitions: small tables need no task, and no shuffle file, for each partition of a large one."""
    return df.coalesce(max(1, n // rows))


def _stars(links: DataFrame, large: bool, hubs: bool) -> DataFrame:
    """One step: every node's neighbours are linked to the least node around it."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = spread_join(both, least, "u", "v") if hubs else both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the least node of its component.

    Links may be repeated, in any direction, or from a node to itself (that node alone gets no row).  Each round is
    written to the checkpoint folder, so a lost executor costs one round.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = gathered(now, now.count())
    mark = None
    for _ in range(most_rounds):
        # Links end in the smaller node, where they gather.
        hubs = (now.groupBy("b").count().agg(F.max("count")).first()[0] or 0) > HUB
        half = cut(_stars(now, True, hubs))
        now = cut(_stars(gathered(half, half.count()), False, hubs).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
        now = gathered(now, mark[0])
    else:
        raise RuntimeError("the links did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
