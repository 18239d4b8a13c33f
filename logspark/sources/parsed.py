"""The parsed table: lines are classified once and stored; all later queries read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.paths import COLLAPSE_IDS, normalize_path
from logspark.operators.classify import FIELDS


def save_parsed(classified: DataFrame, path: str) -> None:
    """classified lines as Parquet, a folder for each kind, with norm_path beside path.

    order_key and line_no are kept if they are there; the text is kept where nothing else says what stood in the line.
    """
    keep = [c for c in ("line_no", "order_key") if c in classified.columns]
    text = F.when(F.col("kind") == "unmatched", F.col("text")).alias("text")
    norm = normalize_path(F.col("path"), COLLAPSE_IDS).alias("norm_path")
    classified.select(*keep, *(c for c in FIELDS if c != "text"), text, norm).write.mode("overwrite").partitionBy("kind").parquet(path)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """What save_parsed has written.  Filters on kind leave out folders, those on fields reach the scan."""
    return spark.read.option("basePath", path).parquet(path)
