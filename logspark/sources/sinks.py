"""Writing results: CSV, JSON and Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.views import decimals, sort_endpoints


def csv_rows(stats: DataFrame) -> DataFrame:
    """The columns of the CSV export, busiest endpoint first; figures as text with two decimals."""
    two = lambda c: decimals(F.col(c), 2)
    return sort_endpoints(stats).select(
        F.col("method").alias("Method"),
        F.col("path").alias("Endpoint"),
        F.col("total_calls").alias("Calls"),
        F.col("error_calls").alias("ErrorCalls"),
        two("error_rate").alias("ErrorRate(%)"),
        two("avg_duration_ms").alias("AvgDuration(ms)"),
        two("p50_ms").alias("p50(ms)"),
        two("p95_ms").alias("p95(ms)"),
        two("p99_ms").alias("p99(ms)"),
    )


def export_csv(stats: DataFrame, path: str) -> None:
    csv_rows(stats).write.mode("overwrite").option("header", True).csv(path)


def export_json(path: str, **tables: DataFrame) -> None:
    """A folder of JSON lines for each table."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def export_parquet(path: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
