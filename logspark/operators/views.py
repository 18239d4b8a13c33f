"""Sorted tables, top lists, cards and reports over the summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names by sort key.
SORTS = {"path": "path", "method": "method", "calls": "total_calls", "error_rate": "error_rate", "avg": "avg_duration_ms", "p50": "p50_ms", "p95": "p95_ms", "p99": "p99_ms"}


def sort_endpoints(stats: DataFrame, by: str = "calls", ascending: bool = False) -> DataFrame:
    """Ties by path and method."""
    key = F.col(SORTS[by])
    return stats.orderBy(key.asc() if ascending else key.desc(), "path", "method")


def top_endpoints(stats: DataFrame, most: int = 10) -> DataFrame:
    """The busiest endpoints with their p95."""
    return sort_endpoints(stats).limit(most).select("path", "method", "total_calls", "p95_ms")


def decimals(value: Column, places: int) -> Column:
    """Rounded half away from zero, as text."""
    return F.format_string(f"%.{places}f", F.round(value.cast("double"), places))


def overall_severity(rate: Column) -> Column:
    return F.when(rate > 5, "red").when(rate > 1, "amber").otherwise("green")


def endpoint_severity(rate: Column) -> Column:
    return F.when(rate > 5, "red").when(rate > 0, "amber").otherwise("green")


def endpoint_view(stats: DataFrame) -> DataFrame:
    figures = {"error_rate": "error_rate", "avg": "avg_duration_ms", "p50": "p50_ms", "p95": "p95_ms", "p99": "p99_ms"}
    return stats.select("method", "path", F.col("total_calls").alias("calls"), *(decimals(F.col(c), 1).alias(n) for n, c in figures.items()), endpoint_severity(F.col("error_rate")).alias("severity"))


def cron_view(stats: DataFrame) -> DataFrame:
    status = F.col("last_status")
    colour = F.when(status == "success", "green").when(status == "failed", "red").otherwise("grey")
    return stats.select("name", F.col("total_runs").alias("runs"), F.col("total_success").alias("successes"), F.col("total_failures").alias("failures"), decimals(F.col("avg_duration_ms"), 1).alias("avg"), "last_status", colour.alias("colour"))


def percentile_curve(summary: DataFrame) -> DataFrame:
    """(percentile, value_ms) from the overall summary."""
    return summary.select(F.expr("stack(4, 50, p50_ms, 90, p90_ms, 95, p95_ms, 99, p99_ms) as (percentile, value_ms)"))


def byte_size(n: Column) -> Column:
    """B, KiB, MiB or GiB with two decimals."""
    unit = lambda power: decimals(n / float(1 << (10 * power)), 2)
    return F.when(n >= 1 << 30, F.concat(unit(3), F.lit(" GiB"))).when(n >= 1 << 20, F.concat(unit(2), F.lit(" MiB"))).when(n >= 1 << 10, F.concat(unit(1), F.lit(" KiB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def kpi_cards(counts: DataFrame, size: DataFrame, summary: DataFrame, endpoints: DataFrame, crons: DataFrame) -> DataFrame:
    """Five rows (title, value, subtitle).  counts, size (n_bytes), summary: one row each; the others are counted."""
    one = counts.crossJoin(size).crossJoin(summary).crossJoin(endpoints.agg(F.count("*").alias("n_endpoints"))).crossJoin(crons.agg(F.count("*").alias("n_jobs")))
    text = lambda c: F.col(c).cast("string")
    cards = [
        (F.lit("Total ingested"), byte_size(F.col("n_bytes")), F.concat(text("total_lines"), F.lit(" lines, "), text("unmatched_lines"), F.lit(" unmatched"))),
        (F.lit("HTTP requests"), text("total_requests"), F.concat(text("n_endpoints"), F.lit(" endpoints"))),
        (F.lit("Error rate"), F.concat(decimals(F.col("error_rate"), 2), F.lit("%")), F.concat(text("total_errors"), F.lit(" errors"))),
        (F.lit("Latency p95"), F.concat(decimals(F.col("p95_ms"), 1), F.lit(" ms")), F.concat(F.lit("p50 "), decimals(F.col("p50_ms"), 1), F.lit(" ms, p99 "), decimals(F.col("p99_ms"), 1), F.lit(" ms"))),
        (F.lit("Cron events"), text("cron_lines"), F.concat(text("n_jobs"), F.lit(" jobs"))),
    ]
    rows = F.array(*(F.struct(F.lit(k + 1).alias("card"), a.alias("title"), b.alias("value"), c.alias("subtitle")) for k, (a, b, c) in enumerate(cards)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def endpoint_report(stats: DataFrame) -> DataFrame:
    """Busiest first, then a row Total with calls and errors; no total without endpoints."""
    figures = [F.round(c, 3).alias(n) for n, c in (("avg_ms", F.col("avg_duration_ms")), *((f"p{q}_ms", F.col(f"p{q}_ms").cast("double")) for q in (50, 90, 95, 99)))]
    detail = stats.select(F.lit(0).alias("section"), "method", F.col("path").alias("endpoint"), F.col("total_calls").alias("calls"), *figures, F.col("error_calls").alias("errors"))
    total = stats.agg(F.lit(1).alias("section"), F.lit("Total").alias("method"), F.sum("total_calls").alias("calls"), F.sum("error_calls").alias("errors")).where(F.col("calls").isNotNull())
    return detail.unionByName(total, allowMissingColumns=True).orderBy("section", F.desc("calls"), "endpoint", "method")


def cron_report(stats: DataFrame) -> DataFrame:
    """Jobs by name, then a row Total with runs and failures; no rows without jobs."""
    status = F.when(F.col("last_status") == "", "-").otherwise(F.col("last_status"))
    detail = stats.select(F.lit(0).alias("section"), F.col("name").alias("job"), F.col("total_runs").alias("runs"), F.col("total_starts").alias("starts"), F.col("total_failures").alias("fails"), F.round("avg_duration_ms", 3).alias("avg_ms"), F.round(F.col("min_duration_ms").cast("double"), 3).alias("min_ms"), F.round(F.col("max_duration_ms").cast("double"), 3).alias("max_ms"), status.alias("last_status"))
    total = stats.agg(F.lit(1).alias("section"), F.lit("Total").alias("job"), F.sum("total_runs").alias("runs"), F.sum("total_failures").alias("fails")).where(F.col("runs").isNotNull())
    return detail.unionByName(total, allowMissingColumns=True).orderBy("section", "job")


def report_metadata(endpoints: DataFrame, crons: DataFrame) -> DataFrame:
    """One row: when, how many endpoints and jobs."""
    return endpoints.agg(F.count("*").alias("endpoints")).crossJoin(crons.agg(F.count("*").alias("jobs"))).withColumn("generated", F.current_timestamp())
