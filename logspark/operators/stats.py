"""Statistics of endpoints, of all requests, and of cron jobs.

One shuffle carries the data: requests are counted by endpoint, method and
histogram bucket, with partial sums on the map side, so a hot endpoint is no
larger than its buckets.  All else is made from these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.histogram import QUANTILES, bucket, quantile

# The keys of status counts; 599 holds every status that has no key of its own.
STATUS_CLASSES = (200, 300, 400, 500, 502, 503, 504, 599)


def status_class(status: Column) -> Column:
    return F.when(status.between(200, 299), 200).when(status.between(300, 399), 300).when(status.between(400, 499), 400).when(status.isin(500, 502, 503, 504), status).otherwise(599)


def status_group(status: Column) -> Column:
    """The class, but 100 for statuses below 200: a group lies wholly inside or outside of each status family."""
    return F.when(status < 200, 100).otherwise(status_class(status))


def class_of_group(group: Column) -> Column:
    return F.when(group == 100, 599).otherwise(group)


def bucket_rows(requests: DataFrame, keys: tuple[str, ...] = ("norm_path", "method")) -> DataFrame:
    """Counts by keys and bucket: calls, errors, sum, least, largest, and each status class."""
    d = F.col("duration_ms")
    kind = status_class(F.col("status"))
    return requests.groupBy(*keys, bucket(d).alias("bucket")).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.sum(d.cast("double")).alias("total"),
        F.min(d).alias("least"),
        F.max(d).alias("most"),
        *(F.count_if(kind == k).alias(f"s{k}") for k in STATUS_CLASSES),
    )


def _summed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Bucket rows added up by keys, with the sorted histogram (values of 0 have no bucket)."""
    if "bucket" in rows.columns and keys != ("norm_path", "method"):
        rows = rows.groupBy(*keys, "bucket").agg(*(F.sum(c).alias(c) for c in ("calls", "errors", "total", *(f"s{k}" for k in STATUS_CLASSES))), F.min("least").alias("least"), F.max("most").alias("most"))
    cells = F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", F.col("calls").alias("n"))))
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("calls", "errors", "total", *(f"s{k}" for k in STATUS_CLASSES))), F.min("least").alias("least"), F.max("most").alias("most"), F.sort_array(cells).alias("histogram"))


def _quantiles() -> dict[str, Column]:
    return {f"p{round(q * 100)}_ms": quantile(F.col("histogram"), q).cast("float") for q in QUANTILES}


def endpoint_stats(requests: DataFrame) -> DataFrame:
    """One row for each (path, method); path is norm_path."""
    return endpoint_stats_of(bucket_rows(requests))


def endpoint_stats_of(counted: DataFrame) -> DataFrame:
    """The same from bucket rows, of a batch or as a stream has written them."""
    rows = _summed(counted, ("norm_path", "method"))
    counts = F.map_from_arrays(F.array(*(F.lit(k) for k in STATUS_CLASSES)), F.array(*(F.col(f"s{k}") for k in STATUS_CLASSES)))
    return rows.select(
        F.col("norm_path").alias("path"),
        "method",
        F.col("calls").alias("total_calls"),
        F.col("errors").alias("error_calls"),
        F.col("total").alias("total_duration_ms"),
        F.coalesce("least", F.lit(0).cast("float")).alias("min_duration_ms"),
        F.coalesce("most", F.lit(0).cast("float")).alias("max_duration_ms"),
        (F.col("total") / F.col("calls")).alias("avg_duration_ms"),
        (100.0 * F.col("errors") / F.col("calls")).alias("error_rate"),
        *(c.alias(n) for n, c in _quantiles().items()),
        F.map_filter(counts, lambda _, n: n > 0).alias("status_counts"),
    )


def status_class_counts(requests: DataFrame) -> DataFrame:
    """(path, method, status_class, n), classes without calls left out."""
    return requests.groupBy(F.col("norm_path").alias("path"), "method", status_class(F.col("status")).alias("status_class")).agg(F.count("*").alias("n"))


def overall_summary(requests: DataFrame) -> DataFrame:
    """One row over all requests, zeros if there are none."""
    return overall_summary_of(requests.groupBy(bucket(F.col("duration_ms")).alias("bucket")).agg(F.count("*").alias("calls"), F.count_if(F.col("status") >= 400).alias("errors")))


def overall_summary_of(counted: DataFrame) -> DataFrame:
    """The same from rows (bucket, calls, errors), of which several may have one bucket."""
    by_bucket = counted.groupBy("bucket").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    cells = F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", F.col("calls").alias("n"))))
    one = by_bucket.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("total_requests"), F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"), F.sort_array(cells).alias("histogram"))
    rate = F.coalesce(F.try_divide(100.0 * F.col("total_errors"), F.col("total_requests")), F.lit(0.0))
    return one.select("total_requests", "total_errors", rate.alias("error_rate"), *(c.alias(n) for n, c in _quantiles().items()))


def cron_stats(events: DataFrame) -> DataFrame:
    """One row for each job.  Starts are runs too; the average is over all runs; last_status follows file order."""
    d, ended = F.col("duration_ms"), F.col("event") != "start"
    last = F.max_by(F.when(F.col("event") == "done", "success").when(F.col("event") == "fail", "failed"), F.when(ended, F.col("order_key")))
    return events.groupBy("name").agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("event") == "start").alias("total_starts"),
        F.count_if(F.col("event") == "done").alias("total_success"),
        F.count_if(F.col("event") == "fail").alias("total_failures"),
        F.count_if(ended).alias("runs_finished"),
        F.coalesce(F.sum(d.cast("double")), F.lit(0.0)).alias("total_duration_ms"),
        (F.coalesce(F.sum(d.cast("double")), F.lit(0.0)) / F.count("*")).alias("avg_duration_ms"),
        F.coalesce(F.min(d), F.lit(0).cast("float")).alias("min_duration_ms"),
        F.coalesce(F.max(d), F.lit(0).cast("float")).alias("max_duration_ms"),
        F.coalesce(last, F.lit("unknown")).alias("last_status"),
    )


def distinct_paths(requests: DataFrame) -> DataFrame:
    """One row: different raw and normalised paths."""
    return requests.agg(F.count_distinct("path").alias("raw_paths"), F.count_distinct("norm_path").alias("normalized_paths"))
