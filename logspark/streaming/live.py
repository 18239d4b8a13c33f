"""The same statistics over lines as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from logspark.operators.classify import classify_lines, http_requests
from logspark.operators.filters import FilterOptions, apply_filters
from logspark.operators.stats import bucket_rows
from logspark.sources.logs import with_keys
from logspark.sources.store import LogStore


def live_bucket_rows(lines: DataFrame, options: FilterOptions = FilterOptions()) -> DataFrame:
    """Running counts by endpoint, method and bucket of a stream of lines; state grows with endpoints, not with lines.

    Write with output mode update or complete; stats.endpoint_stats_of over the sink's last rows gives endpoint statistics.
    """
    return bucket_rows(apply_filters(http_requests(classify_lines(lines)), options))


def windowed_errors(lines: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Calls and errors by the lines' own stamps, with a watermark; lines without a stamp are left out."""
    rows = classify_lines(lines).where(F.col("kind") == "http_a").where(F.col("ts").isNotNull()).withColumn("at", F.col("ts").cast("timestamp"))
    return rows.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("calls"), F.count_if(F.col("status") >= 400).alias("errors"))


def store_batch(store: LogStore, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: a micro-batch of files becomes the store's batch of its number, in place of an earlier try."""

    def write(values: DataFrame, number: int) -> None:
        store.add(with_keys(values), f"{name}-{number:012d}")

    return write


def into_store(values: DataFrame, store: LogStore, checkpoint: str, name: str = "stream", available_now: bool = False) -> StreamingQuery:
    """A running query that adds each micro-batch of logs.stream_log_files to the store, exactly once.

    A batch that Spark runs again after a failure has the same number and replaces what it has written.  Lines of an
    earlier day that come late add to that day: counts of a day are the sum over all batches.  available_now: read
    what is there and end.
    """
    writer = values.writeStream.foreachBatch(store_batch(store, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
