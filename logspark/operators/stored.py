"""Statistics from a log store: filters on clustered rows, search in the dictionary, sums of stored counts.

Which table answers: without bounds on durations all statistics come from the
cube; with them requests are read, and the filter on method, status, duration
and day reaches the scan.  A search is answered by the dictionary first: its
trigrams leave few forms, these are compared, and the ids of those that fit
are joined.  No row of requests or of the cube is compared with the text.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions import sketch
from logspark.functions.paths import COLLAPSE_IDS, RAW, STRIP_QUERY
from logspark.operators import filters as fl
from logspark.operators import stats
from logspark.sources.store import ID_OF, SAMPLES, LogStore

#: Ids of forms up to which they are broadcast: 8 bytes each.
FEW_IDS = 1_000_000
Days = tuple[date | None, date | None]


def in_days(days: Days | None) -> list[Column]:
    """From the first to the last day, both included; None leaves an end open."""
    if days is None:
        return []
    return [F.col("day") >= F.lit(days[0])] * (days[0] is not None) + [F.col("day") <= F.lit(days[1])] * (days[1] is not None)


def matching_forms(store: LogStore, search: str, mode: str = COLLAPSE_IDS) -> DataFrame:
    """(id, form) of the forms that hold the text, in any case of letters."""
    low = search.lower()
    forms = store.forms(mode)
    if len(low) >= 3 and low.isascii():
        asked = sorted({low[k : k + 3] for k in range(len(low) - 2)})[:63]  # a bit each; what fits these is compared
        grams = store.table("grams").where((F.col("mode") == mode) & F.col("gram").isin(asked))
        bit = reduce(lambda c, k: c.when(F.col("gram") == asked[k], F.lit(1 << k)), range(1, len(asked)), F.when(F.col("gram") == asked[0], F.lit(1))).cast("long")
        likely = grams.groupBy("id").agg(F.bit_or(bit).alias("bits")).where(F.col("bits") == (1 << len(asked)) - 1).select("id")
        forms = forms.join(likely, "id", "left_semi")
    return forms.where(F.contains(F.lower("form"), F.lower(F.lit(search))))


def _only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose id is among ids: a broadcast behind a count, else a shuffled semi-join."""
    named = ids.select(F.col("id").alias("_id"))
    n = named.count()
    return rows.join(F.broadcast(named) if n <= FEW_IDS else named, F.col(column) == F.col("_id"), "left_semi")


def requests(store: LogStore, options: fl.FilterOptions = fl.FilterOptions(), days: Days | None = None) -> DataFrame:
    """Stored requests that pass; id is that of the path's form in the options' mode."""
    tests = [*in_days(days), *replace(options, search="").predicates()]
    rows = store.table("requests")
    rows = rows.where(reduce(and_, tests)) if tests else rows
    column = ID_OF[options.path_mode]
    if options.search:
        rows = _only(rows, matching_forms(store, options.search, options.path_mode), column)
    return rows.withColumn("id", F.col(column))


def _group_fits(family: str) -> Column:
    """A status family in terms of the cube's groups, which keep each family apart."""
    return fl.status_family(F.col("status_group"), family)


def cube(store: LogStore, options: fl.FilterOptions = fl.FilterOptions(), days: Days | None = None) -> DataFrame:
    """The cube's rows that pass; options must not bound durations."""
    if options.min_duration_ms > 0 or options.max_duration_ms is not None:
        raise ValueError("the cube has no single durations")
    tests = [F.col("mode") == options.path_mode, *in_days(days)]
    tests += [F.col("method") == options.method] * bool(options.method) + [_group_fits(options.status_family)] * (options.status_family != fl.ALL)
    rows = store.table("cube").where(reduce(and_, tests))
    return _only(rows, matching_forms(store, options.search, options.path_mode), "id") if options.search else rows


def _bucket_rows(rows: DataFrame) -> DataFrame:
    """Cube rows added up over days, batches and groups, in the columns of stats.bucket_rows (with id for norm_path)."""
    kind = stats.class_of_group(F.col("status_group"))
    sums = [F.sum(c).alias(c) for c in ("calls", "errors", "total")] + [F.min("least").alias("least"), F.max("most").alias("most")]
    return rows.groupBy("id", "method", "bucket").agg(*sums, *(F.coalesce(F.sum(F.when(kind == k, F.col("calls"))), F.lit(0)).alias(f"s{k}") for k in stats.STATUS_CLASSES))


def bucket_rows(store: LogStore, options: fl.FilterOptions = fl.FilterOptions(), days: Days | None = None) -> DataFrame:
    """stats.bucket_rows by id, from the cube where it can say it, else from requests."""
    if options.min_duration_ms > 0 or options.max_duration_ms is not None:
        return stats.bucket_rows(requests(store, options, days), ("id", "method"))
    return _bucket_rows(cube(store, options, days))


def endpoint_stats(store: LogStore, options: fl.FilterOptions = fl.FilterOptions(), days: Days | None = None, from_rows: bool = False) -> DataFrame:
    """As stats.endpoint_stats; from_rows: from requests even where the cube would do."""
    counted = stats.bucket_rows(requests(store, options, days), ("id", "method")) if from_rows else bucket_rows(store, options, days)
    names = store.forms(options.path_mode).withColumnRenamed("form", "norm_path")
    return stats.endpoint_stats_of(counted.join(names, "id").drop("id"))


def overall_summary(store: LogStore, options: fl.FilterOptions = fl.FilterOptions(), days: Days | None = None) -> DataFrame:
    """As stats.overall_summary."""
    return stats.overall_summary_of(bucket_rows(store, options, days))


def latency(store: LogStore, keys: list[str], days: Days | None = None) -> DataFrame:
    """keys (of day, id, method) and one sketch for each, from stored sketches alone."""
    rows = store.table("latency")
    rows = rows.where(reduce(and_, in_days(days))) if in_days(days) else rows
    return sketch.merge_groups(rows, keys)


def line_kind_counts(store: LogStore, days: Days | None = None) -> DataFrame:
    """As classify.line_kind_counts, from stored counts."""
    rows = store.table("counts")
    rows = rows.where(reduce(and_, in_days(days))) if in_days(days) else rows

    def of(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0)) if kinds else F.coalesce(F.sum("n"), F.lit(0))

    return rows.agg(of().alias("total_lines"), of("http_a", "http_b").alias("http_lines"), of("cron").alias("cron_lines"), of("unmatched").alias("unmatched_lines"), of("empty").alias("empty_lines"))


def unmatched_samples(store: LogStore, most: int = SAMPLES) -> DataFrame:
    """The first unmatched lines in order, from each batch's first ones: at most SAMPLES a batch are looked at."""
    rows = store.table("samples") if most <= SAMPLES else store.table("unmatched").select("order_key", "text")
    return rows.orderBy("order_key").limit(most)


def crons(store: LogStore, days: Days | None = None) -> DataFrame:
    rows = store.table("crons")
    return (rows.where(reduce(and_, in_days(days))) if in_days(days) else rows).select("order_key", "name", "event", "duration_ms")


def distinct_counts(store: LogStore, days: Days | None = None) -> DataFrame:
    """One row: exact numbers of different raw, bare and normalised paths and endpoints; from the cube by days, from the dictionary without."""
    if days is None:
        counts = store.table("forms").select("mode", "id").distinct().agg(*(F.count_if(F.col("mode") == m).alias(n) for m, n in ((RAW, "raw_paths"), (STRIP_QUERY, "bare_paths"), (COLLAPSE_IDS, "norm_paths"))))
    else:
        counts = store.table("cube").where(reduce(and_, in_days(days))).select("mode", "id").distinct().agg(*(F.count_if(F.col("mode") == m).alias(n) for m, n in ((RAW, "raw_paths"), (STRIP_QUERY, "bare_paths"), (COLLAPSE_IDS, "norm_paths"))))
    pairs = cube(store, days=days).select("id", "method").distinct().agg(F.count("*").alias("endpoints"))
    return counts.crossJoin(pairs)


def estimated_counts(store: LogStore, days: Days | None = None) -> DataFrame:
    """The same numbers estimated from the days' merged sketches."""
    rows = store.table("sketches")
    rows = rows.where(reduce(and_, in_days(days))) if in_days(days) else rows
    return rows.agg(*(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in ("raw_paths", "bare_paths", "norm_paths", "endpoints")))


def job_runs(events: DataFrame, folder: str) -> DataFrame:
    """(name, start_key, end_key, outcome, duration_ms): starts of jobs paired with their ends.

    A job's ends take its open starts in order, the oldest first, so overlapping runs are told apart.  A start without
    an end is `running`; an end without an open start has no start_key.  The order is that of order_key.

    Events are dealt out in order of name and key and written to `folder`; a job of very many events lies in many
    parts.  How many starts a part leaves open follows from two numbers of each part before it: the sum of its steps
    (+1 a start, -1 an end) and their least running sum.
    """
    step = F.when(F.col("event") == "start", 1).otherwise(-1)
    rows = events.select("name", "order_key", "event", "duration_ms", step.alias("step"))
    rows.repartitionByRange("name", "order_key").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(folder)
    placed = events.sparkSession.read.parquet(folder)
    here = Window.partitionBy("name", "part").orderBy("order_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = placed.withColumn("sum", F.sum("step").over(here)).withColumn("low", F.min("sum").over(here))
    inner = inner.withColumn("low_prior", F.min("sum").over(here.rowsBetween(Window.unboundedPreceding, -1))).withColumn("starts", F.sum((F.col("step") == 1).cast("long")).over(here))
    # By part: steps, their least running sum, starts.  Sums over the parts before give the state where a part begins.
    parts = inner.groupBy("name", "part").agg(F.sum("step").alias("part_sum"), F.min("sum").alias("part_low"), F.max("starts").alias("part_starts"))
    earlier = Window.partitionBy("name").orderBy("part")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = parts.withColumn("sum_before", F.coalesce(F.sum("part_sum").over(before), zero)).withColumn("starts_before", F.coalesce(F.sum("part_starts").over(before), zero))
    parts = parts.withColumn("low_before", F.least(zero, F.coalesce(F.min(F.col("sum_before") + F.col("part_low")).over(before), zero)))
    whole = inner.join(parts.select("name", "part", "sum_before", "starts_before", "low_before"), ["name", "part"])
    running = F.col("sum_before") + F.col("sum")
    least = F.least(F.col("low_before"), F.col("sum_before") + F.col("low"))  # of all sums up to here, 0 at most
    least_before = F.least(F.col("low_before"), F.coalesce(F.col("sum_before") + F.col("low_prior"), zero))
    starts = F.col("starts_before") + F.col("starts")
    # An end without an open start makes a new least sum; so far there were -least such ends.
    whole = whole.select("name", "order_key", "event", "duration_ms", "step", starts.alias("starts"), (starts - running).alias("ends"), (running < least_before).alias("lone"), (-least).alias("lone_so_far"))
    started = whole.where("step = 1").select("name", F.col("starts").alias("number"), F.col("order_key").alias("start_key"))
    ended = whole.where("step = -1").select("name", F.when(~F.col("lone"), F.col("ends") - F.col("lone_so_far")).alias("number"), F.col("order_key").alias("end_key"), "event", "duration_ms")
    paired = started.join(ended.where("number is not null"), ["name", "number"], "left")
    outcome = F.when(F.col("event") == "done", "success").when(F.col("event") == "fail", "failed").otherwise("running")
    lone = ended.where("number is null").withColumn("start_key", F.lit(None).cast(events.schema["order_key"].dataType))
    shown = ["name", "start_key", "end_key", outcome.alias("outcome"), "duration_ms"]
    return paired.select(*shown).union(lone.select(*shown))


def run_stats(runs: DataFrame) -> DataFrame:
    """By job: runs (paired or not), finished ones, those still running, ends without a start, and the average over finished runs."""
    finished = F.col("outcome") != "running"
    return runs.groupBy("name").agg(
        F.count("*").alias("runs"),
        F.count_if(finished).alias("finished"),
        F.count_if(~finished).alias("running"),
        F.count_if(F.col("start_key").isNull()).alias("without_start"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.avg(F.when(finished, F.col("duration_ms").cast("double"))).alias("avg_finished_ms"),
    )
