"""Named queries of the log engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import histogram, paths, sketch, text
from logspark.operators import classify, stats, stored, views
from logspark.operators import filters as fl
from logspark.plans.oracle import ROTATED, quoted, stats_ctes, with_ctes
from logspark.sources import derived, logs, parsed, sinks
from logspark.sources.store import LogStore
from logspark.sources.workspace import exists, workspace
from logspark.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_lines(derived.lines(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str, options: fl.FilterOptions = fl.FilterOptions()) -> DataFrame:
    return fl.apply_filters(classify.http_requests(classified(spark, sf_dir)), options)


def endpoints(spark: SparkSession, sf_dir: str, options: fl.FilterOptions = fl.FilterOptions()) -> DataFrame:
    return stats.endpoint_stats(requests(spark, sf_dir, options))


def crons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cron_stats(classify.cron_events(classified(spark, sf_dir)))


def rounded(df: DataFrame, places: int = 3) -> DataFrame:
    """Floating columns as doubles with few decimals, to compare engines that add up in different orders; maps left out."""
    out: list[Column] = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("float", "double"):
            out.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        elif kind != "map":
            out.append(F.col(f.name))
    return df.select(*out)


R = lambda *names: ", ".join(f"round(cast({n} as double), 3) as {n}" for n in names)
ENDPOINT = "path, method, total_calls, error_calls, " + R("total_duration_ms", "min_duration_ms", "max_duration_ms", "avg_duration_ms", "error_rate", "p50_ms", "p90_ms", "p95_ms", "p99_ms")
OVERALL = "total_requests, total_errors, " + R("error_rate", "p50_ms", "p90_ms", "p95_ms", "p99_ms")
CRON = "name, total_runs, total_starts, total_success, total_failures, runs_finished, " + R("total_duration_ms", "avg_duration_ms", "min_duration_ms", "max_duration_ms") + ", last_status"


def fixed(column: str, places: int) -> str:
    return f"printf('%.{places}f', round(cast({column} as double), {places}))"


# --- sources -----------------------------------------------------------------


def lines_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lines, written as text files in order and read again as a log."""
    path = workspace(spark)
    derived.lines(spark, sf_dir).orderBy("line_no").select("line").write.option("lineSep", "\n").text(path)
    return logs.read_log_lines(spark, path)


def rotated_logs(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the derived lines as log files of ROTATED lines each, named so that a later file sorts first."""
    path = workspace(spark)
    number = F.floor(F.col("line_no") / ROTATED)
    files = derived.lines(spark, sf_dir).select("line", "line_no", F.format_string("%012d", F.lit(10**12 - 1) - number).alias("rotated"))
    files.repartition("rotated").sortWithinPartitions("rotated", "line_no").select("line", "rotated").write.mode("overwrite").partitionBy("rotated").option("lineSep", "\n").text(path)
    return path


_STORES: dict[tuple[str, str], str] = {}


def store_of(spark: SparkSession, sf_dir: str) -> LogStore:
    """The log store of the derived lines, parsed once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES or not exists(spark, _STORES[key]):
        store = LogStore(spark, workspace(spark))
        store.add_files(f"{rotated_logs(spark, sf_dir)}/*/*.txt")
        _STORES[key] = store.path
    return LogStore(spark, _STORES[key])


@register("s1_read_log_lines", with_ctes("select count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from lines"))
def s1(spark, sf_dir):
    return lines_on_disk(spark, sf_dir).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@register("s2_line_order", with_ctes("select name, last_status from cron_stats"))
def s2(spark, sf_dir):
    found = classify.classify_lines(lines_on_disk(spark, sf_dir))
    return stats.cron_stats(classify.cron_events(found)).select("name", "last_status")


@register("s3_strip_cr", with_ctes("select count(*) as n_lines, count(*) filter (l <> line) as n_stripped, cast(sum(length(l)) as bigint) as n_chars from stripped"))
def s3(spark, sf_dir):
    rows = derived.lines(spark, sf_dir).withColumn("l", text.strip_cr(F.col("line")))
    return rows.agg(F.count("*").alias("n_lines"), F.count_if(F.col("l") != F.col("line")).alias("n_stripped"), F.sum(F.length("l")).alias("n_chars"))


@register("s4_empty_input", with_ctes(f"select {OVERALL} from overall", **stats_ctes("line_no < 0")))
def s4(spark, sf_dir):
    return rounded(stats.overall_summary(fl.apply_filters(classify.http_requests(classified(spark, sf_dir).where("line_no < 0")))))


@register("s5_utf8_lossy", with_ctes("select line_no, chr(65533) || '(' || l || chr(65533) as text from kinds where kind = 'unmatched'"))
def s5(spark, sf_dir):
    """Each unmatched line between a broken two-byte character and a byte that begins none."""
    rows = classified(spark, sf_dir).where(F.col("kind") == classify.UNMATCHED)
    broken = F.concat(F.lit(b"\xc3("), F.col("text").cast("binary"), F.lit(b"\xff")).cast("string")
    return rows.select("line_no", text.utf8_lossy(broken).alias("text"))


@register("s6_parsed_table", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes("method = 'POST' and status >= 400")))
def s6(spark, sf_dir):
    """Lines are parsed and stored once; the filter and the statistics read the table."""
    path = workspace(spark)
    parsed.save_parsed(classified(spark, sf_dir), path)
    chosen = fl.apply_filters(classify.http_requests(parsed.read_parsed(spark, path)), fl.FilterOptions(method="POST", status_family=fl.ERROR_ONLY))
    return rounded(stats.endpoint_stats(chosen))


# --- classification ------------------------------------------------------------


@register("c1_ansi_as_space", with_ctes("select line_no, c from stripped where c <> l"))
def c1(spark, sf_dir):
    rows = derived.lines(spark, sf_dir).withColumn("l", text.strip_cr(F.col("line"))).withColumn("c", text.ansi_as_space(F.col("l")))
    return rows.where("c <> l").select("line_no", "c")


@register("c2_strip_ansi", with_ctes(r"select line_no, regexp_replace(l, '\x1B\[[^@-~]*(?:[@-~]|\z)', '', 'g') as text from stripped where contains(l, chr(27))"))
def c2(spark, sf_dir):
    rows = derived.lines(spark, sf_dir).withColumn("l", text.strip_cr(F.col("line")))
    return rows.where(F.col("l").contains(text.ESC)).select("line_no", text.strip_ansi(F.col("l")).alias("text"))


@register("c3_timestamps", with_ctes("select kind, count(*) as n, min(cast(substr(c, 1, 19) as timestamp)) as first_ts, max(cast(substr(c, 1, 19) as timestamp)) as last_ts from kinds where kind = 'http_a' and regexp_matches(c, '^[0-9]{4}-') group by kind"))
def c3(spark, sf_dir):
    rows = classified(spark, sf_dir).where(F.col("ts").isNotNull())
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _fields(kind: str) -> Query:
    def query(spark, sf_dir):
        rows = classified(spark, sf_dir).where(F.col("kind") == kind)
        return rounded(rows.select("line_no", "method", "path", "status", "duration_ms", "bytes"))

    return query


for _name, _kind in (("c7_http_a", "http_a"), ("c8_http_b", "http_b")):
    register(_name, with_ctes(f"select line_no, method, path, status, {R('duration_ms')}, bytes from requests where kind = '{_kind}'"))(_fields(_kind))


@register("c9_cron", with_ctes(f"select line_no, name, event, {R('duration_ms')} from crons"))
def c9(spark, sf_dir):
    return rounded(classify.cron_events(classified(spark, sf_dir)).withColumnRenamed("order_key", "line_no").select("line_no", "name", "event", "duration_ms"))


@register("c10_empty", with_ctes("select count(*) as n_empty, cast(sum(length(line)) as bigint) as n_chars from kinds where kind = 'empty'"))
def c10(spark, sf_dir):
    return classified(spark, sf_dir).where("kind = 'empty'").agg(F.count("*").alias("n_empty"), F.sum(F.length("line")).alias("n_chars"))


@register("c11_classify_lines", with_ctes("select line_no, kind from kinds"))
def c11(spark, sf_dir):
    return classified(spark, sf_dir).select("line_no", "kind")


@register("c12_http_requests", with_ctes(f"select method, path, status, {R('duration_ms')} from requests"))
def c12(spark, sf_dir):
    return rounded(classify.http_requests(classified(spark, sf_dir)))


@register("c13_cron_events", with_ctes("select event, count(*) as n, count(duration_ms) as timed, round(sum(cast(duration_ms as double)), 3) as total_ms from crons group by event"))
def c13(spark, sf_dir):
    rows = classify.cron_events(classified(spark, sf_dir)).groupBy("event")
    return rounded(rows.agg(F.count("*").alias("n"), F.count("duration_ms").alias("timed"), F.sum(F.col("duration_ms").cast("double")).alias("total_ms")))


@register("c14_unmatched_samples", with_ctes("select line_no, l as text from kinds where kind = 'unmatched' order by line_no limit 50"))
def c14(spark, sf_dir):
    return classify.unmatched_samples(classified(spark, sf_dir)).select(F.col("order_key").alias("line_no"), "text")


@register("c15_line_kind_counts", with_ctes("select count(*) as total_lines, count(*) filter (kind in ('http_a', 'http_b')) as http_lines, count(*) filter (kind = 'cron') as cron_lines, count(*) filter (kind = 'unmatched') as unmatched_lines, count(*) filter (kind = 'empty') as empty_lines from kinds"))
def c15(spark, sf_dir):
    return classify.line_kind_counts(classified(spark, sf_dir))


@register("c15_document_lines", with_ctes("select kind, count(*) as n from kinds group by kind", lines="select doc_id as line_no, unnest(string_split(text, chr(10))) as line from documents"))
def c15_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify.classify_lines(docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))).groupBy("kind").agg(F.count("*").alias("n"))


# --- paths ---------------------------------------------------------------------

PATH_SQL = {paths.RAW: "path", paths.STRIP_QUERY: "bare_path", paths.COLLAPSE_IDS: "norm_path"}


def _norm(mode: str) -> Query:
    def query(spark, sf_dir):
        return requests(spark, sf_dir, fl.FilterOptions(path_mode=mode)).groupBy(F.col("norm_path").alias("path")).agg(F.count("*").alias("n"))

    return query


def _norm_pages(mode: str) -> Query:
    def query(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.normalize_path(F.col("url"), mode).alias("path"))

    return query


for _k, (_mode, _column) in enumerate(PATH_SQL.items()):
    register(f"p{_k + 1}_norm_{_mode}", with_ctes(f"select {_column} as path, count(*) as n from normed group by 1"))(_norm(_mode))
    register(f"p{_k + 1}_pages_{_mode}", with_ctes(f"select line_no as page_id, {_column} as path from normed", requests="select page_id as line_no, url as path from pages"))(_norm_pages(_mode))

SEGMENT = "select line_no, unnest(string_split(bare_path, '/')) as s from bare"


def _segments(test: Callable[[Column], Column]) -> Query:
    def query(spark, sf_dir):
        rows = classify.http_requests(classified(spark, sf_dir)).select(F.explode(F.split(paths.strip_query(F.col("path")), "/")).alias("segment"))
        return rows.where(test(F.col("segment"))).groupBy("segment").agg(F.count("*").alias("n"))

    return query


for _name, _test, _pattern in (
    ("p4_is_object_id", paths.is_object_id, r"\A[0-9a-fA-F]{24}\z"),
    ("p5_is_long_numeric", paths.is_long_numeric, r"\A[0-9]{6,}\z"),
    ("p6_is_uuid", paths.is_uuid, r"\A[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"),
    ("p8_is_code_id", paths.is_code_id, r"\A[A-Za-z]{2,}-[A-Za-z]{2,}-[0-9]{6,}\z"),
):
    register(_name, with_ctes(f"select s as segment, count(*) as n from segments where regexp_matches(s, {quoted(_pattern)}) group by s", segments=SEGMENT))(_segments(_test))


PR_ID = quoted(r"\A[Pp][Rr]-[A-Za-z]{3,}-[0-9]{8,}\z")


#: The derived paths have no such id: each request also gives one with as many digits as its status has, three times or once.
PR_SEGMENT = "select line_no, unnest([s, 'Pr-' || method || '-' || repeat(cast(status as varchar), 3), 'pR-' || method || '-' || status, 'PR-x-' || repeat(cast(status as varchar), 3)]) as s from (select line_no, method, status, string_split(bare_path, '/')[-1] as s from bare)"


@register("p7_is_pr_id", with_ctes(f"select regexp_matches(s, {PR_ID}) as is_pr_id, count(*) as n, min(s) as least, max(s) as most from segments group by 1", segments=PR_SEGMENT))
def p7(spark, sf_dir):
    status = F.col("status").cast("string")
    made = [F.concat(F.lit(a), m, F.lit("-"), d) for a, m, d in (("Pr-", F.col("method"), F.repeat(status, 3)), ("pR-", F.col("method"), status), ("PR-", F.lit("x"), F.repeat(status, 3)))]
    last = F.element_at(F.split(paths.strip_query(F.col("path")), "/"), -1)
    rows = classify.http_requests(classified(spark, sf_dir)).select(F.explode(F.array(last, *made)).alias("segment"))
    return rows.groupBy(paths.is_pr_id(F.col("segment")).alias("is_pr_id")).agg(F.count("*").alias("n"), F.min("segment").alias("least"), F.max("segment").alias("most"))


@register("p9_distinct_paths", with_ctes("select count(distinct path) as raw_paths, count(distinct norm_path) as normalized_paths from normed"))
def p9(spark, sf_dir):
    return stats.distinct_paths(requests(spark, sf_dir))


# --- filters -------------------------------------------------------------------

NONE = fl.FilterOptions()
FILTERS: dict[str, tuple[fl.FilterOptions, str]] = {
    "f1_filter_method": (replace(NONE, method="POST"), "method = 'POST'"),
    "f2_filter_status_2xx": (replace(NONE, status_family=fl.SUCCESS), "status between 200 and 299"),
    "f3_filter_status_3xx": (replace(NONE, status_family=fl.REDIRECT), "status between 300 and 399"),
    "f4_filter_status_4xx": (replace(NONE, status_family=fl.CLIENT_ERROR), "status between 400 and 499"),
    "f5_filter_status_5xx": (replace(NONE, status_family=fl.SERVER_ERROR), "status >= 500"),
    "f6_filter_errors_only": (replace(NONE, status_family=fl.ERROR_ONLY), "status >= 400"),
    "f7_filter_min_duration": (replace(NONE, min_duration_ms=100.0), "duration_ms >= cast(100 as float)"),
    "f8_filter_max_duration": (replace(NONE, max_duration_ms=20.0), "duration_ms <= cast(20 as float)"),
    "f9_filter_search": (replace(NONE, search="/API/C"), "contains(lower(norm_path), '/api/c')"),
    "f10_filter_compose": (replace(NONE, method="GET", status_family=fl.ERROR_ONLY, min_duration_ms=10.0, max_duration_ms=300.0, search=":id"), "method = 'GET' and status >= 400 and duration_ms >= cast(10 as float) and duration_ms <= cast(300 as float) and contains(lower(norm_path), ':id')"),
}


def _filtered(options: fl.FilterOptions) -> Query:
    """From stored requests: the filter reaches the scan, a search text the dictionary."""
    return lambda spark, sf_dir: rounded(stored.endpoint_stats(store_of(spark, sf_dir), options, from_rows=True))


def _from_cube(options: fl.FilterOptions) -> Query:
    return lambda spark, sf_dir: rounded(stored.endpoint_stats(store_of(spark, sf_dir), options))


for _name, (_options, _where) in FILTERS.items():
    register(_name, with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes(_where)))(_filtered(_options))


for _name, (_options, _where) in FILTERS.items():
    if _name.split("_")[0] in ("f1", "f4", "f5", "f9"):
        register(f"{_name}_cube", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes(_where)))(_from_cube(_options))

register("f9_filter_search_raw", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes("contains(lower(path), 'ab-cd')", "path")))(_filtered(fl.FilterOptions(search="AB-cd", path_mode=paths.RAW)))
register("f9_filter_search_bare", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes("contains(lower(bare_path), 'ab-cd')", "bare_path")))(_filtered(fl.FilterOptions(search="AB-cd", path_mode=paths.STRIP_QUERY)))


# --- aggregates ----------------------------------------------------------------


@register("a1_endpoint_stats", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes()))
def a1(spark, sf_dir):
    return rounded(endpoints(spark, sf_dir))


@register("a1_endpoint_stats_raw", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes(path="path")))
def a1_raw(spark, sf_dir):
    return rounded(endpoints(spark, sf_dir, fl.FilterOptions(path_mode=paths.RAW)))


@register("a2_calls_and_errors", with_ctes("select method, count(*) as total_calls, count(*) filter (status >= 400) as error_calls from requests group by method"))
def a2(spark, sf_dir):
    return classify.http_requests(classified(spark, sf_dir)).groupBy("method").agg(F.count("*").alias("total_calls"), F.count_if(F.col("status") >= 400).alias("error_calls"))


@register("a3_durations", with_ctes(f"select path, method, {R('total_duration_ms', 'min_duration_ms', 'max_duration_ms', 'avg_duration_ms')} from endpoint", **stats_ctes()))
def a3(spark, sf_dir):
    return rounded(endpoints(spark, sf_dir).select("path", "method", "total_duration_ms", "min_duration_ms", "max_duration_ms", "avg_duration_ms"))


@register("a4_error_rate", with_ctes(f"select path, method, {R('error_rate')} from endpoint", **stats_ctes()))
def a4(spark, sf_dir):
    return rounded(endpoints(spark, sf_dir).select("path", "method", "error_rate"))


CLASS_SQL = "case when status between 200 and 299 then 200 when status between 300 and 399 then 300 when status between 400 and 499 then 400 when status in (500, 502, 503, 504) then status else 599 end"


@register("a5_status_class_counts", with_ctes(f"select norm_path as path, method, {CLASS_SQL} as status_class, count(*) as n from normed group by all"))
def a5(spark, sf_dir):
    return stats.status_class_counts(requests(spark, sf_dir))


@register("a5_status_counts_map", with_ctes(f"select norm_path as path, method, {CLASS_SQL} as status_class, count(*) as n from normed group by all"))
def a5_map(spark, sf_dir):
    return endpoints(spark, sf_dir).select("path", "method", F.explode("status_counts").alias("status_class", "n"))


@register("a6_latency_quantiles", with_ctes(f"select path, method, {R('p50_ms', 'p90_ms', 'p95_ms', 'p99_ms')} from endpoint", **stats_ctes()))
def a6(spark, sf_dir):
    return rounded(endpoints(spark, sf_dir).select("path", "method", "p50_ms", "p90_ms", "p95_ms", "p99_ms"))


@register("a7_overall_summary", with_ctes(f"select {OVERALL} from overall", **stats_ctes()))
def a7(spark, sf_dir):
    return rounded(stats.overall_summary(requests(spark, sf_dir)))


@register("a8_cron_stats", with_ctes(f"select {CRON} from cron_stats"))
def a8(spark, sf_dir):
    return rounded(crons(spark, sf_dir))


@register("a9_cron_average", with_ctes(f"select name, {R('avg_duration_ms')} from cron_stats"))
def a9(spark, sf_dir):
    return rounded(crons(spark, sf_dir).select("name", "avg_duration_ms"))


@register("a10_cron_last_status", with_ctes("select name, last_status from cron_stats"))
def a10(spark, sf_dir):
    return crons(spark, sf_dir).select("name", "last_status")


@register("a11_scalar_counts", with_ctes("select (select count(*) from crons) as total_cron_events, (select count(*) from endpoint) as unique_endpoints, (select count(*) from cron_stats) as active_cron_jobs", **stats_ctes()))
def a11(spark, sf_dir):
    found = classified(spark, sf_dir)
    jobs = classify.cron_events(found).groupBy("name").count()
    pairs = fl.apply_filters(classify.http_requests(found)).select("norm_path", "method").distinct()
    return jobs.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_cron_events"), F.count("*").alias("active_cron_jobs")).crossJoin(pairs.agg(F.count("*").alias("unique_endpoints")))


# --- the store: counts, days, order, runs ----------------------------------------


@register("a1_stored_endpoint_stats", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes()))
def a1_stored(spark, sf_dir):
    return rounded(stored.endpoint_stats(store_of(spark, sf_dir)))


@register("a1_stored_raw", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes(path="path")))
def a1_stored_raw(spark, sf_dir):
    return rounded(stored.endpoint_stats(store_of(spark, sf_dir), fl.FilterOptions(path_mode=paths.RAW)))


@register("a7_stored_summary", with_ctes(f"select {OVERALL} from overall", **stats_ctes()))
def a7_stored(spark, sf_dir):
    return rounded(stored.overall_summary(store_of(spark, sf_dir)))


@register("c15_stored_counts", with_ctes("select count(*) as total_lines, count(*) filter (kind in ('http_a', 'http_b')) as http_lines, count(*) filter (kind = 'cron') as cron_lines, count(*) filter (kind = 'unmatched') as unmatched_lines, count(*) filter (kind = 'empty') as empty_lines from kinds"))
def c15_stored(spark, sf_dir):
    return stored.line_kind_counts(store_of(spark, sf_dir))


@register("a1_stored_day", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes("line_no in (select line_no from stamped where cast(stamp as date) = (select min(cast(stamp as date)) from stamped))")))
def a1_stored_day(spark, sf_dir):
    """Statistics of the log's first day, from that day's folder."""
    store = store_of(spark, sf_dir)
    day = store.table("counts").agg(F.min("day")).first()[0]
    return rounded(stored.endpoint_stats(store, days=(day, day)))


@register("p9_stored_distinct", with_ctes("select count(distinct path) as raw_paths, count(distinct bare_path) as bare_paths, count(distinct norm_path) as norm_paths, count(distinct method || ' ' || norm_path) as endpoints, true as sketches_fit from normed"))
def p9_stored(spark, sf_dir):
    """Exact numbers, and whether those of the merged sketches are within 6 % of them."""
    store, names = store_of(spark, sf_dir), ("raw_paths", "bare_paths", "norm_paths", "endpoints")
    near = stored.estimated_counts(store).select(*(F.col(n).alias(f"near_{n}") for n in names))
    fit = reduce(lambda a, b: a & b, [F.abs(F.col(f"near_{n}") - F.col(n)) <= 0.06 * F.col(n) for n in names])
    return stored.distinct_counts(store).crossJoin(near).select(*names, fit.alias("sketches_fit"))


@register("c14_stored_samples", with_ctes("select stamp, l as text from kinds join stamped using (line_no) where kind = 'unmatched' order by stamp nulls first, rotated desc, line_no limit 50"))
def c14_stored(spark, sf_dir):
    """The first unmatched lines by time, over rotated files."""
    return stored.unmatched_samples(store_of(spark, sf_dir)).select(F.col("order_key.stamp").alias("stamp"), "text")


@register("s2_stamp_order", with_ctes("select name, coalesce(arg_max(case event when 'done' then 'success' when 'fail' then 'failed' end, n) filter (event <> 'start'), 'unknown') as last_status from (select *, row_number() over (order by stamp, rotated desc, line_no) as n from timed) group by name"))
def s2_stamps(spark, sf_dir):
    """Each job's last outcome in the order of times: rotated files are read in the wrong order of their names."""
    return stats.cron_stats(stored.crons(store_of(spark, sf_dir))).select("name", "last_status")


@register("a8_job_runs", with_ctes("select name, start_at, end_at, outcome, round(cast(duration_ms as double), 3) as duration_ms from runs"))
def a8_runs(spark, sf_dir):
    """Starts paired with their ends."""
    runs = stored.job_runs(stored.crons(store_of(spark, sf_dir)), workspace(spark))
    return rounded(runs.select("name", F.col("start_key.stamp").alias("start_at"), F.col("end_key.stamp").alias("end_at"), "outcome", "duration_ms"))


@register("a9_true_average", with_ctes("select name, count(*) as runs, count(*) filter (outcome <> 'running') as finished, count(*) filter (outcome = 'running') as running, count(*) filter (lone) as without_start, count(*) filter (outcome = 'failed') as failed, round(avg(cast(duration_ms as double)) filter (outcome <> 'running'), 3) as avg_finished_ms, any_value(diluted) as avg_duration_ms from runs join (select name, round(avg_duration_ms, 3) as diluted from cron_stats) using (name) group by name"))
def a9_true(spark, sf_dir):
    """The average over finished runs beside the one over all events."""
    events = stored.crons(store_of(spark, sf_dir))
    runs = stored.run_stats(stored.job_runs(events, workspace(spark)))
    return rounded(runs.join(stats.cron_stats(events).select("name", "avg_duration_ms"), "name"))


@register("h2_stored_merge", with_ctes("select method, bucket, count(*) as n from chosen where bucket is not null group by all", **stats_ctes()))
def h2_stored(spark, sf_dir):
    """Latency histograms of methods, merged from stored sketches of days and endpoints."""
    merged = stored.latency(store_of(spark, sf_dir), ["method"])
    return merged.select("method", F.explode(sketch.cells(F.col("sketch"))).alias("c")).select("method", "c.bucket", "c.n")


@register("h3_stored_quantiles", with_ctes(f"select method, {R('p50', 'p90', 'p95', 'p99')} from hq", **stats_ctes() | {"chosen": stats_ctes()["chosen"].replace("norm_path as path", "'' as path")}))
def h3_stored(spark, sf_dir):
    merged = stored.latency(store_of(spark, sf_dir), ["method"])
    return rounded(merged.select("method", *(sketch.quantile(F.col("sketch"), q).alias(f"p{round(q * 100)}") for q in histogram.QUANTILES)))


@register("k6_stream_into_store", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes()))
def k6(spark, sf_dir):
    """The log files as a stream, each micro-batch written exactly once."""
    store = LogStore(spark, workspace(spark))
    query = live.into_store(logs.stream_log_files(spark, f"{rotated_logs(spark, sf_dir)}/*"), store, workspace(spark), available_now=True)
    query.awaitTermination()
    return rounded(stored.endpoint_stats(store))


# --- histogram -----------------------------------------------------------------

EVENTS_HIST = {
    "chosen": stats_ctes()["chosen"].replace("from normed where true", "from (select event_type as norm_path, '' as method, 200 as status, value as duration_ms from events)"),
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@register("h1_hist_bucket", with_ctes("select bucket, count(*) as n from chosen where bucket is not null group by bucket", **EVENTS_HIST))
def h1(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(histogram.bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("bucket").isNotNull())


@register("h2_hist_merge", with_ctes("select path as event_type, bucket, count(*) as n from chosen where bucket is not null group by all", **EVENTS_HIST))
def h2(spark, sf_dir):
    parts = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day"), histogram.bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    return parts.where(F.col("bucket").isNotNull()).groupBy("event_type", "bucket").agg(F.sum("n").alias("n"))


@register("h3_hist_quantile", with_ctes(f"select path as event_type, {R('p50', 'p90', 'p95', 'p99')} from hq", **{k: (EVENTS_HIST | {n: stats_ctes()[n] for n in ('hist', 'hq')})[k] for k in ("chosen", "hist", "hq")}))
def h3(spark, sf_dir):
    cells = _events(spark, sf_dir).groupBy("event_type", histogram.bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("bucket").isNotNull())
    by_type = cells.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    return rounded(by_type.select("event_type", *(histogram.quantile(F.col("h"), q).alias(f"p{round(q * 100)}") for q in histogram.QUANTILES)))


@register("h4_hist_value", with_ctes(f"select distinct bucket, round(pow({histogram.GAMMA!r}, bucket - 0.5), 3) as middle from chosen where bucket is not null", **EVENTS_HIST))
def h4(spark, sf_dir):
    cells = _events(spark, sf_dir).select(histogram.bucket(F.col("value")).alias("bucket")).where(F.col("bucket").isNotNull()).distinct()
    return rounded(cells.select("bucket", histogram.bucket_value(F.col("bucket")).alias("middle")))


@register("h5_exact_quantile", "select user_id, " + ", ".join(f"list_sort(list(value))[cast(floor({q} * (count(*) - 1)) as int) + 1] as p{round(q * 100)}" for q in histogram.QUANTILES) + " from events group by user_id")
def h5(spark, sf_dir):
    return histogram.exact_quantiles(_events(spark, sf_dir), "user_id", "value", workspace(spark))


# --- views ---------------------------------------------------------------------


def _sorted(by: str, ascending: bool) -> Query:
    return lambda spark, sf_dir: rounded(views.sort_endpoints(endpoints(spark, sf_dir), by, ascending))


# Sorts of all endpoints: O1-O8 in the direction of a first click, then in both.
for _k, (_by, _column) in enumerate(views.SORTS.items()):
    for _name, _direction in ((f"o{_k + 1}_sort_by_{_by}", "desc"), (f"o{_k + 17}_sort_all_by_{_by}_desc", "desc"), (f"o{_k + 17}_sort_all_by_{_by}_asc", "asc")):
        _sql = with_ctes(f"select {ENDPOINT} from endpoint order by {_column} {_direction}, path, method", **stats_ctes())
        register(_name, _sql)(_sorted(_by, _direction == "asc"))


@register("o9_sort_default", with_ctes(f"select {ENDPOINT} from endpoint order by total_calls desc, path, method", **stats_ctes()))
def o9(spark, sf_dir):
    return rounded(views.sort_endpoints(endpoints(spark, sf_dir)))


@register("o10_top10_endpoints", with_ctes(f"select path, method, total_calls, {R('p95_ms')} from (select * from endpoint order by total_calls desc, path, method limit 10)", **stats_ctes()))
def o10(spark, sf_dir):
    return rounded(views.top_endpoints(endpoints(spark, sf_dir)))


@register("o11_percentile_curve", with_ctes("select 50 as percentile, round(cast(p50_ms as double), 3) as value_ms from overall union all select 90, round(cast(p90_ms as double), 3) from overall union all select 95, round(cast(p95_ms as double), 3) from overall union all select 99, round(cast(p99_ms as double), 3) from overall", **stats_ctes()))
def o11(spark, sf_dir):
    return rounded(views.percentile_curve(stats.overall_summary(requests(spark, sf_dir))))


BYTES = "case " + " ".join(f"when n >= {1 << p} then {fixed(f'n / {1 << p}.0', 2)} || ' {u}'" for p, u in ((30, "GiB"), (20, "MiB"), (10, "KiB"))) + " else n || ' B' end"


@register(
    "o12_kpi_cards",
    with_ctes(
        f"""select 1 as card, 'Total ingested' as title, (select {BYTES} from (select sum(strlen(line) + 1) as n from lines)) as value, (select count(*) from kinds) || ' lines, ' || (select count(*) from kinds where kind = 'unmatched') || ' unmatched' as subtitle
        union all select 2, 'HTTP requests', cast(total_requests as varchar), (select count(*) from endpoint) || ' endpoints' from overall
        union all select 3, 'Error rate', {fixed('error_rate', 2)} || '%', total_errors || ' errors' from overall
        union all select 4, 'Latency p95', {fixed('p95_ms', 1)} || ' ms', 'p50 ' || {fixed('p50_ms', 1)} || ' ms, p99 ' || {fixed('p99_ms', 1)} || ' ms' from overall
        union all select 5, 'Cron events', cast((select count(*) from crons) as varchar), (select count(*) from cron_stats) || ' jobs'""",
        **stats_ctes(),
    ),
)
def o12(spark, sf_dir):
    """The lines are written as a log, so that it has a size in bytes, and parsed once: all cards read the parsed table."""
    lines, path = lines_on_disk(spark, sf_dir), workspace(spark)
    parsed.save_parsed(classify.classify_lines(lines), path)
    found = parsed.read_parsed(spark, path)
    chosen = fl.apply_filters(classify.http_requests(found))
    return views.kpi_cards(classify.line_kind_counts(found), logs.total_bytes(lines), stats.overall_summary(chosen), chosen.select("norm_path", "method").distinct(), classify.cron_events(found).select("name").distinct())


@register("o13_overall_severity", with_ctes("select round(error_rate, 3) as error_rate, case when error_rate > 5 then 'red' when error_rate > 1 then 'amber' else 'green' end as severity from overall", **stats_ctes()))
def o13(spark, sf_dir):
    return rounded(stats.overall_summary(requests(spark, sf_dir)).select("error_rate", views.overall_severity(F.col("error_rate")).alias("severity")))


@register("o14_endpoint_severity", with_ctes("select path, method, case when error_rate > 5 then 'red' when error_rate > 0 then 'amber' else 'green' end as severity from endpoint", **stats_ctes()))
def o14(spark, sf_dir):
    return endpoints(spark, sf_dir).select("path", "method", views.endpoint_severity(F.col("error_rate")).alias("severity"))


def _shown(*columns: tuple[str, str]) -> str:
    return ", ".join(f"{fixed(c, 1)} as {n}" for n, c in columns)


@register("o15_endpoint_view", with_ctes(f"select method, path, total_calls as calls, {_shown(('error_rate', 'error_rate'), ('avg', 'avg_duration_ms'), ('p50', 'p50_ms'), ('p95', 'p95_ms'), ('p99', 'p99_ms'))}, case when error_rate > 5 then 'red' when error_rate > 0 then 'amber' else 'green' end as severity from endpoint", **stats_ctes()))
def o15(spark, sf_dir):
    return views.endpoint_view(endpoints(spark, sf_dir))


@register("o16_cron_view", with_ctes(f"select name, total_runs as runs, total_success as successes, total_failures as failures, {fixed('avg_duration_ms', 1)} as avg, last_status, case last_status when 'success' then 'green' when 'failed' then 'red' else 'grey' end as colour from cron_stats"))
def o16(spark, sf_dir):
    return views.cron_view(crons(spark, sf_dir))


# --- sinks and reports -----------------------------------------------------------

CSV_SQL = f"""select method as "Method", path as "Endpoint", total_calls as "Calls", error_calls as "ErrorCalls", {fixed('error_rate', 2)} as "ErrorRate(%)", {fixed('avg_duration_ms', 2)} as "AvgDuration(ms)",
    {fixed('p50_ms', 2)} as "p50(ms)", {fixed('p95_ms', 2)} as "p95(ms)", {fixed('p99_ms', 2)} as "p99(ms)" from endpoint"""


@register("k1_export_csv", with_ctes(CSV_SQL, **stats_ctes()))
def k1(spark, sf_dir):
    path = workspace(spark)
    sinks.export_csv(endpoints(spark, sf_dir), path)
    kinds = "Method string, Endpoint string, Calls long, ErrorCalls long, `ErrorRate(%)` string, `AvgDuration(ms)` string, `p50(ms)` string, `p95(ms)` string, `p99(ms)` string"
    return spark.read.option("header", True).schema(kinds).csv(path)


@register("k2_export_json", with_ctes(f"select {CRON} from cron_stats"))
def k2(spark, sf_dir):
    path, table = workspace(spark), crons(spark, sf_dir)
    sinks.export_json(path, cron_jobs=table)
    return rounded(spark.read.schema(table.schema).json(f"{path}/cron_jobs"))


@register(
    "k2_export_json_summary",
    with_ctes(
        """select 'overall' as part, 'total_requests' as name, cast(total_requests as varchar) as value from overall
        union all select 'endpoints', method || ' ' || path, cast(total_calls as varchar) from endpoint
        union all select 'cron_jobs', name, last_status from cron_stats
        union all select 'unmatched_samples', cast(line_no as varchar), l from (select line_no, l from kinds where kind = 'unmatched' order by line_no limit 50)""",
        **stats_ctes(),
    ),
)
def k2_summary(spark, sf_dir):
    """The whole summary as JSON, a folder for each of its tables, read again."""
    path, found = workspace(spark), classified(spark, sf_dir)
    chosen = fl.apply_filters(classify.http_requests(found))
    tables = {"overall": stats.overall_summary(chosen), "endpoints": stats.endpoint_stats(chosen), "cron_jobs": stats.cron_stats(classify.cron_events(found)), "unmatched_samples": classify.unmatched_samples(found)}
    sinks.export_json(path, **tables)
    shown = {"overall": ("'total_requests'", "total_requests"), "endpoints": ("method || ' ' || path", "total_calls"), "cron_jobs": ("name", "last_status"), "unmatched_samples": ("order_key", "text")}
    rows = [spark.read.schema(tables[t].drop("status_counts").schema).json(f"{path}/{t}").selectExpr(f"'{t}' as part", f"cast({n} as string) as name", f"cast({v} as string) as value") for t, (n, v) in shown.items()]
    return reduce(DataFrame.unionByName, rows)


@register("k2_export_parquet", with_ctes(f"select {ENDPOINT} from endpoint", **stats_ctes()))
def k2_parquet(spark, sf_dir):
    path = workspace(spark)
    sinks.export_parquet(path, endpoints=endpoints(spark, sf_dir))
    return rounded(spark.read.parquet(f"{path}/endpoints"))


@register(
    "k3_endpoint_report",
    with_ctes(
        """select 0 as section, method, path as endpoint, total_calls as calls, round(avg_duration_ms, 3) as avg_ms, round(cast(p50_ms as double), 3) as p50_ms, round(cast(p90_ms as double), 3) as p90_ms, round(cast(p95_ms as double), 3) as p95_ms, round(cast(p99_ms as double), 3) as p99_ms, error_calls as errors from endpoint
        union all select 1, 'Total', null, cast(sum(total_calls) as bigint), null, null, null, null, null, cast(sum(error_calls) as bigint) from endpoint having count(*) > 0""",
        **stats_ctes(),
    ),
)
def k3(spark, sf_dir):
    return rounded(views.endpoint_report(endpoints(spark, sf_dir)))


@register(
    "k4_cron_report",
    with_ctes(
        """select 0 as section, name as job, total_runs as runs, total_starts as starts, total_failures as fails, round(avg_duration_ms, 3) as avg_ms, round(cast(min_duration_ms as double), 3) as min_ms, round(cast(max_duration_ms as double), 3) as max_ms, last_status from cron_stats
        union all select 1, 'Total', cast(sum(total_runs) as bigint), null, cast(sum(total_failures) as bigint), null, null, null, null from cron_stats having count(*) > 0"""
    ),
)
def k4(spark, sf_dir):
    return rounded(views.cron_report(crons(spark, sf_dir)))


@register("k5_report_metadata", with_ctes("select (select count(*) from endpoint) as endpoints, (select count(*) from cron_stats) as jobs", **stats_ctes()))
def k5(spark, sf_dir):
    return views.report_metadata(endpoints(spark, sf_dir), crons(spark, sf_dir)).drop("generated")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to endpoint statistics, busiest first."""
    return views.sort_endpoints(endpoints(spark, sf_dir))

