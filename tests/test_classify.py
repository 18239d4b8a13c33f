"""Classification of edge lines, order, samples and streaming."""

import pytest
from pyspark.sql import functions as F

from logspark.operators import classify, stats
from logspark.operators import filters as fl
from logspark.sources import logs
from logspark.streaming import live

EDGE = [
    ("2025-03-09T07:41:02: GET /shop/cart 200 31.25 ms - 118", "http_a"),
    ("\x1b[0mPUT /shop/stock/list \x1b[36m204\x1b[0m 9.064 ms - 77\x1b[0m", "http_a"),
    ("1203.5ms\tDELETE /shop/orders/expired", "http_b"),
    ("2025-03-09T07:41:05: [cron] done send_mail 640ms", "cron"),
    ("warehouse worker is up", "unmatched"),
    ("", "empty"),
    (" \t", "empty"),
    ("GET /x 200 1 ms - -\r", "http_a"),
    ("GET /x 20 1 ms - 5", "unmatched"),
    ("GETX /x 200 1 ms - 5", "unmatched"),
    ("12msGET /y", "http_b"),
    ("[cron] start job a", "cron"),
    ("[cron] fail job  b  3.5 ms", "cron"),
    ("[cron] start", "unmatched"),
    ("[cron] start \x1b[0m", "unmatched"),
    ("2025-03-09T07:41:02.123Z GET /x 200 1 ms - 5", "unmatched"),
    ("a\rb lone cr", "unmatched"),
    ("HEAD /h 404 5. ms-7", "http_a"),
    ("PATCH /p 599 0 ms - 1 tail", "unmatched"),
    ("\x1b", "empty"),
    ("\x1b(B text", "unmatched"),
    ("[cron] done\x1b[0m job", "unmatched"),
    ("get /x 200 1 ms - 5", "unmatched"),
    ("GET /a\x1b[0m/b 200 1 ms - 5", "unmatched"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, line, k) for k, (line, _) in enumerate(EDGE)]
    return classify.classify_lines(spark.createDataFrame(rows, "line_no long, line string, order_key long")).cache()


def test_kinds(edge):
    assert [r["kind"] for r in edge.orderBy("line_no").collect()] == [k for _, k in EDGE]


def test_fields(edge):
    by = {r["line_no"]: r for r in edge.collect()}
    assert (by[0]["method"], by[0]["path"], by[0]["status"], by[0]["duration_ms"], by[0]["bytes"]) == ("GET", "/shop/cart", 200, 31.25, 118)
    assert by[0]["ts"].isoformat() == "2025-03-09T07:41:02"
    assert (by[1]["path"], round(by[1]["duration_ms"], 3), by[1]["bytes"]) == ("/shop/stock/list", 9.064, 77)
    assert (by[2]["status"], by[2]["path"]) == (200, "/shop/orders/expired")
    assert (by[3]["cron_event"], by[3]["cron_name"], by[3]["duration_ms"]) == ("done", "send_mail", 640)
    assert (by[11]["cron_name"], by[11]["duration_ms"]) == ("job a", None)
    assert (by[12]["cron_name"], by[12]["duration_ms"]) == ("job  b", 3.5)
    assert by[7]["bytes"] is None and by[17]["duration_ms"] == 5


def test_counts_and_samples(edge):
    n = classify.line_kind_counts(edge).first()
    assert (n["total_lines"], n["http_lines"], n["cron_lines"], n["empty_lines"], n["unmatched_lines"]) == (24, 6, 3, 3, 12)
    assert [r["text"] for r in classify.unmatched_samples(edge, 2).collect()] == ["warehouse worker is up", "GET /x 20 1 ms - 5"]


def test_end_to_end(spark, tmp_path):
    text = "2025-03-09T07:41:02: GET /shop/cart 200 31.25 ms - 118\n2025-03-09T07:41:03: GET /shop/cart 500 2.5 ms - 118\nPOST /shop/u/123456 201 7 ms - -\n2025-03-09T07:41:05: [cron] done send_mail 640ms\nwarehouse worker is up\n"
    (tmp_path / "a.log").write_text(text)
    lines = logs.read_log_lines(spark, str(tmp_path / "a.log"))
    assert lines.count() == 5
    found = classify.classify_lines(lines)
    rows = {(r["path"], r["method"]): r for r in stats.endpoint_stats(fl.apply_filters(classify.http_requests(found))).collect()}
    assert set(rows) == {("/shop/cart", "GET"), ("/shop/u/:id", "POST")}
    cart = rows["/shop/cart", "GET"]
    assert (cart["total_calls"], cart["error_calls"], cart["error_rate"], cart["status_counts"]) == (2, 1, 50.0, {200: 1, 500: 1})
    assert stats.cron_stats(classify.cron_events(found)).first()["name"] == "send_mail"


def test_lone_cr_is_one_line_and_no_phantom(spark, tmp_path):
    (tmp_path / "b.log").write_bytes(b"a\rb\n\nlast")
    assert sorted(r["line"] for r in logs.read_log_lines(spark, str(tmp_path / "b.log")).collect()) == ["", "a\rb", "last"]


def test_last_status_follows_file_order_over_splits(spark, tmp_path):
    events = ["done", "fail", "start"]
    lines = [f"[cron] {events[k % 3]} j{k % 7} 5ms" for k in range(3000)] + ["[cron] start only"]
    (tmp_path / "c.log").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = classify.classify_lines(logs.read_log_lines(spark, str(tmp_path / "c.log")))
        got = {r["name"]: r["last_status"] for r in stats.cron_stats(classify.cron_events(found)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {"only": "unknown"}
    for k in range(3000):
        if k % 3 < 2:
            want[f"j{k % 7}"] = ("success", "failed")[k % 3]
    assert got == want


def test_hostile_lines_end(spark):
    lines = [" " * 200_000 + "x", "GET " + "/a" * 50_000, "\x1b[" * 2000 + "[cron] done x", "9" * 5000 + " ms GET /x"]
    found = classify.classify_lines(spark.createDataFrame([(x,) for x in lines] + [(None,)], "line string"))
    # The third is a job's line after a thousand codes: there is no limit to their number.
    assert [r["kind"] for r in found.collect()] == ["unmatched", "unmatched", "cron", "http_b", "unmatched"]


def test_a_job_line_of_many_codes(spark):
    line = "\x1b[0m" * 600 + "2025-03-09T07:41:05: [cron]" + "\x1b[1m" * 600 + "done \x1b[0mse\x1b[1mnd \x1b[0m" + "7ms" + "\x1b[0m" * 600
    row = classify.classify_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert (row["kind"], row["cron_event"], row["cron_name"], row["duration_ms"]) == ("cron", "done", "send", 7)


def test_fields_that_are_not_asked_for_are_not_made(spark):
    from logspark.plans import queries

    plan = queries.QUERIES["f1_filter_method"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp_ntz" not in plan.split("Generate")[0] and "CRON" not in plan and "try_to_timestamp" not in plan


def test_parsed_table(spark, tmp_path):
    from logspark.plans import queries
    from logspark.sources import parsed

    parsed.save_parsed(queries.classified(spark, "/root/testdata/sf0.001"), str(tmp_path / "p"))
    table = parsed.read_parsed(spark, str(tmp_path / "p"))
    chosen = fl.apply_filters(classify.http_requests(table), fl.FilterOptions(method="POST", max_duration_ms=100.0))
    want = fl.apply_filters(queries.requests(spark, "/root/testdata/sf0.001"), fl.FilterOptions(method="POST", max_duration_ms=100.0))
    key = ["method", "path", "status", "duration_ms", "norm_path"]
    assert sorted(map(tuple, chosen.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    plan = chosen.groupBy("status").count()._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "FileScan parquet" in x][0]
    assert "EqualTo(method,POST)" in scan and "LessThanOrEqual(duration_ms" in scan and "PartitionFilters: [kind" in scan
    assert "path" not in scan.split("ReadSchema")[1] and "regexp" not in plan
    assert classify.line_kind_counts(table).first() == classify.line_kind_counts(queries.classified(spark, "/root/testdata/sf0.001")).first()


def test_windowed_errors_drop_late_lines(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stamp = lambda m, s, code: f"2025-03-09T07:{m:02d}:{s:02d}: GET /w {code} 1 ms - -\n"
    (src / "0.log").write_text(stamp(0, 5, 200) + stamp(0, 50, 500) + stamp(1, 1, 404) + "no stamp\n" + stamp(30, 0, 200))
    found = live.windowed_errors(logs.stream_log_lines(spark, str(src)))
    start = lambda: found.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    start().start().awaitTermination()
    assert sorted((r["calls"], r["errors"]) for r in spark.table("windows").collect()) == [(1, 1), (2, 1)]


def test_streaming_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.log").write_text("".join(f"GET /p/{j % 2} 200 {j + k}.5 ms - -\n" for j in range(10)))
    rows = live.live_bucket_rows(logs.stream_log_lines(spark, str(src)))
    query = rows.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = ["norm_path", "method", "bucket", "calls"]
    batch = stats.bucket_rows(fl.apply_filters(classify.http_requests(classify.classify_lines(logs.read_log_lines(spark, str(src))))))
    assert sorted(map(tuple, spark.table("live").select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    assert sorted(r["total_calls"] for r in stats.endpoint_stats_of(spark.table("live")).collect()) == [15, 15]


def test_one_data_shuffle_and_no_python(spark):
    from logspark.plans import queries

    plan = queries.endpoints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2  # buckets, then their small table
    assert "Python" not in plan and "Arrow" not in plan


def test_filters_compose(spark):
    rows = spark.createDataFrame([("GET", "/a/123456", 404, 5.0), ("GET", "/a/b%", 200, 50.0), ("POST", "/A/_", 503, 500.0)], "method string, path string, status int, duration_ms float")
    count = lambda **o: fl.apply_filters(rows, fl.FilterOptions(**o)).count()
    assert (count(), count(method="GET"), count(status_family=fl.ERROR_ONLY), count(min_duration_ms=50.0), count(max_duration_ms=50.0)) == (3, 2, 2, 2, 2)
    assert (count(search=":ID"), count(search="%"), count(search="123456"), count(search="123456", path_mode="raw")) == (1, 1, 0, 1)


def test_quantiles_within_a_percent(spark):
    from logspark.functions import histogram as h

    rows = spark.range(1, 1001).select((F.col("id") * 10).cast("float").alias("v"))
    cells = rows.groupBy(h.bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))
    assert abs(cells.select(h.quantile(F.col("c"), 0.95)).first()[0] / 9510 - 1) < 0.011
    empty = rows.where("v < 0").select(h.bucket(F.col("v")).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("bucket", F.lit(1).cast("long").alias("n")))).alias("c"))
    assert empty.select(h.quantile(F.col("c"), 0.5)).first()[0] == 0.0
