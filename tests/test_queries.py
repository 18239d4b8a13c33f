"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from logspark.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages")
SOME = ("f1_filter_method", "f9_filter_search_raw", "f9_filter_search_cube", "a1_stored_day", "c14_stored_samples", "s2_stamp_order", "a8_job_runs", "a9_true_average", "p9_stored_distinct", "h2_stored_merge", "h3_stored_quantiles", "s1_read_log_lines", "s2_line_order", "s4_empty_input", "s5_utf8_lossy", "s6_parsed_table", "p7_is_pr_id", "k2_export_json_summary", "c9_cron", "c15_line_kind_counts", "p1_pages_raw", "p2_pages_strip_query", "p3_norm_collapse_ids", "f10_filter_compose", "a1_endpoint_stats", "a5_status_counts_map", "a7_overall_summary", "a8_cron_stats", "h3_hist_quantile", "h5_exact_quantile", "o5_sort_by_avg", "o12_kpi_cards", "o16_cron_view", "k1_export_csv", "k2_export_json", "k3_endpoint_report", "k4_cron_report")


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    sql = con.sql(queries.ORACLES[name])
    assert sorted(sql.columns) == sorted(found.columns)
    key = lambda row: tuple(map(repr, row))
    want = sql.select(*(f'"{c}"' for c in found.columns)).fetchall()
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name, column, descending", [("o21_sort_all_by_avg_desc", "avg_duration_ms", True), ("o17_sort_all_by_path_asc", "path", False), ("o3_sort_by_calls", "total_calls", True)])
def test_sorts_return_every_endpoint(spark, name, column, descending):
    """On enough endpoints that a first page would lose some; the order is checked too."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    want = con.sql(queries.ORACLES[name])
    want = want.select(*(f'"{c}"' for c in found.columns)).fetchall()
    assert len(rows) > 25 and sorted(rows, key=repr) == sorted(want, key=repr)
    values = [r[found.columns.index(column)] for r in rows]
    assert values == sorted(values, reverse=descending)


def test_exact_quantiles_gather_no_group(spark, tmp_path):
    """A hot user, equal, null and odd values: as from the array of all values, but without one."""
    from pyspark.sql import functions as F

    rows = [(1, float(k * 7919 % 20011)) for k in range(20000)] + [(2, 3.5)] * 900 + [(3, None), (3, -1.0), (None, 2.0), (None, float("nan")), (4, None)]
    events = spark.createDataFrame(rows + [(k, float(k % 7)) for k in range(5, 400)], "user_id long, value double").repartition(8)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # small parts stay parts
    try:
        found = queries.histogram.exact_quantiles(events, "user_id", "value", str(tmp_path / "parts"))
    finally:
        spark.conf.set(name, before)
    whole = events.groupBy("user_id").agg(F.collect_list("value").alias("v"))
    want = whole.select("user_id", *(queries.histogram.exact_quantile(F.col("v"), q).alias(f"p{round(q * 100)}") for q in queries.histogram.QUANTILES))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert spark.read.parquet(str(tmp_path / "parts")).where("g = 1").select("part").distinct().count() > 1


def test_exact_quantile_query_has_no_array_of_a_group(spark):
    plan = queries.QUERIES["h5_exact_quantile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_flagship(spark):
    rows = queries.flagship(spark, SF)
    calls = [r["total_calls"] for r in rows.collect()]
    assert calls and calls == sorted(calls, reverse=True)
