"""The log store: parse once, cluster, search the dictionary, add up counts, exactly once; order by stamps; job runs."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from logspark.functions import paths
from logspark.operators import classify, stats, stored
from logspark.operators import filters as fl
from logspark.sources import derived, logs, parsed, workspace
from logspark.sources.store import LogStore
from logspark.streaming import live

SF = "/root/testdata/sf0.001"
NONE = fl.FilterOptions()
OPTIONS = {
    "none": NONE,
    "method": fl.FilterOptions(method="POST"),
    "4xx": fl.FilterOptions(status_family=fl.CLIENT_ERROR),
    "5xx": fl.FilterOptions(status_family=fl.SERVER_ERROR),
    "durations": fl.FilterOptions(method="GET", min_duration_ms=10, max_duration_ms=300),
    "search": fl.FilterOptions(search="/API/C"),
    "short search": fl.FilterOptions(search="i/"),
    "odd search": fl.FilterOptions(search="É%_"),
    "raw": fl.FilterOptions(search="AB-cd", path_mode=paths.RAW),
    "bare": fl.FilterOptions(method="GET", search="ab-cd", path_mode=paths.STRIP_QUERY, status_family=fl.ERROR_ONLY),
    "all": fl.FilterOptions(method="GET", status_family=fl.ERROR_ONLY, min_duration_ms=10, max_duration_ms=300, search=":id"),
}


def written(spark, lines, folder, name="a.log"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def lines(spark):
    """The derived log, its month dealt to three days."""
    three = lambda m: f"2024-01-0{int(m[1]) % 3 + 1}"
    return [re.sub(r"2024-01-(\d\d)", three, r["line"]) for r in derived.lines(spark, SF).orderBy("line_no").collect()]


@pytest.fixture(scope="module")
def whole(spark, lines, tmp_path_factory):
    """One store of the whole log, and the classified lines it was made of."""
    root = tmp_path_factory.mktemp("store")
    written(spark, lines, root / "logs")
    store = LogStore(spark, str(root / "store"))
    assert store.add_files(str(root / "logs")) == 1
    return store, classify.classify_lines(logs.read_log_lines(spark, str(root / "logs"))).cache()


def figures(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", OPTIONS)
def test_statistics_from_the_store_are_those_of_the_lines(whole, name):
    store, found = whole
    options = OPTIONS[name]
    chosen = fl.apply_filters(classify.http_requests(found), options)
    want = figures(stats.endpoint_stats(chosen))
    assert figures(stored.endpoint_stats(store, options)) == want
    assert figures(stored.endpoint_stats(store, options, from_rows=True)) == want
    assert figures(stored.overall_summary(store, options)) == figures(stats.overall_summary(chosen))
    assert want or name == "odd search"


def test_other_tables(whole):
    store, found = whole
    assert figures(stored.line_kind_counts(store)) == figures(classify.line_kind_counts(found))
    drop = lambda rows: [r["text"] for r in rows]
    n = len([r for r in found.where("kind = 'unmatched'").collect()])
    assert stored.unmatched_samples(store, 10_000).count() == n and len(drop(stored.unmatched_samples(store).collect())) == min(n, 50)
    assert figures(stored.crons(store).select("name", "event", "duration_ms").na.fill(0)) == figures(classify.cron_events(found).select("name", "event", "duration_ms").na.fill(0))
    exact, near = stored.distinct_counts(store).first(), stored.estimated_counts(store).first()
    chosen = fl.apply_filters(classify.http_requests(found))
    assert tuple(stats.distinct_paths(chosen).first()) == (exact["raw_paths"], exact["norm_paths"])
    assert exact["endpoints"] == chosen.select("norm_path", "method").distinct().count()
    assert all(abs(near[c] - exact[c]) <= 0.05 * exact[c] for c in ("raw_paths", "bare_paths", "norm_paths", "endpoints"))
    plan = stored.estimated_counts(store)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_two_halves_are_the_whole_and_each_file_is_read_once(spark, whole, lines, tmp_path):
    store, _ = whole
    half = LogStore(spark, str(tmp_path / "store"))
    written(spark, lines[:430], tmp_path / "logs", "a.log")
    assert half.add_files(str(tmp_path / "logs")) == 1 and half.add_files(str(tmp_path / "logs")) == 0
    written(spark, lines[430:], tmp_path / "logs", "b.log")
    assert half.add_files(str(tmp_path / "logs")) == 1
    for options in (NONE, OPTIONS["method"], OPTIONS["bare"], OPTIONS["durations"], OPTIONS["search"]):
        assert figures(stored.endpoint_stats(half, options)) == figures(stored.endpoint_stats(store, options))
    assert figures(stored.overall_summary(half)) == figures(stored.overall_summary(store))
    assert figures(stored.estimated_counts(half)) == figures(stored.estimated_counts(store))
    assert figures(stored.distinct_counts(half)) == figures(stored.distinct_counts(store))
    old = half.batches()
    assert len(old) == 2
    half.merge()
    assert len(half.batches()) == 1 and half.new_files(str(tmp_path / "logs")) == []
    for options in (NONE, OPTIONS["bare"], OPTIONS["durations"]):
        assert figures(stored.endpoint_stats(half, options)) == figures(stored.endpoint_stats(store, options))
    assert figures(stored.estimated_counts(half)) == figures(stored.estimated_counts(store))
    assert figures(stored.line_kind_counts(half)) == figures(stored.line_kind_counts(store))
    assert figures(stored.latency(half, ["method"])) == figures(stored.latency(store, ["method"]))
    half.add(logs.read_log_lines(spark, str(tmp_path / "logs" / "a.log")), old[0])  # known by its name
    assert figures(stored.overall_summary(half)) == figures(stored.overall_summary(store))


def test_a_batch_that_broke_off_is_not_seen_and_one_run_twice_counts_once(spark, lines, tmp_path):
    written(spark, lines[:300], tmp_path / "logs")
    store = LogStore(spark, str(tmp_path / "store"))
    read = lambda: logs.read_log_lines(spark, str(tmp_path / "logs"))
    store.add(read(), "one")
    once = figures(stored.endpoint_stats(store))
    store.add(read(), "one")
    assert figures(stored.endpoint_stats(store)) == once
    store.add(read(), "two")
    assert sum(r[2] for r in figures(stored.endpoint_stats(store))) == 2 * sum(r[2] for r in once)
    workspace.remove(spark, f"{store.path}/batches/batch=two")
    assert figures(stored.endpoint_stats(store)) == once and stored.line_kind_counts(store).first()["total_lines"] == 300


def test_empty_store_and_logs_without_requests(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    assert stored.endpoint_stats(store).collect() == [] and stored.overall_summary(store).first()["total_requests"] == 0
    written(spark, ["nothing", "[cron] start a"], tmp_path / "logs")
    assert store.add_files(str(tmp_path / "logs")) == 1
    (tmp_path / "logs" / "empty.log").write_text("")  # no lines: nothing to read
    assert store.add_files(str(tmp_path / "logs")) == 0
    assert stored.endpoint_stats(store, OPTIONS["search"]).collect() == [] and stored.line_kind_counts(store).first()["unmatched_lines"] == 1
    assert stored.estimated_counts(store).first()["raw_paths"] == 0


def scanned(df, column):
    """(description of the scan that puts out a column, the rows it has put out) after a run."""
    df.collect()

    def scans(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return scans(node.plan())
        own = [(node.toString(), node.metrics().apply("numOutputRows").value())] if name == "FileSourceScanExec" and f"{column}#" in node.toString() else []
        children = node.children()
        return own + [x for k in range(children.size()) for x in scans(children.apply(k))]

    return scans(df._jdf.queryExecution().executedPlan())[0]


def test_filters_reach_the_scan_and_files_are_skipped(spark, tmp_path):
    """Rows clustered by method and status: a filter leaves out row groups, a day all other folders."""
    methods, statuses = ("GET", "POST", "PUT", "DELETE"), (200, 301, 404, 500)
    rows = [f"2025-03-0{1 + k % 3}T07:00:{k % 60:02d}: {methods[k % 4]} /p/{k % 50} {statuses[k // 4 % 4]} {k % 997}.5 ms - 1" for k in range(24_000)]
    written(spark, rows, tmp_path / "logs")
    store = LogStore(spark, str(tmp_path / "store"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        store.add_files(str(tmp_path / "logs"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total = len(rows)
    text, n = scanned(stored.requests(store, fl.FilterOptions(method="POST")).groupBy("status").count(), "method")
    assert "EqualTo(method,POST)" in text and "PushedFilters" in text and n < 0.6 * total
    text, n = scanned(stored.requests(store, fl.FilterOptions(method="PUT", status_family=fl.CLIENT_ERROR, min_duration_ms=5.0)).groupBy("id").count(), "method")
    assert "GreaterThanOrEqual(status,400)" in text and "GreaterThanOrEqual(duration_ms,5.0)" in text and n < 0.4 * total
    days = (date(2025, 3, 2), date(2025, 3, 2))
    text, n = scanned(stored.requests(store, days=days).groupBy("method").count(), "method")
    assert "PartitionFilters" in text and "day" in text.split("PartitionFilters")[1].split("]")[0] and n == total // 3
    text, n = scanned(stored.endpoint_stats(store, days=days), "status_group")
    assert n <= store.table("cube").where("day = '2025-03-02'").count() < store.table("cube").count() / 2


def test_the_search_text_is_nowhere_above_the_rows(whole):
    store, _ = whole
    for mode in paths.MODES:
        plan = stored.requests(store, fl.FilterOptions(search="ab-cd", path_mode=mode))._jdf.queryExecution().optimizedPlan().toString()
        left = plan.split("LeftSemi")[1].split("Relation")[0]
        assert "Contains" not in left and "ab-cd" not in left
        assert "gram" in plan and "PushedFilters: [" in store.table("grams").where("gram = 'abc'")._jdf.queryExecution().executedPlan().toString()


def test_trigrams_leave_few_forms(whole):
    """What the trigrams let through is compared, so a text whose trigrams all occur elsewhere in the form is not found."""
    store, _ = whole
    forms = [r["form"] for r in store.forms(paths.RAW).collect()]
    for text in ("api", "/api/", "-cd-0", "aaaaaaaa", "zzz", "?page=3", "p/i"):
        assert sorted(r["form"] for r in stored.matching_forms(store, text, paths.RAW).collect()) == sorted(f for f in forms if text in f.lower())


def test_sketches(spark):
    """Merged in any way they say what the whole histogram says; an unknown version is refused."""
    from logspark.functions import histogram, sketch

    r = random.Random(4)
    rows = [(k % 3, k % 7, r.choice([0.0, 1e-9, 1e12, r.expovariate(0.01), r.expovariate(1)])) for k in range(3000)] + [(3, 0, 0.0), (4, 1, None)]
    cells = spark.createDataFrame(rows, "g int, part int, v double").select("g", "part", histogram.bucket(F.col("v")).alias("bucket"), F.lit(1).alias("n"))
    whole = {x["g"]: x for x in sketch.aggregate(cells, ["g"]).collect()}
    parts = sketch.aggregate(cells, ["g", "part"])
    assert {x["g"]: x for x in sketch.merge_groups(parts, ["g"]).collect()} == whole
    one = parts.where("g = 1").select("part", "sketch")
    pair = one.where("part = 0").select(F.col("sketch").alias("a")).crossJoin(one.where("part = 4").select(F.col("sketch").alias("b"))).crossJoin(parts.where("g = 3").select(F.col("sketch").alias("none")))
    m = pair.select(sketch.merge(F.col("a"), F.col("b")).alias("ab"), sketch.merge(F.col("none"), F.col("a")).alias("a2"), "a", sketch.count(F.col("a")).alias("n"))
    want = sketch.aggregate(cells.where("g = 1 and part in (0, 4)"), ["g"]).first()["sketch"]
    got = m.first()
    assert got["ab"] == want and got["a2"] == got["a"] and got["n"] == sum(got["a"]["counts"])
    assert (whole[3]["sketch"]["first"], whole[4]["sketch"]["counts"]) == (None, [])
    qs = (0.0, 0.5, 0.99, 1.0)
    found = {x["g"]: x for x in sketch.aggregate(cells, ["g"]).select("g", *(sketch.quantile(F.col("sketch"), q).alias(f"q{k}") for k, q in enumerate(qs))).collect()}
    for g in range(3):
        v = sorted(x for a, _, x in rows if a == g and x)
        for k, q in enumerate(qs):
            exact = min(max(v[int(q * (len(v) - 1))], histogram.GAMMA ** (histogram.LEAST - 1)), histogram.GAMMA**histogram.MOST)
            assert abs(found[g][f"q{k}"] - exact) <= 0.0101 * exact
    assert found[3]["q1"] == 0
    old = parts.withColumn("sketch", F.col("sketch").withField("version", F.lit(0)))
    with pytest.raises(Exception, match="a sketch of version 0"):
        sketch.merge_groups(old, ["g"]).collect()


# --- order by stamps ---------------------------------------------------------------


def test_rotated_files_are_put_in_order(spark, tmp_path):
    """app.log goes on where app.log.1 ends, though its name comes first; unstamped lines follow the line before them."""
    def at(k):
        return f"2025-03-09T07:{k // 60:02d}:{k % 60:02d}: "

    events = [("done" if k % 3 else "fail") for k in range(400)]
    rows = [(at(k) if k % 5 == 0 else "") + f"[cron] {events[k]} j{k % 4} 5ms" for k in range(400)]
    written(spark, rows[:250], tmp_path / "logs", "app.log.1")
    written(spark, rows[250:], tmp_path / "logs", "app.log")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        store = LogStore(spark, str(tmp_path / "store"))
        store.add_files(str(tmp_path / "logs"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r["name"]: r["last_status"] for r in stats.cron_stats(stored.crons(store)).collect()}
    want = {f"j{k % 4}": {"done": "success", "fail": "failed"}[events[k]] for k in range(400)}
    assert got == want
    order = [r["event"] for r in stored.crons(store).orderBy("order_key").collect()]
    assert order == events
    assert stored.crons(store).where("order_key.stamp is null").count() == 0


def test_heads_of_files_take_their_first_stamp(spark, tmp_path):
    written(spark, ["no stamp", "[cron] start a", "2025-03-09T07:00:00: [cron] done a", "2025-99-09T07:00:00: is no date", "tail"], tmp_path / "logs", "a.log")
    written(spark, ["without", "any"], tmp_path / "logs", "b.log")
    store = LogStore(spark, str(tmp_path / "store"))
    store.add_files(str(tmp_path / "logs"))
    found = {r["text"]: r["day"] for r in store.table("unmatched").collect()}
    assert found == {"no stamp": date(2025, 3, 9), "2025-99-09T07:00:00: is no date": date(2025, 3, 9), "tail": date(2025, 3, 9), "without": None, "any": None}
    assert {r["day"] for r in store.table("crons").collect()} == {date(2025, 3, 9)}


# --- runs of jobs --------------------------------------------------------------------


def plain_runs(events):
    out, opened = [], {}
    for key, name, event, _ in events:
        if event == "start":
            opened.setdefault(name, []).append(key)
        else:
            mine = opened.get(name, [])
            out.append((name, mine.pop(0) if mine else None, key, {"done": "success", "fail": "failed"}[event]))
    return sorted(out + [(n, k, None, "running") for n, keys in opened.items() for k in keys], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_paired_over_parts(spark, tmp_path, seed):
    """A hot job lies in many parts; runs overlap, end without a start, or go on."""
    r = random.Random(seed)
    events = [(k, "hot" if r.random() < 0.7 else f"j{r.randrange(5)}", r.choice(["start", "start", "done", "fail"] if seed == 1 else ["start", "done", "fail"]), float(k % 7)) for k in range(900)]
    table = spark.createDataFrame(events, "order_key long, name string, event string, duration_ms float")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = stored.job_runs(table, str(tmp_path / "runs"))
        got = sorted(((x["name"], x["start_key"], x["end_key"], x["outcome"]) for x in runs.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == plain_runs(events)
    assert spark.read.parquet(str(tmp_path / "runs")).where("name = 'hot'").select("part").distinct().count() > 1


def test_true_average_beside_the_diluted_one(spark, tmp_path):
    events = [(0, "a", "start", None), (1, "a", "done", 10.0), (2, "a", "start", None), (3, "a", "fail", 30.0), (4, "b", "start", None)]
    table = spark.createDataFrame(events, "order_key long, name string, event string, duration_ms float")
    runs = {r["name"]: r for r in stored.run_stats(stored.job_runs(table, str(tmp_path / "runs"))).collect()}
    assert (runs["a"]["avg_finished_ms"], runs["a"]["finished"], runs["b"]["running"], runs["b"]["avg_finished_ms"]) == (20.0, 2, 1, None)
    assert {r["name"]: r["avg_duration_ms"] for r in stats.cron_stats(table).collect()}["a"] == 10.0


# --- a stream into the store ---------------------------------------------------------


def test_a_stream_into_the_store(spark, whole, lines, tmp_path):
    """Files arrive in two batches; a batch that is run again changes nothing."""
    (tmp_path / "in").mkdir()
    store = LogStore(spark, str(tmp_path / "store"))

    def run():
        query = live.into_store(logs.stream_log_files(spark, str(tmp_path / "in")), store, str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()

    written(spark, lines[:400], tmp_path / "in", "a.log")
    run()
    written(spark, lines[400:], tmp_path / "in", "b.log")
    run()
    assert len(store.batches()) == 2
    want = figures(stored.endpoint_stats(whole[0]))
    assert figures(stored.endpoint_stats(store)) == want
    again = spark.read.option("lineSep", "\n").text(str(tmp_path / "in" / "b.log")).select("value", *logs._metadata())
    live.store_batch(store)(again, 1)
    assert figures(stored.endpoint_stats(store)) == want


def test_parsed_table_still_reads(spark, tmp_path):
    found = classify.classify_lines(derived.lines(spark, SF))
    parsed.save_parsed(found, str(tmp_path / "parsed"))
    assert parsed.read_parsed(spark, str(tmp_path / "parsed")).where(F.col("kind") == "cron").count() == found.where("kind = 'cron'").count()


def test_no_step_of_the_store_shuffles_more_than_its_lines(spark, tmp_path):
    """Trigrams and counts of the three path modes stay in the tasks that make them: forms and requests are dealt out."""
    written(spark, [f"2025-03-01T07:00:{k % 60:02d}: GET /shop/{k:05d}/a-long-name-with-many-trigrams?q={k * 7919 % 10007} 200 {k % 499 + 1}.5 ms - 1" for k in range(6_000)], tmp_path / "logs")
    stages = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        found = stages.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = shuffled()
    store = LogStore(spark, str(tmp_path / "store"))
    assert store.add_files(str(tmp_path / "logs")) == 1
    new = {k: n for k, n in shuffled().items() if k not in before}
    assert store.table("grams").count() > 100_000 and max(new.values()) <= 3 * 6_000  # forms of three modes at most
    assert sum(new.values()) <= 15 * 6_000
    assert store.table("cube").groupBy("mode").agg(F.sum("calls").alias("n")).where("n = 6000").count() == 3


def test_search_for_more_trigrams_than_a_number_has_bits(spark, tmp_path):
    long = "/".join(f"part{k}of" for k in range(20))
    written(spark, [f"GET /{long}/{end} 200 1.5 ms - 1" for end in ("this", "that")] + [f"GET /{long[:90]} 200 1.5 ms - 1"], tmp_path / "logs")
    store = LogStore(spark, str(tmp_path / "store"))
    store.add_files(str(tmp_path / "logs"))
    assert [r["form"] for r in stored.matching_forms(store, f"{long}/THIS".upper()).collect()] == [f"/{long}/this"]
    assert stored.matching_forms(store, long).count() == 2
