"""A store of parsed logs: every file is parsed once, later questions read what is stored.

A store is a folder of Parquet tables, each with a folder for each batch of
files (batch=...), and below that, where rows have a time, one for each day
(day=...).  A batch is seen only once its row in `batches` is written, which
comes last, and writing a batch again replaces it: a job that was broken off
or a stream's batch that is run twice changes nothing.

| table | rows |
|-|-|
| requests | HTTP requests: day, method, family, status, duration, bytes, time, ids of the path's three forms |
| forms | the dictionary: mode, id, form; for raw paths also the ids of their other forms |
| grams | trigrams of the forms in lower case: mode, gram, id |
| cube | partial counts by mode, day, form, method, status group and histogram bucket; a key may have several rows, which add up |
| sketches | by day, mergeable sketches of different paths and endpoints (HLL) |
| latency | by day, form of the default mode and method: a histogram as one column (functions/sketch.py) |
| crons | scheduled jobs' events in order |
| unmatched, samples | unmatched lines in order; the first SAMPLES of each batch |
| counts | lines of each kind by day |
| batches, files | what has been read |

Requests are dealt out and sorted by day, method, status family and path, with
the duration and the line's place behind them (so that a busy endpoint is cut
over files): row groups are narrow in these columns and skipped by a filter.
A line without a time has that of the line before it (sources/logs.py); lines
of files without any time have no day.

An id is a 64-bit hash of a form.  Two forms of one id would be counted as one:
`add` looks for such pairs and raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import sketch
from logspark.functions.histogram import bucket
from logspark.functions.paths import COLLAPSE_IDS, MODES, RAW, STRIP_QUERY, normalize_path
from logspark.operators import classify
from logspark.operators.stats import status_group
from logspark.sources import logs, workspace

#: The column of requests that holds the id of a path's form.
ID_OF = {RAW: "path_id", STRIP_QUERY: "bare_id", COLLAPSE_IDS: "norm_id"}
SAMPLES = 50
#: Requests that a task counts at a time for the cube, some 80 bytes each.
COUNTED = 500_000
#: Trigrams of a part of `grams`: a part is sorted in memory.
GRAMS = 2_000_000
#: log2 of the registers of a sketch: the standard error is about 1.04 / sqrt(2**12) = 1.6 %.
SKETCH_LOG2 = 12
_ORDER = "struct<stamp: timestamp_ntz, file: string, block: bigint, row: bigint>"
SCHEMAS = {
    "requests": "kind string, method string, family int, status int, duration_ms float, bytes bigint, stamp timestamp_ntz, path_id bigint, bare_id bigint, norm_id bigint, day date",
    "forms": "id bigint, form string, bare_id bigint, norm_id bigint, mode string",
    "grams": "gram string, id bigint, mode string",
    "cube": "id bigint, method string, status_group int, bucket int, calls bigint, errors bigint, total double, least float, most float, mode string, day date",
    "sketches": "raw_paths binary, bare_paths binary, norm_paths binary, endpoints binary, day date",
    "latency": f"id bigint, method string, sketch {sketch.TYPE}, day date",
    "crons": f"order_key {_ORDER}, name string, event string, duration_ms float, day date",
    "unmatched": f"order_key {_ORDER}, text string, day date",
    "samples": f"order_key {_ORDER}, text string",
    "counts": "kind string, n bigint, day date",
    "files": "file_path string, file_size bigint",
    "batches": "batch string, n_files bigint, replaces array<string>",
}
#: Folders below a batch's.
PARTITIONS = {"requests": ["day"], "cube": ["day"], "crons": ["day"], "unmatched": ["day"]}


#: What requests are dealt out and sorted by, first of all.
_CLUSTERED = ["day", "method", "family", "norm_id", "path_id"]
_CUBE_KEYS = ["mode", "day", "id", "method", "status_group", "bucket"]


def _cube_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("calls", "errors", "total")] + [F.min("least").alias("least"), F.max("most").alias("most")]


def _sorted_cube(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("day", "mode", "id", "method", "status_group", "bucket").sortWithinPartitions("day", "mode", "id", "method")


def form_id(form: Column) -> Column:
    return F.xxhash64(form)


def trigrams(form: Column) -> Column:
    """Different runs of three characters of the form in lower case."""
    low = F.lower(form)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class LogStore:
    """The store in the folder `path`, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- reading

    def batches(self) -> list[str]:
        """Names of the batches that are wholly written, a folder each in `batches`, without those that were merged."""
        found = self._written()
        merged = self._merged(found)
        return [b for b in found if b not in merged]

    def _written(self) -> list[str]:
        return [n.removeprefix("batch=") for n in workspace.folders(self.spark, f"{self.path}/batches") if n.startswith("batch=") and workspace.exists(self.spark, f"{self.path}/batches/{n}/_SUCCESS")]

    def _merged(self, written: list[str]) -> set[str]:
        """Batches that others stand for."""
        places = [f"{self.path}/batches/batch={b}" for b in written if b.startswith("merged-")]
        return {r["b"] for r in self.spark.read.schema(SCHEMAS["batches"]).parquet(*places).select(F.explode("replaces").alias("b")).collect()} if places else set()

    def table(self, name: str) -> DataFrame:
        """A table over all whole batches; filters on day and mode leave out folders."""
        places = [f"{self.path}/{name}/batch={b}" for b in self.batches()]
        if not places:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").option("recursiveFileLookup", "false").parquet(*places).select(*(c.split()[0] for c in _columns(SCHEMAS[name])))

    def forms(self, mode: str) -> DataFrame:
        """(id, form) of all paths in a mode, each once."""
        rows = self.table("forms").where(F.col("mode") == mode).select("id", "form")
        return rows if len(self.batches()) == 1 else rows.distinct()  # an id has one form; a batch has it once

    # --- writing

    def new_files(self, paths: str | list[str]) -> list[tuple[str, int]]:
        """(path, bytes) of the files that no batch has read yet, by path."""
        listed = self.spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
        plain = F.regexp_replace("file_path", "^file:/+", "file:///")  # one spelling of local files
        known = self.table("files").select(plain.alias("file_path"))
        return sorted((r["file_path"], r["file_size"]) for r in listed.withColumn("file_path", plain).join(known, "file_path", "left_anti").collect())

    def add_files(self, paths: str | list[str]) -> int:
        """Read the files that the store doesn't know, as one batch; how many they are."""
        found = self.new_files(paths)
        if found:
            name = hashlib.sha256("\n".join(f"{p} {n}" for p, n in found).encode()).hexdigest()[:16]
            self.add(logs.read_log_lines(self.spark, [p for p, _ in found]), f"files-{name}")
        return len(found)

    def add(self, lines: DataFrame, batch: str) -> None:
        """Write lines (as of read_log_lines) as the batch of that name, in place of an earlier one; nothing if it was merged."""
        if batch in self._merged(self._written()):
            return
        workspace.remove(self.spark, f"{self.path}/batches/batch={batch}")
        stage = f"{self.path}/_stage/{batch}"
        self._parse(lines, stage)
        rows = self.spark.read.option("basePath", stage).parquet(stage) if self._staged(stage) else None
        if rows is not None:
            ends = self._kept(logs.split_ends(rows), f"{stage}/_ends")
            self._write_all(logs.in_stamp_order(rows, ends).withColumn("day", F.to_date("stamp")), batch)
        n_files = self.spark.read.schema(SCHEMAS["files"]).parquet(f"{self.path}/files/batch={batch}").count() if rows is not None else 0
        workspace.remove(self.spark, stage)
        self._seen(batch, n_files, [])

    def _seen(self, batch: str, n_files: int, replaces: list[str]) -> None:
        self.spark.createDataFrame([(batch, n_files, replaces)], SCHEMAS["batches"]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def merge(self) -> None:
        """All batches as one: rows clustered anew, counts added up, sketches merged; the old ones' files are removed.

        Readers see the old batches until the new one is wholly written, and then that one alone.  A batch that was
        merged stays known by its name, so adding it again changes nothing.
        """
        old = self.batches()
        if len(old) < 2:
            return
        gone = sorted(set(old) | self._merged(self._written()))
        batch = f"merged-{hashlib.sha256(' '.join(gone).encode()).hexdigest()[:16]}"
        t = {name: self.table(name) for name in SCHEMAS if name != "batches"}
        order = [*_CLUSTERED, "duration_ms", "stamp"]
        self._write("requests", batch, t["requests"].repartitionByRange(*order).sortWithinPartitions(*order))
        self._write("forms", batch, t["forms"].groupBy("mode", "id", "form").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("bare_id", "norm_id"))))
        self._write("grams", batch, t["grams"].distinct().repartitionByRange("mode", "gram", "id").sortWithinPartitions("mode", "gram", "id"))
        self._write("cube", batch, _sorted_cube(t["cube"].groupBy(*_CUBE_KEYS).agg(*_cube_sums())))
        self._write("latency", batch, sketch.merge_groups(t["latency"], ["day", "id", "method"]))
        self._write("sketches", batch, t["sketches"].groupBy("day").agg(*(F.hll_union_agg(c).alias(c) for c in ("raw_paths", "bare_paths", "norm_paths", "endpoints"))))
        self._write("crons", batch, t["crons"].repartitionByRange("day", "order_key"))
        self._write("unmatched", batch, t["unmatched"].repartitionByRange("day", "order_key"))
        self._write("samples", batch, t["samples"].orderBy("order_key").limit(SAMPLES))
        self._write("counts", batch, t["counts"].groupBy("kind", "day").agg(F.sum("n").alias("n")))
        n_files = self._write("files", batch, t["files"]).count()
        self._seen(batch, n_files, gone)
        for name in t:
            for b in old:
                workspace.remove(self.spark, f"{self.path}/{name}/batch={b}")

    def _staged(self, stage: str) -> bool:
        return any(n.startswith("kind=") for n in workspace.folders(self.spark, stage))

    def _parse(self, lines: DataFrame, stage: str) -> None:
        """The only pass over raw text: fields and times as they stand in their splits, a folder for each kind."""
        stamped = logs.carried_in_splits(lines.select("line", "order_key", "file_size").withColumn("stamp", logs.line_stamp(F.col("line"))))
        found = classify.classify_lines(stamped).withColumn("file_path", F.col("order_key.file"))
        text = F.when(F.col("kind") == classify.UNMATCHED, F.col("text")).alias("text")
        ids = [F.when(F.col("path").isNotNull(), form_id(normalize_path(F.col("path"), m))).alias(c) for m, c in ID_OF.items()]
        found.select("kind", "order_key", "stamp", "file_path", "file_size", "method", "path", *ids, "status", "duration_ms", "bytes", "cron_event", "cron_name", text).write.mode("overwrite").partitionBy("kind").parquet(stage)

    def _write(self, name: str, batch: str, rows: DataFrame) -> DataFrame:
        place = f"{self.path}/{name}/batch={batch}"
        rows = rows.select(*(F.col(c.split()[0]) for c in _columns(SCHEMAS[name])))
        rows.write.mode("overwrite").partitionBy(*PARTITIONS.get(name, [])).option("parquet.block.size", str(16 << 20)).parquet(place)
        return self.spark.read.schema(SCHEMAS[name]).parquet(place)

    def _kept(self, rows: DataFrame, place: str) -> DataFrame:
        """rows, written once for several readers."""
        rows.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(rows.schema).parquet(place)

    def _write_all(self, rows: DataFrame, batch: str) -> None:
        http = rows.where(F.col("kind").isin(classify.HTTP_A, classify.HTTP_B))
        named = http.select("day", "kind", "method", F.floor(F.col("status") / 100).cast("int").alias("family"), "status", "duration_ms", "bytes", "stamp", *ID_OF.values(), F.col("order_key.row").alias("_row"))
        order = [*_CLUSTERED, "duration_ms", "_row"]
        requests = self._write("requests", batch, named.repartitionByRange(*order).sortWithinPartitions(*order))
        self._write_forms(http.select("path", *ID_OF.values()).distinct(), batch)
        self._write_cube(requests, batch)
        cron = rows.where(F.col("kind") == classify.CRON)
        self._write("crons", batch, cron.select("order_key", F.col("cron_name").alias("name"), F.col("cron_event").alias("event"), "duration_ms", "day"))
        unmatched = self._write("unmatched", batch, rows.where(F.col("kind") == classify.UNMATCHED).select("order_key", "text", "day"))
        self._write("samples", batch, unmatched.orderBy("order_key").limit(SAMPLES))
        counts = self._kept(rows.groupBy("kind", "day", "file_path").agg(F.count("*").alias("n"), F.first("file_size").alias("file_size")), f"{self.path}/_stage/{batch}/_counts")
        self._write("counts", batch, counts.groupBy("kind", "day").agg(F.sum("n").alias("n")))
        self._write("files", batch, counts.groupBy("file_path").agg(F.first("file_size").alias("file_size")))

    def _write_forms(self, paths: DataFrame, batch: str) -> None:
        """From different raw paths with the ids of their forms."""
        raw = paths.select(F.col("path_id").alias("id"), F.col("path").alias("form"), "bare_id", "norm_id", F.lit(RAW).alias("mode"))
        other = [paths.select(F.col(ID_OF[m]).alias("id"), normalize_path(F.col("path"), m).alias("form"), F.lit(m).alias("mode")).distinct() for m in (STRIP_QUERY, COLLAPSE_IDS)]
        written = self._write("forms", batch, raw.unionByName(other[0].unionByName(other[1]), allowMissingColumns=True))
        every = written.select("mode", "id", "form")
        if self.batches():
            every = self.table("forms").select("mode", "id", "form").union(every).distinct()
        double = every.groupBy("mode", "id").agg(F.count("*").alias("n")).where("n > 1").first()
        if double is not None:
            both = every.where((F.col("mode") == double["mode"]) & (F.col("id") == double["id"])).agg(F.min("form").alias("a"), F.max("form").alias("b")).first()
            raise ValueError(f"two forms share an id: {both['a']!r} and {both['b']!r}")
        self._write_grams(written, batch)

    def _write_grams(self, forms: DataFrame, batch: str) -> None:
        """Forms are dealt out, not their trigrams, which are many times larger; a file is sorted by trigram."""
        n = forms.agg(F.coalesce(F.sum(F.greatest(F.length("form") - 2, F.lit(0))), F.lit(0))).first()[0]
        parts = 1 + max(n // GRAMS, min(n // 100_000, self.spark.sparkContext.defaultParallelism))
        dealt = forms.select("mode", "id", "form").repartitionByRange(parts, "mode", "id")
        self._write("grams", batch, dealt.select(F.explode(trigrams(F.col("form"))).alias("gram"), "id", "mode").sortWithinPartitions("gram", "mode"))

    def _write_cube(self, requests: DataFrame, batch: str) -> None:
        d, status = F.col("duration_ms"), F.col("status")
        rows = requests.select("day", *ID_OF.values(), "method", status_group(status).alias("status_group"), bucket(d).alias("bucket"), F.coalesce((status >= 400).cast("long"), F.lit(0)).alias("errors"), d.cast("double").alias("total"), d.alias("least"))
        cube = self._write("cube", batch, rows.mapInArrow(_counted, SCHEMAS["cube"]).sortWithinPartitions("day", "mode", "id"))
        by_endpoint = cube.where(F.col("mode") == COLLAPSE_IDS).select("day", "id", "method", "bucket", F.col("calls").alias("n"))
        self._write("latency", batch, sketch.aggregate(by_endpoint, ["day", "id", "method"]))
        endpoint = F.concat_ws(" ", F.hex("norm_id"), "method")
        sketched = {"raw_paths": F.col("path_id"), "bare_paths": F.col("bare_id"), "norm_paths": F.col("norm_id"), "endpoints": endpoint}
        self._write("sketches", batch, requests.groupBy("day").agg(*(F.hll_sketch_agg(c, SKETCH_LOG2).alias(n) for n, c in sketched.items())))


def _counted(batches: Iterable) -> Iterator:
    """Rows of the cube from a task's requests, COUNTED at a time; no shuffle.

    Requests lie in the order of their files (day, method, family and path), so a key is nearly always counted whole.
    """
    import pyarrow as pa

    keys = ["id", "method", "status_group", "bucket", "day"]
    sums = [([], "count_all"), ("errors", "sum"), ("total", "sum"), ("least", "min"), ("least", "max")]

    def cells(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        for mode, column in ID_OF.items():
            table = rows.select([column, *keys[1:], "errors", "total", "least"]).rename_columns([*keys, "errors", "total", "least"])
            found = table.group_by(keys, use_threads=False).aggregate(sums)
            columns = {k: found[k] for k in keys[:-1]} | {"calls": found["count_all"], "errors": found["errors_sum"], "total": found["total_sum"], "least": found["least_min"], "most": found["least_max"]}
            columns |= {"mode": pa.repeat(mode, found.num_rows), "day": found["day"]}
            yield from pa.table(columns).to_batches(max_chunksize=20_000)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= COUNTED:
            yield from cells(held)
            held, n = [], 0
    if n:
        yield from cells(held)


def _columns(ddl: str) -> list[str]:
    """Column definitions of a DDL text; commas inside of angle brackets are no ends."""
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
