"""Line classification: HTTP requests in two layouts, cron events, empty and unmatched lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import patterns as P
from logspark.functions.text import ESC, ansi_as_space, strip_ansi, strip_cr

HTTP_A, HTTP_B, EMPTY, CRON, UNMATCHED = "http_a", "http_b", "empty", "cron", "unmatched"
#: The columns that classify_lines adds.
FIELDS = ("kind", "ts", "method", "path", "status", "duration_ms", "bytes", "cron_event", "cron_name", "text")


def classify_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with kind, method, path, status, duration_ms, bytes, ts, cron_event, cron_name and text.

    Each layout is taken apart by one pass of its pattern: the match is rewritten as its parts between ESC
    characters, which no field can hold, and split.  Cheap tests stand before costly patterns; fields are made from
    the parts only where a query asks for them.  Null lines stay null in every column but kind, which is unmatched.
    Columns of these names are replaced.
    """
    rows = lines.withColumn("_l", strip_cr(F.col(line_col))).withColumn("_c", ansi_as_space(F.col("_l")))
    c, raw = F.col("_c"), F.col("_l")
    as_a = F.regexp_replace(c, P.HTTP_A, "A" + ESC + "$2" + ESC + "$3" + ESC + "$4" + ESC + "$5" + ESC + "$6" + ESC + "$1")
    as_b = F.regexp_replace(c, P.HTTP_B, "B" + ESC + "$2" + ESC + "$3" + ESC + "200" + ESC + "$1")
    rows = rows.withColumn("_a", F.when(c.contains("ms"), as_a).otherwise(c))
    rows = rows.withColumn("_h", F.when(F.col("_a") != c, F.col("_a")).when(c.contains("ms"), as_b).otherwise(c))
    is_http = F.col("_h") != c
    is_cron = raw.contains(P.CRON_MARK) & ~c.rlike(P.EMPTY) & ansi_as_space(raw, "\t").rlike(P.CRON)
    as_cron = F.regexp_replace(strip_ansi(raw), P.CRON_NAME, "C" + ESC + "$1" + ESC + "$2")
    rows = rows.withColumn("_p", F.when(is_http, F.split(F.col("_h"), ESC, 7)).when(is_cron, F.split(as_cron, ESC, 3)))
    kind = F.when(F.col("_p")[0] == "A", HTTP_A).when(F.col("_p")[0] == "B", HTTP_B).when(F.col("_p")[0] == "C", CRON).when(c.rlike(P.EMPTY), EMPTY).otherwise(UNMATCHED)
    # A filter on the fields must not be pushed below the patterns: it would repeat them all in its condition.  The
    # optimizer stops at a generator, here of one row; what stands above it is pruned as usual.
    keep = [x for x in lines.columns if x not in FIELDS]
    found = rows.select(*keep, F.col(line_col).alias("_line"), F.explode(F.array(F.struct(kind.alias("kind"), F.col("_p").alias("parts")))).alias("_m"))
    part = lambda k: F.get(F.col("_m.parts"), k)
    is_http, is_cron = F.col("_m.kind").isin(HTTP_A, HTTP_B), F.col("_m.kind") == CRON
    name = F.regexp_replace(part(2), r"\A[ \t]+|[ \t]+\z", "")
    timed = F.split(F.regexp_replace(name, P.CRON_TIMED, "$1" + ESC + "$2"), ESC)
    has_time = is_cron & name.endswith("ms") & (F.size(timed) == 2)
    fields = {
        "kind": F.col("_m.kind"),
        "ts": F.try_to_timestamp(F.regexp_replace(F.when(is_http & (part(6) != ""), part(6)), ":\\z", "").substr(1, 19)).cast("timestamp_ntz"),
        "method": F.when(is_http, part(1)),
        "path": F.when(is_http, part(2)),
        "status": F.when(is_http, part(3).cast("int")),
        "duration_ms": F.when(is_http, part(4).try_cast("double")).when(has_time, F.get(timed, 1).try_cast("double")).cast("float"),
        "bytes": F.when(is_http, part(5).try_cast("long")),
        "cron_event": F.when(is_cron, part(1)),
        "cron_name": F.when(has_time, F.get(timed, 0)).when(is_cron, name),
        "text": strip_ansi(strip_cr(F.col("_line"))),
    }
    return found.select(*keep, *(fields[x].alias(x) for x in FIELDS))


def http_requests(classified: DataFrame) -> DataFrame:
    """(method, path, status, duration_ms), and norm_path where a parsed table has it."""
    found = classified.where(F.col("kind").isin(HTTP_A, HTTP_B))
    return found.select("method", "path", "status", "duration_ms", *(c for c in ("norm_path",) if c in classified.columns))


def cron_events(classified: DataFrame) -> DataFrame:
    """(order_key, name, event, duration_ms)."""
    return classified.where(F.col("kind") == CRON).select("order_key", F.col("cron_name").alias("name"), F.col("cron_event").alias("event"), "duration_ms")


def unmatched_lines(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("kind") == UNMATCHED).select("order_key", "text")


def unmatched_samples(classified: DataFrame, most: int = 50) -> DataFrame:
    """The first unmatched lines in file order."""
    return unmatched_lines(classified).orderBy("order_key").limit(most)


def line_kind_counts(classified: DataFrame) -> DataFrame:
    """One row: all lines, HTTP lines, cron events, unmatched and empty lines."""
    kind = F.col("kind")
    return classified.agg(
        F.count("*").alias("total_lines"),
        F.count_if(kind.isin(HTTP_A, HTTP_B)).alias("http_lines"),
        F.count_if(kind == CRON).alias("cron_lines"),
        F.count_if(kind == UNMATCHED).alias("unmatched_lines"),
        F.count_if(kind == EMPTY).alias("empty_lines"),
    )
