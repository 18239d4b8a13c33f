"""SQL of the log engine for DuckDB, as named common table expressions."""

from __future__ import annotations

import math

from logspark.functions import patterns as P
from logspark.functions.histogram import GAMMA
from logspark.sources.derived import LINES_SQL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LN = repr(math.log(GAMMA))
_GAP = rf"[ \t]*(?:{P.CSI}[ \t]*)*"
#: A scheduled job's line as it stands, with its codes.  Groups: 1 event, 2 name with or without a duration.
CRON = rf"\A{_GAP}(?:{P.STAMP}{_GAP})?\[cron\]{_GAP}(start|done|fail)[ ]{_GAP}((?:[^ \t\x1B]|\x1B[^\[]|\x1B\z)[\s\S]*)\z"
A, B, C, CSI, T = map(quoted, (P.HTTP_A, P.HTTP_B, CRON, P.CSI, P.CRON_TIMED))
BLANKS = quoted(r"\A[ \t]+|[ \t]+\z")
CTES = {
    "lines": LINES_SQL,
    "stripped": f"select line_no, line, l, regexp_replace(l, {CSI}, ' ', 'g') as c from (select line_no, line, regexp_replace(line, '\\r\\z', '') as l from lines)",
    "kinds": f"""select *, case when regexp_matches(c, {A}) then 'http_a' when regexp_matches(c, {B}) then 'http_b' when regexp_matches(c, {quoted(P.EMPTY)}) then 'empty'
        when contains(l, '[cron]') and regexp_matches(l, {C}) then 'cron' else 'unmatched' end as kind from stripped""",
    "requests": f"""select line_no, kind, regexp_extract(c, {A}, 2) as method, regexp_extract(c, {A}, 3) as path, cast(regexp_extract(c, {A}, 4) as int) as status,
        cast(cast(regexp_extract(c, {A}, 5) as double) as float) as duration_ms, try_cast(regexp_extract(c, {A}, 6) as bigint) as bytes from kinds where kind = 'http_a'
        union all select line_no, kind, regexp_extract(c, {B}, 2), regexp_extract(c, {B}, 3), 200, cast(cast(regexp_extract(c, {B}, 1) as double) as float), null from kinds where kind = 'http_b'""",
    "bare": f"select *, regexp_extract(path, {quoted(P.PATH_ONLY)}, 0) as bare_path from requests",
    "normed": f"select *, array_to_string(list_transform(string_split(bare_path, '/'), lambda s: case when regexp_matches(s, {quoted(P.ID_SEGMENT)}) then ':id' else s end), '/') as norm_path from bare",
    "named": f"""select line_no, regexp_extract(l, {C}, 1) as event, regexp_replace(regexp_replace(regexp_extract(l, {C}, 2), {CSI}, '', 'g'), {BLANKS}, '', 'g') as n from kinds where kind = 'cron'""",
    "crons": f"""select line_no, event, case when regexp_matches(n, {T}) then regexp_extract(n, {T}, 1) else n end as name,
        case when regexp_matches(n, {T}) then cast(cast(regexp_extract(n, {T}, 2) as double) as float) end as duration_ms from named""",
    "cron_stats": """select name, count(*) as total_runs, count(*) filter (event = 'start') as total_starts, count(*) filter (event = 'done') as total_success,
        count(*) filter (event = 'fail') as total_failures, count(*) filter (event <> 'start') as runs_finished, coalesce(sum(cast(duration_ms as double)), 0.0) as total_duration_ms,
        coalesce(sum(cast(duration_ms as double)), 0.0) / count(*) as avg_duration_ms, cast(coalesce(min(duration_ms), 0) as float) as min_duration_ms, cast(coalesce(max(duration_ms), 0) as float) as max_duration_ms,
        coalesce(arg_max(case event when 'done' then 'success' when 'fail' then 'failed' end, line_no) filter (event <> 'start'), 'unknown') as last_status from crons group by name""",
}
#: Lines in a file of the rotated logs (queries.rotated_logs).
ROTATED = 3_000
_AT = r"case when regexp_matches(c, '\A[ \t]*" + P.STAMP + r"') then try_cast(replace(substr(ltrim(c, ' ' || chr(9)), 1, 19), 'T', ' ') as timestamp) end"
CTES |= {
    "heads": f"select line_no, line_no // {ROTATED} as rotated, {_AT} as own from stripped",
    "stamped": """select line_no, rotated, coalesce(last_value(own ignore nulls) over (partition by rotated order by line_no rows unbounded preceding),
        first_value(own ignore nulls) over (partition by rotated order by line_no rows between current row and unbounded following)) as stamp from heads""",
    "timed": "select crons.*, stamp, rotated from crons join stamped using (line_no)",
    "steps": """select *, sum(case event when 'start' then 1 else -1 end) over w as level, count(*) filter (event = 'start') over w as starts from timed
        window w as (partition by name order by stamp, rotated desc, line_no rows unbounded preceding)""",
    "lows": "select *, least(0, coalesce(min(level) over (partition by name order by stamp, rotated desc, line_no rows between unbounded preceding and 1 preceding), 0)) as low from steps",
    "ended": """select *, event <> 'start' and level < low as lone, count(*) filter (event <> 'start' and level >= low) over (partition by name order by stamp, rotated desc, line_no rows unbounded preceding) as number from lows""",
    "runs": """select s.name, s.stamp as start_at, e.stamp as end_at, case e.event when 'done' then 'success' when 'fail' then 'failed' else 'running' end as outcome, e.duration_ms, false as lone
        from (select * from ended where event = 'start') s left join (select * from ended where event <> 'start' and not lone) e on s.name = e.name and s.starts = e.number
        union all select name, null, stamp, case event when 'done' then 'success' else 'failed' end, duration_ms, true from ended where lone""",
}
ORDER = list(CTES)


def with_ctes(body: str, **more: str) -> str:
    """body after all CTEs and those of more (which may replace some)."""
    ctes = CTES | more
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in ctes.items()) + "\n" + body


def stats_ctes(where: str = "true", path: str = "norm_path") -> dict[str, str]:
    """CTEs chosen, endpoint (statistics with quantiles) and overall, of the requests that fit."""
    quantiles = ", ".join(f"coalesce(min(case when cum > {q} * (n - 1) then pow({GAMMA!r}, bucket - 0.5) end), 0.0) as p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))
    running = "sum(k) over (partition by {0} order by bucket rows unbounded preceding) as cum, sum(k) over (partition by {0}) as n"
    return {
        "chosen": f"select {path} as path, method, status, duration_ms, case when duration_ms > 0 then greatest(-400, least(799, cast(ceil(ln(cast(duration_ms as double)) / {LN}) as int))) end as bucket from normed where {where}",
        "hist": f"select path, method, bucket, {running.format('path, method')} from (select path, method, bucket, count(*) as k from chosen where bucket is not null group by all)",
        "hq": f"select path, method, {quantiles} from hist group by all",
        "endpoint": """select path, method, count(*) as total_calls, count(*) filter (status >= 400) as error_calls, sum(cast(duration_ms as double)) as total_duration_ms,
            cast(min(duration_ms) as double) as min_duration_ms, cast(max(duration_ms) as double) as max_duration_ms, avg(cast(duration_ms as double)) as avg_duration_ms, 100.0 * count(*) filter (status >= 400) / count(*) as error_rate,
            cast(coalesce(any_value(p50), 0.0) as float) as p50_ms, cast(coalesce(any_value(p90), 0.0) as float) as p90_ms, cast(coalesce(any_value(p95), 0.0) as float) as p95_ms, cast(coalesce(any_value(p99), 0.0) as float) as p99_ms
            from chosen left join hq using (path, method) group by path, method""",
        "ohist": f"select bucket, {running.format('1')} from (select bucket, count(*) as k from chosen where bucket is not null group by all)",
        "oq": f"select {quantiles} from ohist",
        "overall": "select count(status) as total_requests, count(*) filter (status >= 400) as total_errors, coalesce(100.0 * count(*) filter (status >= 400) / nullif(count(status), 0), 0.0) as error_rate, cast(any_value(p50) as float) as p50_ms, cast(any_value(p90) as float) as p90_ms, cast(any_value(p95) as float) as p95_ms, cast(any_value(p99) as float) as p99_ms from oq left join chosen on true",
    }
