"""Log lines derived from the events table: all layouts, methods, id shapes, codes and near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runs as it is in Spark SQL and in DuckDB.
LINES_SQL = r"""
with e as (
  select event_id, user_id, event_type, props,
         cast(floor(event_id / 20) as bigint) as g, event_id % 20 as k,
         replace(substr(cast(ts as string), 1, 19), ' ', 'T') as t,
         cast(cast(value as decimal(18,3)) as string) as d
  from events),
p as (
  select *, split_part('GET,POST,PUT,PATCH,DELETE,OPTIONS,HEAD', ',', cast(g % 7 + 1 as int)) as m,
         split_part('200,201,204,301,304,400,401,404,500,501,502,503,504,100', ',', cast(user_id % 14 + 1 as int)) as st,
         concat('/api/', event_type, '/',
           case user_id % 5 when 0 then lpad(cast(user_id as string), 24, 'a')
                            when 1 then cast(100000 + user_id as string)
                            when 2 then concat('00000000-0000-4000-8000-', lpad(cast(user_id as string), 12, '0'))
                            when 3 then concat('AB-CD-', lpad(cast(user_id as string), 6, '0'))
                            else cast(user_id as string) end,
           case g % 3 when 0 then concat('?page=', cast(g % 9 as string)) when 1 then '#top' else '' end) as path
  from e)
select event_id as line_no,
  case when k <= 11 then concat(t, ': ', m, ' ', path, ' ', st, ' ', d, ' ms - ', cast(event_id as string))
       when k <= 13 then concat(chr(27), '[0m', m, ' ', path, ' ', chr(27), '[32m', st, chr(27), '[0m ', d, ' ms - -', chr(27), '[0m', chr(13))
       when k = 14 then concat(d, 'ms', chr(9), m, ' ', path)
       when k = 15 then concat(t, ': [cron] ', split_part('start,done,fail', ',', cast(g % 3 + 1 as int)), ' job_', cast(user_id % 10 as string),
                               case when g % 3 = 0 then '' else concat(' ', d, 'ms') end)
       when k = 16 then ''
       when k = 17 then '   '
       when k = 18 then concat('worker ', event_type, ' ', props)
       else concat(t, ': GET /x 20 ', d, ' ms - 5') end as line
from p
"""


def lines(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """(line_no, line), with order_key = line_no; times: so many copies of the events behind one another, with ids that go on."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if times > 1:
        step = (events.agg({"event_id": "max"}).first()[0] or 0) + 1
        events = events.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).selectExpr("*", f"event_id + copy * {step} as shifted").drop("event_id").withColumnRenamed("shifted", "event_id")
    return spark.sql(LINES_SQL.replace("from events)", "from {events})"), events=events).selectExpr("line_no", "line", "line_no as order_key")
