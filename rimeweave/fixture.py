"""Observation fixtures derived from the given tables.

``obs`` turns the event table into flight-like observations: the event type
stands for campaign or instrument, type and day for one flight file.  The same
text runs in Spark and in the checking database, ``{S}`` is its string type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import pin_utc

OBS_SQL = """
select event_id as row_no, ts, event_type as campaign, user_id,
 concat(event_type,'_',cast(cast(ts as date) as {S})) as source_file,
 case when event_id%17=0 then cast(-9999 as double) else cast(19000+(event_id*37)%9000 as double) end as raw_t,
 case when event_id%23=0 then cast(-8888 as double) else cast(4000+(event_id*53)%7000 as double) end as raw_p,
 case when event_id%29=0 then cast(-7777 as double) else value end as h2o_ppmv,
 case when event_id%17=0 then cast(999999.9999 as double)
      else cast((event_id*37)%1600 as double)*cast(0.1 as double)-cast(100 as double)
         + case when event_type='signup' then cast(273.15 as double) else cast(0 as double) end end as tair,
 case when event_id%13=0 then cast(-9999.99 as double)
      else cast((event_id*41)%1700 as double)*cast(0.1 as double)-cast(125 as double)
         + case when event_type='signup' then cast(273.15 as double) else cast(0 as double) end end as frost,
 (case when event_id%23=0 then cast(-8888 as double) else cast((event_id*53)%1200 as double) end)
   * (case when event_type='error' then cast(100 as double) else cast(1 as double) end) as pres,
 case when event_id%19=0 then cast(-9999 as double) else cast((event_id*7)%300-25 as double) end as rh_ice,
 case when event_id%31=0 then cast(-99999 as double)
      else cast((event_id*13)%400 as double)*cast(0.5 as double)-cast(100 as double) end as lat,
 cast((event_id*17)%800 as double)*cast(0.5 as double)-cast(200 as double) as lon,
 cast((event_id*29)%12000-1000 as double)
   * (case when event_type='view' then cast(4 as double) else cast(1 as double) end) as alt,
 cast(event_id%4 as int) as qc
from {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS_SQL.replace("{S}", "string"), events=table(spark, sf_dir, "events"))


def oracle_obs() -> str:
    return OBS_SQL.replace("{S}", "varchar").replace("{events}", "events")


def numbered_lines(files: DataFrame, header: list[Column], body: DataFrame) -> DataFrame:
    """Text files as numbered lines.

    ``files``: one row per file with ``path, file_name`` and what the header
    lines are made of; ``body``: ``path, file_name, line, at`` with a number
    that grows down the file.
    """
    top = files.select("path", "file_name", F.posexplode(F.array(*header)).alias("line_no", "value"))
    rest = body.select(
        "path", "file_name", (F.col("at") + F.lit(len(header))).cast("bigint").alias("line_no"), F.col("line").alias("value")
    )
    return top.select("path", "file_name", F.col("line_no").cast("bigint"), "value").unionByName(rest)


def ntz(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def r6(column: Column) -> Column:
    return F.round(column, 6)
