"""Incidents derived from the driver's tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PCT = 10
MILEAGE = 0.5
SEED = 42
CHUNKS = 4
MANY_CHUNKS = 64

# Literals carry an exponent: plain decimals would be DECIMAL, with other rounding rules.
INCIDENTS_SQL = """
SELECT event_id AS row_id,
       52.0e0 + (user_id % 40) * 5e-2 + (event_id * 7919 % 1009) * 5e-6 AS lat,
       -1.5e0 + (user_id - user_id % 40) * 25e-4 + (event_id * 104729 % 211) * 5e-5 AS lon,
       CAST(event_id * 31 % 360 AS INT) AS bearing,
       CASE WHEN event_id % 3 = 0
            THEN upper(concat('Road ', CAST(user_id % 40 AS STRING)))
            ELSE concat('Road ', CAST(user_id % 40 AS STRING)) END AS partial_location,
       concat('day ', CAST(event_id % 7 AS STRING)) AS weekday
FROM events
"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(INCIDENTS_SQL)


# Lines as they would stand in a file. The first four classes of ``broken`` lines cannot be read,
# the fifth has a blank road name, which is valid.
LINE_SQL = r"""
SELECT row_id,
       concat_ws('\t', CAST(lat AS STRING), CAST(lon AS STRING), CAST(bearing AS STRING),
                 partial_location, partial_location, '2024-01-01', '12:00', weekday) AS line
FROM incidents
"""
BROKEN_LINE_SQL = r"""
SELECT row_id,
       CASE row_id % 50
         WHEN 0 THEN concat_ws('\t', CAST(lat AS STRING), CAST(lon AS STRING), '12')
         WHEN 1 THEN concat_ws('\t', 'north', CAST(lon AS STRING), '12', partial_location)
         WHEN 2 THEN concat_ws('\t', CAST(lat AS STRING), '', '12', partial_location)
         WHEN 3 THEN concat_ws('\t', CAST(lat AS STRING), CAST(lon AS STRING), '12.5', 'A1')
         WHEN 4 THEN concat_ws('\t', CAST(lat AS STRING), CAST(lon AS STRING),
                               CAST(bearing AS STRING), '', 'somewhere')
         ELSE concat_ws('\t', CAST(lat AS STRING), CAST(lon AS STRING),
                        CAST(bearing AS STRING), partial_location)
       END AS line
FROM incidents
"""


def lines(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    incidents(spark, sf_dir).createOrReplaceTempView("incidents")
    return spark.sql(BROKEN_LINE_SQL if broken else LINE_SQL)


SHARP_SQL = """
SELECT row_id, CASE row_id % 4 WHEN 0 THEN concat('Hauptstra\u00dfe ', CAST(row_id % 5 AS STRING))
                               WHEN 1 THEN concat('HAUPTSTRASSE ', CAST(row_id % 5 AS STRING))
                               WHEN 2 THEN concat('haupTSTRA\u00dfe ', CAST(row_id % 5 AS STRING))
                               ELSE concat('Hauptstrasse ', CAST(row_id % 5 AS STRING)) END AS partial_location
FROM incidents
"""
