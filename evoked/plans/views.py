"""Views that give the event tables the shape of recordings, in integer ticks (1 tick = 1 microsecond)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Grid width of interval joins: about the length of the windows.
CELL = 10 * SECOND

FX = """fx_events AS (SELECT event_id, user_id, event_type, value, concat('S', user_id % 4) AS session, user_id % 8 AS electrode,
    date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 3600 AS t_tick FROM events),
  fx_spikes AS (SELECT session, electrode, user_id AS unit_id, event_id AS spike_id, t_tick FROM fx_events WHERE event_type IN ('click','view','purchase')),
  fx_trials AS (SELECT session, event_id AS stim_index, t_tick AS t0, t_tick + CAST(round(value * 10000) AS BIGINT) AS t1, (event_id // 20) % 4 AS cond
    FROM fx_events WHERE event_type = 'signup'),
  fx_dead AS (SELECT session, electrode, t_tick AS s, t_tick + CAST(round(value * 20000) AS BIGINT) AS e FROM fx_events WHERE event_type = 'error'),
  fx_units AS (SELECT DISTINCT session, electrode, unit_id FROM fx_spikes),
  d1 AS (SELECT *, max(e) OVER (PARTITION BY session, electrode ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_dead WHERE e > s),
  d2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session, electrode ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM d1),
  fx_merged AS (SELECT session, electrode, min(s) AS s, max(e) AS e FROM d2 GROUP BY session, electrode, island)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    tick = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 3600"
    return rows.select("event_id", "user_id", "event_type", "value", F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("session"), (F.col("user_id") % 8).alias("electrode"), F.expr(tick).alias("t_tick"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter(F.col("event_type").isin("click", "view", "purchase"))
    return rows.select("session", "electrode", F.col("user_id").alias("unit_id"), F.col("event_id").alias("spike_id"), "t_tick")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type = 'signup'")
    return rows.select("session", F.col("event_id").alias("stim_index"), F.col("t_tick").alias("t0"), (F.col("t_tick") + F.round(F.col("value") * 10000).cast("long")).alias("t1"), F.expr("(event_id div 20) % 4").alias("cond"))


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type = 'error'")
    return rows.select("session", "electrode", F.col("t_tick").alias("s"), (F.col("t_tick") + F.round(F.col("value") * 20000).cast("long")).alias("e"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(spark, sf_dir).select("session", "electrode", "unit_id").distinct()
