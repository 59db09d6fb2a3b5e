"""Shared pieces of the query catalogue: the driver tables in their roles, and the same as SQL.

Roles: events is a set of recordings (user_id), its rows in time order the frames, rows of type error the stimuli and
value the signal (valid above 5); customer and orders are animals and their sessions; lineitem is a weighted graph
from supplier to part, inhibitory where l_returnflag is R.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame, event_index, event_type, value, valid."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("recording_id"), (F.row_number().over(w) - 1).alias("frame"), F.col("event_id").alias("event_index"), "event_type", "value", (F.col("value") > 5).alias("valid"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stimuli in order, with trial_id, next_stim_frame and so on."""
    s = series(spark, sf_dir).filter("event_type = 'error'").select("recording_id", F.col("frame").alias("stim_frame"), "event_index")
    return windows.schedule(s)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("recording_id", "frame", "value", "valid")


SERIES = """
series AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    event_id AS event_index, event_type, value, value > 5 AS valid FROM events
), trials AS (
  SELECT *, lead(stim_frame) OVER w AS next_stim_frame, lag(stim_frame) OVER w AS previous_stim_frame, lag(trial_id) OVER w AS previous_trial_id,
    count(*) OVER (PARTITION BY recording_id, stim_frame) AS same_frame
  FROM (SELECT recording_id, frame AS stim_frame, event_index, row_number() OVER (PARTITION BY recording_id ORDER BY frame, event_index) - 1 AS stim_index,
      recording_id || ':trial' || lpad(CAST(row_number() OVER (PARTITION BY recording_id ORDER BY frame, event_index) - 1 AS VARCHAR), 3, '0') AS trial_id
    FROM series WHERE event_type = 'error')
  WINDOW w AS (PARTITION BY recording_id ORDER BY stim_frame, event_index)
), win AS (
  SELECT t.recording_id, t.trial_id, t.event_index, t.stim_index, s.frame, s.frame - t.stim_frame AS o, s.value, s.valid
  FROM trials t JOIN series s ON s.recording_id = t.recording_id AND s.frame BETWEEN t.stim_frame - 10 AND t.stim_frame + 59
    AND (t.next_stim_frame IS NULL OR s.frame < t.next_stim_frame OR s.frame < t.stim_frame)
), base AS (
  SELECT trial_id, n_base, CASE WHEN n_base >= 4 AND f > 1e-6 THEN f END AS f0, CASE WHEN n_base >= 4 AND f > 1e-6 THEN sd / f END AS pre_sd FROM (
    SELECT trial_id, count(*) FILTER (WHERE u) AS n_base, avg(value) FILTER (WHERE u) AS f, stddev_pop(value) FILTER (WHERE u) AS sd
    FROM (SELECT *, o < 0 AND valid AND o NOT IN (-1, 0, 1) AS u FROM win) GROUP BY trial_id)
), dff AS (
  SELECT win.*, b.f0, valid AND o NOT IN (-1, 0, 1) AND b.f0 IS NOT NULL AS ok,
    CASE WHEN valid AND o NOT IN (-1, 0, 1) AND b.f0 IS NOT NULL THEN (value - b.f0) / b.f0 ELSE 0.0 END AS dff FROM win JOIN base b USING (trial_id)
), amp AS (
  SELECT recording_id, trial_id, event_index, CASE WHEN count(*) FILTER (WHERE o BETWEEN 2 AND 30 AND ok) >= 14.5 THEN avg(dff) FILTER (WHERE o BETWEEN 2 AND 30 AND ok) END AS amplitude,
    count(*) FILTER (WHERE o BETWEEN 2 AND 30 AND ok) AS n_response FROM dff GROUP BY ALL
)"""


def with_series(sql: str) -> str:
    return f"WITH {SERIES.strip()}\n{sql}"
