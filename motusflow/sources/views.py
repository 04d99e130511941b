"""Adapter views: the generic test tables in the shapes that the engine's operators take.

``dense``: a 20 Hz three-axis stream with gaps and still stretches, one participant for every 5,000 events. ``annotations``:
labelled intervals. ``sensor``: a sparse stream on the tables' own time stamps. Times are whole milliseconds since 1970.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS, STEP_MS = 1_704_067_200_000, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pid(event_id):
    return F.concat(F.lit("P"), F.floor(event_id / 5000).cast("string"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, pid, sid, t_ms, x, y, z."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    i = F.col("event_id")
    part, third = i % 1000, F.floor(i / 1000) % 3
    still = part < 100
    of = lambda a, b, c: F.when(third == 0, F.lit(a)).when(third == 1, F.lit(b)).otherwise(F.lit(c))
    return e.filter(~part.between(400, 799)).select(
        "event_id",
        _pid(i).alias("pid"),
        F.lit("S1").alias("sid"),
        (F.lit(BASE_MS) + i * STEP_MS).alias("t_ms"),
        F.when(still, of(0.6, 0.0, -0.8)).otherwise(((i * 7) % 200) / 100.0 - 1.0).alias("x"),
        F.when(still, of(0.0, 1.0, 0.6)).otherwise((F.col("user_id") % 50) / 25.0 - 1.0).alias("y"),
        F.when(still, of(0.8, 0.0, 0.0)).otherwise(F.col("value") / 250.0).alias("z"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, pid, annotator, start_ms, stop_ms, label_name."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type").filter("event_id % 400 = 0")
    i, kind = F.col("event_id"), F.col("event_type")
    start = F.lit(BASE_MS) + i * STEP_MS
    label = F.when(kind == "click", "Sitting and Writing").when(kind == "view", "Walking").when(kind == "purchase", "Treadmill 3.5 mph")
    label = label.when(kind == "error", "Lying on the back").otherwise("Stairs going up")
    return e.select(
        "event_id",
        _pid(i).alias("pid"),
        F.concat(F.lit("A"), ((i / 400).cast("long") % 2).cast("string")).alias("annotator"),
        start.alias("start_ms"),
        (start + F.when((i / 400).cast("long") % 5 == 0, 8000).otherwise(20000)).cast("long").alias("stop_ms"),
        label.alias("label_name"),
    )


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, pid, sid, t_ms, value."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        "event_id",
        F.concat(F.lit("P"), (F.col("user_id") % 10).cast("string")).alias("pid"),
        F.col("event_type").alias("sid"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("t_ms"),
        "value",
    )


#: The same views for the SQL twins (DuckDB).
DENSE_SQL = """dense AS (
  SELECT event_id, 'P' || CAST(event_id // 5000 AS VARCHAR) AS pid, 'S1' AS sid, 1704067200000 + event_id * 50 AS t_ms,
    CASE WHEN event_id % 1000 < 100 THEN CASE (event_id // 1000) % 3 WHEN 0 THEN 0.6e0 WHEN 1 THEN 0e0 ELSE -0.8e0 END
         ELSE ((event_id * 7) % 200) / 1e2 - 1e0 END AS x,
    CASE WHEN event_id % 1000 < 100 THEN CASE (event_id // 1000) % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 ELSE 0.6e0 END
         ELSE (user_id % 50) / 25e0 - 1e0 END AS y,
    CASE WHEN event_id % 1000 < 100 THEN CASE (event_id // 1000) % 3 WHEN 0 THEN 0.8e0 ELSE 0e0 END
         ELSE value / 250e0 END AS z
  FROM events WHERE NOT (event_id % 1000 BETWEEN 400 AND 799))"""
ANNOTATIONS_SQL = """ann AS (
  SELECT event_id, 'P' || CAST(event_id // 5000 AS VARCHAR) AS pid, 'A' || CAST((event_id // 400) % 2 AS VARCHAR) AS annotator,
    1704067200000 + event_id * 50 AS start_ms,
    1704067200000 + event_id * 50 + CASE WHEN (event_id // 400) % 5 = 0 THEN 8000 ELSE 20000 END AS stop_ms,
    CASE event_type WHEN 'click' THEN 'Sitting and Writing' WHEN 'view' THEN 'Walking' WHEN 'purchase' THEN 'Treadmill 3.5 mph'
      WHEN 'error' THEN 'Lying on the back' ELSE 'Stairs going up' END AS label_name
  FROM events WHERE event_id % 400 = 0)"""
SENSOR_SQL = """sensor AS (
  SELECT event_id, 'P' || CAST(user_id % 10 AS VARCHAR) AS pid, event_type AS sid, epoch_us(ts) // 1000 AS t_ms, value FROM events)"""
