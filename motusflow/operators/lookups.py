"""Lookups in small tables: locations, sessions, offsets, orientation fixes, clipping.

The lookup side is reduced to one row a key first, so that no lookup multiplies rows; Spark broadcasts it if it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import HOUR_MS, floor_to
from ..functions.vectors import reoriented
from ..session import fresh


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    k = fresh(rows, "k")
    return rows.withColumn(k, F.row_number().over(w)).filter(F.col(k) == 1).drop(k)


def location_of(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``location`` by (pid, sid): the first match, ``unknown`` without one. mapping: pid, sid, location[, order]."""
    once = first_of(mapping, ("pid", "sid"), ["order"] if "order" in mapping.columns else ["location"]).select("pid", "sid", "location")
    return rows.join(once, ["pid", "sid"], "left").withColumn("location", F.coalesce("location", F.lit("unknown")))


def sid_of(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``sid`` by (pid, location): the first match, null without one."""
    once = first_of(mapping, ("pid", "location"), ["order"] if "order" in mapping.columns else ["sid"]).select("pid", "location", "sid")
    return rows.join(once, ["pid", "location"], "left")


def session_bounds(data: DataFrame, sessions: DataFrame | None, compat: bool = True) -> DataFrame:
    """session_start and session_stop a participant: from the sessions' extremes, else from the data.

    With a sessions table that lacks the participant, compat gives nulls; otherwise the data's bounds stand in.
    """
    own = data.groupBy("pid").agg(F.min("t_ms").alias("_low"), F.max("t_ms").alias("_high"))
    if sessions is None:
        return own.select("pid", F.col("_low").alias("session_start"), F.col("_high").alias("session_stop"))
    given = sessions.groupBy("pid").agg(F.min("start_ms").alias("session_start"), F.max("stop_ms").alias("session_stop"))
    out = own.join(given, "pid", "left")
    if not compat:
        out = out.withColumn("session_start", F.coalesce("session_start", "_low")).withColumn("session_stop", F.coalesce("session_stop", "_high"))
    return out.select("pid", "session_start", "session_stop")


def clipped(rows: DataFrame, start: int | None = None, stop: int | None = None, time: str = "t_ms") -> DataFrame:
    """Rows with start <= time < stop; bounds that are not given are the first and last time (so the last row then goes)."""
    if start is not None and stop is not None:
        return rows.filter((F.col(time) >= start) & (F.col(time) < stop))
    ends = rows.agg(F.min(time).alias("_low"), F.max(time).alias("_high")).first()  # one row
    return rows.filter((F.col(time) >= (ends["_low"] if start is None else start)) & (F.col(time) < (ends["_high"] if stop is None else stop)))


def clipped_to_sessions(rows: DataFrame, sessions: DataFrame, by_hour: bool = True, time: str = "t_ms") -> DataFrame:
    """Rows within their participant's sessions; without a session all but the last row of each file (an hour, or all) stays."""
    keys, (hour, start, stop) = ["pid", "sid"], (fresh(rows, n) for n in ("hour", "start", "stop"))
    held = rows.withColumn(hour, floor_to(time, HOUR_MS) if by_hour else F.lit(0).cast("long"))
    ends = held.groupBy(*keys, hour).agg(F.min(time).alias("low"), F.max(time).alias("high"))
    given = sessions.groupBy("pid").agg(F.min("start_ms").alias("first"), F.max("stop_ms").alias("last"))
    ends = ends.join(given, "pid", "left").select(*keys, hour, F.coalesce("first", "low").alias(start), F.coalesce("last", "high").alias(stop))
    return held.join(ends, [*keys, hour]).filter((F.col(time) >= F.col(start)) & (F.col(time) < F.col(stop))).select(rows.columns)


def synced(rows: DataFrame, offsets: DataFrame, time: str = "t_ms", compat: bool = False) -> DataFrame:
    """Times moved by the participant's offset in seconds (its first row); without one by nothing, or an error with compat."""
    once = first_of(offsets, ("pid",), ["offset_s"]).select("pid", "offset_s")
    move = F.round(F.col("offset_s") * 1000).cast("long")
    if compat:
        move = F.when(F.col("offset_s").isNull(), F.raise_error(F.concat(F.lit("no offset for "), F.col("pid"))).cast("long")).otherwise(move)
    else:
        move = F.coalesce(move, F.lit(0))
    return rows.join(once, "pid", "left").withColumn(time, (F.col(time) + move).cast("long")).drop("offset_s")


def orientation_fixed(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """Axes swapped and flipped by the codes (x_code, y_code, z_code) of (pid, sid), where there is exactly one row of them.

    An unknown code leaves its axis as it is.
    """
    codes = ["x_code", "y_code", "z_code"]
    once = fixes.groupBy("pid", "sid").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in codes)).filter("_n = 1").drop("_n")
    out = rows.join(once, ["pid", "sid"], "left")
    new = {a: F.coalesce(reoriented(f"{a}_code"), F.col(a)) for a in ("x", "y", "z")}
    return out.withColumns(new).drop(*codes)


def neighbours(files: DataFrame) -> DataFrame:
    """prev_file and next_file of each file of its (pid, sid), by date and hour."""
    w = W.partitionBy("pid", "sid").orderBy("date", "hour")
    return files.withColumn("prev_file", F.lag("file").over(w)).withColumn("next_file", F.lead("file").over(w))


def deduplicated(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = ("pid", "sid"), time: str = "t_ms") -> DataFrame:
    """One row for each time, the first in ``order``."""
    return first_of(rows, [*keys, time], order)


def masked(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], time: str = "t_ms") -> DataFrame:
    """Rows with start_ms <= time <= stop_ms of their key; bounds: keys, start_ms, stop_ms, a row a key."""
    low, high = fresh(rows, "low"), fresh(rows, "high")
    out = rows.join(bounds.select(*keys, F.col("start_ms").alias(low), F.col("stop_ms").alias(high)), list(keys))
    return out.filter(F.col(time).between(F.col(low), F.col(high))).select(rows.columns)
