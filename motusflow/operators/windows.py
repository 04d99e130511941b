"""Session-anchored windows without a scan a window: points find their windows by arithmetic on whole milliseconds.

A session's windows start at its first sample and step by ``step``; only windows that end by the session's end count. Every
window is kept, also an empty one: the spine of windows is joined on the left of what was measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh

KEYS = ("pid", "sid")
SIZE_MS = 12_800


def bounds(points: DataFrame, keys: Sequence[str] = KEYS, time: str = "t_ms") -> DataFrame:
    """A session for each key: first and last time."""
    return points.groupBy(*keys).agg(F.min(time).alias("session_start"), F.max(time).alias("session_stop"))


def _count(size: int, step: int) -> Column:
    span = F.col("session_stop") - F.col("session_start") - size
    return F.when(span >= 0, F.floor(span / step) + 1).otherwise(F.lit(0)).cast("long")


def spine(sessions: DataFrame, keys: Sequence[str] = KEYS, size: int = SIZE_MS, step: int | None = None) -> DataFrame:
    """keys, window, start_ms, stop_ms for every window of every session."""
    step = step or size
    rows = sessions.withColumn("_n", _count(size, step)).filter("_n > 0")
    rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("session_start") + F.col("window") * step
    return rows.select(*keys, "window", start.alias("start_ms"), (start + size).alias("stop_ms"))


def _more(sessions: DataFrame, keys: Sequence[str]) -> list[str]:
    """What sessions hold besides their keys and bounds; rows take it over."""
    return [c for c in sessions.columns if c not in (*keys, "session_start", "session_stop", "window")]


def assigned(points: DataFrame, sessions: DataFrame, keys: Sequence[str] = KEYS, size: int = SIZE_MS, step: int | None = None, time: str = "t_ms", hour_truncation: bool = False) -> DataFrame:
    """Every point once for each window that holds it (start <= time < stop), with ``window``.

    With ``hour_truncation``, as when each hourly file is cut before its windows, a window sees only samples of the hour it starts in.
    """
    step = step or size
    start, n, low = (fresh(points, c) for c in ("start", "n", "low"))
    more = _more(sessions, keys)
    ends = sessions.select(*keys, *more, F.col("session_start").alias(start), _count(size, step).alias(n))
    rows = points.drop("window").join(ends, list(keys))
    since = F.col(time) - F.col(start)
    if step == size:
        rows = rows.withColumn("window", F.floor(since / step).cast("long")).filter((F.col("window") >= 0) & (F.col("window") < F.col(n)))
    else:
        high = F.least(F.floor(since / step), F.col(n) - 1).cast("long")
        rows = rows.withColumn(low, F.greatest(F.ceil((since - size + 1) / step), F.lit(0)).cast("long")).filter(F.col(low) <= high)
        rows = rows.withColumn("window", F.explode(F.sequence(F.col(low), high)))
    if hour_truncation:
        hour = lambda c: F.floor(c / 3_600_000)
        rows = rows.filter(hour(F.col(time)) == hour(F.col(start) + F.col("window") * step))
    return rows.select(*(c for c in points.columns if c != "window"), *more, "window")


def overlapping(intervals: DataFrame, sessions: DataFrame, keys: Sequence[str] = KEYS, size: int = SIZE_MS, step: int | None = None) -> DataFrame:
    """Every interval (start_ms, stop_ms) once for each window that it overlaps: start < window stop and stop > window start."""
    step = step or size
    first, n, low, high = (fresh(intervals, c) for c in ("first", "n", "low", "high"))
    more = _more(sessions, keys)
    ends = sessions.select(*keys, *more, F.col("session_start").alias(first), _count(size, step).alias(n))
    rows = intervals.drop("window").join(ends, list(keys))
    rows = rows.withColumn(low, F.greatest(F.floor((F.col("start_ms") - F.col(first) - size) / step) + 1, F.lit(0)).cast("long"))
    rows = rows.withColumn(high, F.least(F.ceil((F.col("stop_ms") - F.col(first)) / step) - 1, F.col(n) - 1).cast("long")).filter(F.col(low) <= F.col(high))
    rows = rows.withColumn("window", F.explode(F.sequence(low, high)))
    start = F.col(first) + F.col("window") * step
    rows = rows.filter((F.col("start_ms") < start + size) & (F.col("stop_ms") > start))
    return rows.select(*(c for c in intervals.columns if c != "window"), *more, "window")


def windowed(points: DataFrame, measures: Sequence[Column], keys: Sequence[str] = KEYS, size: int = SIZE_MS, step: int | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Measures of every window, nulls where it is empty: the spine joined with one aggregate."""
    sessions = bounds(points, keys) if sessions is None else sessions
    got = assigned(points, sessions, keys, size, step).groupBy(*keys, "window").agg(*measures)
    return spine(sessions, keys, size, step).join(got, [*keys, "window"], "left")


def hour_owned(windows: DataFrame, hour_start: Column, hour_stop: Column) -> DataFrame:
    """Windows that start within [hour_start, hour_stop)."""
    return windows.filter((F.col("start_ms") >= hour_start) & (F.col("start_ms") < hour_stop))


def synced_bounds(bounds_: DataFrame, rule: str = "union") -> DataFrame:
    """Common bounds of several tables (one row each): union or intersection, widened to whole minutes (a minute more at the end)."""
    if rule not in ("union", "intersection"):
        raise ValueError(f"unknown rule {rule}")
    first, last = (F.min, F.max) if rule == "union" else (F.max, F.min)
    minute = lambda c: (c - F.pmod(c, F.lit(60_000))).cast("long")
    return bounds_.agg(minute(first("session_start")).alias("synced_start"), (minute(last("session_stop")) + 60_000).alias("synced_stop"))
