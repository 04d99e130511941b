"""Streams of samples: windowed summaries with a watermark, and sessions split at gaps. An extension; there is no counterpart to match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import enmo
from ..functions.times import from_ms


def with_time(rows: DataFrame, time: str = "t_ms") -> DataFrame:
    """``ts`` for the watermark, from whole milliseconds."""
    return rows.withColumn("ts", from_ms(time).cast("timestamp"))


def binned(stream: DataFrame, seconds: int = 5, late: str = "1 minute", keys: Sequence[str] = ("pid", "sid")) -> DataFrame:
    """Mean norm above one and number of samples of tumbling bins; a bin is emitted once the watermark has passed it."""
    rows = with_time(stream).withWatermark("ts", late)
    got = rows.groupBy(F.window("ts", f"{seconds} seconds"), *keys).agg(F.avg(enmo()).alias("enmo"), F.count("*").alias("sr"))
    return got.select(*keys, F.unix_millis("window.start").alias("bin_ms"), "enmo", "sr")


def sessions(stream: DataFrame, gap_seconds: float = 1.0, late: str = "1 minute", keys: Sequence[str] = ("pid", "sid")) -> DataFrame:
    """Start, stop and samples of stretches without a gap of that length."""
    rows = with_time(stream).withWatermark("ts", late)
    got = rows.groupBy(F.session_window("ts", f"{int(gap_seconds * 1000)} milliseconds"), *keys).agg(F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count("*").alias("n"))
    return got.drop("session_window")
