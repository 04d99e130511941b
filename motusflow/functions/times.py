"""Time stamps: text in two forms, whole milliseconds since 1970, hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, MINUTE_MS, SECOND_MS = 3_600_000, 60_000, 1_000


def parsed(text: Column) -> Column:
    """A zone-less time stamp from ``yyyy-MM-dd HH:mm:ss[.SSS]`` or ``yyyy/MM/dd HH:mm:ss.SSS``; null if neither fits."""
    forms = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSS")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms))


def written(ts: Column) -> Column:
    """Text with milliseconds; what is below them is cut off."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def to_ms(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def from_ms(ms: str) -> Column:
    return F.expr(f"timestampadd(MILLISECOND, {ms}, TIMESTAMP_NTZ '1970-01-01 00:00:00')")


def floor_to(ms: str | Column, step: int) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return (ms - F.pmod(ms, F.lit(step))).cast("long")


def now_text(form: str = "yyyyMMddHHmmss") -> Column:
    """The wall clock as text."""
    return F.date_format(F.current_timestamp(), form)
