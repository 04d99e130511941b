"""Gaps, resampling and filtering of sensor streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import HOUR_MS, floor_to
from ..functions.vectors import AXES, affine
from ..session import fresh

#: Points of a grid that one array holds.
GRID = 1 << 16
#: What an hour sees of its neighbours when a spline is laid through it: at gaps of a second, 60 samples.
SPLINE_MS = 60_000


def _hours(rows: DataFrame, keys: Sequence[str], time: str, hour: str, sample: Column) -> DataFrame:
    """One row for each hour of each sensor: keys, hour, and the last sample before it and the first one after it."""
    ends = rows.groupBy(*keys, hour).agg(F.min_by(sample, time).alias("first"), F.max_by(sample, time).alias("last"))
    w = W.partitionBy(*keys).orderBy(hour)
    return ends.select(*keys, hour, F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))


def gap_segments(rows: DataFrame, keys: Sequence[str] = ("pid", "sid"), gap_ms: int = 1000, time: str = "t_ms") -> DataFrame:
    """``segment``: a new one begins after a gap longer than ``gap_ms``.

    An hour is sorted by itself; the last time before it and the number of segments before it come from a row an hour.
    """
    hour, far, held = (fresh(rows, n) for n in ("hour", "far", "before"))
    rows = rows.withColumn(hour, floor_to(time, HOUR_MS))
    ends = rows.groupBy(*keys, hour).agg(F.max(time).alias(held))
    ends = ends.select(*keys, hour, F.lag(held).over(W.partitionBy(*keys).orderBy(hour)).alias(held))
    w = W.partitionBy(*keys, hour).orderBy(time)
    gap = F.col(time) - F.coalesce(F.lag(time).over(w), F.col(held))
    rows = rows.join(ends, [*keys, hour]).withColumn(far, F.coalesce(gap > gap_ms, F.lit(False)).cast("long"))
    since = rows.groupBy(*keys, hour).agg(F.sum(far).alias(held))
    since = since.select(*keys, hour, F.coalesce(F.sum(held).over(W.partitionBy(*keys).orderBy(hour).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(held))
    rows = rows.withColumn(far, F.sum(far).over(w.rowsBetween(W.unboundedPreceding, 0))).drop(held).join(since, [*keys, hour])
    return rows.withColumn("segment", F.col(far) + F.col(held)).drop(hour, far, held)


def grid(bounds: DataFrame, rate: float, keys: Sequence[str] = ("pid", "sid")) -> DataFrame:
    """Evenly spaced times from first_ms to last_ms, both included: ceil(seconds * rate) of them."""
    n = F.ceil((F.col("last_ms") - F.col("first_ms")) / 1000.0 * rate).cast("long")
    rows = bounds.select(*keys, "first_ms", "last_ms", n.alias("n")).filter("n > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GRID))))  # no array holds a whole session
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("block") * GRID, F.least(F.col("block") * GRID + (GRID - 1), F.col("n") - 1))))
    step = F.when(F.col("n") > 1, (F.col("last_ms") - F.col("first_ms")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return rows.select(*keys, "k", (F.col("first_ms") + F.col("k") * step).alias("g_ms"))


def _deduplicated(rows: DataFrame, keys: Sequence[str], axes: Sequence[str], time: str) -> DataFrame:
    """One sample for each time: the least in the order of the axes."""
    return rows.groupBy(*keys, time).agg(*(F.min_by(a, F.struct(*axes)).alias(a) for a in axes))


def _interpolated(once: DataFrame, points: DataFrame, keys: Sequence[str], gap_ms: int, fill: bool, axes: Sequence[str], time: str) -> DataFrame:
    """Linear interpolation of ``points`` (keys, k, g_ms) between the samples on either side.

    Samples and points are merged in time order within each hour, to which the nearest samples of other hours are added, so one sort
    of an hour serves all axes. A point between samples further apart than ``gap_ms`` has no values.
    """
    if gap_ms >= HOUR_MS:
        raise ValueError("a gap must be shorter than an hour")
    hour = floor_to(time, HOUR_MS).alias("hour")
    sample = F.struct(F.col(time).cast("double").alias("t"), *axes)
    once = once.select(*keys, hour, F.col(time).cast("double").alias("g_ms"), sample.alias("s"))
    near = _hours(once, keys, "g_ms", "hour", F.col("s"))
    borders = near.select(*keys, "hour", F.explode(F.array("before", "after")).alias("s")).filter("s is not null").select(*keys, "hour", F.col("s.t").alias("g_ms"), "s")
    held = once.union(borders).withColumn("k", F.lit(None).cast("long"))
    points = points.select(*keys, floor_to(F.floor("g_ms").cast("long"), HOUR_MS).alias("hour"), "g_ms", F.lit(None).cast(held.schema["s"].dataType).alias("s"), "k")
    w = W.partitionBy(*keys, "hour")
    up = w.orderBy("g_ms", F.col("k").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    back = w.orderBy(F.desc("g_ms"), F.col("k").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)  # a frame to the end would be summed anew for each row
    both = held.union(points).withColumn("a", F.last("s", ignorenulls=True).over(up)).withColumn("z", F.last("s", ignorenulls=True).over(back)).filter("k is not null")
    at, good = F.col("a.t") == F.col("g_ms"), F.coalesce((F.col("a.t") == F.col("g_ms")) | (F.col("z.t") - F.col("a.t") <= gap_ms), F.lit(False))
    slope = lambda x: F.try_divide(F.col(f"z.{x}") - F.col(f"a.{x}"), F.col("z.t") - F.col("a.t"))
    value = lambda x: F.when(at, F.col(f"a.{x}")).when(good, F.col(f"a.{x}") + slope(x) * (F.col("g_ms") - F.col("a.t")))
    out = both if fill else both.filter(good)
    return out.select(*keys, "k", F.floor("g_ms").cast("long").alias(time), *(value(x).alias(x) for x in axes))


def resampled(rows: DataFrame, rate: float, keys: Sequence[str] = ("pid", "sid"), gap_ms: int = 1000, fill: bool = True, axes: Sequence[str] = AXES, time: str = "t_ms") -> DataFrame:
    """Linear interpolation on each sensor's even grid; big gaps give nulls (or, without ``fill``, no rows).

    The last grid point, at the last sample, is cut off as in [first, last).
    """
    once = _deduplicated(rows, keys, axes, time)
    ends = once.groupBy(*keys).agg(F.min(time).alias("first_ms"), F.max(time).alias("last_ms"))
    points = grid(ends, rate, keys).join(ends, list(keys)).filter("g_ms < last_ms").select(*keys, "k", "g_ms")
    return _interpolated(once, points, keys, gap_ms, fill, axes, time)


def resampled_by_hour(rows: DataFrame, rate: float | None, keys: Sequence[str] = ("pid", "sid"), gap_ms: int = 1000, fill: bool = True, axes: Sequence[str] = AXES, time: str = "t_ms") -> DataFrame:
    """Linear interpolation on a grid of each hour that has samples, ends included, within [first sample, last sample) of the sensor.

    Without a rate the rows stay as they are.
    """
    if rate is None:
        return rows
    once = _deduplicated(rows, keys, axes, time)
    ends = once.groupBy(*keys).agg(F.min(time).alias("low"), F.max(time).alias("high"))
    hours = once.select(*keys, floor_to(time, HOUR_MS).alias("first_ms")).distinct().withColumn("last_ms", F.col("first_ms") + HOUR_MS)
    points = grid(hours.withColumn("hour", F.col("first_ms")), rate, [*keys, "hour"]).filter(F.col("g_ms") < F.col("hour") + HOUR_MS)
    points = points.join(ends, list(keys)).filter("g_ms >= low and g_ms < high").select(*keys, "k", "g_ms")
    return _interpolated(once, points, keys, gap_ms, fill, axes, time)


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through all points, the second and last-but-one not being knots; at least four points."""
    n = len(x)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a = np.zeros((3, n))  # the bands of the system for the slopes at the points
    r = np.zeros(n)
    a[1, 1:-1], a[0, 2:], a[2, :-2] = 2 * (h[:-1] + h[1:]), h[:-1], h[1:]
    r[1:-1] = 3 * (h[1:] * slope[:-1] + h[:-1] * slope[1:])
    d = x[2] - x[0]
    a[1, 0], a[0, 1] = h[1], d
    r[0] = ((h[0] + 2 * d) * h[1] * slope[0] + h[0] ** 2 * slope[1]) / d
    d = x[-1] - x[-3]
    a[1, -1], a[2, -2] = h[-2], d
    r[-1] = (h[-1] ** 2 * slope[-2] + (2 * d + h[-1]) * h[-2] * slope[-1]) / d
    for i in range(1, n):
        m = a[2, i - 1] / a[1, i - 1]
        a[1, i] -= m * a[0, i]
        r[i] -= m * r[i - 1]
    s = np.empty(n)
    s[-1] = r[-1] / a[1, -1]
    for i in range(n - 2, -1, -1):
        s[i] = (r[i] - a[0, i + 1] * s[i + 1]) / a[1, i]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, w = at - x[k], h[k]
    c = (3 * slope[k] - 2 * s[k] - s[k + 1]) / w
    d = (s[k] + s[k + 1] - 2 * slope[k]) / (w * w)
    return y[k] + t * (s[k] + t * (c + t * d))


def resampled_spline(rows: DataFrame, rate: float, keys: Sequence[str] = ("pid", "sid"), gap_ms: int = 1000, axes: Sequence[str] = AXES, time: str = "t_ms") -> DataFrame:
    """Spline interpolation within stretches without a big gap, on the sensor's grid; shorter stretches than four samples go.

    A stretch is interpolated hour by hour, each with SPLINE_MS of its neighbours: a spline forgets a sample by 0.27 at each next one.
    """
    once = _deduplicated(rows, keys, axes, time)
    ends = once.groupBy(*keys).agg(F.min(time).alias("first_ms"), F.max(time).alias("last_ms"))
    cut = gap_segments(once, keys, gap_ms, time).join(ends, list(keys)).select(*keys, "segment", time, *axes, "first_ms", "last_ms")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(time)
        x, hour = p[time].to_numpy(np.float64), int(p["hour"].iloc[0])
        first, last = float(p["first_ms"].iloc[0]), float(p["last_ms"].iloc[0])
        n = int(np.ceil((last - first) / 1000 * rate))
        step = (last - first) / (n - 1) if n > 1 else 1.0
        k = np.arange(max(0, int((hour - first) / step) - 1), max(0, min(n, int((hour + HOUR_MS - first) / step) + 2)))
        at = first + k * step
        at = at[(at >= max(x[0], hour)) & (at <= x[-1]) & (at < min(last, hour + HOUR_MS))] if len(x) >= 4 else at[:0]
        out = {c: [p[c].iloc[0]] * len(at) for c in [*keys, "segment"]} | {time: np.floor(at).astype(np.int64)}
        out |= {a: spline(x, p[a].to_numpy(np.float64), at) if len(at) else np.zeros(0) for a in axes}
        return _frame(out)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "segment"]), f"{time} long", *(f"{a} double" for a in axes)])
    return _with_margins(cut, time, SPLINE_MS).groupBy(*keys, "segment", "hour").applyInPandas(run, schema)


def _frame(columns: dict) -> pd.DataFrame:
    """Text as plain objects: the frame may be empty, and then Arrow has no chunk of text to take."""
    return pd.DataFrame({c: v if isinstance(v, np.ndarray) and v.dtype != object else pd.Series(list(v), dtype=object) for c, v in columns.items()})


def _with_margins(rows: DataFrame, time: str, margin: int) -> DataFrame:
    """Every row in its own hour (``own``), and in each hour that begins or ends within ``margin`` milliseconds of it."""
    mine = floor_to(time, HOUR_MS)
    hours = F.sequence(floor_to(F.col(time) - margin, HOUR_MS), floor_to(F.col(time) + margin, HOUR_MS), F.lit(HOUR_MS).cast("long"))
    return rows.withColumn("hour", F.explode(hours)).withColumn("own", F.col("hour") == mine)


def butterworth(order: int, cutoffs: Sequence[float], rate: float, kind: str = "lowpass") -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth filter by the bilinear transform. Cut-offs in Hz, below half the rate."""
    w = np.atleast_1d(np.asarray(cutoffs, float)) / (rate / 2)
    if (w >= 1).any() or (w <= 0).any():
        raise ValueError("cut-offs must lie between 0 and half the sampling rate")
    warped = 4 * np.tan(np.pi * w / 2)  # analogue frequencies for a sampling rate of 2
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        zeros, poles, gain = np.zeros(0), poles * warped[0], warped[0] ** order
    elif kind == "highpass":
        zeros, gain, poles = np.zeros(order), np.real(1 / np.prod(-poles)), warped[0] / poles
    elif kind == "bandpass":
        wide, middle = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * wide / 2
        root = np.sqrt(half**2 - middle**2 + 0j)
        zeros, poles, gain = np.zeros(order), np.concatenate([half + root, half - root]), wide**order
    else:
        raise ValueError(f"unknown kind {kind}")
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.append((4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros)))
    poles = (4 + poles) / (4 - poles)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter state of a constant input of one."""
    n = len(a) - 1
    companion = np.eye(n) - np.vstack([-a[1:], np.eye(n)[:-1]]).T
    return np.linalg.solve(companion, b[1:] - a[1:] * b[0])


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 256) -> np.ndarray:
    """The filter's output for columns of x from the given states; a block of samples at a time, by matrix products."""
    n = len(a) - 1
    move, into = np.eye(n, k=1), b[1:] - a[1:] * b[0]
    move[:, 0] -= a[1:]
    seen, powers = np.zeros((block, n)), [np.eye(n)]
    for k in range(block):
        seen[k] = powers[-1][0]
        powers.append(powers[-1] @ move)
    reply = np.concatenate([[b[0]], seen[:-1] @ into])  # to a single one
    later = np.tril(reply[np.abs(np.subtract.outer(np.arange(block), np.arange(block)))])
    carry = np.stack([p @ into for p in powers[block - 1 :: -1]], 1)
    out, z = np.empty_like(x), state
    for i in range(0, len(x), block):
        part = x[i : i + block]
        m = len(part)
        out[i : i + m] = seen[:m] @ z + later[:m, :m] @ part
        if m == block:
            z = powers[block] @ z + carry @ part
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward without padding, each started in the steady state of its first value. Along the first axis."""
    if not len(x):
        return x
    b, a = b / a[0], a / a[0]
    held = np.asarray(x, float).reshape(len(x), -1)
    z = _steady(b, a)[:, None]
    y = _filtered(b, a, held, z * held[0])
    return _filtered(b, a, y[::-1], z * y[-1])[::-1].reshape(np.shape(x))


def across_axes(order: int, cutoffs: Sequence[float], rate: float, kind: str = "lowpass", width: int = 3) -> np.ndarray:
    """The matrix by which the zero-phase filter acts on a row of ``width`` values: it is linear, so it is applied to unit rows."""
    b, a = butterworth(order, cutoffs, rate, kind)
    return np.stack([zero_phase(b, a, e) for e in np.eye(width)], 1)


def filtered(rows: DataFrame, rate: float, cutoffs: Sequence[float], order: int = 4, kind: str = "lowpass", axes: Sequence[str] = AXES) -> DataFrame:
    """As shipped: the filter runs across each row's axes, not along time, so it is one constant matrix in a projection."""
    m = across_axes(order, cutoffs, rate, kind, len(axes))
    return rows.withColumns(dict(zip(axes, affine(m.tolist(), [0.0] * len(axes), axes), strict=True)))


def filtered_in_time(rows: DataFrame, rate: float, cutoffs: Sequence[float], order: int = 4, kind: str = "lowpass", keys: Sequence[str] = ("pid", "sid"), gap_ms: int = 1000, axes: Sequence[str] = AXES, time: str = "t_ms") -> DataFrame:
    """The evident intent: zero-phase filtering along time, within stretches without a big gap.

    A stretch is filtered hour by hour, each with as much of its neighbours as it takes for what lies beyond to fade to under 1e-12.
    """
    b, a = butterworth(order, cutoffs, rate, kind)
    fade = float(np.abs(np.roots(a)).max())
    margin = int(np.ceil(np.log(1e-14) / np.log(fade) / rate * 1000)) * 2
    cut = gap_segments(rows, keys, gap_ms, time).select(*keys, "segment", time, *axes)
    names = cut.columns

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(time)
        y = zero_phase(b, a, p[list(axes)].to_numpy(np.float64))
        own = p["own"].to_numpy(bool)
        new = {x: y[:, k] for k, x in enumerate(axes)}
        return _frame({c: (new[c] if c in new else p[c].to_numpy())[own] for c in names})

    return _with_margins(cut, time, margin).groupBy(*keys, "segment", "hour").applyInPandas(run, cut.schema)
