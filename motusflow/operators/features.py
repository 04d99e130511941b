"""Features of windows: amplitude, activation, orientation, spectrum."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import AXES, angle

THRESHOLD, SUBWINDOWS, HIGH_HZ = 0.2, 4, 3.5


def amplitude(column: str) -> list[Column]:
    """mean, std (of the population), max, min, range and absolute maximum of a column; NaN counts as missing."""
    c = F.nanvl(F.col(column), F.lit(None).cast("double"))
    return [
        F.avg(c).alias(f"mean_{column}"),
        F.stddev_pop(c).alias(f"std_{column}"),
        F.max(c).alias(f"max_{column}"),
        F.min(c).alias(f"min_{column}"),
        (F.max(c) - F.min(c)).alias(f"range_{column}"),
        F.max(F.abs(c)).alias(f"amplitude_{column}"),
    ]


def mean_distance(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mean absolute distance from the group's mean."""
    centred = rows.withColumn("_mean", F.avg(column).over(W.partitionBy(*by)))
    return centred.groupBy(*by).agg(F.avg(F.abs(F.col(column) - F.col("_mean"))).alias(f"mean_distance_{column}"))


def activation(rows: DataFrame, by: Sequence[str], column: str, threshold: float = THRESHOLD, time: str = "t_ms") -> DataFrame:
    """Share of active samples, rising edges over active samples (null without any), and the spread of active runs.

    The spread is the population deviation of the lengths of runs of two samples or more, over all samples; 0 with at most two
    runs; null if three or more runs all have one sample.
    """
    w = W.partitionBy(*by).orderBy(time)
    active = (F.col(column) >= threshold).cast("int")
    marked = rows.select(*by, time, active.alias("_a"))
    marked = marked.withColumn("_rise", ((F.col("_a") == 1) & (F.lag("_a", 1, 0).over(w) == 0)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_rise").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "_run").agg(F.sum("_a").alias("_length"), F.count("*").alias("_n"), F.sum("_rise").alias("_rises"))
    total = runs.groupBy(*by).agg(
        F.sum("_length").alias("_active"),
        F.sum("_n").alias("_all"),
        F.sum("_rises").alias("_rises"),
        F.stddev_pop(F.when(F.col("_length") > 1, F.col("_length"))).alias("_spread"),
    )
    return total.select(
        *by,
        (F.col("_active") / F.col("_all")).alias(f"active_perc_{column}"),
        F.try_divide("_rises", "_active").alias(f"activations_{column}"),
        (F.when(F.col("_rises") <= 2, F.lit(0.0)).otherwise(F.col("_spread")) / F.col("_all")).alias(f"activation_std_{column}"),
    )


def orientation(rows: DataFrame, by: Sequence[str], subwindows: int = SUBWINDOWS, time: str = "t_ms") -> DataFrame:
    """Median and range over sub-windows of the mean sample's angle to each axis.

    A sub-window has floor(n / subwindows) samples; when that divides n the very last sample is left out, else the rest is. Null
    unless every sub-window has a sample.
    """
    w = W.partitionBy(*by)
    cut = rows.withColumn("_i", F.row_number().over(w.orderBy(time)) - 1).withColumn("_n", F.count("*").over(w))
    size = F.floor(F.col("_n") / subwindows)
    cut = cut.filter((size > 0) & (F.col("_i") < F.least(size * subwindows, F.col("_n") - 1))).withColumn("_sub", F.floor(F.col("_i") / size))
    means = cut.groupBy(*by, "_sub").agg(*(F.avg(a).alias(a) for a in AXES))
    angles = means.select(*by, *(angle(a).alias(a) for a in AXES))
    whole = F.count("*") == subwindows
    measures = [F.when(whole, F.median(a)).alias(f"median_{a}_angle") for a in AXES]
    measures += [F.when(whole, F.max(a) - F.min(a)).alias(f"range_{a}_angle") for a in AXES]
    return angles.groupBy(*by).agg(*measures)


def spectrum(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density of the whole stretch: Hamming window, mean removed."""
    n = len(x)
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (rate * (w * w).sum())
    if n % 2:
        power[1:] *= 2
    else:
        power[1:-1] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power


def detect_peaks(x, height: float | None = None, distance: int = 1, threshold: float = 0, edge: str | None = "rising", keep_same: bool = False, valley: bool = False) -> np.ndarray:
    """Places of local maxima (or minima). The ends are none, nor are missing values and their neighbours.

    The series is read as runs of equal values. ``edge`` says which sample of a run counts: ``rising`` the first one, if the run is
    above what comes before it (a single sample also above what follows), ``falling`` the last one, if the run is above what follows,
    ``both`` either, None single samples only. Among peaks no further apart than ``distance`` the higher one stays, the first of equal
    ones (with ``keep_same`` all of them).
    """
    if edge not in (None, "", "rising", "falling", "both"):
        raise ValueError(f"unknown edge {edge}")
    x = np.asarray(x, float) * (-1.0 if valley else 1.0)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))  # a missing value is a run of its own
    last = np.append(first[1:], len(x)) - 1
    value = x[first]
    up = np.concatenate([[False], value[1:] > x[first[1:] - 1]])
    down = np.concatenate([value[:-1] > x[last[:-1] + 1], [False]])
    flat = last > first
    places = [first[up & down & ~flat]]
    if edge in ("rising", "both"):
        places.append(first[up & flat])
    if edge in ("falling", "both"):
        places.append(last[down & flat])
    at = np.unique(np.concatenate(places))
    at = at[(at > 0) & (at < len(x) - 1)]
    sides = np.minimum(x[at] - x[at - 1], x[at] - x[at + 1])  # missing beside a missing value
    at = at[sides >= threshold] if threshold > 0 else at[~np.isnan(sides)]
    if height is not None:
        at = at[x[at] >= height]
    if distance <= 1:
        return at
    kept: list[int] = []  # in order of place
    for i in at[np.argsort(-x[at], kind="stable")].tolist():
        near = kept[bisect_left(kept, i - distance) : bisect_right(kept, i + distance)]
        if not any(x[k] > x[i] or not keep_same for k in near):
            insort(kept, i)
    return np.array(kept, np.int64)


def frequency_features(x: np.ndarray, rate: float, top: int = 1) -> list[float]:
    """Frequencies and powers of the ``top`` highest peaks (zeros if there are fewer), total power, power above HIGH_HZ."""
    freq, power = spectrum(x, rate)
    at = detect_peaks(power)
    at = at[np.argsort(-power[at], kind="stable")][:top]
    pad = [0.0] * (top - len(at))
    return [*freq[at].tolist(), *pad, *power[at].tolist(), *pad, float(power.sum()), float(power[freq > HIGH_HZ].sum())]


def _packed(rows: DataFrame, by: Sequence[str], column: str, rate: str, time: str) -> tuple[DataFrame, str]:
    """One row a window with its samples in order (``_x``) and its rate, and the schema of ``by``."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(time, column))).alias("_s"), F.first(rate).alias("_rate"))
    packed = packed.select(*by, F.transform("_s", lambda s: s[column]).alias("_x"), "_rate")
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    return packed, ", ".join(f"{n} {kinds[n]}" for n in by)


def _good(x: list, rate) -> bool:
    return bool(len(x) > 1 and rate and None not in x)


def spectral(rows: DataFrame, by: Sequence[str], column: str, rate: str = "rate", time: str = "t_ms", top: int = 1) -> DataFrame:
    """Frequencies and powers of the ``top`` highest peaks, total and high power of every window; a window's samples are gathered by one aggregate.

    A window is bounded by its duration, so its samples fit a row; the transform then runs over many windows an Arrow batch.
    """
    packed, schema = _packed(rows, by, column, rate, time)
    place = ["", *(f"_{k}" for k in range(2, top + 1))]
    names = [*(f"dom_freq{k}_{column}" for k in place), *(f"dom_power{k}_{column}" for k in place), f"total_power_{column}", f"high_power_{column}"]

    def run(frames):
        for b in frames:
            out = []
            for x, r in zip(b.column("_x").to_pylist(), b.column("_rate").to_pylist(), strict=True):
                out.append(frequency_features(np.array(x, float), float(r), top) if _good(x, r) else [None] * len(names))
            cols = [pa.array([o[k] for o in out], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in by), *cols], names=[*by, *names])

    return packed.mapInArrow(run, ", ".join([schema, *(f"{n} double" for n in names)]))


def spectral_peaks(rows: DataFrame, by: Sequence[str], column: str, rate: str = "rate", time: str = "t_ms") -> DataFrame:
    """Every peak of each window's spectrum: by, rank (1 is the highest), power, freq; no row for a window without peaks."""
    packed, schema = _packed(rows, by, column, rate, time)

    def run(frames):
        for b in frames:
            rank, powers, freqs, row = [], [], [], []
            for i, (x, r) in enumerate(zip(b.column("_x").to_pylist(), b.column("_rate").to_pylist(), strict=True)):
                if not _good(x, r):
                    continue
                freq, power = spectrum(np.array(x, float), float(r))
                at = detect_peaks(power)
                at = at[np.argsort(-power[at], kind="stable")]
                rank += range(1, len(at) + 1)
                powers += power[at].tolist()
                freqs += freq[at].tolist()
                row += [i] * len(at)
            head = [b.column(n).take(pa.array(row, pa.int64())) for n in by]
            yield pa.RecordBatch.from_arrays([*head, pa.array(rank, pa.int64()), pa.array(powers, pa.float64()), pa.array(freqs, pa.float64())], names=[*by, "rank", "power", "freq"])

    return packed.mapInArrow(run, f"{schema}, rank long, power double, freq double")


def peaks(rows: DataFrame, keys: Sequence[str], column: str, time: str = "t_ms", **options) -> DataFrame:
    """The rows at peaks of ``column`` in the time order of each key, with any options of ``detect_peaks``."""

    def run(p):
        p = p.sort_values(time, kind="stable")
        at = detect_peaks(p[column].to_numpy(float), **options)
        return pd.DataFrame({c: p[c].to_numpy()[at] for c in p.columns})

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def sampling_rate(points: DataFrame, keys: Sequence[str], time: str = "t_ms") -> DataFrame:
    """Samples a second: the most frequent count of a whole second, the smallest on a tie; first and last second do not count."""
    second = F.floor(F.col(time) / 1000)
    counts = points.groupBy(*keys, second.alias("_second")).agg(F.count("*").alias("rate"))
    w = W.partitionBy(*keys)
    counts = counts.withColumn("_low", F.min("_second").over(w)).withColumn("_high", F.max("_second").over(w)).filter("_second > _low and _second < _high")
    often = counts.groupBy(*keys, "rate").agg(F.count("*").alias("_n"))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "rate"))
    return often.withColumn("_k", first).filter("_k = 1").select(*keys, "rate")
