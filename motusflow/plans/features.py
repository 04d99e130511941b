"""Composed plans: feature bundles of windows and the preprocessing chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import HOUR_MS, floor_to
from ..functions.vectors import AXES, magnitude
from ..operators import features, lookups, windows
from ..operators.calibration import calibrated
from ..operators.signal import filtered

TIME_FREQ = ("mean", "std", "max", "dom_freq", "dom_freq_power_ratio", "highend_freq_power_ratio", "range", "active_sample_perc", "number_of_activations", "activation_interval_var")


def time_frequency(rows: DataFrame, column: str, rate: DataFrame, keys: Sequence[str] = windows.KEYS, size: int = windows.SIZE_MS, step: int | None = None, threshold: float = features.THRESHOLD, sessions: DataFrame | None = None, hour_truncation: bool = False) -> DataFrame:
    """Amplitude, spectrum and activation of one column for every window, in the order of TIME_FREQ.

    ``dom_freq`` holds the power of the highest peak, as shipped. rate: keys, rate.
    """
    by = [*keys, "window"]
    sessions = windows.bounds(rows, keys) if sessions is None else sessions
    held = windows.assigned(rows.select(*keys, "t_ms", column), sessions, keys, size, step, hour_truncation=hour_truncation)
    base = held.groupBy(*by).agg(*features.amplitude(column))
    active = features.activation(held, by, column, threshold)
    power = features.spectral(held.join(rate, list(keys), "left"), by, column)
    got = base.join(active, by, "left").join(power, by, "left")
    c = column
    out = got.select(
        *by,
        F.col(f"mean_{c}"),
        F.col(f"std_{c}"),
        F.col(f"max_{c}"),
        F.col(f"dom_power_{c}").alias(f"dom_freq_{c}"),
        F.try_divide(f"dom_power_{c}", f"total_power_{c}").alias(f"dom_freq_power_ratio_{c}"),
        F.try_divide(f"high_power_{c}", f"total_power_{c}").alias(f"highend_freq_power_ratio_{c}"),
        F.col(f"range_{c}"),
        F.col(f"active_perc_{c}").alias(f"active_sample_perc_{c}"),
        F.col(f"activations_{c}").alias(f"number_of_activations_{c}"),
        F.col(f"activation_std_{c}").alias(f"activation_interval_var_{c}"),
    )
    return windows.spine(sessions, keys, size, step).join(out, by, "left")


def feature_set(rows: DataFrame, rate: DataFrame, filter_rate: float, fixes: DataFrame | None = None, locations: DataFrame | None = None, high_cutoff: float | None = 20.0, keys: Sequence[str] = windows.KEYS, size: int = windows.SIZE_MS, step: int | None = None, anchor: str = "session", hour_truncation: bool = False) -> DataFrame:
    """Features of the norm and of the orientation for every window.

    ``anchor="hour"`` starts the windows anew at the first sample of every hour, as shipped without a sessions file;
    ``hour_truncation`` keeps session windows but lets each see only the hour it starts in, as shipped with one.
    The norm is taken before the low-pass filter (which leaves a single column as it is); the axes are filtered, then turned.
    """
    if anchor == "hour":
        rows, keys = rows.withColumn("hour_ms", floor_to("t_ms", HOUR_MS)), [*keys, "hour_ms"]
        rate = rows.select(*keys).distinct().join(rate, [k for k in keys if k in rate.columns])
    elif anchor != "session":
        raise ValueError(f"unknown anchor {anchor}")
    by = [*keys, "window"]
    rows = rows.withColumn("vm", magnitude())
    sessions = windows.bounds(rows, keys)
    turned = filtered(rows, filter_rate, [high_cutoff]) if high_cutoff else rows
    turned = lookups.orientation_fixed(turned, fixes) if fixes is not None else turned
    held = windows.assigned(turned.select(*keys, "t_ms", *AXES), sessions, keys, size, step, hour_truncation=hour_truncation)
    out = time_frequency(rows, "vm", rate, keys, size, step, sessions=sessions, hour_truncation=hour_truncation).join(features.orientation(held, by), by, "left")
    return lookups.location_of(out, locations) if locations is not None else out


def preprocessed(rows: DataFrame, calibration: DataFrame | None = None, offsets: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Calibrate, move by the participant's offset, clip to sessions; a step without its table is left out."""
    out = calibrated(rows, calibration) if calibration is not None else rows
    out = lookups.synced(out, offsets) if offsets is not None else out
    return lookups.clipped_to_sessions(out, sessions) if sessions is not None else out
