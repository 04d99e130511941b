"""Still stretches and autocalibration of accelerometers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import AXES, angle, magnitude, unit
from .windows import KEYS, assigned, bounds

CHUNK_MS, MAX_STD, ANGLE, POINTS, LEAST = 1_000, 0.01, 30.0, 12, 9


def still_windows(rows: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK_MS, max_std: float = MAX_STD) -> DataFrame:
    """Windows without movement: the deviation of no axis is above ``max_std``, and the means are not all zero."""
    got = assigned(rows, bounds(rows, keys), keys, size).groupBy(*keys, "window")
    got = got.agg(F.min("t_ms").alias("first_ms"), F.count("*").alias("n"), *(F.avg(a).alias(a) for a in AXES), *(F.stddev_pop(a).alias(f"std_{a}") for a in AXES))
    still = F.lit(True)
    for a in AXES:
        still = still & (F.col(f"std_{a}") <= max_std)
    nothing = F.greatest(*(F.abs(a) for a in AXES)) < 1e-5
    return got.filter(still & ~nothing)


def still_vectors(rows: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK_MS, max_std: float = MAX_STD) -> DataFrame:
    """Unit mean vectors of still windows of about one g, with their angle to (1, 1, 1)."""
    session = bounds(rows, keys)
    got = still_windows(rows, keys, size, max_std).filter(F.abs(magnitude() - 1) < 0.02).join(session, list(keys))
    start = F.col("session_start") + F.col("window") * size
    turned = F.acos(F.least(F.lit(1.0), sum((unit(a) for a in AXES[1:]), unit(AXES[0])) / F.sqrt(F.lit(3.0))))
    return got.select(*keys, "window", start.alias("start_ms"), (start + size).alias("stop_ms"), *(unit(a).alias(f"unit_{a}") for a in AXES), turned.alias("angle"))


def still_chunks(rows: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK_MS, max_std: float = MAX_STD, angle_diff: float = ANGLE, most: int = POINTS) -> DataFrame:
    """Still windows of different orientation, the first ``most`` in time order.

    A window is kept if no kept one is within ``angle_diff`` degrees on all three axes. Only one row a still window reaches Python.
    """
    still = still_windows(rows, keys, size, max_std).select(*keys, "window", *AXES, *(F.degrees(angle(a)).alias(f"deg_{a}") for a in AXES))
    kinds = {f.name: f.dataType.simpleString() for f in still.schema.fields}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("window")
        turned = p[[f"deg_{a}" for a in AXES]].to_numpy(float)
        kept: list[int] = []
        for i in range(len(p)):
            if not any((np.abs(turned[i] - turned[k]) < angle_diff).all() for k in kept):
                kept.append(i)
                if len(kept) >= most:
                    break
        return p.iloc[kept][[*keys, "window", *AXES]].assign(count=np.arange(len(kept)))

    return still.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "window long", *(f"{a} double" for a in AXES), "count long"]))


def calibration_points(chunks: DataFrame, keys: Sequence[str] = KEYS, least: int = LEAST) -> DataFrame:
    """Mean samples of the chunks of sensors that have at least ``least`` of them."""
    enough = chunks.groupBy(*keys).agg(F.count("*").alias("n_points")).filter(F.col("n_points") >= least)
    return chunks.join(enough, list(keys))


def fitted(points: np.ndarray, steps: int = 1000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray] | None:
    """A symmetric matrix M and an offset b that bring M (point - b) to length one; None without nine points or convergence.

    Damped Gauss-Newton: a step is scaled by a gain that shrinks a little while the error falls and much when it does not.
    """
    points = np.asarray(points, float)
    if len(points) < LEAST:
        return None
    scale = 1 / np.sqrt((points**2).sum(1)).mean()
    x = np.array([scale, 0, 0, scale, 0, scale, 0, 0, 0], float)  # upper triangle row by row, then the offset
    place = np.array([[0, 1, 2], [1, 3, 4], [2, 4, 5]])
    gain, error = 1.0, np.inf
    for _ in range(steps):
        m, d = x[place], points - x[6:]
        v = d @ m
        left = (v**2).sum(1) - 1
        jac = np.zeros((len(points), 9))
        for i in range(3):
            for j in range(3):
                jac[:, place[i, j]] += 2 * v[:, i] * d[:, j]
        jac[:, 6:] = -2 * v @ m
        try:
            step = np.linalg.solve(jac.T @ jac, jac.T @ left)
        except np.linalg.LinAlgError:
            return None
        now = float((left**2).mean())
        new = x - gain * step
        gain *= 0.99 if now <= error else 0.01
        error = now
        both = new + x
        change = np.divide(2 * (new - x), both, out=np.zeros(9), where=np.abs(both) > 1e-300)
        x = new
        if abs(change.max()) <= tolerance or np.sqrt(now) < 1e-14:
            return x[place], x[6:]
    return None


def calibration(chunks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, m (nine numbers, row by row) and b (three) for every sensor that converges; at most ``POINTS`` rows a sensor are fitted."""
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        got = fitted(p.sort_values("count")[list(AXES)].to_numpy(float))
        head = {k: [p[k].iloc[0]] for k in keys}
        if got is None:
            return pd.DataFrame({k: [] for k in [*keys, "m", "b"]})
        return pd.DataFrame(head | {"m": [got[0].ravel().tolist()], "b": [got[1].tolist()]})

    return calibration_points(chunks, keys).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "m array<double>, b array<double>"]))


def calibrated(rows: DataFrame, params: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """M (sample - b) for sensors with parameters (keys, m, b); the others as they are."""
    out = rows.join(params.select(*keys, "m", "b"), list(keys), "left")
    d = [F.col(a) - F.col("b")[i] for i, a in enumerate(AXES)]
    new = {a: F.coalesce(sum((F.col("m")[3 * i + j] * d[j] for j in range(1, 3)), F.col("m")[3 * i] * d[0]), F.col(a)) for i, a in enumerate(AXES)}
    return out.withColumns(new).drop("m", "b")
