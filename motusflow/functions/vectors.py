"""Expressions over three-axis samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CODES = ("X", "-X", "Y", "-Y", "Z", "-Z")


def magnitude(*axes: str | Column) -> Column:
    """Euclidean norm."""
    cols = [F.col(a) if isinstance(a, str) else a for a in (axes or AXES)]
    total = cols[0] * cols[0]
    for c in cols[1:]:
        total = total + c * c
    return F.sqrt(total)


def unit(axis: str | Column, norm: Column | None = None) -> Column:
    """The axis over the norm; null for the zero vector."""
    return F.try_divide(F.col(axis) if isinstance(axis, str) else axis, norm if norm is not None else magnitude())


def angle(axis: str | Column, norm: Column | None = None) -> Column:
    """Angle to the axis in radians; rounding cannot push the cosine out of range."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), unit(axis, norm))))


def reoriented(code: str | Column) -> Column:
    """The axis that a code names, from the row's original axes; null for an unknown code."""
    code = F.col(code) if isinstance(code, str) else code
    out = F.when(code == "X", F.col("x")).when(code == "-X", -F.col("x")).when(code == "Y", F.col("y"))
    return out.when(code == "-Y", -F.col("y")).when(code == "Z", F.col("z")).when(code == "-Z", -F.col("z"))


def affine(matrix: Sequence[Sequence[float]], offset: Sequence[float] = (0.0, 0.0, 0.0), axes: Sequence[str] = AXES) -> list[Column]:
    """matrix times (sample - offset), one column an axis, named as the axis."""
    shifted = [F.col(a) - F.lit(float(b)) for a, b in zip(axes, offset, strict=True)]
    out = []
    for row, name in zip(matrix, axes, strict=True):
        total = F.lit(float(row[0])) * shifted[0]
        for m, s in zip(row[1:], shifted[1:], strict=True):
            total = total + F.lit(float(m)) * s
        out.append(total.alias(name))
    return out


def enmo() -> Column:
    """Euclidean norm minus one, negative values as zero."""
    return F.greatest(magnitude() - 1, F.lit(0.0))
