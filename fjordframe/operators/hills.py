"""Deposited kernels and the grid points that they and frames touch.

Operators take one axis with plain columns, or a list of axes with array columns. k is the place of a grid point in row-major
order, points being lo + step * 0..n on each axis.
"""

from __future__ import annotations

from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordframe.functions.binning import Axis

Axes = Axis | list[Axis]


def grid_points(axis: Axes) -> int:
    return prod(a.n + 1 for a in axis) if isinstance(axis, list) else axis.n + 1


def axis_parts(c: Column, axis: Axes) -> list[tuple[Column, Axis]]:
    """The column of each axis."""
    return [(c[d], a) for d, a in enumerate(axis)] if isinstance(axis, list) else [(c, axis)]


def corners(x: Column, axis: Axes) -> list[tuple[Column, Column]]:
    """(k, part) of the grid points around x, clamped to the axes: parts are the weights of multilinear interpolation."""
    sides = []
    for c, a in axis_parts(x, axis):
        place = F.least(F.greatest((c - F.lit(float(a.lo))) / F.lit(a.step), F.lit(0.0)), F.lit(float(a.n)))
        low = F.least(F.floor(place), F.lit(a.n - 1)).cast("int")
        sides.append([(low, 1 - (place - low), a.n + 1), (low + 1, place - low, a.n + 1)])
    out = []
    for corner in product(*sides):
        k, part = F.lit(0), F.lit(1.0)
        for at, share, n in corner:
            k, part = k * n + at, part * share
        out.append((k.cast("int"), part))
    return out


def hill_cells(hills: DataFrame, centre: Column, sigma: Column, height: Column, axis: Axes, cutoff: float = 4.0, extra: list[str] | None = None) -> DataFrame:
    """(k, g, *extra): what each hill adds to the grid points within cutoff sigmas of it on every axis."""
    rows = hills.select(centre.alias("_c"), sigma.alias("_s"), height.alias("g"), F.lit(0).alias("k"), *(extra or []))
    for (c, a), (w, _) in zip(axis_parts(F.col("_c"), axis), axis_parts(F.col("_s"), axis), strict=True):
        step, lo = F.lit(a.step), F.lit(float(a.lo))
        reach, near = F.ceil(F.lit(cutoff) * w / step), F.rint((c - lo) / step)
        first, last = F.greatest(near - reach, F.lit(0)).cast("int"), F.least(near + reach, F.lit(a.n)).cast("int")
        spread = rows.withColumn("_lo", first).withColumn("_hi", last).where("_lo <= _hi").withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
        delta = F.col("_k") * step + lo - c
        rows = spread.withColumn("g", F.col("g") * F.exp(-delta * delta / (2 * w * w))).withColumn("k", (F.col("k") * (a.n + 1) + F.col("_k")).cast("int")).drop("_lo", "_hi", "_k")
    return rows.select("k", "g", *(extra or []))
