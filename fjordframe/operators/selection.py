"""Filters, lookups, unions and draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.cells import cell_of, copied


def until(frames: DataFrame, t: Column, cut: float) -> DataFrame:
    """Frames up to a time."""
    return frames.where(t <= F.lit(cut))


def transient_zeroed(frames: DataFrame, t: Column, start: float, w: str) -> DataFrame:
    """Frames before start stay, with weight 0."""
    return frames.withColumn(w, F.when(t < start, 0.0).otherwise(F.col(w)))


def on_lattice(frames: DataFrame, t: Column, dt: float, cap: Column | float, tolerance: float = 1e-3) -> DataFrame:
    """Frames whose time is a multiple of dt, up to a cap."""
    ratio = t / F.lit(dt)
    return frames.where((F.abs(ratio - F.rint(ratio)) < tolerance) & (t <= F.lit(cap) + 1e-6 if isinstance(cap, float) else t <= cap + 1e-6))


def lookup_last(frames: DataFrame, series: DataFrame, by: list[str], t: str, order: str, decimals: int, how: str = "inner", exact_first: bool = False) -> DataFrame:
    """frames joined with the last row, in file order, of the series at the same rounded time.

    exact_first keeps the last row of each exact time before times are rounded; two times that then round to one are an error.
    """
    key = F.round(F.col(t), decimals)
    if exact_first:
        series = series.withColumn("_r", F.row_number().over(Window.partitionBy(*by, t).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
        if not series.groupBy(*by, key.alias("_k")).count().where("count > 1").isEmpty():
            raise ValueError("different times round to one")
    last = series.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_k").orderBy(F.desc(order)))).where("_r = 1").drop("_r", t, order)
    return frames.withColumn("_k", key).join(last, [*by, "_k"], how).drop("_k")


def matched_enough(frames: DataFrame, joined: DataFrame, present: Column, least: float = 0.95) -> DataFrame:
    """joined; fewer matches than the least share of frames are an error."""
    total, met = frames.count(), joined.where(present).count()
    if met < least * total:
        raise ValueError(f"only {met} of {total} frames found their row")
    return joined


def nearby_pairs(points: DataFrame, key: str, residue: str, xyz: tuple[str, str, str], cutoff: float, separation: int, by: list[str] | None = None) -> DataFrame:
    """(*by, a, b, dist): pairs a < b nearer than the cutoff and at least so many residues apart, of each structure that by names.

    A point meets only the points of its own cell and those within the cutoff of it, so pairs grow with density, not with the
    square of the points. Both sides are shuffled: Spark's estimate knows nothing of how many points a structure has, and would
    send a side of any size through the driver.
    """
    by, cells = by or [], [f"_{c}" for c in xyz]
    points = points.dropna(subset=list(xyz))
    left = points.select(*by, F.col(key).alias("a"), F.col(residue).alias("_ra"), *(F.col(c).alias(f"_a{c}") for c in xyz), *(cell_of(F.col(c), cutoff).alias(n) for c, n in zip(xyz, cells, strict=True)))
    right = copied(points.select(*by, F.col(key).alias("b"), F.col(residue).alias("_rb"), *(F.col(c).alias(f"_b{c}") for c in xyz)), [f"_b{c}" for c in xyz], cells, cutoff)
    dist = F.sqrt(reduce(Column.__add__, [F.pow(F.col(f"_a{c}") - F.col(f"_b{c}"), 2) for c in xyz]))
    pairs = left.join(right.hint("merge"), [*by, *cells]).where((F.col("a") < F.col("b")) & (F.abs(F.col("_ra") - F.col("_rb")) >= separation))
    return pairs.select(*by, "a", "b", dist.alias("dist")).where(F.col("dist") < cutoff)


def boltzmann_sample(candidates: DataFrame, by: str, key: str, w: Column, n: int, seed: int) -> DataFrame:
    """n candidates per basin without replacement, by weight: the n largest ln(u) / w, u being 50 bits of the MD5 of "seed:key"."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")
    u = (F.shiftrightunsigned(bits, 2) + 1) / F.lit(float((1 << 50) + 1))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_score"), key))
    return candidates.where(w > 0).withColumn("_score", F.ln(u) / w).withColumn("draw", best).where(F.col("draw") <= n).drop("_score")


def pool_candidates(parts: list[DataFrame], t: Column, dt: float, cap: float, values: dict[str, Column], tolerance: float = 1e-3) -> DataFrame:
    """The frames of all walkers that lie on a lattice of times up to a cap, with derived values beside their own columns."""
    rows = [on_lattice(p, t, dt, cap, tolerance) for p in parts]
    return reduce(DataFrame.unionByName, rows).withColumns(values)


def pooled(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of walkers in a stable order."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def least_cell(table: DataFrame, f: str, *index: str) -> DataFrame:
    """The cell of least f, ties to the smallest index."""
    return table.where(F.col(f).isNotNull()).agg(F.min(F.struct(f, *index)).alias("m")).select("m.*")


def frame_place(time: Column, dt: float) -> Column:
    """The frame index of a time on a lattice."""
    return F.rint(time / F.lit(dt)).cast("long")
