"""Weighted histograms and what follows from them: free energies, profiles, sample sizes, marginals, coverage.

Inputs are frames with a weight column; outputs have a row per bin, null where a bin is empty. Every histogram is one
partially aggregated groupBy; windows run over bins only, whose number the axes fix.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.binning import Axis
from fjordframe.operators.grid import gaussian_smoothed
from fjordframe.operators.hills import hill_cells
from fjordframe.operators.ordering import exact_percentiles


def _all():
    """The window over a whole (bin) table."""
    return Window.partitionBy()


def histogram(frames: DataFrame, axes: dict[str, tuple[Column, Axis]], w: Column) -> DataFrame:
    """(one bin column per axis, h, n): weight and count of each bin that has frames."""
    rows = frames.select(w.alias("_w"), *(a.index(x).alias(name) for name, (x, a) in axes.items())).dropna(subset=list(axes))
    return rows.groupBy(*axes).agg(F.sum("_w").alias("h"), F.count("*").alias("n"))


def dense(table: DataFrame, axes: dict[str, Axis]) -> DataFrame:
    """table with a row for every bin of its axes."""
    grid = None
    for name, axis in axes.items():
        line = table.sparkSession.range(axis.n).select(F.col("id").cast("int").alias(name))
        grid = line if grid is None else grid.crossJoin(line)  # a grid is this product
    return grid.join(table, list(axes), "left")


def free_energy(h: Column, kbt: float) -> Column:
    """-kT ln h, null where h is not positive."""
    return F.when(h > 0, -F.lit(kbt) * F.ln(h))


def min_shifted(table: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """column less its minimum over the bins (of each group)."""
    return table.withColumn(column, F.col(column) - F.min(column).over(Window.partitionBy(*(by or []))))


def fes_1d(frames: DataFrame, x: Column, w: Column, axis: Axis, kbt: float, normalised: bool = False) -> DataFrame:
    """(k, f): free energy along one axis on the full axis; normalised takes each bin's share of the weight."""
    h = histogram(frames, {"k": (x, axis)}, w)
    h = h.withColumn("h", F.col("h") / F.sum("h").over(_all())) if normalised else h
    f = dense(h.select("k", free_energy(F.col("h"), kbt).alias("f")), {"k": axis})
    return f if normalised else min_shifted(f, "f")


def fes_2d(frames: DataFrame, x: Column, y: Column, w: Column, ax: Axis, ay: Axis, kbt: float, normalised: bool = False, bandwidth: tuple[float, float] | None = None) -> DataFrame:
    """(i, j, f) for the bins that have weight, the minimum at 0; normalised takes each bin's share of the weight first.

    With a bandwidth, in units of the axes, the density is smoothed before the logarithm (0 leaves an axis alone), on the
    whole grid, bins beyond its border taking the border's weight.
    """
    h = histogram(frames, {"i": (x, ax), "j": (y, ay)}, w)
    if bandwidth is not None and any(bandwidth):
        h = dense(h.select("i", "j", "h"), {"i": ax, "j": ay}).withColumn("h", F.coalesce("h", F.lit(0.0)))
        for index, other, axis, width in (("i", "j", ax, bandwidth[0]), ("j", "i", ay, bandwidth[1])):
            if width:
                h = gaussian_smoothed(h, index, [other], "h", axis.n, width / axis.step)
    h = h.withColumn("h", F.col("h") / F.sum("h").over(_all())) if normalised else h
    return min_shifted(h.select("i", "j", free_energy(F.col("h"), kbt).alias("f")).dropna(), "f")


def kernel_histogram(frames: DataFrame, x: Column, bias: Column, axis: Axis, bandwidth: float, kbt: float, cutoff: float = 4.0) -> DataFrame:
    """(k, density, f) on the points lo + step * 0..n: Gaussian kernels weighted by exp(bias / kT), and -kT ln of the density.

    Weights are taken over their maximum; points within cutoff bandwidths of no frame have no row.
    """
    rows = frames.select(x.alias("_x"), bias.alias("_b"))
    top = rows.agg(F.max("_b").alias("_m"))  # one row
    rows = rows.join(F.broadcast(top)).withColumn("_w", F.exp((F.col("_b") - F.col("_m")) / F.lit(kbt)))
    cells = hill_cells(rows, F.col("_x"), F.lit(float(bandwidth)), F.col("_w"), axis, cutoff).groupBy("k").agg(F.sum("g").alias("g"))
    total = rows.agg(F.sum("_w").alias("_t"))  # one row
    density = F.col("g") / (F.col("_t") * F.lit(bandwidth * sqrt(2 * pi)))
    return cells.join(F.broadcast(total)).select("k", density.alias("density"), free_energy(density, kbt).alias("f"))


def effective_size(w: Column) -> Column:
    """Kish's effective sample size of a group's weights, 0 where they are all 0."""
    return F.coalesce(F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w)), F.lit(0.0))


def weighted_profile(frames: DataFrame, x: Column, axis: Axis, w: Column, values: dict[str, Column]) -> DataFrame:
    """Per bin: the weighted mean of each value and the effective sample size."""
    rows = frames.select(axis.index(x).alias("k"), w.alias("_w"), *(v.alias(name) for name, v in values.items())).where("k IS NOT NULL")
    means = [F.try_divide(F.sum(F.col("_w") * F.col(name)), F.sum("_w")).alias(name) for name in values]
    return rows.groupBy("k").agg(*means, effective_size(F.col("_w")).alias("ess"), F.count("*").alias("n"))


def weighted_error(frames: DataFrame, x: Column, axis: Axis, w: Column, v: Column, least: int = 50) -> DataFrame:
    """Per bin with enough frames: weighted mean and its standard error, sqrt(variance / effective size).

    The variance is taken about the bin's mean in a second pass, which joins the means (a row per bin) back.
    """
    rows = frames.select(axis.index(x).alias("k"), w.alias("_w"), v.alias("_v")).where("k IS NOT NULL")
    means = rows.groupBy("k").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"), effective_size(F.col("_w")).alias("ess"), F.count("*").alias("n"))
    spread = rows.join(means, "k").groupBy("k", "mean", "ess", "n").agg((F.sum(F.col("_w") * F.pow(F.col("_v") - F.col("mean"), 2)) / F.sum("_w")).alias("var"))
    return spread.where(F.col("n") >= least).select("k", "mean", F.sqrt(F.col("var") / F.greatest(F.col("ess"), F.lit(1.0))).alias("se"), "n")


def conditional_profile(frames: DataFrame, x: Column, lo: float, width: float, n: int, v: Column, least: int) -> DataFrame:
    """Mean and population deviation of v in half-open bins (the last one too) with enough frames."""
    k = F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")
    rows = frames.select(k.alias("k"), v.alias("v")).where(F.col("k").between(0, n - 1))
    return rows.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n")).where(F.col("n") >= least)


def reference_mean(frames: DataFrame, condition: Column, w: Column, v: Column) -> DataFrame:
    """Weighted mean of v over the frames that meet a condition."""
    return frames.where(condition).agg(F.try_divide(F.sum(w * v), F.sum(w)).alias("mean"), F.count("*").alias("n"))


def marginal(fes: DataFrame, keep: str, f: str, kbt: float, window: Column | None = None) -> DataFrame:
    """(keep, f): -kT ln of the summed Boltzmann factors over the other axis, the minimum at 0.

    Null free energies count as nothing, and an all-null line stays null. The group's minimum is taken out of the
    exponent first.
    """
    rows = fes if window is None else fes.where(window)
    low = F.min(f).over(Window.partitionBy(keep))
    sums = rows.withColumn("_m", low).groupBy(keep).agg(F.first("_m").alias("_m"), F.sum(F.exp(-(F.col(f) - F.col("_m")) / F.lit(kbt))).alias("_s"))
    return min_shifted(sums.select(keep, (F.col("_m") - F.lit(kbt) * F.ln("_s")).alias(f)), f)


def log_sum_exp(table: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """ln of summed exp(x) for each group, in two steps."""
    top = table.groupBy(*by).agg(F.max(x).alias("_m"))
    joined = table.join(top, by) if by else table.crossJoin(F.broadcast(top))
    return joined.groupBy(*by).agg((F.first("_m") + F.ln(F.sum(F.exp(F.col(x) - F.col("_m"))))).alias(out))


def walker_coverage(frames: DataFrame, walker: str, x: Column, y: Column, ax: Axis, ay: Axis, least: int) -> DataFrame:
    """(i, j, walkers): how many walkers visited a bin at least so often."""
    rows = frames.select(walker, ax.index(x).alias("i"), ay.index(y).alias("j")).dropna()
    return rows.groupBy(walker, "i", "j").count().where(F.col("count") >= least).groupBy("i", "j").agg(F.count("*").alias("walkers"))


def rebinned_density(counts: DataFrame, axis: Axis, factor: int) -> DataFrame:
    """Counts (k, n) as a density on bins factor times as wide; a tail that fills no bin is cut off."""
    wide = axis.n // factor
    rows = counts.where(F.col("k") < wide * factor).groupBy(F.floor(F.col("k") / factor).cast("int").alias("k")).agg(F.sum("n").alias("n"))
    return rows.withColumn("density", F.col("n") / (F.sum("n").over(_all()) * F.lit(axis.step * factor)))


def density_mean(density: DataFrame, axis: Axis, factor: int) -> DataFrame:
    """(mean, n): the mean of a rebinned density, from the centres of its bins (k, n)."""
    centre = F.lit(float(axis.lo)) + (F.col("k") + 0.5) * F.lit(axis.step * factor)
    return density.agg(F.try_divide(F.sum(centre * F.col("n")), F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def summary(frames: DataFrame, v: Column, condition: Column) -> DataFrame:
    """Mean, population deviation, median, extremes, and the share that meets a condition."""
    plain = frames.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(condition.cast("int")).alias("frac"), F.count(v).alias("n"))
    middle = exact_percentiles(frames.select(v.alias("v")), "v", {"median": 0.5})
    return plain.join(F.broadcast(middle), F.lit(True), "left").select("mean", "std", "median", "low", "high", "frac", "n")  # one row each


def clipped_means(frames: DataFrame, x: Column, axis: Axis, v: Column) -> DataFrame:
    """Mean of v per bin with values outside folded into the end bins, on the full axis."""
    rows = frames.select(axis.clipped(x).alias("k"), v.alias("v")).groupBy("k").agg(F.avg("v").alias("mean"))
    return dense(rows, {"k": axis})
