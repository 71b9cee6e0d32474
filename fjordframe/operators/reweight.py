"""Bias reweighting: final-bias weights, kernel sums over deposited hills, and time-dependent weights.

kbt has no default anywhere: it belongs to the data. height_scale multiplies hill heights (1.0 takes them as stored).

Hill operators take one axis with plain columns, or a list of axes with array columns (centre, sigma and x, as
read_hills gives them). A hill is the product of its kernels, frames are read off multilinearly, and k is the place of
a grid point in row-major order, points being lo + step * 0..n on each axis.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.binning import Axis
from fjordframe.functions.lineage import cut
from fjordframe.operators.hills import Axes, corners, grid_points, hill_cells
from fjordframe.operators.ordering import exact_percentiles


def final_bias_weights(frames: DataFrame, f: Column, gamma: float, kbt: float, out: str = "w") -> DataFrame:
    """w = exp(-(1 - 1/gamma) f / kT) over its maximum; frames without a finite f weigh 0.

    The maximum comes from one aggregate over the frames, not from a window over them.
    """
    energy = -F.lit(1 - 1 / gamma) * f / F.lit(kbt)
    rows = frames.withColumn("_e", F.when(f.isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")), energy))
    top = rows.agg(F.max("_e").alias("_m"))
    return rows.crossJoin(F.broadcast(top)).withColumn(out, F.coalesce(F.exp(F.col("_e") - F.col("_m")), F.lit(0.0))).drop("_e", "_m")


def hill_surface(hills: DataFrame, centre: Column, sigma: Column, height: Column, axis: Axes, cutoff: float = 4.0, height_scale: float = 1.0) -> DataFrame:
    """(k, f): minus the summed hills on the grid, the minimum at 0. Sums are partial per task, so only cells are shuffled."""
    cells = hill_cells(hills, centre, sigma, height * F.lit(height_scale), axis, cutoff).groupBy("k").agg((-F.sum("g")).alias("f"))
    return cells.withColumn("f", F.col("f") - F.min("f").over(Window.partitionBy()))


def pooled_widths(hills: DataFrame, sigmas: list[str], biasf: str) -> DataFrame:
    """Median widths and bias factor of the pooled hills."""
    long = hills.unpivot([], [*sigmas, biasf], "name", "value")
    found = exact_percentiles(long, "value", {"median": 0.5}, ["name"])
    return found.agg(*(F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in [*sigmas, biasf]))


#: Stretches of time that a cell's history is cut into, so that no cell is one task's.
EPOCHS = 64


def bias_history(hills: DataFrame, axis: Axes, batch: float, cutoff: float, height_scale: float) -> DataFrame:
    """(k, b, g): what hills add to each grid point in each batch they touch it; hills up to an edge b * batch belong to it."""
    edge = F.greatest(F.lit(1), F.ceil(F.col("t") / F.lit(batch))).cast("int")
    deposit = hill_cells(hills.withColumn("b", edge), F.col("centre"), F.col("sigma"), F.col("height") * F.lit(height_scale), axis, cutoff, ["b"])
    return deposit.groupBy("k", "b").agg(F.sum("g").alias("g")).transform(cut)


def bias_at(history: DataFrame, asked: DataFrame, batches: int) -> DataFrame:
    """asked (k, b, ...) with v, the bias of grid point k after batch b; batches: the last one with hills.

    Time is cut into EPOCHS stretches. A point's growth is summed up by stretch, that small table gives each stretch its
    start, and the as-of order runs inside (point, stretch): history first, then questions, the last value carried on.
    """
    width = max(1, -(-batches // EPOCHS))
    epoch = F.floor((F.least(F.col("b"), F.lit(batches)) - 1) / width).cast("int")
    rows = history.withColumn("e", epoch)
    sums = rows.groupBy("k", "e").agg(F.sum("g").alias("g"))
    # Each stretch's sum counts in all later ones.
    later = F.explode(F.sequence(F.col("e") + 1, F.lit(EPOCHS)))
    starts = sums.select("k", "g", later.alias("e")).groupBy("k", "e").agg(F.sum("g").alias("g")).select("k", "e", F.lit(0).alias("b"), "g", F.lit(0).alias("kind"))
    grown = rows.select("k", "e", "b", "g", F.lit(1).alias("kind"))
    questions = asked.withColumn("e", epoch).withColumn("g", F.lit(0.0)).withColumn("kind", F.lit(2))
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema if f.name not in ("k", "b")]
    mixed = starts.unionByName(grown).select("k", "e", "b", "g", "kind", *more).unionByName(questions)
    upto = Window.partitionBy("k", "e").orderBy("b", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mixed.withColumn("v", F.sum("g").over(upto)).where("kind = 2").drop("e", "g", "kind")


def time_dependent_weights(frames: DataFrame, hills: DataFrame, axis: Axes, gamma: float, kbt: float, batch: float, checkpoint: float, cutoff: float = 4.0, height_scale: float = 1.0, strict: bool = False) -> DataFrame:
    """frames (t, x) with v and c at each frame's time, and w = exp((v - c) / kT) over its maximum.

    Bias grows in batches: at each edge tb = m * batch all hills with t <= tb are on the grid, and frames with t < tb
    that waited for the edge are evaluated there, so a frame may see hills of its own batch (strict=True takes the
    edge before it). v is read off by (multi)linear interpolation at the points around the frame, clamped to the axes. c is
    computed over the whole grid at the first edge that brings hills, and then at the first one that does a checkpoint or
    more after the last time; every frame takes the last c at or before its edge, 0 before the first.
    """
    beta = 1 / kbt
    history = bias_history(hills, axis, batch, cutoff, height_scale)
    edge = F.greatest(F.lit(1), F.ceil(F.col("t") / F.lit(batch))).cast("int")
    filled = np.sort(hills.select(edge.alias("b")).distinct().toArrow()["b"].to_numpy())  # a number for each batch at most
    last = int(filled[-1]) if len(filled) else 0
    every, marks = ceil(round(checkpoint / batch, 9)), []
    for b in filled:
        if not marks or b >= marks[-1] + every:
            marks.append(int(b))
    # Numbered and written once, so that a frame keeps its number.
    at = F.floor(F.col("t") / F.lit(batch)) + (0 if strict else 1)
    rows = frames.withColumn("_id", F.monotonically_increasing_id()).withColumn("b", F.least(at, F.lit(last)).cast("int")).transform(cut)
    corner = F.explode(F.array(*(F.struct(k.alias("k"), part.alias("part")) for k, part in corners(F.col("x"), axis))))
    asked = rows.where("b > 0").select("_id", "b", corner.alias("c")).select("_id", "b", "c.k", "c.part")
    bias = bias_at(history, asked, last).groupBy("_id").agg(F.sum(F.col("part") * F.col("v")).alias("v"))
    known = np.arange(1, last + 1, dtype=np.int32)
    places = rows.sparkSession.createDataFrame(pa.table({"b": known, "_cp": np.searchsorted(marks, known, "right").astype(np.int32)}))
    offsets = checkpoint_offsets(history, axis, gamma, kbt, marks, last).withColumnRenamed("cp", "_cp")
    out = rows.join(bias, "_id", "left").join(places.join(offsets, "_cp"), "b", "left")
    out = out.withColumn("v", F.coalesce("v", F.lit(0.0))).withColumn("c", F.coalesce("c", F.lit(0.0)))
    top = out.agg(F.max(F.col("v") - F.col("c")).alias("_m"))  # one row
    return out.join(F.broadcast(top)).withColumn("w", F.exp((F.col("v") - F.col("c") - F.col("_m")) * F.lit(beta))).drop("_id", "b", "_cp", "_m")


def checkpoint_offsets(history: DataFrame, axis: Axes, gamma: float, kbt: float, marks: list[int], batches: int) -> DataFrame:
    """(cp, c): the offset after each of the marked batches, cp from 1 on, over the dense grid of that moment.

    c = (lse(beta * g * v) - lse(beta * v / (gamma - 1))) / beta with g = gamma / (gamma - 1). Dense rows number points times
    marks, which the caller keeps small by the choice of checkpoint.
    """
    spark, beta, g = history.sparkSession, 1 / kbt, gamma / (gamma - 1)
    times = spark.createDataFrame(pa.table({"cp": np.arange(1, len(marks) + 1, dtype=np.int32), "b": np.array(marks, np.int32)}))
    points = spark.range(grid_points(axis)).select(F.col("id").cast("int").alias("k"))
    moments = bias_at(history, points.crossJoin(times), batches)
    tops = moments.groupBy("cp").agg(F.max("v").alias("m"))
    sums = moments.join(tops, "cp").groupBy("cp", "m").agg(F.sum(F.exp(F.lit(beta * g) * (F.col("v") - F.col("m")))).alias("up"), F.sum(F.exp(F.lit(beta / (gamma - 1)) * (F.col("v") - F.col("m")))).alias("down"))
    return sums.select("cp", ((F.lit(beta * g) * F.col("m") + F.ln("up") - F.lit(beta / (gamma - 1)) * F.col("m") - F.ln("down")) / F.lit(beta)).alias("c"))


def _slot(cuts: list[float]) -> Column:
    """The first cut-off at or after t, null after the last."""
    return F.coalesce(*[F.when(F.col("t") <= F.lit(c), k) for k, c in enumerate(cuts)])


def hill_snapshots(hills: DataFrame, axis: Axes, cuts: list[float], cutoff: float = 4.0) -> DataFrame:
    """(snap, k, f): the surface of the hills up to each cut-off on the whole grid, each with its minimum at 0.

    Hills are read once: they are summed by point and slice between cut-offs, and each slice counts in all later snapshots.
    """
    spark = hills.sparkSession
    cells = hill_cells(hills.withColumn("s", _slot(cuts)).where("s IS NOT NULL"), F.col("centre"), F.col("sigma"), F.col("height"), axis, cutoff, ["s"])
    later = F.explode(F.sequence(F.col("s"), F.lit(len(cuts) - 1)))
    each = cells.groupBy("k", "s").agg(F.sum("g").alias("g")).withColumn("snap", later).groupBy("snap", "k").agg((-F.sum("g")).alias("f"))
    points = grid_points(axis)
    grid = spark.range(points * len(cuts)).select((F.col("id") % points).cast("int").alias("k"), F.floor(F.col("id") / points).cast("int").alias("snap"))
    dense = grid.join(each, ["snap", "k"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return dense.withColumn("f", F.col("f") - F.min("f").over(Window.partitionBy("snap"))).select("snap", "k", "f")


def snapshot_weights(frames: DataFrame, hills: DataFrame, axis: Axes, cuts: list[float], gamma: float, kbt: float, cutoff: float = 4.0) -> DataFrame:
    """frames (t, x, ...) once for each cut-off at or after their time, with snap, f, w and lw, the logarithm of w.

    f is the surface of the hills up to the cut-off, read off by (multi)linear interpolation; w = exp(-(1 - 1/gamma) f / kT)
    over the snapshot's maximum. Hills and frames are read once; snapshots differ in sums over slices between cuts.
    """
    low = hill_snapshots(hills, axis, cuts, cutoff)
    slot, later = _slot(cuts), F.explode(F.sequence(F.col("s"), F.lit(len(cuts) - 1)))
    met = frames.withColumn("s", slot).where("s IS NOT NULL").withColumn("snap", later).withColumn("f", F.lit(0.0))
    for k, part in corners(F.col("x"), axis):
        met = met.withColumn("_k", k).join(low.select("snap", F.col("k").alias("_k"), F.col("f").alias("_g")), ["snap", "_k"]).withColumn("f", F.col("f") + part * F.col("_g")).drop("_k", "_g")
    met = met.withColumn("_e", -F.lit(1 - 1 / gamma) * F.col("f") / F.lit(kbt))
    tops = met.groupBy("snap").agg(F.max("_e").alias("_m"))
    return met.join(tops, "snap").withColumn("lw", F.col("_e") - F.col("_m")).withColumn("w", F.exp("lw")).drop("s", "_e", "_m")


#: Span of logarithms of weights that are summed together.
SPAN = 300.0


def weighted_bundle(weighted: DataFrame, views: dict[str, tuple[Column, Axis] | list[tuple[Column, Axis]]], kbt: float) -> DataFrame:
    """(view, k, mean, std, n): each view's free energy per snapshot from one weighting, then mean and deviation over snapshots.

    A view is a column with its axis, or a list of them; k is then the place of the bin in row-major order. Weights are summed by
    their logarithm (lw, where there is one), each by its span of SPAN, so that a bin whose weights are under the least double
    keeps its free energy.
    """
    bins = []
    for name, view in views.items():
        k = None
        for x, a in view if isinstance(view, list) else [view]:
            k = a.index(x) if k is None else k * a.n + a.index(x)
        bins.append(F.struct(F.lit(name).alias("view"), k.cast("int").alias("k")))
    weight = F.col("lw") if "lw" in weighted.columns else F.ln("w")
    rows = weighted.select("snap", weight.alias("_l"), F.explode(F.array(*bins)).alias("b")).select("snap", "b.view", "b.k", "_l", F.floor(F.col("_l") / SPAN).alias("_s")).where("k IS NOT NULL AND _l IS NOT NULL")
    sums = rows.groupBy("snap", "view", "k", "_s").agg(F.sum(F.exp(F.col("_l") - F.col("_s") * SPAN)).alias("_h"))
    tops = sums.withColumn("_m", F.max("_s").over(Window.partitionBy("snap", "view", "k")))
    h = tops.groupBy("snap", "view", "k", "_m").agg(F.sum(F.col("_h") * F.exp((F.col("_s") - F.col("_m")) * SPAN)).alias("h"))
    f = h.withColumn("f", -F.lit(kbt) * (F.ln("h") + F.col("_m") * SPAN)).drop("_m")
    f = f.withColumn("f", F.col("f") - F.min("f").over(Window.partitionBy("snap", "view")))
    m = f.groupBy("view", "k").agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"), F.count("*").alias("n"))
    return m.withColumn("mean", F.col("mean") - F.min("mean").over(Window.partitionBy("view")))
