"""Grid operators: nearest cell, interpolation, smoothing, border extension and connected regions.

Grids are tables (i, j, f) whose size is fixed by their axes. Joins of frames with a grid carry no hint: Spark sends the
grid out where its size allows and shuffles otherwise. Iterations over a grid write each round to a checkpoint.
"""

from __future__ import annotations

from itertools import product
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.binning import Axis
from fjordframe.functions.lineage import cut

#: Cells of a grid that the driver may walk.
SMALL_GRID = 50_000
#: The eight neighbours of a cell, in the order that breaks ties.
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def nearest_cell(x: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest of n grid points, halves to even, -1 outside."""
    k = F.rint((x - F.lit(float(first))) / F.lit(float(step))).cast("int")
    return F.when(k.between(0, n - 1), k).otherwise(F.lit(-1))


def interpolated(points: DataFrame, x: str, curve: DataFrame, cx: str, cf: str, out: str, outside: str = "null", by: list[str] | None = None) -> DataFrame:
    """points with the curve's linear interpolation at x; outside its range null, or the end value ('clamp').

    by names columns that tell several curves apart; points of a curve that is not there stay, with null. The curve's range
    is cut into as many cells as it has segments, segments are laid into the cells they touch, and points meet them by cell.
    """
    by = by or []
    good = curve.where(F.col(cf).isNotNull()).select(*by, F.col(cx).alias("_a"), F.col(cf).alias("_fa"))
    ends = good.groupBy(*by).agg(F.min(F.struct("_a", "_fa")).alias("_lo"), F.max(F.struct("_a", "_fa")).alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi._a") - F.col("_lo._a")) / F.greatest(F.col("_n") - 1, F.lit(1))
    ends = ends.select(*by, "_lo", "_hi", F.when(width > 0, width).otherwise(1.0).alias("_w"))
    order = Window.partitionBy(*by).orderBy("_a")
    segments = good.withColumn("_b", F.lead("_a").over(order)).withColumn("_fb", F.lead("_fa").over(order))
    join = lambda a, b: a.join(b, by) if by else a.join(F.broadcast(b))  # without by, one row
    cell = lambda v: F.floor((v - F.col("_lo._a")) / F.col("_w"))
    touched = F.explode(F.sequence(cell(F.col("_a")), cell(F.coalesce("_b", "_a"))))
    segments = join(segments, ends).select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), touched.alias("_c"), "_a", "_fa", "_b", "_fb")
    placed = points.join(ends, by, "left") if by else points.join(F.broadcast(ends), F.lit(True), "left")
    placed = placed.withColumn("_p", cell(F.col(x)))
    inside = (F.col("_p") == F.col("_c")) & (F.col(x) >= F.col("_a")) & ((F.col(x) < F.col("_b")) | ((F.col(x) == F.col("_a")) & F.col("_b").isNull()))
    for i, c in enumerate(by):
        inside = inside & (placed[c] == F.col(f"_by{i}"))
    rows = placed.join(segments, inside, "left")
    value = F.when(F.col("_b").isNull(), F.col("_fa")).otherwise(F.col("_fa") + (F.col("_fb") - F.col("_fa")) * (F.col(x) - F.col("_a")) / (F.col("_b") - F.col("_a")))
    if outside == "clamp":
        value = F.when(F.col(x) < F.col("_lo._a"), F.col("_lo._fa")).when(F.col(x) > F.col("_hi._a"), F.col("_hi._fa")).otherwise(value)
    return rows.withColumn(out, value).drop("_a", "_fa", "_b", "_fb", "_lo", "_hi", "_w", "_c", "_p", *(f"_by{i}" for i in range(len(by))))


def resampled(curves: DataFrame, by: list[str], x: str, f: str, lo: float, hi: float, n: int, least: int = 4) -> DataFrame:
    """(*by, k, x, f): curves read off at n points from lo to hi, null beyond a curve's own points between lo and hi.

    Curves with fewer than `least` values there are left out.
    """
    good = curves.where(F.col(f).isNotNull() & F.col(x).between(lo, hi))
    enough = good.groupBy(*by).count().where(F.col("count") >= least).select(*by)
    place = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    points = enough.select(*by, place).withColumn("_x", F.lit(float(lo)) + F.col("k") * F.lit((hi - lo) / (n - 1)))
    return interpolated(points, "_x", good.select(*by, x, f), x, f, "_f", by=by).select(*by, "k", F.col("_x").alias(x), F.col("_f").alias(f))


def multilinear(points: DataFrame, x: list[Column], grid: DataFrame, axes: list[Axis], out: str, outside: str = "null") -> DataFrame:
    """points with the linear interpolation, along every axis, of grid (k, f); k is a grid point's place in row-major order.

    Outside the axes null, or the value at the border ('clamp'). A point that a null grid point bears on is null.
    """
    rows, inside, cell = points, F.lit(True), F.lit(0)
    for d, (c, a) in enumerate(zip(x, axes, strict=True)):
        place = F.least(F.greatest((c - F.lit(float(a.lo))) / F.lit(a.step), F.lit(0.0)), F.lit(float(a.n)))
        rows = rows.withColumn(f"_u{d}", place).withColumn(f"_i{d}", F.least(F.floor(f"_u{d}"), F.lit(a.n - 1)))
        inside, cell = inside & c.between(float(a.lo), float(a.hi)), cell * a.n + F.col(f"_i{d}")
    corners = list(product((0, 1), repeat=len(axes)))
    spots, rest = grid.select("k", "f").withColumn("_r", F.col("k")), F.col("_r")
    for d in reversed(range(len(axes))):
        spots = spots.withColumn(f"_j{d}", F.pmod(rest, F.lit(axes[d].n + 1))).withColumn("_r", F.floor(rest / (axes[d].n + 1)))
    of = []
    for o in corners:
        at, fits = F.lit(0), F.lit(True)
        for d, a in enumerate(axes):
            low = F.col(f"_j{d}") - o[d]
            at, fits = at * a.n + low, fits & low.between(0, a.n - 1)
        of.append(F.struct(F.when(fits, at).alias("cell"), F.lit("".join(map(str, o))).alias("corner")))
    cells = spots.select("f", F.explode(F.array(*of)).alias("_o")).select("f", "_o.*").where("cell IS NOT NULL")
    values = [F.max(F.when(F.col("corner") == "".join(map(str, o)), F.col("f"))).alias("_f" + "".join(map(str, o))) for o in corners]
    met = rows.withColumn("_cell", cell).join(cells.groupBy(F.col("cell").alias("_cell")).agg(*values), "_cell", "left")
    total = F.lit(0.0)
    for o in corners:
        part = F.lit(1.0)
        for d, side in enumerate(o):
            share = F.col(f"_u{d}") - F.col(f"_i{d}")
            part = part * (share if side else 1 - share)
        total = total + F.when(part == 0, 0.0).otherwise(part * F.col("_f" + "".join(map(str, o))))
    value = total if outside == "clamp" else F.when(inside, total)
    return met.withColumn(out, value).drop("_cell", *(f"_{n}{d}" for d in range(len(axes)) for n in "ui"), *("_f" + "".join(map(str, o)) for o in corners))


def bilinear(points: DataFrame, x: Column, y: Column, grid: DataFrame, ax: Axis, ay: Axis, out: str) -> DataFrame:
    """points with the bilinear interpolation of grid (i, j, f) on points lo + k * step, k = 0..n, clamped to the range."""
    clamp = lambda v, a: F.least(F.greatest((v - F.lit(float(a.lo))) / F.lit(a.step), F.lit(0.0)), F.lit(float(a.n)))
    rows = points.withColumn("_u", clamp(x, ax)).withColumn("_v", clamp(y, ay))
    rows = rows.withColumn("i", F.least(F.floor("_u"), F.lit(ax.n - 1)).cast("int")).withColumn("j", F.least(F.floor("_v"), F.lit(ay.n - 1)).cast("int"))
    cell = grid.select("i", "j", F.col("f").alias("f00"))
    for di, dj in ((0, 1), (1, 0), (1, 1)):
        cell = cell.join(grid.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("f").alias(f"f{di}{dj}")), ["i", "j"])
    a, b = F.col("_u") - F.col("i"), F.col("_v") - F.col("j")
    value = (1 - a) * (1 - b) * F.col("f00") + (1 - a) * b * F.col("f01") + a * (1 - b) * F.col("f10") + a * b * F.col("f11")
    return rows.join(cell, ["i", "j"], "left").withColumn(out, value).drop("_u", "_v", "i", "j", "f00", "f01", "f10", "f11")


def gaussian_smoothed(grid: DataFrame, index: str, others: list[str], f: str, n: int, sigma: float, cutoff: float = 4.0) -> DataFrame:
    """grid smoothed along one index by a truncated Gaussian, cells beyond the border taking the border's value."""
    reach = int(cutoff * sigma + 0.5)
    weights = [exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    total = sum(weights)
    kernel = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w / total).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True)))
    # A cell gives w to the cells that reach it; a border cell also gives for the places beyond the border.
    takers = grid.select(*others, F.col(index), F.explode(kernel).alias("_k")).select(*others, F.col(index), F.least(F.greatest(F.col(index) + F.col("_k.d"), F.lit(0)), F.lit(n - 1)).alias("_s"), F.col("_k.w").alias("_w"))
    source = grid.select(*others, F.col(index).alias("_s"), F.col(f).alias("_f"))
    return takers.join(source, [*others, "_s"]).groupBy(*others, index).agg(F.sum(F.col("_w") * F.col("_f")).alias(f))


def masked_smoothed(grid: DataFrame, f: str, n: tuple[int, int], sigma: tuple[float, float]) -> DataFrame:
    """2D smoothing that keeps empty cells empty: the ratio of smoothed values and smoothed presence."""
    value = grid.withColumn("_m", F.col(f).isNotNull().cast("double")).withColumn("_v", F.coalesce(f, F.lit(0.0)))
    smooth = lambda c: gaussian_smoothed(gaussian_smoothed(value.select("i", "j", F.col(c).alias("g")), "i", ["j"], "g", n[0], sigma[0]), "j", ["i"], "g", n[1], sigma[1]).withColumnRenamed("g", c)
    both = smooth("_v").join(smooth("_m"), ["i", "j"]).join(grid.select("i", "j", F.col(f).isNotNull().alias("_has")), ["i", "j"])
    return both.select("i", "j", F.when(F.col("_has"), F.try_divide("_v", "_m")).alias(f))


def extended(grid: DataFrame, n: tuple[int, int]) -> DataFrame:
    """grid with a border of one cell on every side that repeats the outermost cells."""
    rows = grid
    for axis, size in zip(("i", "j"), n, strict=True):
        low, high = rows.where(F.col(axis) == 0).withColumn(axis, F.lit(-1)), rows.where(F.col(axis) == size - 1).withColumn(axis, F.lit(size))
        rows = rows.unionByName(low).unionByName(high)
    return rows


def component_of(cells: DataFrame, seed: DataFrame, small: int = SMALL_GRID) -> DataFrame:
    """(i, j) of the 4-connected component of cells that holds the seed.

    Up to `small` cells are walked on the driver; of more, runs of cells are labelled in rounds. Both give the same cells.
    """
    cells = cells.select("i", "j").distinct().transform(cut)
    spark = cells.sparkSession
    if cells.count() <= small:
        left, todo = {tuple(r) for r in cells.collect()}, [tuple(r) for r in seed.select("i", "j").collect()]
        todo = [c for c in todo if c in left]
        reached = set(todo)
        while todo:
            i, j = todo.pop()
            more = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & left - reached
            reached |= more
            todo += more
        return spark.createDataFrame(sorted(reached), "i int, j int")
    # Cells in a row of the grid that lie together are one run; runs of neighbouring rows that touch are joined.
    place = F.col("j") - F.row_number().over(Window.partitionBy("i").orderBy("j"))
    first = F.min("j").over(Window.partitionBy("i", "_p"))
    runs = cells.withColumn("_p", place).withColumn("run", F.col("i").cast("long") * (1 << 32) + first + (1 << 31)).drop("_p").transform(cut)
    above = runs.select((F.col("i") + 1).alias("i"), "j", F.col("run").alias("other"))
    touching = runs.join(above, ["i", "j"]).select("run", "other").distinct()
    labels = joined_labels(runs.select("run").distinct(), touching.unionByName(touching.select(F.col("other").alias("run"), F.col("run").alias("other"))).transform(cut))
    named = runs.join(labels, "run")
    return named.join(named.join(seed.select("i", "j"), ["i", "j"], "left_semi").select("label").distinct(), "label", "left_semi").select("i", "j")


def joined_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(run, label): the least run of each component of nodes (run) by links (run, other), which hold both directions.

    In each round a node takes the least label of its neighbours, and then its label's own, so that labels leap along paths
    and rounds number about the logarithm of the longest one.
    """
    labels = nodes.withColumn("label", F.col("run")).transform(cut)
    while True:
        near = links.join(labels.select(F.col("run").alias("other"), F.col("label").alias("_l")), "other").groupBy("run").agg(F.min("_l").alias("_l"))
        lower = labels.join(near, "run", "left").select("run", "label", F.least("label", "_l").alias("_n"))
        leap = labels.select(F.col("run").alias("_n"), F.col("label").alias("_m"))
        new = lower.join(leap, "_n").select("run", F.col("label").alias("_old"), F.least("_n", "_m").alias("label")).transform(cut)
        if new.where("label <> _old").isEmpty():
            return new.select("run", "label")
        labels = new.select("run", "label")


def reliable_region(grid: DataFrame, mean: str, ok: Column, small: int = SMALL_GRID) -> DataFrame:
    """grid with reliable: the 4-connected component, among ok cells, of the one with the least mean.

    Where no cell is ok, all cells with a mean are reliable.
    """
    good = grid.where(ok & F.col(mean).isNotNull()).transform(cut)
    if good.isEmpty():
        return grid.withColumn("reliable", F.col(mean).isNotNull())
    seed = good.orderBy(mean, "i", "j").limit(1)
    region = component_of(good, seed, small).withColumn("reliable", F.lit(True))
    return grid.join(region, ["i", "j"], "left").withColumn("reliable", F.coalesce("reliable", F.lit(False)))


def sampled_cells(frames: DataFrame, x: Column, y: Column, ax: Axis, ay: Axis, least: int) -> DataFrame:
    """(i, j, n, sampled): visits to the cell around each grid point lo + step * 0..n, half a step to either side."""
    around = [Axis(a.lo - a.step / 2, a.hi + a.step / 2, a.n + 1) for a in (ax, ay)]
    counts = frames.select(around[0].index(x).alias("i"), around[1].index(y).alias("j")).dropna().groupBy("i", "j").agg(F.count("*").alias("n"))
    spark = frames.sparkSession
    points = spark.range((ax.n + 1) * (ay.n + 1)).select(F.floor(F.col("id") / (ay.n + 1)).cast("int").alias("i"), (F.col("id") % (ay.n + 1)).cast("int").alias("j"))
    return points.join(counts, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("sampled", F.col("n") >= least)


def swapped_surface(region: DataFrame, ax: Axis, ay: Axis, f: str) -> DataFrame:
    """(i, j, cv1, cv2, f) of a region's surface with its axes swapped, for segmentation; null outside the region."""
    value = F.when(F.col("reliable"), F.col(f))
    return region.select(F.col("j").alias("i"), F.col("i").alias("j"), ay.centre(F.col("j")).alias("cv1"), ax.centre(F.col("i")).alias("cv2"), value.alias("f"))


def visited_region(grid: DataFrame, mean: str, std: str, count: str, ceiling: float, least_visits: int, walkers: str | None = None, least_walkers: int = 1) -> DataFrame:
    """Cells with enough visits in the low-deviation component; with walkers, cells enough of them reached, and the component anew."""
    ok = (F.col(std) <= ceiling) & (F.col(count) >= least_visits)
    first = reliable_region(grid, mean, ok)
    if walkers is not None:
        first = reliable_region(first.drop("reliable"), mean, ok & (F.col(walkers) >= least_walkers))
    low = F.min(F.when(F.col("reliable"), F.col(mean))).over(Window.partitionBy())
    return first.withColumn(mean, F.when(F.col("reliable"), F.col(mean) - low))
