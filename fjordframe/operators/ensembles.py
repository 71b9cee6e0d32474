"""Snapshot ensembles: cumulative cut-offs, mean and deviation over snapshots, drift, and validation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.binning import Axis
from fjordframe.operators.hist import free_energy, min_shifted
from fjordframe.operators.ordering import row_index


def fixed_cuts(t_max: float, n: int) -> list[float]:
    """n cut-offs, evenly from t_max / n to t_max."""
    return [t_max / n + (t_max - t_max / n) * i / max(1, n - 1) for i in range(n)]


def converged_cuts(t_conv: float, t_max: float, n: int) -> list[float]:
    """n cut-offs, evenly after t_conv up to t_max."""
    return [t_conv + (t_max - t_conv) * (i + 1) / n for i in range(n)]


def cuts_after(start: float, t_max: float, n: int) -> list[float]:
    """n cut-offs, evenly after a discarded start up to t_max; frames before the start are the caller's to leave out."""
    return converged_cuts(start, t_max, n)


def cut_offs(ends: DataFrame, by: list[str], kinds: dict[str, tuple], n: int) -> DataFrame:
    """(*by, kind, snap, t_cut): n cut-offs of each kind for every row of ends, a kind being (start, end): columns of ends.

    They lie evenly after the start up to the end, or, without a start, evenly from end / n to the end.
    """
    def cut(start: Column | str | None, end: Column | str, k: int) -> Column:
        end = F.col(end) if isinstance(end, str) else end
        if start is None:
            return end / n + (end - end / n) * k / max(1, n - 1)
        start = F.col(start) if isinstance(start, str) else start
        return start + (end - start) * (k + 1) / n

    each = [F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("snap"), cut(start, end, k).alias("t_cut")) for kind, (start, end) in kinds.items() for k in range(n)]
    return ends.select(*by, F.explode(F.array(*each)).alias("_c")).select(*by, "_c.*")


def hill_count_cuts(hills: DataFrame, t: str, n: int, ties: str | None = None) -> DataFrame:
    """(snap, hills, t_cut): a cut-off at every max(1, hills // n)-th hill in time order and one at the last.

    Where the stride divides the hills exactly the last cut-off would come twice; it comes once.
    """
    placed = row_index(hills, t, "_p", ties)
    total = placed.agg(F.count("*").alias("_n"))  # one row
    rows = placed.join(F.broadcast(total)).withColumn("_s", F.greatest(F.lit(1), F.floor(F.col("_n") / n)))
    kept = rows.where((F.col("_p") % F.col("_s") == 0) | (F.col("_p") == F.col("_n")))
    # Cut-offs number about n.
    return kept.select((F.row_number().over(Window.orderBy("_p")) - 1).alias("snap"), F.col("_p").cast("long").alias("hills"), F.col(t).alias("t_cut"))


def snapshot_table(spark: SparkSession, cuts: list[float]) -> DataFrame:
    """(snap, t_cut), one row per snapshot."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, {t!r}D)" for k, t in enumerate(cuts)) + " AS s(snap, t_cut)")


def snapshot_histograms(frames: DataFrame, t: Column, x: Column, w: Column, axis: Axis, cuts: list[float]) -> DataFrame:
    """(snap, k, h, n): weights per bin of the frames up to each cut-off, from one scan.

    Frames are first summed per bin and slice between cut-offs; cumulative sums over that small table follow.
    """
    snap = F.coalesce(*[F.when(t <= F.lit(c), k) for k, c in enumerate(cuts)])
    slices = frames.select(axis.index(x).alias("k"), snap.alias("s"), w.alias("_w")).dropna().groupBy("k", "s").agg(F.sum("_w").alias("h"), F.count("*").alias("n"))
    each = slices.withColumn("snap", F.explode(F.sequence(F.col("s"), F.lit(len(cuts) - 1))))
    return each.groupBy("snap", "k").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))


def snapshot_surfaces(frames: DataFrame, t: Column, x: Column, w: Column, axis: Axis, cuts: list[float], kbt: float) -> DataFrame:
    """(snap, k, f): the free energy of each cumulative snapshot, each with its minimum at 0."""
    h = snapshot_histograms(frames, t, x, w, axis, cuts)
    return min_shifted(h.select("snap", "k", free_energy(F.col("h"), kbt).alias("f")).dropna(), "f", ["snap"])


def mean_and_deviation(surfaces: DataFrame, bins: list[str], f: str = "f") -> DataFrame:
    """Per bin: mean (its minimum at 0), population deviation and number of snapshots that have the bin."""
    return min_shifted(surfaces.groupBy(*bins).agg(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), F.count(f).alias("n")), "mean")


def consecutive_difference(surfaces: DataFrame, bins: list[str], least: int = 4, f: str = "f") -> DataFrame:
    """(snap, mad): mean absolute difference to the snapshot before, null with fewer shared bins."""
    before = surfaces.select((F.col("snap") + 1).alias("snap"), *bins, F.col(f).alias("_b"))
    both = surfaces.join(before, ["snap", *bins]).where(F.col(f).isNotNull() & F.col("_b").isNotNull())
    return both.groupBy("snap").agg(F.when(F.count("*") >= least, F.avg(F.abs(F.col(f) - F.col("_b")))).alias("mad"))


def drift_from_last(surfaces: DataFrame, bins: list[str], below: float, f: str = "f") -> DataFrame:
    """(snap, drift): mean absolute difference to the last snapshot over its bins under a ceiling."""
    last = surfaces.agg(F.max("snap").alias("_l"))
    final = surfaces.join(F.broadcast(last), F.col("snap") == F.col("_l"))  # one row
    final = final.where(F.col(f) < below).select(*bins, F.col(f).alias("_f"))
    return surfaces.join(final, bins).groupBy("snap").agg(F.avg(F.abs(F.col(f) - F.col("_f"))).alias("drift"))


def trend(series: DataFrame, value: str) -> DataFrame:
    """Rises in a (snap, value) series, and whether there are none."""
    step = F.col(value) - F.lag(value).over(Window.orderBy("snap"))
    return series.withColumn("_d", step).agg(F.count_if(F.col("_d") > 0).alias("rises")).withColumn("monotonic", F.col("rises") == 0)


def minimum_drift(surfaces: DataFrame, x: str, f: str = "f") -> DataFrame:
    """How far the minimum moves over the final third of the snapshots."""
    minima = surfaces.groupBy("snap").agg(F.min(F.struct(f, x)).getField(x).alias("at"))
    last = F.max("snap").over(Window.partitionBy())
    return minima.withColumn("_l", last).where(F.col("snap") > 2 * F.col("_l") / 3).agg((F.max("at") - F.min("at")).alias("drift"))


def gate(curve: DataFrame, reference: DataFrame, bins: list[str], counts: DataFrame | None, least: int, ceiling: float, limit: float) -> DataFrame:
    """(mad, n, passed): mean absolute difference over bins with enough counts and a reference under the ceiling."""
    rows = curve.select(*bins, F.col("f").alias("_f")).join(reference.select(*bins, F.col("f").alias("_r")), bins)
    if counts is not None:
        rows = rows.join(counts.select(*bins, F.col("n").alias("_n")), bins).where(F.col("_n") >= least)
    rows = rows.where((F.col("_r") <= ceiling) & F.col("_f").isNotNull())
    return rows.agg(F.avg(F.abs(F.col("_f") - F.col("_r"))).alias("mad"), F.count("*").alias("n")).withColumn("passed", F.coalesce(F.col("mad") <= limit, F.lit(False)))


def enforced(result: DataFrame, on_fail: str = "flag") -> DataFrame:
    """A gate's result; on_fail='raise' stops where it has not passed."""
    if on_fail == "raise" and not result.first()["passed"]:
        raise ValueError(f"validation gate failed: {result.first().asDict()}")
    return result
