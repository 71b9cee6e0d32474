"""Runs, hysteresis, blocks and checks over time-ordered series.

Series may be few and long: orders go through slices of them (see ordering), so tasks grow in number with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.operators.ordering import exact_percentiles, lagged, one_slice, row_index, running_total, sliced


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left and right on equal by columns, nulls equal too."""
    other = right.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(by)), *(c for c in right.columns if c not in by))
    met = F.lit(True)
    for i, c in enumerate(by):
        met = met & left[c].eqNullSafe(other[f"_o{i}"])
    return left.join(other, met, "left").drop(*(f"_o{i}" for i in range(len(by))))


def round_trips(series: DataFrame, by: list[str], t: str, x: Column, lo: Column | float, hi: Column | float, ties: str | None = None) -> DataFrame:
    """Per series: state switches between at-or-below lo and at-or-above hi, the dead band keeping the state; trips are switches // 2.

    Rows in the dead band change nothing, so only the others are put in order; a slice's first state meets the last one of
    the slice before. With ties, a column, rows of one time count as one, in the state of the last of them by that column.
    """
    names = series.select(*by).distinct()
    states = series.withColumn("_s", F.when(x <= lo, -1).when(x >= hi, 1)).where("_s IS NOT NULL").select(*by, t, "_s", *([ties] if ties else []))
    cut_up = sliced(states, by, [t])  # None where few rows are outside of the dead band
    rows = states.withColumn("_slice", F.lit(0)) if cut_up is None else cut_up
    if ties:  # a time lies in one slice
        after = F.lead(F.struct(t)).over(Window.partitionBy(*by, "_slice").orderBy(t, ties))
        rows = rows.withColumn("_next", after).where(~F.col("_next").eqNullSafe(F.struct(t))).drop("_next")
    order = Window.partitionBy(*by, "_slice").orderBy(t)
    rows = rows.withColumn("_c", F.coalesce((F.col("_s") != F.lag("_s").over(order)).cast("int"), F.lit(0)))
    ends = rows.groupBy(*by, "_slice").agg(F.sum("_c").alias("_c"), F.min_by("_s", t).alias("_a"), F.max_by("_s", t).alias("_b"))
    crossed = F.coalesce((F.lag("_b").over(Window.partitionBy(*by).orderBy("_slice")) != F.col("_a")).cast("int"), F.lit(0))
    switches = ends.withColumn("_c", F.col("_c") + crossed).groupBy(*by).agg(F.sum("_c").alias("_n"))
    return _joined(names, switches, by).select(*by, F.coalesce("_n", F.lit(0)).alias("switches"), F.floor(F.coalesce("_n", F.lit(0)) / 2).alias("trips"))


def longest_run(series: DataFrame, by: list[str], t: str, below: Column) -> DataFrame:
    """Per series: the longest run of rows that meet a condition, in rows and in time (rows times the median step)."""
    rows = series.withColumn("_bad", (~F.coalesce(below, F.lit(False))).cast("int")).select(*by, t, "_bad")
    if one_slice(rows):
        order = Window.partitionBy(*by).orderBy(t)
        rows = rows.withColumn("_dt", F.col(t) - F.lag(t).over(order)).withColumn("_g", F.sum("_bad").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        runs = rows.groupBy(*by, "_g").agg(F.count_if(F.col("_bad") == 0).alias("_n")).groupBy(*by).agg(F.max("_n").alias("rows"))
        steps = rows.groupBy(*by).agg(F.median("_dt").alias("step"))
        return _joined(runs, steps, by).withColumn("time", F.col("rows") * F.col("step"))
    rows = lagged(rows, t, t, "_before", by)
    rows = running_total(rows.withColumn("_dt", F.col(t) - F.col("_before")).drop("_before"), t, "_bad", "_g", by=by)
    runs = rows.groupBy(*by, "_g").agg(F.count_if(F.col("_bad") == 0).alias("_n")).groupBy(*by).agg(F.max("_n").alias("rows"))
    return _joined(runs, exact_percentiles(rows, "_dt", {"step": 0.5}, by), by).withColumn("time", F.col("rows") * F.col("step"))


def contact_verdict(runs: DataFrame, lows: DataFrame, by: list[str], cutoff: float, sustained: float) -> DataFrame:
    """Per series its closest approach `low` and whether its longest dip lasts; verdict, the same in every row, judges all together.

    clear: none comes under the cut-off; transient: some do, none for longer than `sustained`; sustained: one does.
    """
    flagged = _joined(lows, runs, by).withColumn("lasting", F.coalesce(F.col("time") > sustained, F.lit(False)))
    worst = flagged.agg(F.min("low").alias("_w"), F.max("lasting").alias("_l"))  # one row
    verdict = F.when(F.col("_w") >= cutoff, "clear").when(~F.col("_l"), "transient").otherwise("sustained")
    return flagged.join(F.broadcast(worst)).withColumn("verdict", verdict).drop("_w", "_l")


def reliable_run(profile: DataFrame, k: str, f: str, ok: Column, among_ok: bool = False) -> DataFrame:
    """profile with reliable: the run of ok bins around the minimum of f; where no bin is ok, all bins with a value.

    The minimum is taken over all bins with a value, or among the ok ones. profile has a row per bin.
    """
    good = F.coalesce(ok & F.col(f).isNotNull(), F.lit(False))
    order = Window.orderBy(k)
    rows = profile.withColumn("_ok", good).withColumn("_g", F.sum((~good).cast("int")).over(order))
    eligible = F.col("_ok") if among_ok else F.col(f).isNotNull()
    everything = Window.partitionBy()
    place = F.min(F.when(eligible, F.struct(F.col(f), F.col(k), F.col("_g"), F.col("_ok")))).over(everything)
    any_ok = F.max("_ok").over(everything)
    inside = F.col("_ok") & place["_ok"] & (F.col("_g") == place["_g"])
    return rows.withColumn("reliable", F.coalesce(F.when(any_ok, inside).otherwise(F.col(f).isNotNull()), F.lit(False))).drop("_ok", "_g")


def block_means(series: DataFrame, by: list[str], t: str, v: Column, width: float) -> DataFrame:
    """Means over blocks of a fixed time, blocks without rows left out."""
    return series.groupBy(*by, F.floor(F.col(t) / F.lit(width)).cast("int").alias("block")).agg(F.avg(v).alias("mean"), F.count("*").alias("n"))


def count_blocks(series: DataFrame, by: list[str], t: str, v: Column, blocks: int) -> DataFrame:
    """Means over blocks of equal row counts; rows that fill no block are cut off."""
    rows = row_index(series.withColumn("_v", v).select(*by, t, "_v"), t, "_rn", by=by)
    rows = _joined(rows, rows.groupBy(*by).agg(F.count("*").alias("_n")), by)
    rows = rows.withColumn("_w", F.greatest(F.lit(1), F.floor(F.col("_n") / blocks))).where(F.col("_rn") <= F.floor(F.col("_n") / F.col("_w")) * F.col("_w"))
    return rows.groupBy(*by, F.floor((F.col("_rn") - 1) / F.col("_w")).cast("int").alias("block")).agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))


def backward_steps(series: DataFrame, by: list[str], order: str, t: str) -> DataFrame:
    """Per series: how many rows do not come later than the row before."""
    rows = lagged(series.select(*by, order, t), order, t, "_before", by)
    return rows.groupBy(*by).agg(F.count_if(F.col(t) <= F.col("_before")).alias("backward"), F.count("*").alias("n"))


def keep_last(series: DataFrame, by: list[str], key: Column, order: str) -> DataFrame:
    """The last row, by file order, of each key in each series."""
    best = Window.partitionBy(*by, "_key").orderBy(F.desc(order))
    return series.withColumn("_key", key).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "_key")


def every_nth(series: DataFrame, by: list[str], order: str, stride: int) -> DataFrame:
    """Every stride-th row of each series, beginning with the first."""
    return row_index(series, order, "_rn", by=by).where((F.col("_rn") - 1) % stride == 0).drop("_rn")


def first_below(means: DataFrame, t: str, mean: str, top: float, fraction: float) -> DataFrame:
    """The first time at which a running mean falls below a fraction of the top value; null if it never does."""
    return means.agg(F.min(F.when(F.col(mean) < fraction * top, F.col(t))).alias("t_conv"))


def drop_repeated_last(snapshots: DataFrame, order: str, index: str) -> DataFrame:
    """Snapshots less those whose index repeats the one before."""
    return snapshots.withColumn("_p", F.lag(index).over(Window.orderBy(order))).where(F.col("_p").isNull() | (F.col("_p") != F.col(index))).drop("_p")
