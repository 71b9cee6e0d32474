"""Orders over whole tables and over long series without putting either into one task.

A table of more than ROWS rows, counted first, is dealt out by range into slices, in number proportional to its rows, and
written once. Each slice is summed up to a row; that small table carries sums and last values from slice to slice, and
windows run inside slices only. A smaller table is one slice, whose windows run over each series whole. Ties may be broken by
a further column, which also parts very frequent values; a series may be named by columns (null is a name too).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.lineage import cut

#: Rows of a slice, about.
ROWS = 1_000_000


def one_slice(df: DataFrame) -> bool:
    """Whether a table is small enough for one task."""
    return df.count() <= ROWS


def sliced(df: DataFrame, by: list[str], order: list[str]) -> DataFrame | None:
    """df with _slice, a number that grows with (by, order); None for a table that is one slice."""
    n = df.count()
    if n <= ROWS:
        return None
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS + 1)
    return df.repartitionByRange(parts, *by, *order).withColumn("_slice", F.spark_partition_id()).transform(cut)


def _with_base(rows: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with their slice's row of bases; null keys meet."""
    other = bases.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in bases.columns if c not in keys))
    met = reduce(Column.__and__, [rows[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)])
    return rows.join(other, met).drop(*(f"_k{i}" for i in range(len(keys))))


def running_total(df: DataFrame, order: str, value: str, out: str, ties: str | None = None, by: list[str] | None = None) -> DataFrame:
    """df with out, the sum of value over all rows (of the series) up to this one in the order of a column, then of ties."""
    by = by or []
    columns = [order, *([ties] if ties else [])]
    rows = sliced(df, by, columns)
    if rows is None:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    keys = [*by, "_slice"]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_base(rows, bases, keys).withColumn(out, F.sum(value).over(inside) + F.col("_base")).drop("_slice", "_base")


def row_index(df: DataFrame, order: str, out: str, ties: str | None = None, by: list[str] | None = None) -> DataFrame:
    """df with its 1-based place (in its series) in the order of a column."""
    return running_total(df.withColumn("_one", F.lit(1)), order, "_one", out, ties, by).drop("_one")


def lagged(df: DataFrame, order: str, column: str, out: str, by: list[str] | None = None, ties: str | None = None) -> DataFrame:
    """df with out, the column's value in the row before (of the series), null in the first; rows of equal order go by ties."""
    by = by or []
    columns = [order, *([ties] if ties else [])]
    rows = sliced(df, by, columns)
    if rows is None:
        return df.withColumn(out, F.lag(column).over(Window.partitionBy(*by).orderBy(*columns)))
    keys = [*by, "_slice"]
    ends = rows.groupBy(*keys).agg(F.max_by(column, F.struct(*columns)).alias("_end"))
    bases = ends.select(*keys, F.lag("_end").over(Window.partitionBy(*by).orderBy("_slice")).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*columns)
    first = F.row_number().over(inside) == 1
    return _with_base(rows, bases, keys).withColumn(out, F.when(first, F.col("_base")).otherwise(F.lag(column).over(inside))).drop("_slice", "_base")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the average rank of column, ties sharing the mean of their places."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    ends = running_total(counts, column, "_n", "_end").select(column, (F.col("_end") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ends, column)


def exact_percentiles(df: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(*by, one column per share): linearly interpolated percentiles of the column's values; null values count for nothing.

    Of a table over one slice, distinct values are counted, their running counts taken by slices, and the two values around
    each place picked out.
    """
    by = by or []
    if one_slice(df):
        return df.where(F.col(column).isNotNull()).groupBy(*by).agg(*(F.percentile(column, F.lit(float(q))).alias(n) for n, q in shares.items()))
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    upto = running_total(counts, column, "_n", "_end", by=by).withColumn("_one", F.lit(1))
    totals = upto.groupBy(*by, "_one").agg(F.max("_end").alias("_all"))
    rows = _with_base(upto, totals, [*by, "_one"])
    picked = []
    for name, q in shares.items():
        place = F.lit(float(q)) * (F.col("_all") - 1)
        at = lambda p: F.max(F.when((F.col("_end") - F.col("_n") <= p) & (p < F.col("_end")), F.col(column)))
        picked += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")]
    found = rows.groupBy(*by).agg(*picked)
    return found.select(*by, *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in shares))


def running_mean(df: DataFrame, index: str, value: str, width: int, out: str) -> DataFrame:
    """Mean of each full run of width rows in a row; the row at width // 2 of the run stands for it.

    index is a 1-based dense place. Rows go to their own block of width places and to the one before, so that each
    run lies in one block whole.
    """
    block = F.floor((F.col(index) - 1) / width)
    spread = df.withColumn("_block", F.explode(F.array_distinct(F.array(block, F.greatest(block - 1, F.lit(0).cast("long"))))))
    order = Window.partitionBy("_block").orderBy(index)
    run = order.rowsBetween(0, width - 1)
    means = spread.withColumn(out, F.avg(value).over(run)).withColumn("_n", F.count("*").over(run)).withColumn("_first", F.floor((F.col(index) - 1) / width))
    starts = means.where((F.col("_n") == width) & (F.col("_first") == F.col("_block"))).select((F.col(index) + width // 2).alias(index), out)
    return df.join(starts, index)
