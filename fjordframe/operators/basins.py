"""Basin segmentation of a surface: watershed, prominence merging, shoulders, assignment, and medoids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.lineage import cut
from fjordframe.functions.shipping import released, shipped
from fjordframe.operators.grid import NEIGHBOURS
from fjordframe.operators.selection import boltzmann_sample
from fjordframe.operators.structure import frame_arrays, pair_deviations


def watershed(grid: DataFrame, ceiling: float) -> DataFrame:
    """grid (i, j, f) with label: the minimum that each cell drains to by steepest strictly lower neighbours.

    Minima are cells with no lower neighbour among the eight around them; those under the ceiling are numbered from 1
    by depth, other cells get 0. Links double in length each round, so rounds are logarithmic in the longest path.
    """
    cells = grid.where("f IS NOT NULL").select("i", "j", "f").transform(cut)
    steps = F.array(*(F.struct(F.lit(o).alias("o"), (F.col("i") + di).alias("ni"), (F.col("j") + dj).alias("nj")) for o, (di, dj) in enumerate(NEIGHBOURS)))
    asked = cells.select("i", "j", "f", F.explode(steps).alias("s")).select("i", "j", "f", "s.o", "s.ni", "s.nj")
    near = asked.join(cells.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("f").alias("nf")), ["ni", "nj"]).where("nf < f")
    lowest = near.groupBy("i", "j").agg(F.min(F.struct("nf", "o", "ni", "nj")).alias("m"))
    to = cells.join(lowest, ["i", "j"], "left").select("i", "j", F.coalesce("m.ni", "i").alias("ti"), F.coalesce("m.nj", "j").alias("tj")).transform(cut)
    while True:
        hop = to.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("ti").alias("ui"), F.col("tj").alias("uj"))
        further = to.join(hop, ["ti", "tj"]).select("i", "j", F.col("ui").alias("ti"), F.col("uj").alias("tj"), ((F.col("ui") != F.col("ti")) | (F.col("uj") != F.col("tj"))).alias("moved")).transform(cut)
        to = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    # Minima number at most the grid's cells; their order by depth is one small sort.
    minima = to.where("i = ti AND j = tj").select("i", "j").join(cells, ["i", "j"]).where(F.col("f") < ceiling)
    named = minima.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.row_number().over(Window.orderBy("f", "i", "j")).alias("label"))
    labels = to.join(named, ["ti", "tj"], "left").select("i", "j", F.coalesce("label", F.lit(0)).alias("label"))
    return grid.join(labels, ["i", "j"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def saddles(labelled: DataFrame) -> DataFrame:
    """(a, b, saddle): the lowest pass between neighbouring labels."""
    cells = labelled.where("label > 0").select("i", "j", "f", "label")
    steps = F.explode(F.array(*(F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for di, dj in NEIGHBOURS)))
    asked = cells.select(F.col("label").alias("a"), F.col("f").alias("fa"), steps.alias("s")).select("a", "fa", "s.*")
    return asked.join(cells.withColumnRenamed("label", "b"), ["i", "j"]).where("a < b").groupBy("a", "b").agg(F.min(F.greatest("fa", "f")).alias("saddle"))


def merged_labels(depths: dict[int, float], passes: list[tuple[int, int, float]], barrier: float) -> dict[int, int]:
    """Each label's final label: while the least prominence is under the barrier, that basin joins the deeper one beyond its pass.

    Works on the table of basins, which is a grid's number of minima at most.
    """
    parent = {k: k for k in depths}

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    while True:
        best = None
        for a, b, saddle in passes:
            a, b = root(a), root(b)
            if a != b:
                shallow, deep = (a, b) if (depths[a], a) > (depths[b], b) else (b, a)
                prominence = saddle - depths[shallow]
                if best is None or (prominence, shallow, deep) < best:
                    best = (prominence, shallow, deep)
        if best is None or best[0] >= barrier:
            return {k: root(k) for k in depths}
        parent[best[1]] = best[2]


def segmented(grid: DataFrame, ceiling: float, barrier: float) -> DataFrame:
    """The watershed with basins of low prominence merged, labels again by depth."""
    labelled = watershed(grid, ceiling).transform(cut)
    depths = {r["label"]: r["f"] for r in labelled.where("label > 0").groupBy("label").agg(F.min("f").alias("f")).collect()}
    final = merged_labels(depths, [tuple(r) for r in saddles(labelled).orderBy("a", "b").collect()], barrier)
    order = {k: n for n, k in enumerate(sorted({*final.values()}, key=lambda k: (depths[k], k)), 1)}
    if not final:
        return labelled
    names = F.create_map(*(F.lit(x) for k, v in final.items() for x in (k, order[v])))
    return labelled.withColumn("label", F.coalesce(F.try_element_at(names, F.col("label")), F.lit(0)))


def basin_table(segments: DataFrame, delta: float) -> DataFrame:
    """(label, i, j, fmin, ncells): each basin's minimum and its cells within delta of it."""
    low = segments.where("label > 0").groupBy("label").agg(F.min(F.struct("f", "i", "j")).alias("m"))
    rows = segments.where("label > 0").join(low, "label")
    return rows.groupBy("label", "m.i", "m.j", F.col("m.f").alias("fmin")).agg(F.count_if(F.col("f") < F.col("m.f") + delta).alias("ncells"))


def with_shoulder(segments: DataFrame, window: Column, label: int) -> DataFrame:
    """segments with a window of cells painted as a label of its own, flagged as no basin."""
    return segments.withColumn("label", F.when(window & F.col("f").isNotNull(), F.lit(label)).otherwise(F.col("label"))).withColumn("shoulder", F.col("label") == label)


def assigned(candidates: DataFrame, i: Column, j: Column, segments: DataFrame, basins: DataFrame, delta: float) -> DataFrame:
    """Candidates with the label of their cell, only where the cell lies within delta of its basin's minimum."""
    cells = segments.where("label > 0").select("i", "j", "f", "label").join(basins.select("label", "fmin"), "label").where(F.col("f") < F.col("fmin") + delta)
    return candidates.withColumn("i", i).withColumn("j", j).join(cells.select("i", "j", "label"), ["i", "j"])


#: Members of a block of a state; two blocks are compared by one task at a time.
BLOCK = 4096
#: Squared distances under this share of both squared lengths are taken from the differences, not from the products.
NEAR = 1e-3


def medoids(items: DataFrame, by: str, key: str, vector: str, most: int | None = None, w: Column | None = None, seed: int = 42) -> DataFrame:
    """(by, key, total): per state the item with the least summed Euclidean distance to the others, ties to the smaller key.

    A state is dealt out into blocks of about BLOCK members by their key's hash, and every two blocks are a group of their own, so
    that no task holds more than two; all pairs are compared. Components that either item lacks don't count. most bounds the
    members of a state that are compared: so many are drawn without replacement, by weight w or evenly.
    """
    few = items if most is None else boltzmann_sample(items, by, key, F.lit(1.0) if w is None else w, most, seed)
    rows = few.select(by, F.col(key).alias("_a"), F.col(vector).cast("array<double>").alias("_v")).where(F.col(by).isNotNull())
    blocks = rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    own = rows.join(blocks, by).withColumn("_b", F.pmod(F.xxhash64("_a"), F.col("_n")))
    met = own.select(by, "_a", "_v", "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_o"))
    pairs = met.select(by, "_a", "_v", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), (F.col("_b") <= F.col("_o")).alias("_left"))

    def measure(group: pa.Table) -> pa.Table:
        sums = _summed_distances(group)
        released()
        return pa.Table.from_arrays([group[by], group["_a"], sums], names=[by, "_a", "d"])

    shipped(items.sparkSession)
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in (by, "_a"))
    return _least_total(pairs.groupBy(by, "_p", "_q").applyInArrow(measure, f"{kinds}, d double"), by, key)


def _summed_distances(group: pa.Table) -> pa.Array:
    """Each row's summed distance to the rows of the other block, or of its own where the group is one block; null without any."""
    lists = group["_v"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    x, there = np.zeros((len(sizes), width)), np.zeros((len(sizes), width))
    flat = lists.flatten()  # without what null rows may hold
    inside = np.arange(width) < sizes[:, None]
    x[inside], there[inside] = flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    left = group["_left"].combine_chunks().to_numpy(zero_copy_only=False)
    one = bool((group["_p"].combine_chunks()[0] == group["_q"].combine_chunks()[0]))
    p, q = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
    whole = bool(there.all())
    total, met = np.zeros(len(x)), np.zeros(len(x), np.int64)
    length = (x * x).sum(axis=1)
    for start in range(0, len(p), 512):
        at = p[start : start + 512]
        with np.errstate(invalid="ignore", over="ignore"):
            if whole:
                square = length[at, None] + length[None, q]
                limit = NEAR * square
                square = square - 2 * (x[at] @ x[q].T)
            else:
                square = (x[at] ** 2) @ there[q].T + there[at] @ (x[q] ** 2).T
                limit = NEAR * square
                square = square - 2 * (x[at] @ x[q].T)
            i, j = np.nonzero(~((square > limit) & (square < np.inf)))
            for k in range(0, len(i), 1 << 16):  # near ones, and those without a finite product
                u, v = at[i[k : k + (1 << 16)]], q[j[k : k + (1 << 16)]]
                apart = np.where(there[u] * there[v] > 0, x[u] - x[v], 0.0)
                square[i[k : k + (1 << 16)], j[k : k + (1 << 16)]] = (apart * apart).sum(axis=1)
            d = np.sqrt(square)
        known = np.ones(d.shape, bool) if whole else there[at] @ there[q].T > 0
        d = np.where(known, d, 0.0) if not whole else d
        total[at] += d.sum(axis=1)
        met[at] += known.sum(axis=1)
        if not one:
            total[q] += d.sum(axis=0)
            met[q] += known.sum(axis=0)
    return pa.array(total, mask=met == 0)


def _least_total(pairs: DataFrame, by: str, key: str) -> DataFrame:
    sums = pairs.groupBy(by, "_a").agg(F.sum("d").alias("total"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("total"), "_a"))
    return sums.withColumn("_r", best).where("_r = 1").select(by, F.col("_a").alias(key), "total")


def structural_medoids(coords: DataFrame, by: str, most: int, seed: int = 42) -> DataFrame:
    """(by, frame, total): per state the frame whose summed deviation from the others, each pair superposed, is least.

    coords has by, frame, atom, x, y, z of the atoms to compare (heavy ones, by the caller's choice). At most `most` frames of a
    state are drawn and compared, so pairs stay bounded.
    """
    drawn = boltzmann_sample(coords.select(by, "frame").distinct(), by, "frame", F.lit(1.0), most, seed).select(by, "frame")
    shapes = frame_arrays(coords.join(drawn, [by, "frame"]), [by])
    a = shapes.select(by, F.col("frame").alias("_a"), F.col("xyz").alias("p"))
    b = shapes.select(by, F.col("frame").alias("_b"), F.col("xyz").alias("q"))
    return _least_total(pair_deviations(a.join(b, by)), by, "frame")
