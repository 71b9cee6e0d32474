"""Snapshot, reweighting, grid and basin queries over the stand-in frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordframe.functions.binning import Axis
from fjordframe.operators import basins as B
from fjordframe.operators import ensembles as E
from fjordframe.operators import grid as G
from fjordframe.operators import hist as H
from fjordframe.operators import reweight as W
from fjordframe.operators import simplex as X
from fjordframe.plans.standin import AX, AY, CUTS, FRAMES, GAMMA, KBT, frames, r, rounded

HX, SIGMA, HEIGHT = Axis(0.0, 500.0, 100), 8.0, 0.5
BATCH, CHECK = 24.0, 120.0
GX, GY = Axis(0.0, 200.0, 20), Axis(0.0, 100.0, 20)
HX2, HY2, SIGMA2 = Axis(0.0, 500.0, 50), Axis(0.0, 100.0, 20), (15.0, 6.0)


def _surfaces(spark, d):
    return E.snapshot_surfaces(frames(spark, d), F.col("t"), F.col("x"), F.col("w"), AX, CUTS, KBT)


def _grid(spark, d):
    return H.fes_2d(frames(spark, d), F.col("x"), F.col("y"), F.col("w"), GX, GY, KBT).withColumn("f", F.round("f", 6))


def _walker_grid(spark, d):
    """Mean and deviation over walkers of their own surfaces."""
    h = frames(spark, d).select("walker", GX.index(F.col("x")).alias("i"), GY.index(F.col("y")).alias("j"), "w").dropna().groupBy("walker", "i", "j").agg(F.sum("w").alias("h"), F.count("*").alias("n"))
    f = H.min_shifted(h.withColumn("f", H.free_energy(F.col("h"), KBT)), "f", ["walker"])
    return f.groupBy("i", "j").agg(F.round(F.avg("f"), 6).alias("mean"), F.round(F.stddev_pop("f"), 6).alias("std"), F.sum("n").alias("n"), F.count("*").alias("walkers"))


def snapshot_mean_std(spark, d):
    return rounded(E.mean_and_deviation(_surfaces(spark, d), ["k"]))


def snapshot_mad(spark, d):
    return rounded(E.consecutive_difference(_surfaces(spark, d), ["k"]))


def fes_drift(spark, d):
    return rounded(E.drift_from_last(_surfaces(spark, d), ["k"], 12.0))


def mad_trend(spark, d):
    return E.trend(rounded(E.consecutive_difference(_surfaces(spark, d), ["k"])), "mad")


def final_bias_weights(spark, d):
    f = frames(spark, d).withColumn("f", F.when(F.col("y") > 5, F.col("y") / 10))
    return rounded(W.final_bias_weights(f, F.col("f"), GAMMA, KBT, "wf").select("row", "wf"), 9)


def gate_mad(spark, d):
    f = frames(spark, d)
    a, b = H.fes_1d(f, F.col("x"), F.col("w"), AX, KBT), H.fes_1d(f.where("walker < 3"), F.col("x"), F.col("w"), AX, KBT)
    counts = H.histogram(f, {"k": (F.col("x"), AX)}, F.lit(1.0))
    return rounded(E.gate(b, a, ["k"], counts, 200, 30.0, 2.99))


def _hills(spark, d):
    return frames(spark, d).where("kind = 'purchase'").select("t", F.col("x").alias("centre"), F.lit(SIGMA).alias("sigma"), F.lit(HEIGHT).alias("height"))


def hills_kernel_sum_1d(spark, d):
    return rounded(W.hill_surface(_hills(spark, d), F.col("centre"), F.col("sigma"), F.col("height"), HX))


def ct_weights_bucketed(spark, d):
    f = frames(spark, d).where("kind <> 'purchase'").select("row", "t", "x")
    out = W.time_dependent_weights(f, _hills(spark, d), HX, GAMMA, 50.0, BATCH, CHECK)
    return rounded(out.select("row", "v", "c", "w"))


def nearest_cell(spark, d):
    return frames(spark, d).select("row", G.nearest_cell(F.col("x"), 2.5, 5.0, 80).alias("cell"))


def _curve(spark, d):
    return H.fes_1d(frames(spark, d), F.col("x"), F.col("w"), AX, KBT).where("f IS NOT NULL").select(AX.centre(F.col("k")).alias("cx"), F.col("f").alias("cf"))


def interp_clamp(spark, d):
    return rounded(G.interpolated(frames(spark, d).select("row", "x"), "x", _curve(spark, d), "cx", "cf", "f", "clamp").select("row", "f"))


def interp_null(spark, d):
    return rounded(G.interpolated(frames(spark, d).select("row", "x"), "x", _curve(spark, d), "cx", "cf", "f").select("row", "f"))


def bilinear_frames(spark, d):
    spots = H.dense(spark.createDataFrame([], "i int, j int"), {"i": Axis(0, 21, 21), "j": Axis(0, 21, 21)}).withColumn("f", (F.col("i") * F.col("j")) / 7.0 + F.col("i"))
    return rounded(G.bilinear(frames(spark, d).select("row", "x", "y"), F.col("x"), F.col("y"), spots, GX, GY, "f").select("row", "f"))


def smooth_grid(spark, d):
    counts = H.dense(H.histogram(frames(spark, d), {"k": (F.col("x"), AX)}, F.lit(1.0)).select("k", "n"), {"k": AX}).select("k", F.coalesce("n", F.lit(0)).cast("double").alias("f"))
    return rounded(G.gaussian_smoothed(counts, "k", [], "f", AX.n, 1.5))


def reliable_region2d(spark, d):
    return G.reliable_region(_walker_grid(spark, d), "mean", F.col("std") <= 1.6).select("i", "j", "reliable")


def watershed_labels(spark, d):
    return B.watershed(_grid(spark, d), 9.0).select("i", "j", "label")


def basin_segments(spark, d):
    return B.basin_table(B.segmented(_grid(spark, d), 9.0, 1.0), 2.0)


def basin_segments_low(spark, d):
    """The same with a barrier that leaves several basins."""
    return B.basin_table(B.segmented(_grid(spark, d), 9.0, 0.2), 2.0)


def snapshot_bundle(spark, d):
    f = frames(spark, d).where("kind <> 'purchase'").select("t", "x", "y")
    w = W.snapshot_weights(f, _hills(spark, d), HX, CUTS, GAMMA, 50.0)
    return rounded(W.weighted_bundle(w, {"x": (F.col("x"), AX), "y": (F.col("y"), AY), "xy": [(F.col("x"), AX), (F.col("y"), AY)]}, 50.0))


def _hills_2d(spark, d):
    """Hills in (x, y) up to t = 400, so that later frames see the last grid and the last offset."""
    f = frames(spark, d).where("kind = 'purchase' AND t <= 400")
    return f.select("t", F.array("x", "y").alias("centre"), F.array(F.lit(SIGMA2[0]), F.lit(SIGMA2[1])).alias("sigma"), F.lit(HEIGHT).alias("height"))


def hill_snapshots(spark, d):
    return rounded(W.hill_snapshots(_hills(spark, d), HX, CUTS))


def hills_kernel_sum_2d(spark, d):
    return rounded(W.hill_surface(_hills_2d(spark, d), F.col("centre"), F.col("sigma"), F.col("height"), [HX2, HY2]))


def ct_weights_2d(spark, d):
    f = frames(spark, d).where("kind <> 'purchase'").select("row", "t", F.array("x", "y").alias("x"))
    out = W.time_dependent_weights(f, _hills_2d(spark, d), [HX2, HY2], GAMMA, 50.0, 12.0, 60.0)
    return rounded(out.select("row", "v", "c", "w"))


def fes_at_points(spark, d):
    """A 2D surface on grid points read off at the frames, null outside of it."""
    spots = H.dense(spark.createDataFrame([], "i int, j int"), {"i": Axis(0, 21, 21), "j": Axis(0, 21, 21)}).select((F.col("i") * 21 + F.col("j")).alias("k"), ((F.col("i") * F.col("j")) / 7.0 + F.col("i")).alias("f"))
    return rounded(G.multilinear(frames(spark, d).select("row", "x", "y"), [F.col("x"), F.col("y")], spots, [GX, GY], "f").select("row", "f"))


RX, RY = Axis(0.0, 500.0, 8), Axis(0.0, 100.0, 6)


def fes_simplex(spark, d):
    """Each walker's frames on its own surface through the centres of mass of coarse bins, by Delaunay triangles; null outside of them."""
    f = frames(spark, d)
    binned = f.select("walker", RX.index(F.col("x")).alias("i"), RY.index(F.col("y")).alias("j"), "x", "y", "w").dropna()
    nodes = binned.groupBy("walker", "i", "j").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("w").alias("f"))
    return rounded(X.simplex_values(f.select("walker", "row", "x", "y"), X.triangulated(nodes, ["walker"]), ["walker"], ["row"]).select("walker", "row", "f"))


def resampled_curves(spark, d):
    s = _surfaces(spark, d).withColumn("x", AX.centre(F.col("k")))
    return rounded(G.resampled(s, ["snap"], "x", "f", 20.0, 320.0, 300, 4).select("snap", "k", "f"))


def sampled_cells(spark, d):
    return G.sampled_cells(frames(spark, d), F.col("x"), F.col("y"), GX, GY, 5)


def swapped_surface(spark, d):
    region = G.visited_region(_walker_grid(spark, d), "mean", "std", "n", 1.6, 5)
    return rounded(G.swapped_surface(region, GX, GY, "mean"))


def reliable_region2d_rounds(spark, d):
    """The region grown round by round in joins, as beyond a small grid."""
    return G.reliable_region(_walker_grid(spark, d), "mean", F.col("std") <= 1.6, small=0).select("i", "j", "reliable")


def region_without_good_cells(spark, d):
    return G.reliable_region(_walker_grid(spark, d), "mean", F.col("std") < -1).groupBy("reliable").count()


def hill_count_cuts(spark, d):
    return rounded(E.hill_count_cuts(frames(spark, d).where("kind = 'purchase'").select("row", "t"), "t", 7, "row"))


def snapshot_cut_offs(spark, d):
    """Six cut-offs of three kinds for every walker, by its own first and last times."""
    ends = frames(spark, d).groupBy("walker").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return rounded(E.cut_offs(ends, ["walker"], {"fixed": (None, "last"), "converged": (F.col("last") / 6, "last"), "after": ("first", "last")}, 6))


def basins_below(spark, d):
    """Unmerged basins with their cells near the minimum."""
    return B.basin_table(B.watershed(_grid(spark, d), 9.0), 2.0)


def shoulder_cells(spark, d):
    painted = B.with_shoulder(B.watershed(_grid(spark, d), 9.0), F.col("i").between(2, 4) & F.col("j").between(3, 8), 99)
    return painted.select("i", "j", "label", "shoulder")


def assigned_frames(spark, d):
    segments = B.watershed(_grid(spark, d), 9.0)
    f = frames(spark, d).select("row", "x", "y")
    return B.assigned(f, GX.index(F.col("x")), GY.index(F.col("y")), segments, B.basin_table(segments, 2.0), 2.0).select("row", "label")


def pooled_widths(spark, d):
    return rounded(W.pooled_widths(frames(spark, d), ["x", "y"], "t"))


def minimum_drift(spark, d):
    return rounded(E.minimum_drift(_surfaces(spark, d).withColumn("f", F.round("f", 6)), "k"))


def extended_grid(spark, d):
    whole = H.dense(_grid(spark, d), {"i": GX, "j": GY})
    return G.extended(whole, (GX.n, GY.n))


def masked_smooth(spark, d):
    return rounded(G.masked_smoothed(H.dense(_grid(spark, d), {"i": GX, "j": GY}), "f", (GX.n, GY.n), (1.0, 1.0)))


def visited_region(spark, d):
    return rounded(G.visited_region(_walker_grid(spark, d), "mean", "std", "n", 1.6, 5, "walkers", 4)).select("i", "j", "mean", "reliable")


_S = f"""s AS (SELECT k, t_snap.snap, f - min(f) OVER (PARTITION BY t_snap.snap) AS f FROM (
SELECT snap, k, -{KBT}::DOUBLE * ln(sum(w)) AS f FROM (SELECT {AX.sql("x")} AS k, t, w FROM {FRAMES}) a JOIN (VALUES {", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(CUTS))}) c(snap, cut) ON t <= cut WHERE k IS NOT NULL GROUP BY 1, 2) t_snap)"""
_MAD = "m AS (SELECT a.snap, CASE WHEN count(*) >= 4 THEN avg(abs(a.f - b.f)) END AS mad FROM s a JOIN s b ON a.snap = b.snap + 1 AND a.k = b.k GROUP BY 1)"


def _fes(where: str = "true") -> str:
    return f"(SELECT k, f - min(f) OVER () AS f, n FROM (SELECT {AX.sql('x')} AS k, -{KBT}::DOUBLE * ln(sum(w)) AS f, count(*) AS n FROM {FRAMES} WHERE {where} GROUP BY 1) WHERE k IS NOT NULL)"


_CURVE = f"(SELECT (k + 0.5::DOUBLE) * {AX.step}::DOUBLE + 0.0::DOUBLE AS cx, f AS cf FROM {_fes()})"
_SEG = f"(SELECT cx AS a, cf AS fa, lead(cx) OVER (ORDER BY cx) AS b, lead(cf) OVER (ORDER BY cx) AS fb FROM {_CURVE})"
_LERP = "CASE WHEN b IS NULL THEN fa ELSE fa + (fb - fa) * (x - a) / (b - a) END"
_GRID = f"(SELECT i, j, round(f - min(f) OVER (), 6) AS f FROM (SELECT {GX.sql('x')} AS i, {GY.sql('y')} AS j, -{KBT}::DOUBLE * ln(sum(w)) AS f FROM {FRAMES} GROUP BY 1, 2) WHERE i IS NOT NULL AND j IS NOT NULL)"
_WGRID = f"""(SELECT i, j, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std FROM (SELECT walker, i, j, f - min(f) OVER (PARTITION BY walker) AS f FROM (
SELECT walker, {GX.sql("x")} AS i, {GY.sql("y")} AS j, -{KBT}::DOUBLE * ln(sum(w)) AS f FROM {FRAMES} GROUP BY 1, 2, 3) WHERE i IS NOT NULL AND j IS NOT NULL) GROUP BY 1, 2)"""
_VGRID = f"""(SELECT i, j, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std, sum(n) AS n, count(*) AS walkers FROM (SELECT walker, i, j, n, f - min(f) OVER (PARTITION BY walker) AS f FROM (
SELECT walker, {GX.sql("x")} AS i, {GY.sql("y")} AS j, count(*) AS n, -{KBT}::DOUBLE * ln(sum(w)) AS f FROM {FRAMES} GROUP BY 1, 2, 3) WHERE i IS NOT NULL AND j IS NOT NULL) GROUP BY 1, 2)"""
_HSQL = f"(SELECT t, x AS c FROM {FRAMES} WHERE kind = 'purchase')"
_REACH = f"k BETWEEN round_even(c / {HX.step}::DOUBLE, 0) - ceil(4 * {SIGMA}::DOUBLE / {HX.step}::DOUBLE) AND round_even(c / {HX.step}::DOUBLE, 0) + ceil(4 * {SIGMA}::DOUBLE / {HX.step}::DOUBLE)"
_BUMP = f"{HEIGHT}::DOUBLE * exp(-pow(k * {HX.step}::DOUBLE - c, 2) / (2 * {SIGMA}::DOUBLE * {SIGMA}::DOUBLE))"

QUERIES = {f.__name__: f for f in (snapshot_mean_std, snapshot_mad, fes_drift, mad_trend, final_bias_weights, gate_mad, hills_kernel_sum_1d, ct_weights_bucketed, nearest_cell, interp_clamp, interp_null, bilinear_frames, smooth_grid, reliable_region2d, watershed_labels, basin_segments, basin_segments_low, snapshot_bundle, pooled_widths, minimum_drift, extended_grid, masked_smooth, visited_region, hill_snapshots, hills_kernel_sum_2d, ct_weights_2d, fes_at_points, fes_simplex, resampled_curves, sampled_cells, swapped_surface, reliable_region2d_rounds, region_without_good_cells, hill_count_cuts, snapshot_cut_offs, basins_below, shoulder_cells, assigned_frames)}
_NEAR2 = " AND ".join(f"{k} BETWEEN round_even({c} / {a.step}::DOUBLE, 0) - ceil(4 * {w}::DOUBLE / {a.step}::DOUBLE) AND round_even({c} / {a.step}::DOUBLE, 0) + ceil(4 * {w}::DOUBLE / {a.step}::DOUBLE)" for k, c, a, w in (("i", "x", HX2, SIGMA2[0]), ("j", "y", HY2, SIGMA2[1])))
_BUMP2 = f"{HEIGHT}::DOUBLE * exp(-pow(i * {HX2.step}::DOUBLE - x, 2) / (2 * pow({SIGMA2[0]}::DOUBLE, 2))) * exp(-pow(j * {HY2.step}::DOUBLE - y, 2) / (2 * pow({SIGMA2[1]}::DOUBLE, 2)))"
_SPREAD2 = f"(SELECT t, (i * {HY2.n + 1} + j)::INTEGER AS k, {_BUMP2} AS g FROM {FRAMES}, range({HX2.n + 1}) a(i), range({HY2.n + 1}) b(j) WHERE kind = 'purchase' AND t <= 400 AND {_NEAR2})"
_AROUND = " UNION ALL ".join(f"SELECT row, b, ((i + {di}) * {HY2.n + 1} + j + {dj})::INTEGER AS k, {'(p - i)' if di else '(1 - (p - i))'} * {'(q - j)' if dj else '(1 - (q - j))'} AS part FROM f" for di in (0, 1) for dj in (0, 1))
_DRAINS = f"""g AS MATERIALIZED (SELECT * FROM {_GRID}),
n AS MATERIALIZED (SELECT a.i, a.j, b.i AS ti, b.j AS tj FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND b.f < a.f QUALIFY row_number() OVER (PARTITION BY a.i, a.j ORDER BY b.f, b.i, b.j) = 1),
w AS (SELECT i, j, i AS ti, j AS tj FROM g UNION SELECT w.i, w.j, n.ti, n.tj FROM w JOIN n ON w.ti = n.i AND w.tj = n.j),
e AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.i = w.ti AND n.j = w.tj)),
m AS (SELECT g.i, g.j, g.f, row_number() OVER (ORDER BY f, g.i, g.j) AS label FROM g WHERE f < 9 AND NOT EXISTS (SELECT 1 FROM n WHERE n.i = g.i AND n.j = g.j)),
l AS (SELECT e.i, e.j, g.f, coalesce(label, 0)::INTEGER AS label, m.f AS fmin, m.i AS mi, m.j AS mj FROM e JOIN g ON g.i = e.i AND g.j = e.j LEFT JOIN m ON m.i = e.ti AND m.j = e.tj)"""
def _merged(barrier: float) -> str:
    """Basins merged one at a time, the least prominence first; labels go by depth, so of two the larger one is the shallower."""
    return f"""WITH RECURSIVE {_DRAINS},
a AS MATERIALIZED (SELECT x.label AS a, y.label AS b, min(greatest(x.f, y.f)) AS saddle FROM l x JOIN l y ON abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 AND x.label < y.label WHERE x.label > 0 GROUP BY 1, 2),
d AS MATERIALIZED (SELECT list(f ORDER BY label) AS depths, list(label ORDER BY label) AS labels FROM m),
r AS (SELECT 0 AS step, labels AS p FROM d UNION ALL SELECT step + 1, list_transform(p, lambda x: CASE WHEN x = hi THEN lo ELSE x END) FROM (
  SELECT step, p, min(prominence) AS least, arg_min(hi, (prominence, hi, lo)) AS hi, arg_min(lo, (prominence, hi, lo)) AS lo FROM (
    SELECT step, p, hi, lo, saddle - depths[hi] AS prominence FROM (SELECT step, p, saddle, greatest(p[a], p[b]) AS hi, least(p[a], p[b]) AS lo FROM r, a WHERE p[a] <> p[b]), d) GROUP BY step, p) WHERE least < {barrier}),
q AS (SELECT p FROM r ORDER BY step DESC LIMIT 1), s AS (SELECT l.i, l.j, l.f, p[l.label] AS root FROM l, q WHERE label > 0), t AS (SELECT i, j, f, dense_rank() OVER (ORDER BY root) AS label, min((f, i, j)) OVER (PARTITION BY root) AS least FROM s)
SELECT label::INTEGER AS label, least[2] AS i, least[3] AS j, least[1] AS fmin, count(*) FILTER (WHERE f < least[1] + 2) AS ncells FROM t GROUP BY ALL"""


ORACLES = {
    "hill_snapshots": f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(CUTS))}) c(snap, cut)),
v AS (SELECT snap, gk.k, -sum({_BUMP}) AS f FROM {_HSQL} h JOIN c ON h.t <= c.cut, range({HX.n + 1}) gk(k) WHERE {_REACH} GROUP BY 1, 2)
SELECT c.snap, gk.k::INTEGER AS k, {r("coalesce(f, 0) - min(coalesce(f, 0)) OVER (PARTITION BY c.snap)", "f")} FROM c CROSS JOIN range({HX.n + 1}) gk(k) LEFT JOIN v ON v.snap = c.snap AND v.k = gk.k""",
    "hills_kernel_sum_2d": f"SELECT k, {r('f - min(f) OVER ()', 'f')} FROM (SELECT k, -sum(g) AS f FROM {_SPREAD2} GROUP BY 1)",
    "ct_weights_2d": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT k, greatest(1, ceil(t / 12.0::DOUBLE))::INTEGER AS b, sum(g) AS g FROM {_SPREAD2} GROUP BY 1, 2),
h AS (SELECT k, b, sum(g) OVER (PARTITION BY k ORDER BY b) AS v FROM d),
f AS (SELECT *, least(floor(p), {HX2.n - 1}) AS i, least(floor(q), {HY2.n - 1}) AS j FROM (SELECT row, (floor(t / 12.0::DOUBLE) + 1)::INTEGER AS b, least(greatest(x / {HX2.step}::DOUBLE, 0), {HX2.n}) AS p, least(greatest(y / {HY2.step}::DOUBLE, 0), {HY2.n}) AS q FROM {FRAMES} WHERE kind <> 'purchase')),
a AS ({_AROUND}), v AS (SELECT row, sum(part * coalesce(v, 0)) AS v FROM a ASOF LEFT JOIN h ON a.k = h.k AND a.b >= h.b GROUP BY 1),
mk AS (SELECT min(b) AS b FROM d UNION ALL SELECT min(d.b) FROM mk JOIN d ON d.b >= mk.b + 5 GROUP BY mk.b),
z AS (SELECT y.b, coalesce(v, 0) AS v FROM (SELECT mk.b, gk.k FROM mk, range({(HX2.n + 1) * (HY2.n + 1)}) gk(k)) y ASOF LEFT JOIN h ON y.k = h.k AND y.b >= h.b),
c AS (SELECT b, 50.0::DOUBLE * (ln(sum(exp({GAMMA / (GAMMA - 1) / 50.0!r}::DOUBLE * v))) - ln(sum(exp({1 / (GAMMA - 1) / 50.0!r}::DOUBLE * v)))) AS c FROM z GROUP BY 1),
o AS (SELECT f.row, v.v, coalesce(c.c, 0) AS c FROM f JOIN v ON f.row = v.row ASOF LEFT JOIN c ON f.b >= c.b)
SELECT row, {r("v", "v")}, {r("c", "c")}, {r("exp((v - c - max(v - c) OVER ()) / 50.0::DOUBLE)", "w")} FROM o""",
    "fes_at_points": f"""WITH p AS (SELECT row, x, y, least(greatest(x / {GX.step}::DOUBLE, 0), {GX.n}) AS u, least(greatest(y / {GY.step}::DOUBLE, 0), {GY.n}) AS v FROM {FRAMES}), q AS (SELECT *, least(floor(u), {GX.n - 1}) AS i, least(floor(v), {GY.n - 1}) AS j FROM p)
SELECT row, CASE WHEN x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 100 THEN {r("(1 - (u - i)) * (1 - (v - j)) * (i * j / 7.0::DOUBLE + i) + (1 - (u - i)) * (v - j) * (i * (j + 1) / 7.0::DOUBLE + i) + (u - i) * (1 - (v - j)) * ((i + 1) * j / 7.0::DOUBLE + i + 1) + (u - i) * (v - j) * ((i + 1) * (j + 1) / 7.0::DOUBLE + i + 1)", "f").removesuffix(" AS f")} END AS f FROM q""",
    "fes_simplex": f"""WITH n AS MATERIALIZED (SELECT walker, row_number() OVER (PARTITION BY walker ORDER BY i, j) AS k, x, y, f FROM (SELECT walker, {RX.sql("x")} AS i, {RY.sql("y")} AS j, avg(x) AS x, avg(y) AS y, avg(w) AS f FROM {FRAMES} GROUP BY ALL) WHERE i IS NOT NULL AND j IS NOT NULL),
t AS (SELECT a.walker, a.k AS ka, b.k AS kb, c.k AS kc, a.x AS ax, a.y AS ay, a.f AS af, b.x AS bx, b.y AS b_y, b.f AS bf, c.x AS cx, c.y AS cy, c.f AS cf, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn FROM n a JOIN n b ON a.walker = b.walker AND b.k > a.k JOIN n c ON c.walker = a.walker AND c.k > b.k),
d AS MATERIALIZED (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.walker = t.walker AND n.k NOT IN (ka, kb, kc) AND sign(turn) * ((pow(ax - x, 2) + pow(ay - y, 2)) * ((bx - x) * (cy - y) - (b_y - y) * (cx - x)) - (pow(bx - x, 2) + pow(b_y - y, 2)) * ((ax - x) * (cy - y) - (ay - y) * (cx - x)) + (pow(cx - x, 2) + pow(cy - y, 2)) * ((ax - x) * (b_y - y) - (ay - y) * (bx - x))) > 0)),
q AS (SELECT p.walker, row, ((b_y - cy) * (x - cx) + (cx - bx) * (y - cy)) / ((b_y - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS u, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / ((b_y - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS v, af, bf, cf FROM {FRAMES} p JOIN d ON d.walker = p.walker)
SELECT p.walker, p.row, {r("f", "f")} FROM {FRAMES} p LEFT JOIN (SELECT walker, row, min(u * af + v * bf + (1 - u - v) * cf) AS f FROM q WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9 GROUP BY 1, 2) m ON m.walker = p.walker AND m.row = p.row""",
    "resampled_curves": f"""WITH {_S}, c AS (SELECT snap, (k + 0.5::DOUBLE) * {AX.step}::DOUBLE AS x, f FROM s WHERE (k + 0.5::DOUBLE) * {AX.step}::DOUBLE BETWEEN 20 AND 320),
e AS (SELECT snap FROM c GROUP BY 1 HAVING count(*) >= 4), g AS (SELECT snap, x AS a, f AS fa, lead(x) OVER (PARTITION BY snap ORDER BY x) AS b, lead(f) OVER (PARTITION BY snap ORDER BY x) AS fb FROM c),
p AS (SELECT snap, k::INTEGER AS k, 20.0::DOUBLE + k * {300.0 / 299!r}::DOUBLE AS x FROM e, range(300) r(k))
SELECT p.snap, p.k, {r("CASE WHEN b IS NULL THEN fa ELSE fa + (fb - fa) * (x - a) / (b - a) END", "f")} FROM p LEFT JOIN g ON g.snap = p.snap AND x >= a AND (x < b OR (b IS NULL AND x = a))""",
    "sampled_cells": f"""WITH c AS (SELECT {Axis(GX.lo - GX.step / 2, GX.hi + GX.step / 2, GX.n + 1).sql("x")} AS i, {Axis(GY.lo - GY.step / 2, GY.hi + GY.step / 2, GY.n + 1).sql("y")} AS j FROM {FRAMES})
SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, coalesce(n, 0) AS n, coalesce(n, 0) >= 5 AS sampled FROM range({GX.n + 1}) a(i), range({GY.n + 1}) b(j) LEFT JOIN (SELECT i, j, count(*) AS n FROM c GROUP BY 1, 2) c ON c.i = a.i AND c.j = b.j""",
    "swapped_surface": f"""WITH RECURSIVE g AS (SELECT * FROM {_VGRID}), ok AS (SELECT * FROM g WHERE std <= 1.6 AND n >= 5),
reach AS (SELECT i, j FROM (SELECT i, j FROM ok ORDER BY mean, i, j LIMIT 1) UNION SELECT ok.i, ok.j FROM reach JOIN ok ON abs(ok.i - reach.i) + abs(ok.j - reach.j) = 1)
SELECT g.j AS i, g.i AS j, (g.j + 0.5::DOUBLE) * {GY.step}::DOUBLE AS cv1, (g.i + 0.5::DOUBLE) * {GX.step}::DOUBLE AS cv2, CASE WHEN reach.i IS NOT NULL THEN round(g.mean - (SELECT min(mean) FROM g JOIN reach USING (i, j)), 6) END AS f FROM g LEFT JOIN reach ON g.i = reach.i AND g.j = reach.j""",
    "region_without_good_cells": f"SELECT true AS reliable, count(*) AS count FROM {_WGRID}",
    "hill_count_cuts": f"""SELECT (row_number() OVER (ORDER BY p) - 1)::INTEGER AS snap, p AS hills, round(t, 6) AS t_cut FROM (SELECT t, row_number() OVER (ORDER BY t, row) AS p, count(*) OVER () AS n FROM {FRAMES} WHERE kind = 'purchase') WHERE p % greatest(1, n // 7) = 0 OR p = n""",
    "snapshot_cut_offs": f"""WITH e AS (SELECT walker, min(t) AS a, max(t) AS b FROM {FRAMES} GROUP BY 1) SELECT walker, kind, k::INTEGER AS snap,
round(CASE kind WHEN 'fixed' THEN b / 6 + (b - b / 6) * k / 5 WHEN 'converged' THEN b / 6 + (b - b / 6) * (k + 1) / 6 ELSE a + (b - a) * (k + 1) / 6 END, 6) AS t_cut FROM e, range(6) r(k), (VALUES ('fixed'), ('converged'), ('after')) v(kind)""",
    "basins_below": f"WITH RECURSIVE {_DRAINS} SELECT label, mi AS i, mj AS j, fmin, count(*) FILTER (WHERE f < fmin + 2) AS ncells FROM l WHERE label > 0 GROUP BY ALL",
    "basin_segments": _merged(1.0),
    "basin_segments_low": _merged(0.2),
    "shoulder_cells": f"WITH RECURSIVE {_DRAINS} SELECT i, j, CASE WHEN i BETWEEN 2 AND 4 AND j BETWEEN 3 AND 8 THEN 99 ELSE label END AS label, i BETWEEN 2 AND 4 AND j BETWEEN 3 AND 8 AS shoulder FROM l",
    "assigned_frames": f"WITH RECURSIVE {_DRAINS} SELECT row, label FROM (SELECT row, {GX.sql('x')} AS i, {GY.sql('y')} AS j FROM {FRAMES}) p JOIN l USING (i, j) WHERE label > 0 AND f < fmin + 2",
    "snapshot_mean_std": f"WITH {_S} SELECT k, {r('mean - min(mean) OVER ()', 'mean')}, {r('std', 'std')}, n FROM (SELECT k, avg(f) AS mean, stddev_pop(f) AS std, count(f) AS n FROM s GROUP BY k)",
    "snapshot_mad": f"WITH {_S}, {_MAD} SELECT snap, {r('mad', 'mad')} FROM m",
    "fes_drift": f"WITH {_S} SELECT s.snap, {r('avg(abs(s.f - l.f))', 'drift')} FROM s JOIN s l ON l.snap = 4 AND l.k = s.k AND l.f < 12 GROUP BY 1",
    "mad_trend": f"WITH {_S}, {_MAD} SELECT count(*) FILTER (WHERE d > 0) AS rises, count(*) FILTER (WHERE d > 0) = 0 AS monotonic FROM (SELECT round(mad, 6) - lag(round(mad, 6)) OVER (ORDER BY snap) AS d FROM m)",
    "final_bias_weights": f"SELECT row, {r('coalesce(exp(e - max(e) OVER ()), 0)', 'wf', 9)} FROM (SELECT row, CASE WHEN y > 5 THEN -{1 - 1 / GAMMA}::DOUBLE * (y / 10) / {KBT}::DOUBLE END AS e FROM {FRAMES})",
    "gate_mad": f"SELECT *, coalesce(mad <= 2.99, false) AS passed FROM (SELECT {r('avg(abs(b.f - a.f))', 'mad')}, count(*) AS n FROM {_fes('walker < 3')} b JOIN {_fes()} a USING (k) WHERE a.n >= 200 AND a.f <= 30)",
    "hills_kernel_sum_1d": f"SELECT k, {r('f - min(f) OVER ()', 'f')} FROM (SELECT g.k::INTEGER AS k, -sum({_BUMP}) AS f FROM {_HSQL}, range({HX.n + 1}) g(k) WHERE {_REACH} GROUP BY 1)",
    "ct_weights_bucketed": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT k, greatest(1, ceil(t / {BATCH}))::INTEGER AS b, sum({_BUMP}) AS g FROM {_HSQL}, range({HX.n + 1}) gk(k) WHERE {_REACH} GROUP BY 1, 2),
h AS (SELECT k, b, sum(g) OVER (PARTITION BY k ORDER BY b) AS v FROM d),
f AS (SELECT row, (floor(t / {BATCH}) + 1)::INTEGER AS b, least(greatest(x / {HX.step}::DOUBLE, 0), {HX.n}) AS p FROM {FRAMES} WHERE kind <> 'purchase'),
q AS (SELECT row, b, least(floor(p), {HX.n - 1})::INTEGER AS k, 1 - (p - least(floor(p), {HX.n - 1})) AS part FROM f UNION ALL SELECT row, b, least(floor(p), {HX.n - 1})::INTEGER + 1, p - least(floor(p), {HX.n - 1}) FROM f),
v AS (SELECT row, sum(part * coalesce(v, 0)) AS v FROM q ASOF LEFT JOIN h ON q.k = h.k AND q.b >= h.b GROUP BY 1),
mk AS (SELECT min(b) AS b FROM d UNION ALL SELECT min(d.b) FROM mk JOIN d ON d.b >= mk.b + {round(CHECK / BATCH)} GROUP BY mk.b),
z AS (SELECT y.b, coalesce(v, 0) AS v FROM (SELECT mk.b, gk.k FROM mk, range({HX.n + 1}) gk(k)) y ASOF LEFT JOIN h ON y.k = h.k AND y.b >= h.b),
c AS (SELECT b, 50.0::DOUBLE * (ln(sum(exp({GAMMA / (GAMMA - 1) / 50.0!r}::DOUBLE * v))) - ln(sum(exp({1 / (GAMMA - 1) / 50.0!r}::DOUBLE * v)))) AS c FROM z GROUP BY 1),
o AS (SELECT f.row, v.v, coalesce(c.c, 0) AS c FROM f JOIN v ON f.row = v.row ASOF LEFT JOIN c ON f.b >= c.b)
SELECT row, {r("v", "v")}, {r("c", "c")}, {r("exp((v - c - max(v - c) OVER ()) / 50.0::DOUBLE)", "w")} FROM o""",
    "nearest_cell": f"SELECT row, CASE WHEN k BETWEEN 0 AND 79 THEN k ELSE -1 END AS cell FROM (SELECT row, round_even((x - 2.5::DOUBLE) / 5.0::DOUBLE, 0)::INTEGER AS k FROM {FRAMES})",
    "interp_clamp": f"SELECT row, {r(f'CASE WHEN x < lx THEN lf WHEN x > hx THEN hf ELSE {_LERP} END', 'f')} FROM {FRAMES} LEFT JOIN {_SEG} ON x >= a AND (x < b OR (b IS NULL AND x = a)), (SELECT min(cx) AS lx, min_by(cf, cx) AS lf, max(cx) AS hx, max_by(cf, cx) AS hf FROM {_CURVE})",
    "interp_null": f"SELECT row, {r(_LERP, 'f')} FROM {FRAMES} LEFT JOIN {_SEG} ON x >= a AND (x < b OR (b IS NULL AND x = a))",
    "bilinear_frames": f"""WITH p AS (SELECT row, least(greatest(x / {GX.step}::DOUBLE, 0), {GX.n}) AS u, least(greatest(y / {GY.step}::DOUBLE, 0), {GY.n}) AS v FROM {FRAMES}), q AS (SELECT *, least(floor(u), {GX.n - 1}) AS i, least(floor(v), {GY.n - 1}) AS j FROM p)
SELECT row, {r("(1 - (u - i)) * (1 - (v - j)) * (i * j / 7.0::DOUBLE + i) + (1 - (u - i)) * (v - j) * (i * (j + 1) / 7.0::DOUBLE + i) + (u - i) * (1 - (v - j)) * ((i + 1) * j / 7.0::DOUBLE + i + 1) + (u - i) * (v - j) * ((i + 1) * (j + 1) / 7.0::DOUBLE + i + 1)", "f")} FROM q""",
    "smooth_grid": f"""WITH c AS (SELECT g.k::INTEGER AS k, coalesce(n, 0)::DOUBLE AS f FROM range({AX.n}) g(k) LEFT JOIN (SELECT {AX.sql("x")} AS k, count(*) AS n FROM {FRAMES} GROUP BY 1) h ON g.k = h.k),
w AS (SELECT d, exp(-0.5::DOUBLE * pow(d / 1.5::DOUBLE, 2)) / (SELECT sum(exp(-0.5::DOUBLE * pow(e / 1.5::DOUBLE, 2))) FROM range(-6, 7) r(e)) AS w FROM range(-6, 7) r(d))
SELECT a.k, {r("sum(w * b.f)", "f")} FROM c a, w JOIN c b ON b.k = least(greatest(a.k + d, 0), {AX.n - 1}) GROUP BY 1""",
    "reliable_region2d": f"""WITH RECURSIVE g AS (SELECT * FROM {_WGRID}), ok AS (SELECT * FROM g WHERE std <= 1.6),
reach AS (SELECT i, j FROM (SELECT i, j FROM ok ORDER BY mean, i, j LIMIT 1) UNION SELECT ok.i, ok.j FROM reach JOIN ok ON abs(ok.i - reach.i) + abs(ok.j - reach.j) = 1)
SELECT g.i, g.j, reach.i IS NOT NULL AS reliable FROM g LEFT JOIN reach ON g.i = reach.i AND g.j = reach.j""",
    "watershed_labels": f"""WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {_GRID}),
n AS MATERIALIZED (SELECT a.i, a.j, b.i AS ti, b.j AS tj FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND b.f < a.f QUALIFY row_number() OVER (PARTITION BY a.i, a.j ORDER BY b.f, b.i, b.j) = 1),
w AS (SELECT i, j, i AS ti, j AS tj FROM g UNION SELECT w.i, w.j, n.ti, n.tj FROM w JOIN n ON w.ti = n.i AND w.tj = n.j),
e AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.i = w.ti AND n.j = w.tj)),
m AS (SELECT g.i, g.j, row_number() OVER (ORDER BY f, g.i, g.j) AS label FROM g WHERE f < 9 AND NOT EXISTS (SELECT 1 FROM n WHERE n.i = g.i AND n.j = g.j))
SELECT e.i, e.j, coalesce(label, 0)::INTEGER AS label FROM e LEFT JOIN m ON m.i = e.ti AND m.j = e.tj""",
    "snapshot_bundle": f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(CUTS))}) c(snap, cut)),
v AS (SELECT snap, gk.k, -sum({_BUMP}) AS f FROM {_HSQL} h JOIN c ON h.t <= c.cut, range({HX.n + 1}) gk(k) WHERE {_REACH} GROUP BY 1, 2),
d AS (SELECT c.snap, gk.k::INTEGER AS k, coalesce(f, 0) AS f FROM c CROSS JOIN range({HX.n + 1}) gk(k) LEFT JOIN v ON v.snap = c.snap AND v.k = gk.k),
z AS (SELECT snap, k, f - min(f) OVER (PARTITION BY snap) AS f, lead(f) OVER (PARTITION BY snap ORDER BY k) - min(f) OVER (PARTITION BY snap) AS g FROM d),
f AS (SELECT t, x, y, least(greatest(x / {HX.step}::DOUBLE, 0), {HX.n}) AS p FROM {FRAMES} WHERE kind <> 'purchase'),
e AS (SELECT c.snap, x, y, -{1 - 1 / GAMMA}::DOUBLE * (z.f + (z.g - z.f) * (p - z.k)) / 50.0::DOUBLE AS e FROM f JOIN c ON f.t <= c.cut JOIN z ON z.snap = c.snap AND z.k = least(floor(p), {HX.n - 1})),
w AS (SELECT *, exp(e - max(e) OVER (PARTITION BY snap)) AS w FROM e),
b AS (SELECT snap, 'x' AS view, {AX.sql("x")} AS k, w FROM w UNION ALL SELECT snap, 'y', {AY.sql("y")}, w FROM w UNION ALL SELECT snap, 'xy', {AX.sql("x")} * {AY.n} + {AY.sql("y")}, w FROM w),
q AS (SELECT snap, view, k, -50.0::DOUBLE * ln(sum(w)) AS f FROM b WHERE k IS NOT NULL GROUP BY ALL),
m AS (SELECT view, k, avg(f) AS mean, stddev_pop(f) AS std, count(*) AS n FROM (SELECT view, k, f - min(f) OVER (PARTITION BY snap, view) AS f FROM q) GROUP BY ALL)
SELECT view, k, {r("mean - min(mean) OVER (PARTITION BY view)", "mean")}, {r("std", "std")}, n FROM m""",
    "pooled_widths": f"SELECT {r('median(x)', 'x')}, {r('median(y)', 'y')}, {r('median(t)', 't')} FROM {FRAMES}",
    "minimum_drift": f"WITH {_S} SELECT max(m) - min(m) AS drift FROM (SELECT snap, arg_min(k, (round(f, 6), k)) AS m FROM s WHERE snap > 2 * 4 / 3.0 GROUP BY snap)",
    "extended_grid": f"""WITH g AS (SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, f FROM range({GX.n}) a(i), range({GY.n}) b(j) LEFT JOIN {_GRID} h ON h.i = a.i AND h.j = b.j)
SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, f FROM range(-1, {GX.n + 1}) a(i), range(-1, {GY.n + 1}) b(j) JOIN g ON g.i = least(greatest(a.i, 0), {GX.n - 1}) AND g.j = least(greatest(b.j, 0), {GY.n - 1})""",
    "masked_smooth": f"""WITH g AS (SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, f FROM range({GX.n}) a(i), range({GY.n}) b(j) LEFT JOIN {_GRID} h ON h.i = a.i AND h.j = b.j),
w AS (SELECT d, exp(-0.5::DOUBLE * d * d) AS w FROM range(-4, 5) r(d))
SELECT a.i, a.j, {r("CASE WHEN any_value(a.f) IS NOT NULL THEN sum(u.w * v.w * coalesce(b.f, 0)) / sum(u.w * v.w * (b.f IS NOT NULL)::INTEGER) END", "f")}
FROM g a, w u, w v JOIN g b ON b.i = least(greatest(a.i + u.d, 0), {GX.n - 1}) AND b.j = least(greatest(a.j + v.d, 0), {GY.n - 1}) GROUP BY 1, 2""",
    "visited_region": f"""WITH RECURSIVE g AS (SELECT * FROM {_VGRID}), ok AS (SELECT * FROM g WHERE std <= 1.6 AND n >= 5 AND walkers >= 4),
reach AS (SELECT i, j FROM (SELECT i, j FROM ok ORDER BY mean, i, j LIMIT 1) UNION SELECT ok.i, ok.j FROM reach JOIN ok ON abs(ok.i - reach.i) + abs(ok.j - reach.j) = 1)
SELECT g.i, g.j, CASE WHEN reach.i IS NOT NULL THEN {r("g.mean - (SELECT min(mean) FROM g JOIN reach USING (i, j))", "x").removesuffix(" AS x")} END AS mean, reach.i IS NOT NULL AS reliable FROM g LEFT JOIN reach ON g.i = reach.i AND g.j = reach.j""",
}
ORACLES["reliable_region2d_rounds"] = ORACLES["reliable_region2d"]
