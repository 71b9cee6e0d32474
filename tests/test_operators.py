"""Micro fixtures with results worked out by hand or by numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fjordframe.functions.binning import Axis
from fjordframe.operators import basins, ensembles, grid, hist, ordering, reweight, runs, selection, structure
from fjordframe.operators.thermo import folded_fraction, fraction_spread
from fjordframe.plans.thermo_queries import GAS_CONSTANT, TEMPERATURES, scenario_rows


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("lo,hi,n", [(0.0, 1.0, 10), (0.3, 1.0, 100), (2.4, 6.0, 80), (0.0, 180.0, 90), (-1.0, 2.0, 7)])
def test_bins_match_numpy(spark, lo, hi, n):
    edges = np.linspace(lo, hi, n + 1)
    x = np.concatenate([edges, np.nextafter(edges, -np.inf), np.nextafter(edges, np.inf), [lo - 1, hi + 1, 0.3]])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).select(Axis(lo, hi, n).index(F.col("x")).alias("k")).where("k IS NOT NULL").groupBy("k").count()
    got = np.zeros(n, int)
    for k, c in values(df, "k", "count"):
        got[k] = c
    assert (got == np.histogram(x, bins=n, range=(lo, hi))[0]).all()


def test_spread_has_the_known_peaks(spark):
    degrees = spark.range(TEMPERATURES[0], TEMPERATURES[1] + 1).selectExpr("CAST(id AS DOUBLE) AS t")
    spread = fraction_spread(folded_fraction(spark.sql(f"SELECT * FROM {scenario_rows()}"), degrees, GAS_CONSTANT))
    peaks = spread.groupBy("scenario").agg(F.max(F.struct("pf_std", "t")).alias("m")).orderBy("scenario")
    want = [(0.29033, 325), (0.17126, 328), (0.18965, 307), (0.31558, 305), (0.26936, 305)]
    for (std, t), (w, wt) in zip(values(peaks, "m.pf_std", "m.t"), want, strict=True):
        assert std == pytest.approx(w, abs=5e-6) and t == wt


def test_free_energy_ignores_the_scale_of_weights(spark):
    f = spark.createDataFrame([(0.1, 1.0), (0.2, 2.0), (0.9, 0.5)], "x double, w double")
    a, b = (values(hist.fes_1d(f, F.col("x"), F.col("w") * s, Axis(0, 1, 4), 2.5).orderBy("k"), "f") for s in (1, 7))
    assert [x[0] for x in a] == pytest.approx([x[0] for x in b], nan_ok=True) if None not in [x[0] for x in a] else [x[0] is None for x in a] == [x[0] is None for x in b]
    assert min(x[0] for x in a if x[0] is not None) == 0 and len(a) == 4


def test_round_trips(spark):
    s = spark.createDataFrame([(1, t, x) for t, x in enumerate([0.0, 0.5, 1.0, 0.5, 0.0, 1.0])], "w int, t int, x double")
    assert values(runs.round_trips(s, ["w"], "t", F.col("x"), 0.1, 0.9), "switches", "trips") == [(3, 1)]


def test_reliable_run_with_a_gap_and_without_any(spark):
    p = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 0.0), (3, None), (4, 1.0)], "k int, f double")
    got = values(runs.reliable_run(p, "k", "f", F.col("f") <= 2).orderBy("k"), "reliable")
    assert [g[0] for g in got] == [False, True, True, False, False]
    none = values(runs.reliable_run(p, "k", "f", F.col("f") < -1).orderBy("k"), "reliable")
    assert [g[0] for g in none] == [True, True, True, False, True]


def test_longest_run_and_blocks(spark):
    s = spark.createDataFrame([(1, float(t), x) for t, x in enumerate([1, 0, 0, 0, 1, 0, 0])], "w int, t double, x int")
    assert values(runs.longest_run(s, ["w"], "t", F.col("x") == 0), "rows", "time") == [(3, 3.0)]
    assert values(runs.count_blocks(s, ["w"], "t", F.col("t"), 3).orderBy("block"), "mean") == [(0.5,), (2.5,), (4.5,)]


def test_keep_last_and_lookup(spark):
    s = spark.createDataFrame([(1, 0.10, 0, 1.0), (1, 0.12, 1, 2.0), (1, 0.30, 2, 3.0)], "w int, t double, o int, v double")
    assert values(runs.keep_last(s, ["w"], F.round("t", 1), "o").orderBy("o"), "v") == [(2.0,), (3.0,)]
    f = spark.createDataFrame([(1, 0.1), (1, 0.9)], "w int, t double")
    left = selection.lookup_last(f, s, ["w"], "t", "o", 1, "left")
    assert sorted(values(left, "t", "v")) == [(0.1, 2.0), (0.9, None)]
    with pytest.raises(ValueError):
        selection.matched_enough(f, left, F.col("v").isNotNull())


@pytest.mark.parametrize("size", [3, 1_000_000])
def test_orders_over_slices(spark, monkeypatch, size):
    monkeypatch.setattr(ordering, "ROWS", size)
    x = [5.0, 1.0, 1.0, 3.0, 9.0, 9.0, 9.0, 2.0] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x double")
    got = dict(values(ordering.average_ranks(df, "x", "r"), "id", "r"))
    want = pd.Series(x).rank()
    assert [got[i] for i in range(len(x))] == list(want)
    placed = ordering.row_index(df, "x", "p", "id")
    means = dict(values(ordering.running_mean(placed, "p", "x", 6, "m"), "p", "m"))
    y = np.sort(x)
    assert means == {i + 4: pytest.approx(y[i : i + 6].mean()) for i in range(len(x) - 5)}


def test_snapshots_mean_and_gate(spark):
    f = spark.createDataFrame([(float(t), (t * 37 % 10) / 10, 1.0) for t in range(1, 101)], "t double, x double, w double")
    s = ensembles.snapshot_surfaces(f, F.col("t"), F.col("x"), F.col("w"), Axis(0, 1, 5), ensembles.fixed_cuts(100.0, 4), 2.5)
    assert s.agg(F.max("snap")).first()[0] == 3
    assert {r[0] for r in values(ensembles.mean_and_deviation(s, ["k"]), "n")} == {4}
    last = s.where("snap = 3").select("k", "f")
    passed = ensembles.gate(last, last, ["k"], None, 0, 99.0, 0.1)
    assert values(passed, "mad", "n", "passed") == [(0.0, 5, True)]
    with pytest.raises(ValueError):
        ensembles.enforced(ensembles.gate(last.withColumn("f", F.col("f") + F.col("k")), last, ["k"], None, 0, 99.0, 0.1), "raise")


def sequential_weights(hills, frames, axes, gamma, kbt, batch, check):
    """V and c of each frame by the loop over batch edges: hills up to an edge, then c on its schedule, then the frames before it."""
    points = [a.lo + a.step * np.arange(a.n + 1) for a in axes]
    v, c, next_check = np.zeros([a.n + 1 for a in axes]), 0.0, -1.0
    lse = lambda e: np.log(np.exp(e - e.max()).sum()) + e.max()

    def read(x):
        out = v
        for p, at in reversed(list(zip(points, x, strict=True))):
            out = np.apply_along_axis(lambda line: np.interp(at, p, line), -1, out)  # noqa: B023
        return float(out)

    hills, todo, want = sorted(hills, key=lambda h: h[0]), sorted(frames, key=lambda f: f[1]), {}
    end = max(hills[-1][0], todo[-1][1])
    for tb in np.arange(batch, end + batch, batch):
        added = False
        while hills and hills[0][0] <= tb:
            _, centre, sigma, height = hills.pop(0)
            bumps = []
            for a, p, m, s in zip(axes, points, centre, sigma, strict=True):
                near = abs(np.arange(a.n + 1) - np.rint((m - a.lo) / a.step)) <= np.ceil(4 * s / a.step)
                bumps.append(near * np.exp(-((p - m) ** 2) / (2 * s * s)))
            v = v + height * (bumps[0] if len(bumps) == 1 else np.multiply.outer(bumps[0], bumps[1]))
            added = True
        if added and tb >= next_check:
            c, next_check = kbt * (lse(gamma / (gamma - 1) / kbt * v) - lse(v / (gamma - 1) / kbt)), tb + check
        while todo and todo[0][1] < tb:
            i, _, x = todo.pop(0)
            want[i] = read(x), c
    return want | {i: (read(x), c) for i, _, x in todo}


@pytest.mark.parametrize("dimensions", [1, 2])
@pytest.mark.parametrize("batch,check", [(1.0, 2.0), (0.5, 1.25), (2.0, 2.0)])
def test_time_dependent_weights_by_the_sequential_rule(spark, dimensions, batch, check):
    """Frames before the first hill, on edges, and long after the last hill and the last checkpoint."""
    axes, kbt, gamma = [Axis(0.0, 10.0, 20), Axis(-1.0, 3.0, 8)][:dimensions], 2.5, 10.0
    rng = np.random.default_rng(3)
    spot = lambda: [float(rng.uniform(a.lo - 0.5, a.hi + 0.5)) for a in axes]
    hills = [(float(t), spot(), [0.7, 0.4][:dimensions], 0.4) for t in [*np.arange(2.5, 5, 0.5), 7.5, 7.5]]
    frames = [(i, float(t), spot()) for i, t in enumerate([*np.arange(0.05, 10, 0.3), 3.0, 4.0, 8.2, 9.5, 12, 30])]
    want = sequential_weights(hills, frames, axes, gamma, kbt, batch, check)
    d, h = spark.createDataFrame(frames, "id int, t double, x array<double>"), spark.createDataFrame(hills, "t double, centre array<double>, sigma array<double>, height double")
    axis = axes
    if dimensions == 1:
        axis, d, h = axes[0], d.withColumn("x", F.col("x")[0]), h.withColumn("centre", F.col("centre")[0]).withColumn("sigma", F.col("sigma")[0])
    out = values(reweight.time_dependent_weights(d, h, axis, gamma, kbt, batch, check), "id", "v", "c", "w")
    top = max(v - c for v, c in want.values())
    assert len(out) == len(frames) and {i: (pytest.approx(v), pytest.approx(c)) for i, v, c, _ in out} == want
    assert all(w == pytest.approx(np.exp((want[i][0] - want[i][1] - top) / kbt)) for i, _, _, w in out)
    none = reweight.time_dependent_weights(d, h.limit(0), axis, gamma, kbt, batch, check)
    assert {r for r in values(none, "v", "c", "w")} == {(0.0, 0.0, 1.0)}


def test_hills_in_two_dimensions(spark):
    axes, kbt, gamma = [Axis(0.0, 6.0, 12), Axis(-1.0, 3.0, 8)], 2.5, 10.0
    rng = np.random.default_rng(5)
    hills = [(t + 0.5, [float(rng.uniform(1, 5)), float(rng.uniform(0, 2))], [0.6, 0.4], 0.5) for t in range(2, 9)]
    frames = [(i, float(t), [float(rng.uniform(-0.5, 6.5)), float(rng.uniform(-1, 3))]) for i, t in enumerate(np.arange(0.1, 8, 0.4))]
    p, q = (a.lo + a.step * np.arange(a.n + 1) for a in axes)

    def field(last):
        v = np.zeros((13, 9))
        for t, c, s, h in hills:
            if t <= last:
                near = [abs(np.arange(a.n + 1) - np.rint((m - a.lo) / a.step)) <= np.ceil(4 * w / a.step) for a, m, w in zip(axes, c, s, strict=True)]
                v += h * np.outer(near[0] * np.exp(-((p - c[0]) ** 2) / (2 * s[0] ** 2)), near[1] * np.exp(-((q - c[1]) ** 2) / (2 * s[1] ** 2)))
        return v

    def read(v, x):
        return np.interp(x[1], q, [np.interp(x[0], p, v[:, j]) for j in range(9)])

    d, h = spark.createDataFrame(frames, "id int, t double, x array<double>"), spark.createDataFrame(hills, "t double, centre array<double>, sigma array<double>, height double")
    surface = dict(values(reweight.hill_surface(h, F.col("centre"), F.col("sigma"), F.col("height"), axes), "k", "f"))
    want = -field(99)
    assert all(f == pytest.approx((want - want.min()).flat[k]) for k, f in surface.items())
    got = values(reweight.snapshot_weights(d, h, axes, [4.0, 8.0], gamma, kbt), "id", "snap", "f")
    assert len(got) == sum(1 + (t <= 4) for _, t, _ in frames)
    for i, snap, f in got:
        v = -field([4.0, 8.0][snap])
        assert f == pytest.approx(read(v - v.min(), frames[i][2]))


def surface(spark):
    x, y = np.meshgrid(np.arange(9), np.arange(9), indexing="ij")
    f = np.minimum((x - 2) ** 2 + (y - 2) ** 2, 1.5 + (x - 6) ** 2 + (y - 6) ** 2).astype(float)
    return spark.createDataFrame([(int(i), int(j), float(f[i, j])) for i in range(9) for j in range(9)], "i int, j int, f double")


def test_watershed_and_merging(spark):
    w = basins.watershed(surface(spark), 5.0)
    labels = {(i, j): k for i, j, k in values(w, "i", "j", "label")}
    assert labels[2, 2] == labels[0, 0] == 1 and labels[6, 6] == labels[8, 8] == 2 and len(labels) == 81
    counts = [basins.segmented(surface(spark), 5.0, b).where("label > 0").select("label").distinct().count() for b in (0.0, 2.0, 99.0)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 2 and counts[-1] == 1
    table = basins.basin_table(w, 1.1)
    assert sorted(values(table, "label", "i", "j", "ncells")) == [(1, 2, 2, 5), (2, 6, 6, 5)]


def test_component_region_and_smoothing(spark):
    g = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 1.0, 1.0), (1, 1, 2.0, 1.0), (3, 3, 0.5, 0.1), (2, 2, 0.5, 9.0)], "i int, j int, m double, s double")
    got = {(i, j) for i, j, r in values(grid.reliable_region(g, "m", F.col("s") <= 2), "i", "j", "reliable") if r}
    assert got == {(0, 0), (0, 1), (1, 1)}
    seed = g.where("m = 0")
    assert {tuple(r) for r in grid.component_of(g, seed, small=0).collect()} == {tuple(r) for r in grid.component_of(g, seed).collect()} == {(0, 0), (0, 1), (1, 1)}
    line = spark.createDataFrame([(k, 1.0) for k in range(6)], "i int, f double")
    assert [v[0] for v in values(grid.gaussian_smoothed(line, "i", [], "f", 6, 1.0), "f")] == pytest.approx([1.0] * 6)
    holes = spark.createDataFrame([(i, j, 2.0 if (i, j) != (1, 1) else None) for i in range(3) for j in range(3)], "i int, j int, f double")
    smooth = {(i, j): f for i, j, f in values(grid.masked_smoothed(holes, "f", (3, 3), (1.0, 1.0)), "i", "j", "f")}
    assert smooth[1, 1] is None and smooth[0, 0] == pytest.approx(2.0)
    assert grid.extended(holes, (3, 3)).count() == 25


def test_half_even_cells(spark):
    x = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.6,), (9.0,)], "x double")
    assert [v[0] for v in values(x.select(grid.nearest_cell(F.col("x"), 0, 1, 5).alias("k")), "k")] == [0, 2, 2, -1, -1]


def test_interpolation_outside(spark):
    c = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "cx double, cf double")
    rough = spark.createDataFrame([(0.0, 1.0), (0.01, 5.0), (0.02, None), (7.0, 2.0), (9.0, 4.0), (100.0, 0.0)], "cx double, cf double")
    at = [0.0, 0.005, 0.01, 3.0, 7.0, 8.0, 50.5, 100.0, 100.5]
    spots = spark.createDataFrame([(v,) for v in at], "x double")
    want = np.interp(at, [0, 0.01, 7, 9, 100], [1, 5, 2, 4, 0], right=np.nan)
    got = [v[0] for v in values(grid.interpolated(spots, "x", rough, "cx", "cf", "f").orderBy("x"), "f")]
    assert got[-1] is None and got[:-1] == pytest.approx(list(want[:-1]))
    p = spark.createDataFrame([(-1.0,), (0.25,), (1.0,), (2.0,)], "x double")
    assert [v[0] for v in values(grid.interpolated(p, "x", c, "cx", "cf", "f", "clamp").orderBy("x"), "f")] == [1.0, 1.5, 3.0, 3.0]
    assert [v[0] for v in values(grid.interpolated(p, "x", c, "cx", "cf", "f").orderBy("x"), "f")] == [None, 1.5, 3.0, None]


def test_pairs_near_and_far(spark):
    rng = np.random.default_rng(0)
    xyz = rng.uniform(0, 3, (60, 3))
    p = spark.createDataFrame([(i, i // 3, *map(float, v)) for i, v in enumerate(xyz)], "k int, res int, x double, y double, z double")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if abs(a // 3 - b // 3) >= 4 and np.linalg.norm(xyz[a] - xyz[b]) < 0.7}
    assert set(values(selection.nearby_pairs(p, "k", "res", ("x", "y", "z"), 0.7, 4), "a", "b")) == want


def test_superposition_and_axes(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=(12, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved = ref @ q + 3
    reference = pd.DataFrame({"atom": range(12), "x": ref[:, 0], "y": ref[:, 1], "z": ref[:, 2]})
    rows = [(0, i, *map(float, v)) for i, v in enumerate(moved)]
    out = structure.superposed(spark.createDataFrame(rows, "frame long, atom int, x double, y double, z double"), reference).toPandas().sort_values("atom")
    assert out["rmsd"].max() < 1e-9 and np.allclose(out[["x", "y", "z"]].to_numpy(), ref)
    line = [(0, i, float(i), 0.0, 0.0) for i in range(4)] + [(0, 10 + i, 0.0, float(i), 0.0) for i in range(4)]
    angle = structure.axis_angle(spark.createDataFrame(line, "frame long, atom int, x double, y double, z double"), [0, 1, 2, 3], [10, 11, 12, 13])
    assert angle.first()["angle"] == pytest.approx(90)


def test_contact_fraction_of_the_reference_is_near_one(spark):
    c = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(5)], "frame int, atom int, x double, y double, z double")
    contacts = spark.createDataFrame([(0, 4, 4.2, 0.5), (1, 3, 2.2, 0.5)], "a int, b int, ref double, weight double")
    assert structure.native_fraction(c, contacts).first()["q"] > 0.999
    assert structure.contact_map_value(c, contacts).first()["cmap"] > 0.999


def test_sampling_is_repeatable_and_without_replacement(spark):
    c = spark.range(100).select((F.col("id") % 2).alias("basin"), "id", (F.col("id") + 1.0).alias("w"))
    a, b = (sorted(values(selection.boltzmann_sample(c, "basin", "id", F.col("w"), 5, 42), "basin", "id")) for _ in range(2))
    assert a == b and len(set(a)) == 10


@pytest.mark.parametrize("size", [7, 1_000_000])
def test_long_series_are_ordered_in_slices(spark, monkeypatch, size):
    """Few series, null names among them: sums, lags, runs and trips carry over the slices' ends."""
    monkeypatch.setattr(ordering, "ROWS", size)
    rng = np.random.default_rng(6)
    rows = [(w, float(t), float(rng.integers(0, 10))) for w in ("a", None) for t in rng.permutation(200)] + [("b", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "w string, t double, x double")
    by = {w: sorted((t, x) for v, t, x in rows if v == w) for w in ("a", None, "b")}
    total = {(w, t): s for w, t, s in values(ordering.running_total(df, "t", "x", "s", by=["w"]), "w", "t", "s")}
    before = {(w, t): s for w, t, s in values(ordering.lagged(df, "t", "x", "s", ["w"]), "w", "t", "s")}
    for w, series in by.items():
        x = [v for _, v in series]
        assert [total[w, t] for t, _ in series] == list(np.cumsum(x)) and [before[w, t] for t, _ in series] == [None, *x[:-1]]
    runs_of = {w: (n, time) for w, n, time in values(runs.longest_run(df, ["w"], "t", F.col("x") < 7), "w", "rows", "time")}
    trips = {w: n for w, n in values(runs.round_trips(df, ["w"], "t", F.col("x"), 2, 7), "w", "switches")}
    back = {w: n for w, n in values(runs.backward_steps(df, ["w"], "t", "x"), "w", "backward")}
    for w, series in by.items():
        x = [v for _, v in series]
        longest = max(map(len, "".join("1" if v < 7 else " " for v in x).split()), default=0)
        state = [s for s in (-1 if v <= 2 else 1 if v >= 7 else 0 for v in x) if s]
        assert runs_of[w] == (longest, longest * 1.0 if len(x) > 1 else None)
        assert trips[w] == sum(a != b for a, b in zip(state, state[1:], strict=False)) and back[w] == sum(b <= a for a, b in zip(x, x[1:], strict=False))
    assert values(runs.every_nth(df.where("w = 'a'"), ["w"], "t", 50).orderBy("t"), "t") == [(0.0,), (50.0,), (100.0,), (150.0,)]


@pytest.mark.parametrize("size", [7, 1_000_000])
def test_percentiles_are_numpys(spark, monkeypatch, size):
    monkeypatch.setattr(ordering, "ROWS", size)
    rng = np.random.default_rng(7)
    x = [*map(float, rng.integers(0, 9, 301)), *map(float, rng.normal(size=100))]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(x)] + [(7, None), (8, 4.0)], "g int, x double")
    shares = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.66, "e": 1.0}
    assert list(ordering.exact_percentiles(df, "x", shares).first()) == pytest.approx(list(np.quantile([*x, 4.0], list(shares.values()))))
    got = {r["g"]: list(r)[1:] for r in ordering.exact_percentiles(df, "x", shares, ["g"]).collect()}
    assert got.keys() == {0, 1, 2, 8} and got[8] == [4.0] * 5
    for g in range(3):
        assert got[g] == pytest.approx(list(np.quantile(x[g::3], list(shares.values()))))
    assert ordering.exact_percentiles(df.limit(0), "x", shares).count() == 0 or ordering.exact_percentiles(df.limit(0), "x", shares).first()["c"] is None


def test_region_without_good_cells_is_all_cells_with_a_mean(spark):
    g = spark.createDataFrame([(0, 0, 0.0, 9.0), (0, 1, 1.0, 8.0), (1, 1, None, 1.0)], "i int, j int, m double, s double")
    assert sorted(values(grid.reliable_region(g, "m", F.col("s") <= 2), "i", "j", "reliable")) == [(0, 0, True), (0, 1, True), (1, 1, False)]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_multilinear_reads(spark, d):
    axes = [Axis(0.0, 3.0, 3), Axis(-1.0, 1.0, 4), Axis(2.0, 4.0, 2)][:d]
    rng = np.random.default_rng(2)
    f = rng.normal(size=[a.n + 1 for a in axes])
    spots = [[float(rng.uniform(a.lo, a.hi)) for a in axes] for _ in range(30)] + [[a.lo for a in axes], [a.hi for a in axes], [a.hi + 1 for a in axes]]
    table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(f.reshape(-1))], "k long, f double")
    points = spark.createDataFrame(list(enumerate(spots)), "id int, x array<double>")
    for outside in ("null", "clamp"):
        got = dict(values(grid.multilinear(points, [F.col("x")[k] for k in range(d)], table, axes, "v", outside), "id", "v"))
        for k, x in enumerate(spots):
            out = f
            for a, at in reversed(list(zip(axes, x, strict=True))):
                out = np.apply_along_axis(lambda line: np.interp(at, a.lo + a.step * np.arange(a.n + 1), line), -1, out)  # noqa: B023
            assert got[k] is None if outside == "null" and k == len(spots) - 1 else got[k] == pytest.approx(float(out))


def test_common_axis_needs_enough_points(spark):
    rows = [(s, float(x), None if x == 2 else float(x * s)) for s in (1, 2) for x in range(6)] + [(3, 0.0, 1.0), (3, 1.0, 2.0), (3, 2.0, 3.0), (3, 9.0, 1.0)]
    got = {(s, k): f for s, k, f in values(grid.resampled(spark.createDataFrame(rows, "s int, x double, f double"), ["s"], "x", "f", 0.5, 4.5, 9), "s", "k", "f")}
    assert {s for s, _ in got} == set() or {s for s, _ in got} == {1, 2}
    good = {(s, k): f for s, k, f in values(grid.resampled(spark.createDataFrame(rows, "s int, x double, f double"), ["s"], "x", "f", 0.0, 5.0, 11), "s", "k", "f")}
    assert {s for s, _ in good} == {1, 2} and good[2, 3] == pytest.approx(3.0) and good[1, 4] == pytest.approx(2.0)


def test_smoothed_surface_and_kernels(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1, (200, 2))
    df = spark.createDataFrame([(float(x), float(y), float(x)) for x, y in xy], "x double, y double, w double")
    got = {(i, j): f for i, j, f in values(hist.fes_2d(df, F.col("x"), F.col("y"), F.col("w"), Axis(0, 1, 5), Axis(0, 1, 4), 2.5, bandwidth=(0.2, 0.0)), "i", "j", "f")}
    h = np.histogram2d(xy[:, 0], xy[:, 1], bins=(5, 4), range=((0, 1), (0, 1)), weights=xy[:, 0])[0]
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    smooth = np.array([[sum(k * h[min(max(i + d, 0), 4), j] for d, k in zip(range(-4, 5), kernel / kernel.sum(), strict=True)) for j in range(4)] for i in range(5)])
    f = -2.5 * np.log(smooth)
    assert got == {(i, j): pytest.approx(f[i, j] - f.min()) for i in range(5) for j in range(4)}
    density = {k: v for k, v in values(hist.kernel_histogram(df, F.col("x"), F.col("w"), Axis(0, 1, 20), 0.1, 2.5, 12.0), "k", "density")}
    w = np.exp(xy[:, 0] / 2.5)
    assert density == {k: pytest.approx((w * np.exp(-((k / 20 - xy[:, 0]) ** 2) / 0.02)).sum() / w.sum() / 0.1 / np.sqrt(2 * np.pi)) for k in range(21)}


def test_hill_count_cuts(spark):
    h = spark.createDataFrame([(float(t),) for t in range(1, 11)], "t double")
    assert values(ensembles.hill_count_cuts(h, "t", 3).orderBy("snap"), "snap", "hills", "t_cut") == [(0, 3, 3.0), (1, 6, 6.0), (2, 9, 9.0), (3, 10, 10.0)]
    assert [n for _, n in values(ensembles.hill_count_cuts(h, "t", 5).orderBy("snap"), "snap", "hills")] == [2, 4, 6, 8, 10]


def test_contacts_by_nearest_image(spark):
    """Every image of an angled box against the nearest-image count, with and without boxes."""
    rng = np.random.default_rng(9)
    a, b, c = np.array([3.0, 0, 0]), np.array([0.8, 2.8, 0]), np.array([-0.5, 0.6, 2.6])
    atoms = [(k, f"{'H' if k % 7 == 0 else 'C'}{k}", k // 4, "A" if k < 60 else "B") for k in range(120)]
    rows = [(f, k, *map(float, rng.uniform(-4, 4, 3))) for f in range(3) for k in range(120)]
    df, top = spark.createDataFrame(rows, "frame int, atom int, x double, y double, z double"), spark.createDataFrame(atoms, "atom int, name string, resnum int, chain string")
    boxes = spark.createDataFrame([(f, 3.0, 0.8, 2.8, -0.5, 0.6, 2.6) for f in range(3)], "frame int, ax double, bx double, by double, cx double, cy double, cz double")
    shifts = [i * a + j * b + k * c for i in range(-5, 6) for j in range(-5, 6) for k in range(-5, 6)]
    for box, images in ((None, [np.zeros(3)]), (boxes, shifts)):
        want = {}
        for f in range(3):
            xyz = {k: np.array(v) for g, k, *v in rows if g == f}
            heavy = [(k, r, ch) for k, n, r, ch in atoms if n[0] != "H"]
            p, q = [(k, r) for k, r, ch in heavy if ch == "A"], [(k, r) for k, r, ch in heavy if ch == "B"]
            diff = np.array([xyz[k] for k, _ in p])[:, None] - np.array([xyz[k] for k, _ in q])[None]
            near = min_distance(diff, images) < 0.45
            want[f] = len({(p[i][1], q[j][1]) for i, j in zip(*np.nonzero(near), strict=True)})
        got = dict(values(structure.residue_contacts(df, top, F.col("chain") == "A", F.col("chain") == "B", 0.45, box), "frame", "n"))
        assert got == want and sum(want.values()) > 0


def min_distance(diff, images):
    return np.min([np.linalg.norm(diff + s, axis=-1) for s in images], axis=0)


def test_structural_medoid_ignores_place_and_turn(spark):
    rng = np.random.default_rng(12)
    base, rows, shapes = rng.normal(size=(10, 3)), [], {}
    for k in range(12):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        shapes[k] = base + (0.02 if k == 5 else 0.3) * rng.normal(size=(10, 3))
        rows += [(k % 2, k, i, *map(float, v)) for i, v in enumerate(shapes[k] @ q + 5 * k)]
    got = {s: f for s, f in values(basins.structural_medoids(spark.createDataFrame(rows, "state int, frame long, atom int, x double, y double, z double"), "state", 99), "state", "frame")}
    assert got[1] == 5
    one = basins.structural_medoids(spark.createDataFrame(rows[:10], "state int, frame long, atom int, x double, y double, z double"), "state", 99)
    assert values(one, "frame", "total") == [(0, pytest.approx(0, abs=1e-6))]


def test_verdicts(spark):
    runs_of = spark.createDataFrame([(0, 0.5), (1, 2.0)], "w int, time double")
    for lows, sustained, want in (([2.0, 3.0], 1.0, "clear"), ([1.0, 3.0], 5.0, "transient"), ([1.0, 3.0], 1.0, "sustained")):
        low = spark.createDataFrame(list(enumerate(lows)), "w int, low double")
        assert {v[0] for v in values(runs.contact_verdict(runs_of, low, ["w"], 1.4, sustained), "verdict")} == {want}


def test_molecules_made_whole(spark):
    """A walk of small steps, wrapped into an angled box atom by atom, comes back as the walk, but for a shift of the whole."""
    rng = np.random.default_rng(15)
    box = np.array([[3.0, 0, 0], [0.8, 2.8, 0], [-0.5, 0.6, 2.6]])
    rows, want = [], {}
    for frame in range(2):
        for molecule in ("A", "B"):
            walk = np.cumsum(rng.uniform(-0.4, 0.4, (60, 3)), axis=0)
            wrapped = (lambda f: (f - np.floor(f)) @ box)(walk @ np.linalg.inv(box))
            rows += [(frame, molecule, k, *map(float, v)) for k, v in enumerate(wrapped)]
            want[frame, molecule] = walk - walk[0]
    boxes = spark.createDataFrame([(f, 3.0, 0.8, 2.8, -0.5, 0.6, 2.6) for f in range(2)], "frame int, ax double, bx double, by double, cx double, cy double, cz double")
    out = structure.made_whole(spark.createDataFrame(rows, "frame int, m string, atom int, x double, y double, z double"), boxes, "m").toPandas()
    for key, x in out.sort_values("atom").groupby(["frame", "m"]):
        xyz = x[["x", "y", "z"]].to_numpy()
        assert np.allclose(xyz - xyz[0], want[key])
