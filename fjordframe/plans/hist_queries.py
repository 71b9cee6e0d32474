"""Histogram, profile and marginal queries over the stand-in frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordframe.operators import hist as H
from fjordframe.operators.ordering import average_ranks, exact_percentiles
from fjordframe.plans.standin import AT, AX, AY, FRAMES, KBT, frames, r, rounded

_K, _I, _J = AX.sql("x"), AX.sql("x"), AY.sql("y")
_H1 = f"(SELECT {_K} AS k, sum(w) AS h, count(*) AS n FROM {FRAMES} GROUP BY 1 HAVING k IS NOT NULL)"
_H2 = f"(SELECT {_I} AS i, {_J} AS j, sum(w) AS h, count(*) AS n FROM {FRAMES} GROUP BY 1, 2 HAVING i IS NOT NULL AND j IS NOT NULL)"
_F2 = f"(SELECT i, j, f - min(f) OVER () AS f FROM (SELECT i, j, -{KBT}::DOUBLE * ln(h) AS f FROM {_H2} WHERE h > 0))"


def fes1d_value(spark, d):
    return rounded(H.fes_1d(frames(spark, d), F.col("x"), F.col("w"), AX, KBT))


def fes1d_value_norm(spark, d):
    return rounded(H.fes_1d(frames(spark, d), F.col("x"), F.col("w"), AX, KBT, normalised=True))


def fes2d_value_k(spark, d):
    return rounded(H.fes_2d(frames(spark, d), F.col("x"), F.col("y"), F.col("w"), AX, AY, KBT))


def hist_counts(spark, d):
    return rounded(H.histogram(frames(spark, d), {"k": (F.col("x"), AX)}, F.col("w")))


def ess_global(spark, d):
    return rounded(frames(spark, d).agg(H.effective_size(F.col("w")).alias("ess"), F.count("*").alias("n")))


def weighted_profile(spark, d):
    return rounded(H.weighted_profile(frames(spark, d), F.col("x"), AX, F.col("w"), {"m_y": F.col("y"), "m_t": F.col("t")}))


def weighted_error(spark, d):
    return rounded(H.weighted_error(frames(spark, d), F.col("t"), AT, F.col("w"), F.col("y")))


def cond_profile(spark, d):
    return rounded(H.conditional_profile(frames(spark, d), F.col("y"), 0.0, 5.0, 20, F.col("x"), 50))


def reference_mean(spark, d):
    return rounded(H.reference_mean(frames(spark, d), F.col("x") >= 60, F.col("w"), F.col("y")))


def marginal_value(spark, d):
    return rounded(H.marginal(H.fes_2d(frames(spark, d), F.col("x"), F.col("y"), F.col("w"), AX, AY, KBT), "i", "f", KBT))


def marginal_k(spark, d):
    return rounded(H.marginal(H.fes_2d(frames(spark, d), F.col("x"), F.col("y"), F.col("w"), AX, AY, KBT), "j", "f", KBT, F.col("i").between(0, 9)))


def grid_logsumexp(spark, d):
    f = H.fes_2d(frames(spark, d), F.col("x"), F.col("y"), F.col("w"), AX, AY, KBT)
    return rounded(H.log_sum_exp(f.withColumn("e", -F.col("f") / F.lit(KBT)), ["i"], "e", "lse"))


def walker_coverage(spark, d):
    return H.walker_coverage(frames(spark, d), "walker", F.col("x"), F.col("y"), AX, AY, 3)


def rebin_density(spark, d):
    counts = H.histogram(frames(spark, d), {"k": (F.col("x"), AX)}, F.lit(1.0)).select("k", "n")
    return rounded(H.rebinned_density(counts, AX, 3), 9)


def scalar_summary(spark, d):
    return rounded(H.summary(frames(spark, d), F.col("x"), F.col("x") > 50))


def pctl_thresholds(spark, d):
    return rounded(exact_percentiles(frames(spark, d), "x", {"p33": 0.33, "p66": 0.66}))


def fes2d_normalised(spark, d):
    return rounded(H.fes_2d(frames(spark, d), F.col("x"), F.col("y"), F.col("w"), AX, AY, KBT, normalised=True))


def fes2d_smoothed(spark, d):
    return rounded(H.fes_2d(frames(spark, d), F.col("x"), F.col("y"), F.col("w"), AX, AY, KBT, bandwidth=(15.0, 5.0)).where("f < 40"))


def kernel_histogram(spark, d):
    return rounded(H.kernel_histogram(frames(spark, d), F.col("x"), F.col("y") / 50, H.Axis(0.0, 500.0, 200), 5.0, KBT).where("density > 1e-6"))


def density_mean(spark, d):
    counts = H.histogram(frames(spark, d), {"k": (F.col("x"), AX)}, F.lit(1.0)).select("k", "n")
    return rounded(H.density_mean(H.rebinned_density(counts, AX, 3), AX, 3))


def corr_pearson(spark, d):
    return rounded(frames(spark, d).agg(F.corr("x", "t").alias("r")))


def corr_spearman(spark, d):
    ranked = average_ranks(average_ranks(frames(spark, d).select("row", "x", "y"), "x", "rx"), "y", "ry")
    return rounded(ranked.agg(F.corr("rx", "ry").alias("rho")))


def height_decay(spark, d):
    return rounded(H.clipped_means(frames(spark, d).where("kind = 'purchase'"), F.col("t"), H.Axis(100.0, 600.0, 100), F.col("x")))


_LSE = "(SELECT {k}, m - {kbt}::DOUBLE * ln(sum(exp(-(f - m) / {kbt}::DOUBLE))) AS f FROM (SELECT *, min(f) OVER (PARTITION BY {k}) AS m FROM {src}) GROUP BY {k}, m)"
_MV, _MK = _LSE.format(k="i", kbt=KBT, src=_F2), _LSE.format(k="j", kbt=KBT, src=f"(SELECT * FROM {_F2} WHERE i BETWEEN 0 AND 9)")

QUERIES = {f.__name__: f for f in (fes1d_value, fes1d_value_norm, fes2d_value_k, hist_counts, ess_global, weighted_profile, weighted_error, cond_profile, reference_mean, marginal_value, marginal_k, grid_logsumexp, walker_coverage, rebin_density, density_mean, fes2d_normalised, fes2d_smoothed, kernel_histogram, scalar_summary, pctl_thresholds, corr_pearson, corr_spearman, height_decay)}
ORACLES = {
    "fes1d_value": f"SELECT g.k::INTEGER AS k, {r('f - min(f) OVER ()', 'f')} FROM range({AX.n}) g(k) LEFT JOIN (SELECT k, -{KBT}::DOUBLE * ln(h) AS f FROM {_H1} WHERE h > 0) h ON g.k = h.k",
    "fes1d_value_norm": f"SELECT g.k::INTEGER AS k, {r('f', 'f')} FROM range({AX.n}) g(k) LEFT JOIN (SELECT k, -{KBT}::DOUBLE * ln(h) AS f FROM (SELECT k, h / sum(h) OVER () AS h FROM {_H1}) WHERE h > 0) h ON g.k = h.k",
    "fes2d_value_k": f"SELECT i, j, {r('f', 'f')} FROM {_F2}",
    "hist_counts": f"SELECT k, {r('h', 'h')}, n FROM {_H1}",
    "ess_global": f"SELECT {r('pow(sum(w), 2) / sum(w * w)', 'ess')}, count(*) AS n FROM {FRAMES}",
    "weighted_profile": f"SELECT {_K} AS k, {r('sum(w * y) / sum(w)', 'm_y')}, {r('sum(w * t) / sum(w)', 'm_t')}, {r('pow(sum(w), 2) / sum(w * w)', 'ess')}, count(*) AS n FROM {FRAMES} GROUP BY 1 HAVING k IS NOT NULL",
    "weighted_error": f"""WITH f AS (SELECT {AT.sql("t")} AS k, w, y FROM {FRAMES}), m AS (SELECT k, sum(w * y) / sum(w) AS mean, pow(sum(w), 2) / sum(w * w) AS ess, count(*) AS n FROM f WHERE k IS NOT NULL GROUP BY k)
SELECT k, {r("mean", "mean")}, {r("sqrt(var / greatest(ess, 1.0))", "se")}, n FROM (SELECT m.k, mean, ess, n, sum(w * pow(y - mean, 2)) / sum(w) AS var FROM f JOIN m USING (k) GROUP BY m.k, mean, ess, n) WHERE n >= 50""",
    "cond_profile": f"SELECT floor(y / 5.0)::INTEGER AS k, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'std')}, count(*) AS n FROM {FRAMES} GROUP BY 1 HAVING k BETWEEN 0 AND 19 AND n >= 50",
    "reference_mean": f"SELECT {r('sum(w * y) / sum(w)', 'mean')}, count(*) AS n FROM {FRAMES} WHERE x >= 60",
    "marginal_value": f"SELECT i, {r('f - min(f) OVER ()', 'f')} FROM {_MV}",
    "marginal_k": f"SELECT j, {r('f - min(f) OVER ()', 'f')} FROM {_MK}",
    "grid_logsumexp": f"SELECT i, {r(f'max(m) + ln(sum(exp(-f / {KBT}::DOUBLE - m)))', 'lse')} FROM (SELECT *, max(-f / {KBT}::DOUBLE) OVER (PARTITION BY i) AS m FROM {_F2}) GROUP BY i",
    "walker_coverage": f"SELECT i, j, count(*) AS walkers FROM (SELECT walker, {_I} AS i, {_J} AS j, count(*) AS c FROM {FRAMES} GROUP BY 1, 2, 3 HAVING c >= 3) WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY 1, 2",
    "rebin_density": f"SELECT k, n::BIGINT AS n, {r(f'n / (sum(n) OVER () * {AX.step * 3}::DOUBLE)', 'density', 9)} FROM (SELECT (k // 3)::INTEGER AS k, sum(n) AS n FROM {_H1} WHERE k < 48 GROUP BY 1)",
    "scalar_summary": f"SELECT {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'std')}, {r('median(x)', 'median')}, {r('min(x)', 'low')}, {r('max(x)', 'high')}, {r('avg((x > 50)::INTEGER)', 'frac')}, count(x) AS n FROM {FRAMES}",
    "pctl_thresholds": f"SELECT {r('quantile_cont(x, 0.33)', 'p33')}, {r('quantile_cont(x, 0.66)', 'p66')} FROM {FRAMES}",
    "density_mean": f"SELECT {r(f'sum((k + 0.5::DOUBLE) * {AX.step * 3}::DOUBLE * n) / sum(n)', 'mean')}, sum(n)::BIGINT AS n FROM (SELECT (k // 3)::INTEGER AS k, sum(n) AS n FROM {_H1} WHERE k < 48 GROUP BY 1)",
    "fes2d_normalised": f"SELECT i, j, {r('f - min(f) OVER ()', 'f')} FROM (SELECT i, j, -{KBT}::DOUBLE * ln(h / sum(h) OVER ()) AS f FROM {_H2} WHERE h > 0)",
    "fes2d_smoothed": f"""WITH g AS (SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, coalesce(h, 0) AS h FROM range({AX.n}) a(i), range({AY.n}) b(j) LEFT JOIN {_H2} h ON h.i = a.i AND h.j = b.j),
u AS (SELECT d, exp(-0.5::DOUBLE * pow(d / 1.5::DOUBLE, 2)) AS w FROM range(-6, 7) r(d)), v AS (SELECT d, exp(-0.5::DOUBLE * pow(d / 1.0::DOUBLE, 2)) AS w FROM range(-4, 5) r(d)),
s AS (SELECT a.i, a.j, sum(u.w * v.w * b.h) / ((SELECT sum(w) FROM u) * (SELECT sum(w) FROM v)) AS h FROM g a, u, v JOIN g b ON b.i = least(greatest(a.i + u.d, 0), {AX.n - 1}) AND b.j = least(greatest(a.j + v.d, 0), {AY.n - 1}) GROUP BY 1, 2)
SELECT i, j, round(f, 6) AS f FROM (SELECT i, j, f - min(f) OVER () AS f FROM (SELECT i, j, -{KBT}::DOUBLE * ln(h) AS f FROM s WHERE h > 0)) WHERE f < 40""",
    "kernel_histogram": f"""WITH f AS (SELECT x, exp((y / 50 - max(y / 50) OVER ()) / {KBT}::DOUBLE) AS w FROM {FRAMES}),
g AS (SELECT k::INTEGER AS k, sum(w * exp(-pow(k * 2.5::DOUBLE - x, 2) / 50)) / ((SELECT sum(w) FROM f) * 5 * sqrt(2 * pi())) AS density FROM f, range(201) r(k) WHERE abs(k - round_even(x / 2.5::DOUBLE, 0)) <= 8 GROUP BY 1)
SELECT k, round(density, 6) AS density, round(-{KBT}::DOUBLE * ln(density), 6) AS f FROM g WHERE density > 1e-6""",
    "corr_pearson": f"SELECT {r('corr(x, t)', 'r')} FROM {FRAMES}",
    "corr_spearman": f"SELECT {r('corr(rx, ry)', 'rho')} FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM {FRAMES})",
    "height_decay": f"SELECT g.k::INTEGER AS k, {r('mean', 'mean')} FROM range(100) g(k) LEFT JOIN (SELECT least(greatest(floor((t - 100) / 5.0), 0), 99)::INTEGER AS k, avg(x) AS mean FROM {FRAMES} WHERE kind = 'purchase' GROUP BY 1) h ON g.k = h.k",
}
