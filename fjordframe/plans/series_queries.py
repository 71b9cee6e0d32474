"""Run, block, dedup, filter and lookup queries over the stand-in frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordframe.functions.ranges import bend_degrees
from fjordframe.operators import runs as R
from fjordframe.operators import selection as S
from fjordframe.operators.ordering import row_index, running_mean
from fjordframe.plans.hist_queries import fes1d_value
from fjordframe.plans.standin import AX, FRAMES, KBT, frames, r, rounded


def roundtrips(spark, d):
    return R.round_trips(frames(spark, d), ["walker"], "t", F.col("x"), 20.0, 54.0, "row")


def longest_dip(spark, d):
    return rounded(R.longest_run(frames(spark, d), ["walker"], "t", F.col("x") < 100.0))


def reliable_run(spark, d):
    return R.reliable_run(fes1d_value(spark, d), "k", "f", F.col("f") <= 15.0).select("k", "f", "reliable")


def block_means(spark, d):
    return rounded(R.block_means(frames(spark, d), ["walker"], "t", F.col("x"), 25.0), 9)


def block_means_count(spark, d):
    return rounded(R.count_blocks(frames(spark, d), ["walker"], "t", F.col("x"), 40), 9)


def running_mean_tconv(spark, d):
    hills = row_index(frames(spark, d).where("kind = 'purchase'").select("row", "t", "x"), "t", "place", "row")
    means = running_mean(hills, "place", "x", 200, "mean")
    return rounded(R.first_below(means, "t", "mean", 100.0, 0.45))


def monotonic_check(spark, d):
    return R.backward_steps(frames(spark, d), ["walker"], "row", "x")


def dedup_keep_last(spark, d):
    return rounded(R.keep_last(frames(spark, d), ["walker"], F.rint(F.col("t")), "row").select("walker", "row", "t", "x"))


def lattice_filter(spark, d):
    return rounded(S.on_lattice(frames(spark, d), F.col("t"), 0.25, 500.0, 0.02).select("row", "t"))


def stride_rows(spark, d):
    return R.every_nth(frames(spark, d), ["walker"], "row", 7).select("walker", "row")


def transient_weights(spark, d):
    return rounded(S.transient_zeroed(frames(spark, d), F.col("t"), 100.0, "w").groupBy("walker").agg(F.sum("w").alias("w"), F.count("*").alias("n")))


def lookup_last(spark, d):
    f = frames(spark, d)
    series = f.where("kind = 'purchase'").select("walker", "t", F.col("row").alias("o"), F.col("x").alias("v"))
    return rounded(S.lookup_last(f.where("kind <> 'purchase'").select("walker", "row", "t"), series, ["walker"], "t", "o", 1).select("walker", "row", "v"))


def pooled_order(spark, d):
    f = frames(spark, d).select("walker", "row", "t")
    parts = [f.where(F.col("walker") == k) for k in range(6)]
    return rounded(S.pooled(parts, ["t", "walker", "row"]))


def least_cell(spark, d):
    return S.least_cell(fes1d_value(spark, d), "f", "k")


def boltzmann_sample(spark, d):
    return S.boltzmann_sample(frames(spark, d), "walker", "row", F.col("w"), 20, 42).select("walker", "row", "draw")


def until(spark, d):
    return rounded(S.until(frames(spark, d), F.col("t"), 300.0).groupBy("walker").agg(F.count("*").alias("n"), F.max("t").alias("t")))


def bend_degrees_of(spark, d):
    return rounded(frames(spark, d).select("row", bend_degrees(F.radians("y")).alias("bend"), (F.col("x") + F.col("y")).alias("total")))


def lookup_left(spark, d):
    """Every frame's row in a series that lacks each 50th: 98 in 100 find theirs, which is enough."""
    f = frames(spark, d)
    series = f.where("row % 50 <> 7").select("walker", F.rint(F.col("t") * 1000).alias("t"), F.col("row").alias("o"), F.col("x").alias("v"))
    asked = f.select("walker", "row", F.rint(F.col("t") * 1000).alias("t"))
    met = S.lookup_last(asked, series, ["walker"], "t", "o", 1, "left", exact_first=True)
    return rounded(S.matched_enough(asked, met, F.col("v").isNotNull()).select("walker", "row", "v"))


def frame_place(spark, d):
    return frames(spark, d).select("row", S.frame_place(F.col("t"), 0.25).alias("place"))


def pool_candidates(spark, d):
    f = frames(spark, d).select("walker", "row", "t", "x", "y")
    parts = [f.where(F.col("walker") == k) for k in range(6)]
    return rounded(S.pool_candidates(parts, F.col("t"), 0.25, 400.0, {"total": F.col("x") + F.col("y")}, 0.05).select("walker", "row", "t", "total"))


def drop_repeated_last(spark, d):
    """Snapshots at every 20th hill of all walkers and at the last; the last one comes twice where the stride fits."""
    hills = row_index(frames(spark, d).where("kind = 'purchase'").select("row", "t"), "t", "place", "row")
    most = hills.agg(F.max("place").alias("most"))
    snaps = hills.where("place % 20 = 0").select("place").unionByName(most.select((F.col("most") - F.col("most") % 20).alias("place")))
    placed = snaps.withColumn("order", F.col("place") * 2).unionByName(most.select(F.col("most").alias("place"), (F.col("most") * 2 + 1).alias("order")))
    return R.drop_repeated_last(placed, "order", "place").select("place")


def contact_verdict(spark, d):
    f = frames(spark, d)
    runs = R.longest_run(f, ["walker"], "t", F.col("x") < 5.0)
    lows = f.groupBy("walker").agg(F.min("x").alias("low"))
    return rounded(R.contact_verdict(runs, lows, ["walker"], 5.0, 1.0))


_FES = f"(SELECT g.k::INTEGER AS k, round(f - min(f) OVER (), 6) AS f FROM range({AX.n}) g(k) LEFT JOIN (SELECT {AX.sql('x')} AS k, -{KBT}::DOUBLE * ln(sum(w)) AS f FROM {FRAMES} GROUP BY 1) h ON g.k = h.k)"
_HILLS = f"(SELECT row, t, x, row_number() OVER (ORDER BY t, row) AS p FROM {FRAMES} WHERE kind = 'purchase')"

QUERIES = {f.__name__: f for f in (roundtrips, longest_dip, reliable_run, block_means, block_means_count, running_mean_tconv, monotonic_check, dedup_keep_last, lattice_filter, stride_rows, transient_weights, lookup_last, pooled_order, least_cell, boltzmann_sample, until, bend_degrees_of, lookup_left, frame_place, pool_candidates, drop_repeated_last, contact_verdict)}
_DIPS = """WITH a AS (SELECT walker, t, x < 5 AS ok, t - lag(t) OVER (PARTITION BY walker ORDER BY t) AS dt FROM {f}), b AS (SELECT *, sum((NOT ok)::INTEGER) OVER (PARTITION BY walker ORDER BY t) AS g FROM a),
c AS (SELECT walker, max(n) AS n FROM (SELECT walker, g, count(*) FILTER (WHERE ok) AS n FROM b GROUP BY 1, 2) GROUP BY 1), s AS (SELECT walker, median(dt) AS step FROM a GROUP BY 1), l AS (SELECT walker, min(x) AS low FROM {f} GROUP BY 1),
v AS (SELECT walker, low, n AS rows, step, n * step AS time, n * step > 1.0 AS lasting FROM c JOIN s USING (walker) JOIN l USING (walker))
SELECT walker, round(low, 6) AS low, rows, round(step, 6) AS step, round(time, 6) AS time, lasting, CASE WHEN min(low) OVER () >= 5 THEN 'clear' WHEN NOT bool_or(lasting) OVER () THEN 'transient' ELSE 'sustained' END AS verdict FROM v"""
ORACLES = {
    "until": f"SELECT walker, count(*) AS n, {r('max(t)', 't')} FROM {FRAMES} WHERE t <= 300 GROUP BY 1",
    "bend_degrees_of": f"SELECT row, {r('180 - y', 'bend')}, {r('x + y', 'total')} FROM {FRAMES}",
    "lookup_left": f"""WITH s AS (SELECT walker, round_even(t * 1000, 0) AS k, x AS v FROM {FRAMES} WHERE row % 50 <> 7 QUALIFY row_number() OVER (PARTITION BY walker, round_even(t * 1000, 0) ORDER BY row DESC) = 1)
SELECT f.walker, row, {r("v", "v")} FROM {FRAMES} f LEFT JOIN s ON f.walker = s.walker AND round_even(f.t * 1000, 0) = s.k""",
    "frame_place": f"SELECT row, round_even(t / 0.25::DOUBLE, 0)::BIGINT AS place FROM {FRAMES}",
    "pool_candidates": f"SELECT walker, row, {r('t', 't')}, {r('x + y', 'total')} FROM {FRAMES} WHERE abs(t / 0.25::DOUBLE - round_even(t / 0.25::DOUBLE, 0)) < 0.05 AND t <= 400 + 1e-6",
    "drop_repeated_last": f"SELECT DISTINCT place FROM (SELECT row_number() OVER (ORDER BY t, row) AS place, count(*) OVER () AS most FROM {FRAMES} WHERE kind = 'purchase') WHERE place % 20 = 0 OR place = most OR place = most - most % 20",
    "contact_verdict": _DIPS.format(f=FRAMES),
    "boltzmann_sample": f"""SELECT walker, row, draw FROM (SELECT walker, row, (row_number() OVER (PARTITION BY walker ORDER BY ln(((('0x' || substr(md5('42:' || row), 1, 13))::BIGINT >> 2) + 1) / {float((1 << 50) + 1)!r}::DOUBLE) / w DESC, row))::INTEGER AS draw FROM {FRAMES} WHERE w > 0) WHERE draw <= 20""",
    "roundtrips": f"""SELECT walker, sum(c)::BIGINT AS switches, floor(sum(c) / 2)::BIGINT AS trips FROM (
SELECT walker, CASE WHEN lag(s) OVER (PARTITION BY walker ORDER BY t) <> s THEN 1 ELSE 0 END AS c, t FROM (
SELECT walker, t, last_value(CASE WHEN x <= 20 THEN -1 WHEN x >= 54 THEN 1 END IGNORE NULLS) OVER (PARTITION BY walker ORDER BY t) AS s FROM {FRAMES})) GROUP BY walker""",
    "longest_dip": f"""WITH a AS (SELECT walker, t, x < 100 AS ok, t - lag(t) OVER (PARTITION BY walker ORDER BY t) AS dt FROM {FRAMES}),
b AS (SELECT *, sum((NOT ok)::INTEGER) OVER (PARTITION BY walker ORDER BY t) AS g FROM a),
c AS (SELECT walker, max(n) AS n FROM (SELECT walker, g, count(*) FILTER (WHERE ok) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT walker, median(dt) AS step FROM a GROUP BY 1)
SELECT walker, n AS rows, {r("step", "step")}, {r("n * step", "time")} FROM c JOIN s USING (walker)""",
    "reliable_run": f"""WITH p AS (SELECT *, coalesce(f <= 15, false) AS ok FROM {_FES}), q AS (SELECT *, sum((NOT ok)::INTEGER) OVER (ORDER BY k) AS g FROM p),
m AS (SELECT g, ok FROM q WHERE f IS NOT NULL ORDER BY f, k LIMIT 1)
SELECT k, f, CASE WHEN (SELECT bool_or(ok) FROM q) THEN q.ok AND (SELECT ok FROM m) AND q.g = (SELECT g FROM m) ELSE f IS NOT NULL END AS reliable FROM q""",
    "block_means": f"SELECT walker, floor(t / 25.0)::INTEGER AS block, {r("avg(x)", "mean", 9)}, count(*) AS n FROM {FRAMES} GROUP BY 1, 2",
    "block_means_count": f"""WITH a AS (SELECT walker, x, row_number() OVER (PARTITION BY walker ORDER BY t) AS rn, count(*) OVER (PARTITION BY walker) AS n FROM {FRAMES}), b AS (SELECT *, greatest(1, n // 40) AS w FROM a)
SELECT walker, ((rn - 1) // w)::INTEGER AS block, {r("avg(x)", "mean", 9)}, count(*) AS n FROM b WHERE rn <= (n // w) * w GROUP BY 1, 2""",
    "running_mean_tconv": f"SELECT {r('min(t2)', 't_conv')} FROM (SELECT avg(x) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS m, count(*) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS c, lead(t, 100) OVER (ORDER BY p) AS t2 FROM {_HILLS}) WHERE c = 200 AND m < 45",
    "monotonic_check": f"SELECT walker, count(*) FILTER (WHERE dx <= 0) AS backward, count(*) AS n FROM (SELECT walker, x - lag(x) OVER (PARTITION BY walker ORDER BY row) AS dx FROM {FRAMES}) GROUP BY walker",
    "dedup_keep_last": f"SELECT walker, row, {r('t', 't')}, {r('x', 'x')} FROM {FRAMES} QUALIFY row_number() OVER (PARTITION BY walker, round_even(t, 0) ORDER BY row DESC) = 1",
    "lattice_filter": f"SELECT row, {r('t', 't')} FROM {FRAMES} WHERE abs(t / 0.25::DOUBLE - round_even(t / 0.25::DOUBLE, 0)) < 0.02 AND t <= 500 + 1e-6",
    "stride_rows": f"SELECT walker, row FROM {FRAMES} QUALIFY (row_number() OVER (PARTITION BY walker ORDER BY row) - 1) % 7 = 0",
    "transient_weights": f"SELECT walker, {r('sum(CASE WHEN t < 100 THEN 0.0 ELSE w END)', 'w')}, count(*) AS n FROM {FRAMES} GROUP BY walker",
    "lookup_last": f"""WITH s AS (SELECT walker, round(t, 1) AS k, x AS v FROM {FRAMES} WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY walker, round(t, 1) ORDER BY row DESC) = 1)
SELECT f.walker, row, {r("v", "v")} FROM {FRAMES} f JOIN s ON f.walker = s.walker AND round(f.t, 1) = s.k WHERE kind <> 'purchase'""",
    "pooled_order": f"SELECT walker, row, {r('t', 't')} FROM {FRAMES} ORDER BY t, walker, row",
    "least_cell": f"SELECT f, k FROM {_FES} WHERE f IS NOT NULL ORDER BY f, k LIMIT 1",
}
