"""Findings of the third round: each case failed before its change."""

import numpy as np

from pyspark.sql import functions as F

from fjordframe.functions import cells
from fjordframe.functions.binning import Axis
from fjordframe.operators import basins as B
from fjordframe.operators import reweight, runs, selection
from fjordframe.plans import source_queries
from fjordframe.sources import text


def test_medoids_by_blocks(spark, monkeypatch):
    """Blocks of four: the same as all pairs at once; an item without a vector is no medoid, and lacking components don't count."""
    monkeypatch.setattr(B, "BLOCK", 4)
    draw = np.random.default_rng(3)
    rows = [(k % 2, k, [None if draw.random() < 0.1 else float(x) for x in draw.normal(size=5)]) for k in range(40)]
    rows += [(0, 100, None), (0, 101, rows[0][2]), (None, 102, [0.0] * 5)]
    got = {r["s"]: (r["k"], r["total"]) for r in B.medoids(spark.createDataFrame(rows, "s int, k long, v array<double>"), "s", "k", "v").collect()}
    for s in (0, 1):
        mine = [(k, np.array(v, dtype=float)) for t, k, v in rows if t == s and v is not None]
        total, k = min((sum(np.sqrt(np.nansum((a - b) ** 2)) for _, b in mine), k) for k, a in mine)
        assert got[s][0] == k and abs(got[s][1] - total) < 1e-9
    assert set(got) == {0, 1}


def test_near_pairs_are_shuffled(spark):
    """However small the table's file is, a side of many points to a structure is not sent through the driver; points at both ends of the reach meet."""
    draw = np.random.default_rng(5)
    spots = [(f, k, *map(float, draw.normal(scale=2, size=3))) for f in range(2) for k in range(60)] + [(2, 0, 0.0, 0.0, 0.0), (2, 1, 0.69999999, 0.0, 0.0), (2, 2, 1.4, 0.0, 0.0)]
    points = spark.createDataFrame(spots, "f int, k int, x double, y double, z double").withColumn("res", F.col("k"))
    out = selection.nearby_pairs(points, "k", "res", ("x", "y", "z"), 0.7, 1, ["f"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(a[0], a[1], b[1]) for a in spots for b in spots if a[0] == b[0] and a[1] < b[1] and np.sqrt(sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True))) < 0.7}
    assert {(r["f"], r["a"], r["b"]) for r in out.collect()} == want and (2, 0, 1) in want


def test_copies_to_cells(spark):
    """A point in a cell's middle has one copy, one at its corner eight, and evenly spread ones four on average."""
    spots = [(0, 0.0, 0.0, 0.0), (1, 1.99, 2.01, -2.0)] + [(k, *map(float, p)) for k, p in enumerate(np.random.default_rng(7).uniform(-40, 40, (2000, 3)), 2)]
    rows = cells.copied(spark.createDataFrame(spots, "k int, x double, y double, z double"), ["x", "y", "z"], ["cx", "cy", "cz"], 1.0)
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    assert counts[0] == 1 and counts[1] == 8 and sum(counts.values()) < 4 * len(spots)


def test_text_in_several_files(spark, monkeypatch, tmp_path):
    """Lines over one file's worth go to several files, and are read back in order over them."""
    monkeypatch.setattr(source_queries, "ROWS", 100)
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o")).withColumn("value", F.concat(F.lit("line "), F.col("o").cast("string")))
    source_queries._text(rows.repartition(3), "o", path := f"{tmp_path}/lines", "# head\n# of it")
    assert len(list((tmp_path / "lines").glob("part-*"))) > 5
    assert text.header(spark, path) == ["# head", "# of it"]
    back = [r["value"] for r in text.lines(spark, path).orderBy("row").collect()]
    assert back == ["# head", "# of it", *(f"line {k}" for k in range(1000))]
    section = text.text_section(spark, path, "line 250", "line 610").orderBy("row").collect()
    assert [r["value"] for r in section] == [f"line {k}" for k in range(250, 610)]


def test_text_in_several_files_of_any_name(spark, monkeypatch, tmp_path):
    """Order over a folder's files does not depend on how their path is written."""
    monkeypatch.setattr(source_queries, "ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("o"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    source_queries._text(rows, "o", path := f"{tmp_path}/run 1+2, 50%25 \u00e4", "# head")
    back = [r["value"] for r in text.lines(spark, path).orderBy("row").collect()]
    assert back == ["# head", *(f"line {k}" for k in range(1000))]


def test_round_trips_with_ties(spark):
    """Rows of one time count as one, in the state of the last."""
    rows = [(0, 1.0, 0.0, 0), (0, 2.0, 9.0, 1), (0, 2.0, 0.0, 2), (0, 2.0, 5.0, 3), (0, 3.0, 9.0, 4), (1, 1.0, 5.0, 5)]
    out = runs.round_trips(spark.createDataFrame(rows, "s int, t double, x double, row long"), ["s"], "t", F.col("x"), 1.0, 8.0, "row")
    assert {tuple(r) for r in out.collect()} == {(0, 1, 0), (1, 0, 0)}


def test_bundle_of_very_small_weights(spark):
    """A bin whose weights are under the least double keeps its free energy."""
    rows = [(s, x, l) for s in (0, 1) for x, l in ((0.5, 0.0), (1.5, -2000.0), (1.5, -2001.0))]
    weighted = spark.createDataFrame(rows, "snap int, x double, lw double").withColumn("w", F.exp("lw"))
    out = {r["k"]: (r["mean"], r["n"]) for r in reweight.weighted_bundle(weighted, {"x": (F.col("x"), Axis(0.0, 2.0, 2))}, 2.0).collect()}
    assert out[0] == (0.0, 2) and out[1][1] == 2 and abs(out[1][0] - 2 * (2000 - np.log1p(np.exp(-1)))) < 1e-9
