"""Weights of a live run equal those of the finished one, also after a restart; growing files give whole lines once."""

import random

import pytest
from pyspark.sql import functions as F

from fjordframe.functions.binning import Axis
from fjordframe.operators import reweight as W
from fjordframe.streaming.weights import growing_lines, live_weights, normalised

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
AXES = [Axis(0.0, 10.0, 40), Axis(-1.0, 1.0, 16)]


@pytest.fixture()
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, old)


def lines(seed, n, group):
    """time kind x y height, in order of time, hills on batch edges too, none in the first batch of the second group."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        t = k * 0.3 if k % 10 else round(k * 0.3)
        if k % 3 == 0 and (group or t > 3):
            out.append(f"{t} H {rng.uniform(0, 10)} {rng.uniform(-1, 1)} {rng.uniform(0.2, 1)}")
        out.append(f"{t} F {rng.uniform(-1, 11)} {rng.uniform(-1.2, 1.2)} 0")
    return out


def parsed(text):
    p = F.split("value", " ")
    number = lambda k: F.get(p, F.lit(k)).cast("double")
    return text.select(
        F.regexp_extract("file", r"run(\d)", 1).cast("int").alias("grp"), F.col("place").alias("id"), (F.get(p, F.lit(1)) == "H").alias("hill"), number(0).alias("t"),
        F.array(number(2), number(3)).alias("x"), F.array(F.lit(0.8), F.lit(0.2)).alias("sigma"), number(4).alias("height"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + number(0)).alias("ts"),
    )


def test_live_weights_equal_those_of_the_finished_run(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "in"
    folder.mkdir()
    texts = {f"run{g}.dat": lines(g, 120, g) for g in range(2)}
    args = dict(gamma=8.0, kbt=2.5, batch=2.0, checkpoint=5.0)

    def go(upto):
        for name, rows in texts.items():
            body = "\n".join(rows) + "\n9999 F 0 0 0\n99999 F 0 0 0\n"  # the last two move the watermark on
            (folder / name).write_text(body[: int(len(body) * upto)])  # half lines and all
        live = live_weights(parsed(growing_lines(spark, str(folder), 700)), "ts", "grp", AXES, late="30 seconds", origin="2024-01-01 00:00:00", unit_seconds=1.0, **args)
        query = live.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()

    for upto in (0.31, 0.62, 1.0, 1.0):
        go(upto)
    got = spark.read.parquet(f"{tmp_path}/out").where("t < 9000")
    for g in range(2):
        rows = parsed(spark.createDataFrame([(v, f"run{g}", k) for k, v in enumerate(texts[f"run{g}.dat"])], "value string, file string, place long"))
        hills = rows.where("hill").select("t", F.col("x").alias("centre"), "sigma", "height")
        want = {(r["t"], tuple(r["x"])): (r["v"], r["c"], r["w"]) for r in W.time_dependent_weights(rows.where("NOT hill").select("t", "x"), hills, AXES, **args).collect()}
        own = normalised(got.where(F.col("grp") == g)).collect()
        found = {r["id"]: (r["t"], r["v"], r["c"], r["w"]) for r in own}
        assert len(found) == len(own) == 120
        wanted = sorted((k[0], *v) for k, v in want.items())
        for a, b in zip(sorted(found.values()), wanted, strict=True):
            assert a == pytest.approx(b, abs=1e-9)


def test_growing_files_give_whole_lines_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo\nthr")
    (folder / "b.txt").write_text("x" * 50 + "\n" + "y" * 50 + "\n")
    query = growing_lines(spark, f"{folder}/*.txt", 60).writeStream.format("memory").queryName("grown").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    seen = lambda: sorted((r["file"][-5:], r["place"], r["value"]) for r in spark.table("grown").collect())
    first = [("a.txt", 0, "one"), ("a.txt", 4, "two"), ("b.txt", 0, "x" * 50), ("b.txt", 51, "y" * 50)]
    assert seen() == first
    with open(folder / "a.txt", "a") as f:
        f.write("ee\nfour\nfi")
    (folder / "c.txt").write_text("new\n")
    query.processAllAvailable()
    query.stop()
    assert seen() == sorted([*first, ("a.txt", 8, "three"), ("a.txt", 14, "four"), ("c.txt", 0, "new")])
