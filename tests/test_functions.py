"""The shared folder and the package that executors get."""

import zipfile
from types import SimpleNamespace

import pytest

from fjordframe.functions.lineage import shared_folder
from fjordframe.functions.shipping import shipped


def session(master, folder=None):
    """A stand-in for a session without, or with, spark.checkpoint.dir."""
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: folder), getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context), made


def test_a_cluster_needs_a_shared_folder():
    spark, _ = session("spark://host:7077")
    with pytest.raises(ValueError):
        shared_folder(spark)
    spark, made = session("spark://host:7077", "hdfs:///shared/")
    assert shared_folder(spark) == "hdfs:///shared" and made == ["hdfs:///shared/"]


def test_one_machine_may_use_a_temporary_folder():
    spark, made = session("local[2]")
    assert shared_folder(spark) == made[0].rstrip("/") and shared_folder(spark) == made[0].rstrip("/")


def test_the_package_is_shipped_once():
    paths = []
    spark = SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=paths.append))
    shipped(spark)
    shipped(spark)
    assert len(paths) == 1
    names = zipfile.ZipFile(paths[0]).namelist()
    assert "fjordframe/__init__.py" in names and "fjordframe/functions/shipping.py" in names


def test_rows_before_go_by_ties_over_slices(spark, monkeypatch):
    """Rows of equal order, in one slice and in many."""
    from fjordframe.operators import ordering

    rows = [(g, k // 5, k, k * 10) for g in (1, None) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, o int, tie int, v int").repartition(5)
    want = sorted((str(g), k, None if k == 0 else (k - 1) * 10) for g, _, k, _ in rows)
    for most in (1_000_000, 12):
        monkeypatch.setattr(ordering, "ROWS", most)
        got = ordering.lagged(df, "o", "v", "before", ["g"], "tie").collect()
        assert sorted(((str(r["g"]), r["tie"], r["before"]) for r in got), key=lambda r: (r[0], r[1])) == sorted(want, key=lambda r: (r[0], r[1]))
