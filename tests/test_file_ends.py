"""Range reads of file ends, caches that follow their files, line order over file parts."""

import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from fjordframe.operators import selection
from fjordframe.sources import ends, sinks
from fjordframe.sources import text as S


@pytest.fixture()
def folder(tmp_path):
    return tmp_path / "in"


def save(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(folder / name)


def test_ends_of_long_files_are_read_by_blocks(spark, folder):
    body = "#! FIELDS time x\n" + "".join(f"{k} {k / 2}\n" for k in range(400_000))
    for k in range(3):
        save(folder, f"colvar.{k}", body)
    files = ends.files_of(spark, f"{folder}/colvar.*")
    assert [f[1] for f in files] == [len(body)] * 3 and all(f[0].startswith("file:///") for f in files)
    tail = ends.end_lines(spark, files, -ends.TAIL)
    assert {r["read"] for r in tail.select("read").distinct().collect()} == {ends.TAIL}
    assert tail.where("file LIKE '%1'").orderBy(F.desc("row")).first()["value"] == "399999 199999.5"
    assert {r["t"] for r in S.last_times(spark, f"{folder}/colvar.*", {"x": 1}, scale=1.0).collect()} == {399_999.0}
    assert S.header(spark, files[0][0]) == ["#! FIELDS time x"]
    same = S.last_time(S.read_series(spark, f"{folder}/colvar.*", {"x": 1}, scale=1.0))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, S.last_times(spark, f"{folder}/colvar.*", {"x": 1}, scale=1.0).collect()))


def test_blocks_grow_for_long_headers_and_broken_ends(spark, folder):
    """A header and a broken end that are longer than the first blocks, in one of two files."""
    long = "".join(f"# line {k} of the header\n" for k in range(9000)) + "#! FIELDS time x biasf\n"
    save(folder, "a.1", long + "1 2 3\n2 3 4\n" + "broken\n" * 5000)
    save(folder, "a.2", "#! FIELDS time x biasf\r\n5 6 7\r\n6 7 8\r\n7 8 9")
    save(folder, "a.3", "# nothing else")
    save(folder, "a.4", "")
    assert S.header_fields(spark, f"{folder}/a.2") == ["time", "x", "biasf"] and len(S.header(spark, f"{folder}/a.1")) == 9001
    assert S.header(spark, f"{folder}/a.3") == ["# nothing else"] and S.header(spark, f"{folder}/a.4") == []
    got = {r["file"][-1]: r["t"] for r in S.last_times(spark, f"{folder}/a.*", {"x": 1}, scale=1.0).collect()}
    assert got == {"1": 2.0, "2": 7.0}
    hills = "".join(f"# {k:>40}\n" for k in range(3000))
    save(folder, "hills.0", hills + "1 0 0.1 1 12 1\n2 0 0.1 1 99 1\n")
    save(folder, "hills.1", "1 0 0.1 1 15 1\n")
    got = {r["file"][-1]: r["gamma"] for r in S.first_bias_factors(spark, f"{folder}/hills.*", 1).collect()}
    assert got == {"0": 12.0, "1": 15.0}


def test_compressed_files_are_read_through(spark, folder):
    save(folder, "b.gz", gzip.compress(b"#! FIELDS time x\n1 2\n3 4\n"))
    assert S.header_fields(spark, f"{folder}/b.gz") == ["time", "x"]
    assert S.last_times(spark, f"{folder}/b.gz", {"x": 1}, scale=1.0).first()["t"] == 3.0
    assert S.last_times(spark, f"{folder}/none.*", {"x": 1}).collect() == []


def test_lines_keep_their_order_over_parts(spark, folder):
    """A file read in many small parts, which Spark packs by size."""
    path = save(folder, "long.txt", "".join(f"{k}\n" for k in range(60_000)))
    save(folder, "short.txt", "0\n1\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 100)
        rows = S.lines(spark, [path, f"{folder}/short.txt"]).orderBy("file", "row").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["value"] for r in rows] == [*map(str, range(60_000)), "0", "1"] and len({(r["file"], r["row"]) for r in rows}) == len(rows)


def test_cache_follows_its_sources(spark, folder, tmp_path):
    path = save(folder, "s.1", "1 2\n2 3\n3 4\n")
    read = lambda: sinks.cached(spark, f"{tmp_path}/c", ["x"], lambda: S.read_series(spark, path, {"x": 1}), path).count()
    assert read() == 3 == read()
    save(folder, "s.1", "".join(f"{k} 1\n" for k in range(9)))
    assert read() == 9
    save(folder, "s.1", "".join(f"{k} 2\n" for k in range(9)))  # as long as before
    os.utime(path, (time.time() + 5,) * 2)
    again = sinks.cached(spark, f"{tmp_path}/c", ["x"], lambda: S.read_series(spark, path, {"x": 1}), path)
    assert again.agg(F.sum("x")).first()[0] == 18.0


def test_cache_by_file_reads_changed_files_only(spark, folder, tmp_path):
    for k in range(4):
        save(folder, f"s.{k}", f"1 {k}\n2 {k}\n")
    save(folder, "s.9", "# no rows\n")
    made = []

    def make(files):
        made.append(sorted(f[-1] for f in files))
        return S.read_series(spark, files, {"x": 1}) if files else S.read_series(spark, f"{folder}/s.9", {"x": 1})

    read = lambda: sorted((r["walker"], r["x"]) for r in sinks.cached_by_file(spark, f"{tmp_path}/c", ["x"], f"{folder}/s.*", make).collect())
    everything = [(k, float(k)) for k in range(4) for _ in range(2)]
    assert read() == everything == read() and made == [["0", "1", "2", "3", "9"]]
    save(folder, "s.2", "1 7\n2 7\n3 7\n")
    os.remove(f"{folder}/s.0")
    save(folder, "s.5", "1 5\n")
    assert read() == sorted([(1, 1.0)] * 2 + [(2, 7.0)] * 3 + [(3, 3.0)] * 2 + [(5, 5.0)]) and made[1:] == [["2", "5"]]
    # What an interrupted write left behind is not listed and not read.
    os.makedirs(f"{tmp_path}/c/rows-left/_entry=x")
    assert len(read()) == 8 and len(made) == 2


def test_too_few_matches_are_an_error(spark):
    frames = spark.range(100)
    joined = lambda n: frames.withColumn("v", F.when(F.col("id") < n, 1.0))
    assert selection.matched_enough(frames, joined(95), F.col("v").isNotNull()).count() == 100
    with pytest.raises(ValueError, match="only 94 of 100"):
        selection.matched_enough(frames, joined(94), F.col("v").isNotNull())
