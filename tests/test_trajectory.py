"""The binary trajectory source: round trips, ranges, chosen atoms, both precisions, half frames."""

import struct

import numpy as np
import pytest

from fjordframe.sources import trajectory as T


def frames(n, atoms=7, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, k * 0.5, rng.uniform(1, 2, 9).astype(np.float32).tolist() if k % 3 else None, rng.normal(0, 1, atoms * 3).astype(np.float32).tolist()) for k in range(n)]


SCHEMA = "step int, t double, box array<double>, xyz array<float>"


def read(spark, path, **options):
    return {r["step"]: (r["t"], r["box"], list(r["atoms"]), list(r["xyz"])) for r in T.read_trajectory(spark, path, **options).collect()}


def test_round_trip_in_ranges(spark, tmp_path):
    rows, path = frames(60), f"{tmp_path}/run"
    T.write_trajectory(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    want = {k: (t, box, list(range(1, 8)), xyz) for k, t, box, xyz in rows}
    for size in (T.RANGE, 1000, 100, 37):
        assert read(spark, path, range=size) == want
    table = T.read_trajectory(spark, f"{path}/*.trr", range=500)
    assert table.rdd.getNumPartitions() > 10 and table.select("file").distinct().count() == 3
    T.write_trajectory(spark.createDataFrame(rows[:5], SCHEMA).coalesce(1), path, "overwrite")
    assert set(read(spark, path)) == set(range(5))
    T.write_trajectory(spark.createDataFrame(rows[5:9], SCHEMA).coalesce(1), path)
    assert set(read(spark, path)) == set(range(9))


def test_chosen_atoms_and_times(spark, tmp_path):
    rows, path = frames(20), f"{tmp_path}/run"
    T.write_trajectory(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    got = read(spark, path, atoms="5,2-3,99", begin=2.0, end=4.0)
    assert set(got) == {4, 5, 6, 7, 8}
    for k, (_, _, atoms, xyz) in got.items():
        assert atoms == [2, 3, 5] and xyz == [rows[k][3][3 * (a - 1) + c] for a in atoms for c in range(3)]
    assert all(v[2:] == ([], []) for v in read(spark, path, atoms="50").values())
    flat = T.atom_rows(T.read_trajectory(spark, path, atoms="2"), "step").orderBy("step").collect()
    assert [(r["step"], r["atom"], r["x"]) for r in flat] == [(k, 2, pytest.approx(rows[k][3][3])) for k in range(20)]
    boxes = T.boxes_of(T.read_trajectory(spark, path), "step").collect()
    assert {r["step"] for r in boxes} == {k for k in range(20) if k % 3} and all(r["cz"] == rows[r["step"]][2][8] for r in boxes)


def test_double_precision_velocities_and_half_frames(spark, tmp_path):
    """A file with velocities and pressures in double precision, frames without coordinates, and one that is not whole yet."""
    def frame(step, x, v, half=False):
        sizes = [0, 0, 72, 72, 72, 0, 0, 24 * len(x) // 3 if x is not None else 0, 24 * len(v) // 3, 0]
        raw = T.SIGNATURE + struct.pack(">13i", *sizes, len(v) // 3, step, 0) + struct.pack(">dd", step * 2.0, 0.0)
        raw += np.arange(9, dtype=">f8").tobytes() + bytes(144) + (np.asarray(x, ">f8").tobytes() if x is not None else b"") + np.asarray(v, ">f8").tobytes()
        return raw[:-5] if half else raw

    rng = np.random.default_rng(2)
    xs = [rng.normal(0, 1, 12) for _ in range(6)]
    body = b"".join(frame(k, None if k == 3 else x, x * 2, k == 5) for k, x in enumerate(xs))
    (tmp_path / "a.trr").write_bytes(body)
    for size in (T.RANGE, 200):
        got = read(spark, f"{tmp_path}/a.trr", range=size)
        assert set(got) == {0, 1, 2, 4}
        assert all(v[0] == 2.0 * k and v[1] == list(range(9)) and np.allclose(v[3], xs[k], atol=1e-6) for k, v in got.items())


def test_signatures_inside_of_coordinates_are_passed_over(spark, tmp_path):
    """Coordinates that look like a signature, but no header follows."""
    fake = np.frombuffer(T.SIGNATURE + bytes(12), ">f4").astype(np.float32)
    rows = [(k, float(k), None, [*fake.tolist(), *[1.0] * 6]) for k in range(10)]
    path = f"{tmp_path}/run"
    T.write_trajectory(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert set(read(spark, path, range=90)) == set(range(10))


def test_nothing_there(spark, tmp_path):
    (tmp_path / "empty.trr").write_bytes(b"")
    assert T.read_trajectory(spark, str(tmp_path)).collect() == []
    (tmp_path / "junk.trr").write_bytes(b"x" * 5000)
    assert T.read_trajectory(spark, str(tmp_path)).collect() == []
    assert T.header_of(T.SIGNATURE + struct.pack(">13i", *[0] * 7, 5, 0, 0, 3, 0, 0) + bytes(16)) is None
