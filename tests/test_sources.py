"""Readers and writers on hand-written files."""

import pytest
from pyspark.sql import functions as F

from fjordframe.functions.ranges import format_ranges, parse_ranges
from fjordframe.sources import sinks
from fjordframe.sources import text as S


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "colvar.0").write_text("#! FIELDS time q theta_A\n0 0.1 1.0\n100 0.2\n200 nan 1.0\n300 0.4 2.0 9\n300 0.5 3.0\n400 0.")
    (tmp_path / "hills.dat.3").write_text("! made\n# x\n0 1.0 0.1 0.5 10 1\n1 2.0 0.1 0.4 10 1\n")
    (tmp_path / "a.xvg").write_text("# c\n@ t\n0 1 2\n1 2 3\n")
    (tmp_path / "a.pdb").write_text("REMARK\nATOM     12  CA  ALA A  21      11.104   6.134  -6.504  1.00  0.00           C\nTER\n")
    (tmp_path / "a.gro").write_text("title\n    1\n    1ALA     CA    7   1.000   2.000   3.000\n   5.0   5.0   5.0\n")
    (tmp_path / "fes.dat").write_text("#! FIELDS a b f\n0.5 1 3.0\n0.0 1 1.0\n0.0 2 2.0\n0.5 2 inf\n")
    (tmp_path / "map.txt").write_text("0 9 0.55\n3 8 0.60\n")
    (tmp_path / "map.dat").write_text("ATOMS1=1,10 SWITCH1={Q R_0=0.1 BETA=50 LAMBDA=1 REF=0.55} WEIGHT1=0.5\n")
    return tmp_path


def test_series(spark, folder):
    rows = S.read_series(spark, str(folder / "colvar.0"), {"q": 1, "s": [1, 2]})
    got = [(r["walker"], r["t"], r["q"], r["s"]) for r in rows.orderBy("row").collect()]
    assert [(w, round(t, 3), q) for w, t, q, _ in got] == [(0, 0.0, 0.1), (0, 0.3, 0.4), (0, 0.3, 0.5)]
    assert got[0][3] == pytest.approx(1.1)
    assert S.skipped_lines(spark, str(folder / "colvar.0"), 2).first().asDict() == {"kept": 4, "skipped": 2}
    assert S.last_time(rows).first()["t"] == pytest.approx(0.3)


def test_header_names_and_copies(spark, folder):
    path = str(folder / "colvar.0")
    assert S.header_fields(spark, path) == ["time", "q", "theta_A"]
    rows = S.read_with_header(spark, path, {"time": "t"}, ["q"])
    assert rows.columns == ["row", "t", "q", "theta_A"] and rows.count() == 2
    long = S.copies_of(rows.drop("row"), ["t"])
    assert {(r["observable"], r["copy"]) for r in long.collect()} == {("q", ""), ("theta", "A")}
    with pytest.raises(ValueError):
        S.read_with_header(spark, path, required=["nothing"])


def test_hills_and_tables(spark, folder):
    h = S.read_hills(spark, str(folder / "hills.dat.*"), 1)
    assert [tuple(r) for r in h.select("walker", "t", "centre", "sigma", "height", "biasf").orderBy("t").collect()] == [(3, 0.0, [1.0], [0.1], 0.5, 10.0), (3, 1.0, [2.0], [0.1], 0.4, 10.0)]
    assert S.first_bias_factor(h).first()["gamma"] == 10.0
    assert S.read_xvg(spark, str(folder / "a.xvg"), ["t", "d", "e"]).count() == 2
    g = {(r["i"], r["j"]): r["f"] for r in S.read_grid(spark, str(folder / "fes.dat"), 2).collect()}
    assert g[0, 0] == 1.0 and g[0, 1] == 2.0 and g[1, 0] == 3.0 and len(g) == 4


def test_structures(spark, folder):
    a = S.read_pdb(spark, str(folder / "a.pdb"))
    assert tuple(a.drop("row").first()) == (12, "CA", "ALA", "A", 21, 11.104, 6.134, -6.504)
    assert sinks.pdb_lines(a).first()["line"].startswith("ATOM     12 CA   ALA A  21      11.104   6.134  -6.504")
    assert tuple(S.read_gro(spark, str(folder / "a.gro")).drop("row").first()) == (1, "ALA", "CA", 7, 1.0, 2.0, 3.0)
    assert S.read_contacts(spark, str(folder / "map.txt")).count() == 2
    assert tuple(S.read_contact_block(spark, str(folder / "map.dat")).first()) == (1, 10, 0.55, 0.5)


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([(1, 0.5), (0, 2.0)], "k int, f double")
    sinks.archive(t, f"{tmp_path}/a", ["k"], {"panel": {"kbt": 2.5}})
    sinks.upsert_meta(spark, f"{tmp_path}/a.meta", {"panel": {"n": 2}, "other": 1})
    merged = sinks.upsert_meta(spark, f"{tmp_path}/a.meta", {})
    assert merged == {"panel": {"kbt": 2.5, "n": 2}, "other": 1}
    sinks.export_text(t, f"{tmp_path}/t", ["k"], "k f")
    assert [[float(x) if x[0].isdigit() else x for x in r["value"].split()] for r in spark.read.text(f"{tmp_path}/t").collect()] == [["#", "k", "f"], [0, 2], [1, 0.5]]
    made = []
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/c", ["x", 1], lambda: made.append(1) or t).count() == 2
    assert len(made) == 1


def test_ranges(spark):
    r = spark.createDataFrame([("27-29,31",), ("5",), ("1-4",)], "t string").select(parse_ranges(F.col("t")).alias("v"))
    assert [x[0] for x in r.select(format_ranges(F.col("v"))).collect()] == ["27,28,29,31", "5", "1-4"]


def test_missing_files_and_long_headers(spark, folder):
    path = str(folder / "long.dat")
    (folder / "long.dat").write_text("\n".join(f"# line {k}" for k in range(500)) + "\n# a b(nm)\n1 2\n# late\n3 4\n")
    assert len(S.header(spark, path)) == 501 and S.header_fields(spark, path) == ["a", "b"]
    assert S.read_with_header(spark, path).count() == 2
    assert S.read_with_header(spark, str(folder / "none"), missing_ok=True) is None and S.read_meta(spark, str(folder / "none")) == {}
    with pytest.raises(FileNotFoundError):
        S.read_hills(spark, str(folder / "none.*"), 1)
    assert [p.rsplit("/", 1)[1] for p in S.found_paths(spark, str(folder / "a.*"))] == ["a.gro", "a.pdb", "a.xvg"]
    saved = S.read_saved(spark, {"one": [path], "two": [path, str(folder / "none")]}, ["a", "b"])
    assert {(r["name"], r["a"]) for r in saved.collect()} == {("one", 1.0), ("one", 3.0)}
    assert S.read_saved(spark, {"two": [str(folder / "none")]}, ["a"]).count() == 0
    assert [r["c"] for r in S.read_table(spark, path, ["a", "b"], ["c"]).collect()] == [None, None]
    with pytest.raises(ValueError):
        S.read_table(spark, path, ["a", "b"], ["c"], ["c"])


def test_broken_structure_lines_are_left_out(spark, tmp_path):
    (tmp_path / "b.pdb").write_text("ATOM     12  CA  ALA A  21      11.104   6.134  -6.504\nATOM     xx  CA  ALA A  21      11.104   6.134  -6.504\nATOM\n")
    assert S.read_pdb(spark, str(tmp_path / "b.pdb")).count() == 1


def test_group_and_contact_lines(spark):
    from fjordframe.operators import structure

    atoms = spark.createDataFrame([("tail", k) for k in (3, 4, 5)] + [("dna", k) for k in (9, 7)], "g string, serial int")
    assert {tuple(r) for r in structure.group_lines(atoms, "g").collect()} == {("tail", "tail: GROUP ATOMS=3-5"), ("dna", "dna: GROUP ATOMS=7,9")}
    lines = structure.contact_lines(spark.createDataFrame([(2, 9, 0.5), (0, 4, 0.25)], "a int, b int, ref double"))
    assert {r["line"] for r in lines.collect()} == {"ATOMS1=1,5 REFERENCE1=0.250000 WEIGHT1=0.500000", "ATOMS2=3,10 REFERENCE2=0.500000 WEIGHT2=0.500000"}


def test_text_trajectories(spark, tmp_path):
    atoms = "".join(f"{k:5d}{'ALA':<5s}{'CA':>5s}{k:5d}{k / 10:8.3f}{{0}}{0:8.3f}\n" for k in (1, 2))
    gro = "".join(f"box of it t= {t:.5f} step= {f}\n    2\n" + atoms.format(f"{f:8.3f}") + "   5.0   5.0   5.0\n" for f, t in enumerate([0.0, 10.0, 20.5]))
    (tmp_path / "a.gro").write_text(gro)
    got = {(r["frame"], r["t"], r["atom"], r["x"], r["y"]) for r in S.read_gro_frames(spark, str(tmp_path / "a.gro")).collect()}
    assert got == {(f, t, k, k / 10, float(f)) for f, t in enumerate([0.0, 10.0, 20.5]) for k in (1, 2)}
    line = "ATOM     12  CA  ALA A  21      {:6.3f}   6.134  -6.504\n"
    (tmp_path / "m.pdb").write_text("REMARK\n" + "".join(f"MODEL        {k}\n" + line.format(k) + "ENDMDL\n" for k in range(1, 4)))
    assert {(r["frame"], r["serial"], r["x"]) for r in S.read_models(spark, str(tmp_path / "m.pdb")).collect()} == {(k - 1, 12, float(k)) for k in range(1, 4)}


def test_thermodynamic_summary(spark, tmp_path):
    (tmp_path / "e.log").write_text("Statistics over 5 steps\nEnergy    Average  Err.Est.  RMSD  Tot-Drift\n-----\nTemperature  300.1  0.02  1.5  -0.1  (K)\nPressure  1.0  --  2.0  0.1  (bar)\nDensity 990.5 0.1 2 3 (kg/m^3)\nTemperature\n")
    got = [tuple(r) for r in S.read_thermo(spark, str(tmp_path / "e.log"), ["Temperature", "Pressure", "Density"]).collect()]
    assert sorted(got) == [("Density", 990.5, 0.1, 2.0, 3.0), ("Temperature", 300.1, 0.02, 1.5, -0.1)]


def test_sections_of_an_input(spark, tmp_path):
    (tmp_path / "in.dat").write_text("a\ntail: A=1-9\nq: RES=64-91\nwall: x\ntail: again\n")
    path = str(tmp_path / "in.dat")
    assert [r["value"] for r in S.text_section(spark, path, "tail:", "wall:", {"64-91": "64-93"}).orderBy("row").collect()] == ["tail: A=1-9", "q: RES=64-93"]
    with pytest.raises(ValueError):
        S.text_section(spark, path, "wall:", "nothing:")
