"""Placed side chains against vectors in numpy."""

import numpy as np
import pytest

from fjordframe.operators import structure as A

ATOMS = "serial int, name string, resname string, chain string, resnum int, x double, y double, z double"


def residue(rng, chain, number, first, names=("N", "CA", "CB", "OG")):
    return [(first + k, n, "SER", chain, number, *map(float, rng.normal(0, 2, 3))) for k, n in enumerate(names)]


def test_aspartates_like_plain_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [r for k in range(6) for r in residue(rng, "AB"[k % 2], 20 + k, 10 * k + 1)] + residue(rng, "A", 40, 100, ("N", "CA", "OG"))
    rows += [(200 + k, n, "SER", "A", 50, float(k), 0.0, 0.0) for k, n in enumerate(("N", "CA", "CB"))]  # on a line
    atoms = spark.createDataFrame(rows, ATOMS)
    sites = spark.createDataFrame([("A", 20), ("A", 22), ("B", 21), ("B", 21), ("A", 40), ("A", 50), ("C", 1)], "chain string, resnum int")
    out = A.side_chain(atoms, sites, A.aspartate(), "ASP").orderBy("serial").collect()
    assert [(r["serial"], r["chain"], r["resnum"], r["name"]) for r in out] == [(203 + 3 * s + k, *site, n) for s, site in enumerate((("A", 20), ("A", 22), ("B", 21))) for k, n in enumerate(("CG", "OD1", "OD2"))]
    unit = lambda v: v / np.linalg.norm(v)
    for s, site in enumerate((("A", 20), ("A", 22), ("B", 21))):
        spot = {r[1]: np.array(r[5:]) for r in rows if (r[3], r[4]) == site}
        x = unit(spot["CB"] - spot["CA"])
        z = unit(np.cross(spot["N"] - spot["CA"], x))
        cg = spot["CB"] + 1.52 * x
        want = [cg, *(cg + 1.25 * (np.cos(2 * np.pi / 3) * x + sign * np.sin(2 * np.pi / 3) * np.cross(z, x)) for sign in (1, -1))]
        assert np.allclose([[r["x"], r["y"], r["z"]] for r in out[3 * s : 3 * s + 3]], want, atol=1e-12)
    changed = A.substituted(atoms, sites, "ASP", ["N", "CA", "CB"], A.aspartate()).collect()
    names = lambda chain, n: sorted((r["name"], r["resname"]) for r in changed if (r["chain"], r["resnum"]) == (chain, n))
    assert names("A", 20) == [(n, "ASP") for n in ("CA", "CB", "CG", "N", "OD1", "OD2")] and names("A", 24) == [(n, "SER") for n in ("CA", "CB", "N", "OG")]
    assert names("A", 40) == [("CA", "SER"), ("N", "SER"), ("OG", "SER")] and len(changed) == len(rows) - 3 + 9


@pytest.mark.parametrize(("angle", "torsion"), [(109.5, 60.0), (90.0, 180.0), (120.0, -75.0)])
def test_internal_coordinates(spark, angle, torsion):
    """The atom placed by length, angle and torsion has them."""
    n, a, b = np.array([0.3, 1.2, -0.4]), np.array([0.0, 0.0, 0.0]), np.array([1.1, 0.5, 0.9])
    rows = [(k, name, "ALA", "A", 1, *map(float, p)) for k, (name, p) in enumerate((("N", n), ("CA", a), ("CB", b)))]
    atoms = spark.createDataFrame(rows, ATOMS)
    r = A.side_chain(atoms, atoms, {"X": A.from_internal(1.5, angle, torsion)}, "ALA").first()
    x = np.array([r["x"], r["y"], r["z"]])
    cosine = (a - b) @ (x - b) / np.linalg.norm(a - b) / np.linalg.norm(x - b)
    p, q = np.cross(a - n, b - a), np.cross(b - a, x - b)
    found = np.degrees(np.arctan2(np.cross(p, q) @ (b - a) / np.linalg.norm(b - a), p @ q))
    assert np.linalg.norm(x - b) == pytest.approx(1.5) and np.degrees(np.arccos(cosine)) == pytest.approx(angle) and (found - torsion + 180) % 360 - 180 == pytest.approx(0, abs=1e-9)


def test_first_residues_lose_their_atoms(spark):
    rows = [(k, n, "DG", c, r, 0.0, 0.0, 0.0) for k, (c, r, n) in enumerate((c, r, n) for c in "ABC" for r in (3, 4) for n in ("P", "O5", "C1"))]
    got = A.without_at_start(spark.createDataFrame(rows, ATOMS), ["P", "O5"], ["B", "C"]).collect()
    assert sorted((r["chain"], r["resnum"], r["name"]) for r in got) == sorted((c, r, n) for c in "ABC" for r in (3, 4) for n in ("P", "O5", "C1") if not (c in "BC" and r == 3 and n != "C1"))
    assert A.without_at_start(spark.createDataFrame(rows, ATOMS), ["P"]).count() == 15
