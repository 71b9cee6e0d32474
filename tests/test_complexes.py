"""Periodic complexes, secondary structure, helix windows and two-pass fluctuations against plain numpy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordframe.operators import helices as H
from fjordframe.operators import periodic as P
from fjordframe.operators import structure as A

BOXES = [(1.0, 0.0, 1.0, 0.0, 0.0, 1.0), (1.1, 0.4, 0.9, -0.3, 0.35, 0.8), (0.7, -0.3, 1.4, 0.2, -0.5, 0.6)]
EDGES = "frame long, ax double, bx double, by double, cx double, cy double, cz double"
ATOMS = "frame long, molecule int, atom int, x double, y double, z double"


def lattice(box):
    ax, bx, by, cx, cy, cz = box
    return np.array([[ax, 0, 0], [bx, by, 0], [cx, cy, cz]])


def least(a, b, box, own=False, reach=6):
    """(distance, shift) of the nearest image of b to a, all images tried; the middle is brought near first."""
    cell = lattice(box)
    middle = np.rint((a.mean(axis=0) - b.mean(axis=0)) @ np.linalg.inv(cell)).astype(int)
    found = []
    for s in itertools.product(range(-reach, reach + 1), repeat=3):
        s = tuple(int(x) for x in np.array(s) + middle)
        if not own or s > (0, 0, 0):
            found.append((np.sqrt(((a[:, None] - b[None] - np.array(s) @ cell) ** 2).sum(axis=-1)).min(), s))
    return min(found)


@pytest.fixture(scope="module")
def complexes(spark):
    """Frames of one to four molecules, apart by up to three boxes, in three shapes of box."""
    rng = np.random.default_rng(7)
    rows, boxes, shapes = [], [], {}
    for frame in range(24):
        box, n = BOXES[frame % 3], frame % 4 + 1
        boxes.append((frame, *box))
        for m in range(n):
            size = int(rng.integers(1, 6))
            spots = np.cumsum(rng.normal(0, 0.06, (size, 3)), axis=0) + rng.uniform(-1, 1, 3) + rng.integers(-3, 4, 3) @ lattice(box)
            shapes[frame, m] = spots
            scattered = spots + rng.integers(-1, 2, (size, 3)) @ lattice(box)  # atoms in different boxes
            scattered[0] = spots[0]
            rows += [(frame, m, 10 * m + k, *map(float, s)) for k, s in enumerate(scattered)]
    return spark.createDataFrame(rows, ATOMS), spark.createDataFrame(boxes, EDGES), shapes


@pytest.mark.parametrize("first", [0.05, 0.5, 5.0])
def test_clusters_like_all_images(complexes, first):
    coords, boxes, shapes = complexes
    got = {}
    for r in P.clustered(coords, boxes, "molecule", first).orderBy("atom").collect():
        got.setdefault((r["frame"], r["molecule"]), []).append([r["x"], r["y"], r["z"]])
    for frame in range(24):
        box, n = BOXES[frame % 3], frame % 4 + 1
        placed = {0: shapes[frame, 0]}
        edges = {(a, b): least(shapes[frame, a], shapes[frame, b], box) for a in range(n) for b in range(a + 1, n)}
        shift = {0: np.zeros(3, int)}
        while len(shift) < n:
            (d, s), (a, b) = min((v, k) for k, v in edges.items() if (k[0] in shift) != (k[1] in shift))
            old, new, sign = (a, b, 1) if a in shift else (b, a, -1)
            shift[new] = shift[old] + sign * np.array(s)
            placed[new] = shapes[frame, new] + shift[new] @ lattice(box)
        for m in range(n):
            assert np.allclose(got[frame, m], placed[m], atol=1e-9), (frame, m)


@pytest.mark.parametrize("first", [0.05, 1.0])
def test_own_images_like_all_images(spark, first):
    rng = np.random.default_rng(3)
    rows, boxes, shapes = [], [], {}
    for frame in range(12):
        shapes[frame] = rng.normal(0, 0.5 if frame % 2 else 0.1, (int(rng.integers(1, 9)), 3))
        boxes.append((frame, *BOXES[frame % 3]))
        rows += [(frame, 0, k, *map(float, s)) for k, s in enumerate(shapes[frame])]
    coords, box = spark.createDataFrame(rows, ATOMS), spark.createDataFrame(boxes, EDGES)
    near = {r["frame"]: r for r in P.self_image(coords, box, first).collect()}
    report = {r["frame"]: r for r in P.image_report(coords, box, first).collect()}
    for frame, spots in shapes.items():
        d, s = least(spots, spots, BOXES[frame % 3], own=True)
        r = near[frame]
        assert r["d"] == pytest.approx(d, abs=1e-12)
        there = spots[r["atom_b"]] + np.array([r["su"], r["sv"], r["sw"]]) @ lattice(BOXES[frame % 3])
        assert np.linalg.norm(spots[r["atom_a"]] - there) == pytest.approx(d, abs=1e-12) and (r["su"], r["sv"], r["sw"]) > (0, 0, 0)
        assert report[frame]["dist"] == r["d"] and report[frame]["longest"] == pytest.approx(np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(axis=-1)).max(), abs=1e-12)
        assert [report[frame][f"box_{c}"] for c in "xyz"] == pytest.approx(np.linalg.norm(lattice(BOXES[frame % 3]), axis=1).tolist())


def test_frames_without_box_or_atoms(spark):
    coords, box = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0), (2, 0, 0, 0.0, 0.0, 0.0)], ATOMS), spark.createDataFrame([(1, *BOXES[0])], EDGES)
    assert [r["frame"] for r in P.clustered(coords, box, "molecule").collect()] == [1] == [r["frame"] for r in P.self_image(coords, box).collect()]
    none = coords.where("frame > 5")
    assert P.clustered(none, box, "molecule").collect() == P.self_image(none, box).collect() == P.image_report(none, box.where("frame > 5")).collect() == []


def plain_codes(residues, bonds):
    """Codes of one frame by the definitions; residues: {(chain, number): run}, bonds: {(acceptor, donor)}."""
    has = lambda a, d: (a, d) in bonds
    step = lambda r, n: (r[0], r[1] + n)
    linked = lambda r, n: residues.get(r) == residues.get(step(r, n)) and r in residues and step(r, n) in residues
    code = dict.fromkeys(residues, "-")
    inner = [r for r in residues if linked(r, -1) and linked(r, 1)]
    for i in inner:
        for j in inner:
            if i[0] == j[0] and abs(i[1] - j[1]) <= 2:
                continue
            parallel = has(step(i, -1), j) and has(j, step(i, 1))
            crossed = (has(i, j) and has(j, i)) or (has(step(i, -1), step(j, 1)) and has(step(j, -1), step(i, 1)))
            if parallel or crossed:
                code[i] = code[j] = "E"
    turn = lambda r, n: linked(r, n) and has(r, step(r, n))
    for n, letter in ((4, "H"), (3, "G"), (5, "I")):
        new = {}
        for r in residues:
            if linked(r, -1) and turn(step(r, -1), n) and turn(r, n):
                held = [step(r, k) for k in range(n)]
                if letter == "H" or all(code[x] == "-" for x in held):
                    new |= dict.fromkeys(held, letter)
        code |= new
    return code


def test_codes_by_the_definitions(spark):
    """Dense random bonds, so that helices and bridges of all kinds come up, over two chains with gaps."""
    rng = random.Random(5)
    rows, bonds, want = [], [], {}
    for frame in range(60):
        residues = {}
        for chain, size in (("A", 18), ("B", 9)):
            numbers = [n for n in range(1, size + 1) if not (n == 7 and frame % 3 == 0)]
            residues |= {(chain, n): n - k for k, n in enumerate(numbers, 1)}
        names = list(residues)
        own = set()
        kinds = [[3], [4], [5], [3, 4, 5]][frame % 4]
        for chain, n in names:
            if rng.random() < 0.6 and (chain, n + (k := rng.choice(kinds))) in residues and residues[chain, n] == residues[chain, n + k]:
                own.add(((chain, n), (chain, n + k)))
        for _ in range(40 if frame % 2 else 5):
            a, d = rng.choice(names), rng.choice(names)
            if a != d:
                own |= {(a, d), *([(d, a)] if rng.random() < 0.5 else [])}
        rows += [(frame, c, n, run) for (c, n), run in residues.items()]
        bonds += [(frame, d[0], d[1], residues[d], a[0], a[1], residues[a], -1.0) for a, d in own]
        want |= {(frame, *r): c for r, c in plain_codes(residues, own).items()}
    residues = spark.createDataFrame(rows, "frame long, chain string, resnum int, run int")
    table = spark.createDataFrame(bonds, "frame long, d_chain string, d int, d_run int, a_chain string, a int, a_run int, energy double")
    got = {(r["frame"], r["chain"], r["resnum"]): r["code"] for r in H.assigned(residues, table).collect()}
    assert got == want and set(want.values()) == set("HEGI-")


def peptide(spark, residues=range(1, 13), frame=1, moved=0.0, names=H.WINDOW_ATOMS):
    rng = np.random.default_rng(frame)
    spots = H.ideal_helix(len(residues)) + rng.normal(0, moved, (5 * len(residues), 3)) if moved else H.ideal_helix(len(residues))
    rows = [(frame, "A", r, name, *map(float, spots[5 * k + i])) for k, r in enumerate(residues) for i, name in enumerate(H.WINDOW_ATOMS) if name in names]
    return spark.createDataFrame(rows, "frame long, chain string, resnum int, name string, x double, y double, z double")


def test_an_ideal_helix_is_one(spark):
    codes = {r["resnum"]: r["code"] for r in H.secondary_structure(peptide(spark)).collect()}
    assert [codes[r] for r in range(1, 13)] == ["-", *["H"] * 10, "-"]
    assert H.helicity(H.secondary_structure(peptide(spark)), (2, 11)).first()[1:] == (1.0, 0.0)
    # Without a residue in the middle the halves are too short; a proline gives no bond.
    gap = {r["resnum"]: r["code"] for r in H.secondary_structure(peptide(spark).where("resnum <> 6")).collect()}
    assert set(gap.values()) == {"-", "H"} and [gap[r] for r in range(1, 6)] == ["-"] * 5
    proline = H.backbone(peptide(spark).withColumn("resname", F.when(F.col("resnum") == 8, "PRO").otherwise("ALA")))
    assert {r["resnum"] for r in proline.where("NOT donor").collect()} == {1, 8}
    assert not H.hydrogen_bonds(proline).where("d = 8").collect()


def test_windows_by_numpy(spark):
    ideal = H.ideal_helix(6)
    coords = peptide(spark, moved=0.05).unionByName(peptide(spark, [1, 2, 3, 4, 6, 7, 8, 9, 10, 11], 2, 0.05)).unionByName(peptide(spark, [1, 2, 3], 3))
    rows = {(r["frame"], r["first"]): np.array(r["w"]).reshape(-1, 3) for r in H.window_arrays(coords, 6).collect()}
    assert set(rows) == {(1, k) for k in range(1, 8)} | {(2, 6)}
    far = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1))
    wanted = np.triu(far(ideal) > 0.17)
    plain = {k: np.sqrt(((far(w) - far(ideal))[wanted] ** 2).mean()) for k, w in rows.items()}
    laid = {k: A.kabsch(w[None], ideal[None])[1][0] for k, w in rows.items()}
    for superpose, want in ((False, plain), (True, laid)):
        got = {(r["frame"], r["first"]): r["d"] for r in H.window_deviations(H.window_arrays(coords, 6), ideal, superpose).collect()}
        assert got == pytest.approx(want, abs=1e-9)
        sums = {r["frame"]: r["helix"] for r in H.helix_windows(coords, ideal, superpose=superpose).collect()}
        assert sums == pytest.approx({f: sum((1 - (d / 0.08) ** 8) / (1 - (d / 0.08) ** 12) for (g, _), d in want.items() if g == f) for f in (1, 2, 3)}, abs=1e-9)
    edge = spark.createDataFrame([(0.08,), (0.0,)], "d double").select(H.window_switch(F.col("d"), 0.08).alias("s")).collect()
    assert [r["s"] for r in edge] == [pytest.approx(8 / 12), 1.0]


def test_fluctuations_after_two_passes(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (9, 3))
    turn = lambda: np.linalg.qr(rng.normal(0, 1, (3, 3)))[0]
    shapes, weights, walkers = [], [], []
    for k in range(60):
        q = turn()
        q[:, 0] *= np.sign(np.linalg.det(q))
        shapes.append((base + rng.normal(0, 0.1, base.shape)) @ q + rng.normal(0, 3, 3))
        weights.append(float(rng.choice([0.0, 0.5, 2.0])) if k else 0.0)
        walkers.append(k % 4)
    rows = [(k, a, *map(float, s)) for k, x in enumerate(shapes) for a, s in enumerate(x)]
    coords = spark.createDataFrame(rows, "frame long, atom int, x double, y double, z double").repartition(5)
    frames = spark.createDataFrame([(k, w, v) for k, (w, v) in enumerate(zip(weights, walkers, strict=True))], "frame long, w double, walker int")
    fit = [0, 2, 3, 5, 6]
    kept = [k for k, w in enumerate(weights) if w > 0]
    x, w, v = np.array(shapes)[kept], np.array(weights)[kept], np.array(walkers)[kept]

    def over(x, fixed):
        out = []
        for s in x:
            a, b = s[fit] - s[fit].mean(axis=0), fixed[fit] - fixed[fit].mean(axis=0)
            u, _, t = np.linalg.svd(a.T @ b)
            u[:, 2] *= np.sign(np.linalg.det(u @ t))
            out.append((s - s[fit].mean(axis=0)) @ u @ t + fixed[fit].mean(axis=0))
        return np.array(out)

    mean = lambda x: np.tensordot(w / w.sum(), x, axes=(0, 0))
    x = over(x, x[0])
    x = over(x, mean(x))
    square = ((x - mean(x)) ** 2).sum(axis=2)
    rmsf = np.sqrt((w[:, None] * square).sum(axis=0) / w.sum())
    err = np.std([np.sqrt((w[v == r, None] * square[v == r]).sum(axis=0) / w[v == r].sum()) for r in range(4)], axis=0, ddof=1)
    got = A.superposed_fluctuation(coords, frames, fit).orderBy("atom").collect()
    assert [r["rmsf"] for r in got] == pytest.approx(rmsf.tolist(), abs=1e-9)
    assert [r["err"] for r in got] == pytest.approx(err.tolist(), abs=1e-9)
    assert [r["raw"] for r in got] == pytest.approx(np.sqrt(square.mean(axis=0)).tolist(), abs=1e-9)
    assert A.superposed_fluctuation(coords, frames.where("w < 0"), fit).collect() == []


def test_components_by_labels_like_the_walk(spark):
    """Mazes of one path, combs, rings and random cells: labelled runs give the walked component."""
    from fjordframe.operators import grid as G

    rng = random.Random(2)
    snake = {(i, j) for i in range(0, 24, 2) for j in range(20)} | {(i, 19 if i % 4 == 1 else 0) for i in range(1, 23, 2)}
    comb = {(0, j) for j in range(21)} | {(i, j) for i in range(1, 12) for j in range(0, 21, 2)}
    ring = {(i, j) for i in range(9) for j in range(9) if i in (0, 8) or j in (0, 8)} | {(4, 4)}
    shapes = [(snake, (0, 0)), (comb, (11, 20)), (ring, (4, 4)), (ring, (8, 8)), ({(i, j) for i in range(-9, 9) for j in range(-9, 9) if rng.random() < 0.6}, (0, 0))]
    for cells, seed in shapes:
        cells = cells | {seed}
        table = spark.createDataFrame(sorted(cells), "i int, j int")
        start = spark.createDataFrame([seed], "i int, j int")
        walked = sorted(map(tuple, G.component_of(table, start).collect()))
        assert sorted(map(tuple, G.component_of(table, start, 0).collect())) == walked
    assert G.component_of(table, spark.createDataFrame([(99, 99)], "i int, j int"), 0).collect() == []
