"""Delaunay triangles and linear values against all triangles and hand-made surfaces."""

import itertools

import numpy as np
import pytest

from fjordframe.operators import simplex as X

NODES = "g int, x double, y double, f double"


def every(nodes):
    """All triangles whose circle is empty, tried one by one."""
    found = set()
    for t in itertools.combinations(range(len(nodes)), 3):
        a, b, c = nodes[list(t)]
        turn = np.sign(X._turn(a, b, c))
        rest = [k for k in range(len(nodes)) if k not in t]
        if turn and not (turn * X._encircles(*(np.broadcast_to(q, (len(rest), 2)) for q in (a, b, c)), nodes[rest]) > 0).any():
            found.add(t)
    return found


@pytest.mark.parametrize("n", [3, 4, 5, 9, 25])
def test_triangles_like_all_circles(n):
    rng = np.random.default_rng(n)
    for _ in range(5):
        nodes = rng.normal(0, [3, 0.2], (n, 2))
        corners = X.delaunay(nodes)
        assert {tuple(sorted(t)) for t in corners.tolist()} == every(nodes)
        assert (X._turn(*(nodes[corners[:, k]] for k in range(3))) > 0).all()


def test_lattices_lines_and_few_nodes():
    """Four on a circle, many on a line: some triangulation of all the area, no flat triangle."""
    grid = np.array([(i, j) for i in range(12) for j in range(9)], float)
    corners = X.delaunay(grid)
    area = X._turn(*(grid[corners[:, k]] for k in range(3))) / 2
    assert area.sum() == pytest.approx(88) and np.allclose(area, 0.5) and len(corners) == 176
    line = np.array([(k, 2 * k) for k in range(10)], float)
    assert len(X.delaunay(line)) == 0 and len(X.delaunay(line[:2])) == 0 and len(X.delaunay(np.zeros((0, 2)))) == 0
    big = np.random.default_rng(1).uniform(0, 1, (2000, 2))
    corners = X.delaunay(big)
    edges = {tuple(sorted(e)) for t in corners.tolist() for e in itertools.combinations(t, 2)}
    assert len(edges) == len(big) + len(corners) - 1  # Euler


def test_values_of_hand_made_surfaces(spark):
    # Surface 1: two triangles of a square with a peak at one corner; surface 2: a plane through scattered nodes; surface 3: a line.
    rng = np.random.default_rng(4)
    plane = lambda x, y: 3 * x - 2 * y + 1
    rows = [(1, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (1, 1.1, 1.1, 6.0)]
    rows += [(2, float(x), float(y), float(plane(x, y))) for x, y in rng.uniform(-5, 5, (60, 2))] + [(2, 0.0, 0.0, None)]
    rows += [(2, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 3.0)]  # one place twice: its mean is on the plane
    rows += [(3, float(k), float(k), 1.0) for k in range(5)]
    triangles = X.triangulated(spark.createDataFrame(rows, NODES), ["g"])
    asked = [(1, 1, 0.25, 0.25), (1, 2, 0.5, 0.5), (1, 3, 1.1, 1.1), (1, 4, 0.0, 1.0), (1, 5, -0.01, 0.5), (1, 6, 1.2, 1.2), (1, 7, 0.5, 0.0), (1, 8, 0.8, 0.8), (3, 9, 1.0, 1.0), (4, 10, 0.0, 0.0)]
    inside = rng.uniform(-3, 3, (300, 2))
    asked += [(2, 100 + k, float(x), float(y)) for k, (x, y) in enumerate(inside)] + [(2, 900, 9.0, 0.0), (2, 901, None, 0.0)]
    points = spark.createDataFrame(asked, "g int, k int, x double, y double")
    for cells in (1, 7, 64):
        got = {r["k"]: r["f"] for r in X.simplex_values(points, triangles, ["g"], ["k"], cells=cells).collect()}
        assert len(got) == len(asked)
        assert [got[k] for k in (5, 6, 9, 10, 900, 901)] == [None] * 6
        assert [got[k] for k in (1, 2, 3, 4, 7)] == pytest.approx([0, 0, 6, 0, 0], abs=1e-9)
        assert got[8] == pytest.approx(3.0)
        assert [got[100 + k] for k in range(300)] == pytest.approx([plane(x, y) for x, y in inside], abs=1e-9)


def test_one_surface_without_a_name(spark):
    nodes = spark.createDataFrame([(0.0, 0.0, 1.0), (2.0, 0.0, 3.0), (0.0, 2.0, 5.0)], "x double, y double, f double")
    triangles = X.triangulated(nodes, [])
    got = X.simplex_values(spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0)], "k int, x double, y double"), triangles, [], ["k"])
    assert {r["k"]: r["f"] for r in got.collect()} == {1: 2.5, 2: None}
