"""Piecewise linear surfaces through scattered points: Delaunay triangles in a table, and values at other points from them.

A surface is a group of nodes (x, y, f); surfaces are triangulated beside each other, each by one task, as many nodes as a
surface has (grids and bins bound them; a surface of n nodes takes time in n squared on arrays). Points meet the triangles of their
cell only, so any number of them is looked up by a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordframe.functions.shipping import shipped

#: Shift, as a share of the nodes' extent, that settles which of several equal triangulations is taken; values use the nodes as they are.
SHIFT = 1e-7
_TRIANGLE = "triangle long, x1 double, y1 double, f1 double, x2 double, y2 double, f2 double, x3 double, y3 double, f3 double"


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Above 0 where a, b, c go to the left."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _encircles(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Above 0 where p lies inside of the circle through a, b, c, which go to the left."""
    (ax, ay), (bx, by), (cx, cy) = ((q - p).T for q in (a, b, c))
    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return aa * (bx * cy - by * cx) - bb * (ax * cy - ay * cx) + cc * (ax * by - ay * bx)


def delaunay(nodes: np.ndarray) -> np.ndarray:
    """(triangles, 3): places of the corners of the Delaunay triangles of different nodes (n, 2), each going to the left, none flat.

    Nodes are added one by one: the triangles whose circles hold the new one go, and their outline is joined to it. Beyond
    each outer edge lies a triangle with an endless corner (-1), whose circle is the outer half plane. The nodes are shifted a
    little, by their places, so that no four lie on a circle and no three on a line; triangles that are flat without the shift are left out.
    """
    n = len(nodes)
    extent = np.ptp(nodes, axis=0) if n else np.zeros(2)
    if n < 3 or not extent.max() > 0:
        return np.zeros((0, 3), np.int64)
    spots = (nodes - nodes.min(axis=0)) / extent.max()
    spots = spots + SHIFT * np.random.default_rng(0).uniform(-1, 1, spots.shape)
    first = [0, 1, 2] if _turn(*spots[:3]) > 0 else [0, 2, 1]
    corners = np.full((2 * n + 10, 3), -2)
    corners[:4] = [first, [first[1], first[0], -1], [first[2], first[1], -1], [first[0], first[2], -1]]
    used, free = 4, []
    for k in range(3, n):
        p, now = spots[k], corners[:used]
        real = now[:, 2] >= 0
        hit = np.zeros(used, bool)
        hit[real] = _encircles(spots[now[real, 0]], spots[now[real, 1]], spots[now[real, 2]], p) > 0
        endless = now[:, 2] == -1
        hit[endless] = _turn(spots[now[endless, 0]], spots[now[endless, 1]], p[None]) > 0
        gone = np.flatnonzero(hit)
        edges = np.concatenate([now[gone][:, [i, (i + 1) % 3]] for i in range(3)])
        codes = (edges[:, 0] + 1) * (n + 1) + edges[:, 1] + 1
        outline = edges[~np.isin((edges[:, 1] + 1) * (n + 1) + edges[:, 0] + 1, codes)]
        new = np.column_stack([outline, np.full(len(outline), k)])
        new = np.where((new[:, :1] == -1), new[:, [1, 2, 0]], np.where(new[:, 1:2] == -1, new[:, [2, 0, 1]], new))  # the endless corner last
        corners[gone] = -2
        slots = [*free, *gone.tolist()]
        more = len(new) - len(slots)
        if more > 0:
            slots += range(used, used + more)
            used += more
        free = slots[len(new) :]
        corners[slots[: len(new)]] = new
    found = corners[:used][corners[:used, 2] >= 0]
    area = _turn(nodes[found[:, 0]], nodes[found[:, 1]], nodes[found[:, 2]])
    return found[area > 1e-12 * extent.max() ** 2]


def triangulated(nodes: DataFrame, by: list[str], x: str = "x", y: str = "y", f: str = "f") -> DataFrame:
    """(*by, triangle, x1, y1, f1, ..., f3) of every surface; nodes with a null are left out, of several at one place their mean counts."""
    shipped(nodes.sparkSession)
    rows = nodes.dropna(subset=[x, y, f]).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.avg(f).alias("f"))
    kinds = [rows.schema[c] for c in by]

    def cut(key: tuple, surface: pd.DataFrame) -> pd.DataFrame:
        table = surface.sort_values(["x", "y"], ignore_index=True)
        corners = delaunay(table[["x", "y"]].to_numpy())
        values = table[["x", "y", "f"]].to_numpy()[corners].reshape(len(corners), 9)
        out = pd.DataFrame(values, columns=[f"{c}{k}" for k in (1, 2, 3) for c in ("x", "y", "f")])
        out.insert(0, "triangle", np.arange(len(out)))
        for place, (name, value) in enumerate(zip(by, key, strict=True)):
            out.insert(place, name, value)
        return out

    kind = ", ".join([*(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds), _TRIANGLE])
    return rows.groupBy(*by).applyInPandas(cut, kind)


def simplex_values(points: DataFrame, triangles: DataFrame, by: list[str], key: list[str], x: str = "x", y: str = "y", out: str = "f", cells: int = 64) -> DataFrame:
    """points with out, the linear value in the triangle they lie in; null outside of all triangles of their surface.

    key names a point's row. On an edge both triangles give the same value; the one of the lower number is taken. A surface's extent is
    cut into cells by cells, and a triangle is kept in all that its bounds touch.
    """
    low = {c: F.least(*(F.col(f"{c}{k}") for k in (1, 2, 3))) for c in "xy"}
    high = {c: F.greatest(*(F.col(f"{c}{k}") for k in (1, 2, 3))) for c in "xy"}
    extents = triangles.groupBy(*by).agg(*(f(edge[c]).alias(f"_{n}{c}") for c in "xy" for n, f, edge in (("l", F.min, low), ("h", F.max, high))))
    cell = lambda value, c: F.least(F.floor((value - F.col(f"_l{c}")) / (F.col(f"_h{c}") - F.col(f"_l{c}")) * cells), F.lit(cells - 1))
    held = triangles.join(extents, by) if by else triangles.join(extents)
    held = held.withColumn("_i", F.explode(F.sequence(cell(low["x"], "x"), cell(high["x"], "x")))).withColumn("_j", F.explode(F.sequence(cell(low["y"], "y"), cell(high["y"], "y")))).drop("_lx", "_hx", "_ly", "_hy")
    asked = points.select(*by, *key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    asked = (asked.join(extents, by) if by else asked.join(extents)).where(F.col("_x").between(F.col("_lx"), F.col("_hx")) & F.col("_y").between(F.col("_ly"), F.col("_hy")))
    asked = asked.select(*by, *key, "_x", "_y", cell(F.col("_x"), "x").alias("_i"), cell(F.col("_y"), "y").alias("_j"))
    whole = (F.col("y2") - F.col("y3")) * (F.col("x1") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("y1") - F.col("y3"))
    a = ((F.col("y2") - F.col("y3")) * (F.col("_x") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("_y") - F.col("y3"))) / whole
    b = ((F.col("y3") - F.col("y1")) * (F.col("_x") - F.col("x3")) + (F.col("x1") - F.col("x3")) * (F.col("_y") - F.col("y3"))) / whole
    met = asked.join(held, [*by, "_i", "_j"]).withColumns({"_a": a, "_b": b}).where((F.col("_a") >= -1e-9) & (F.col("_b") >= -1e-9) & (F.col("_a") + F.col("_b") <= 1 + 1e-9))
    value = F.col("_a") * F.col("f1") + F.col("_b") * F.col("f2") + (1 - F.col("_a") - F.col("_b")) * F.col("f3")
    found = met.groupBy(*by, *key).agg(F.min_by(value, "triangle").alias(out))
    return points.join(found, [*by, *key], "left")
