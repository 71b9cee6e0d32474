"""Complexes in periodic boxes: molecules brought together over images, and distances of a structure to its own images.

Boxes are rows (frame, ax, bx, by, cx, cy, cz), lower triangular and so possibly angled, of positive heights. A part of a frame
(a molecule, or the whole structure) is compared with images of another under a radius: the images are those whose bounds,
in box units, come within the radius by the box's heights; of both parts only atoms near the other's bounds are taken, and
these meet through cells (see functions/cells). Radii double from round to round for the frames that are not settled yet;
a box's edges say where the last round is, so every distance is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordframe.functions.cells import cell_of, copied
from fjordframe.functions.lineage import cut
from fjordframe.operators.structure import distance, made_whole

_EDGES = ["ax", "bx", "by", "cx", "cy", "cz"]
_SHIFT = ["su", "sv", "sw"]
_KEYS = ["frame", "a", "b", *_SHIFT]


def in_box_units(coords: DataFrame, boxes: DataFrame) -> DataFrame:
    """coords with the box's edges, (u, v, w) in their units, and the box's heights (hu, hv, hw); frames without a box are left out."""
    w = F.col("z") / F.col("cz")
    v = (F.col("y") - w * F.col("cy")) / F.col("by")
    u = (F.col("x") - w * F.col("cx") - v * F.col("bx")) / F.col("ax")
    bc = F.sqrt(F.pow(F.col("by") * F.col("cz"), 2) + F.pow(F.col("bx") * F.col("cz"), 2) + F.pow(F.col("bx") * F.col("cy") - F.col("by") * F.col("cx"), 2))
    heights = {"hu": F.col("ax") * F.col("by") * F.col("cz") / bc, "hv": F.col("by") * F.col("cz") / F.sqrt(F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz")), "hw": F.col("cz")}
    return coords.join(boxes.select("frame", *_EDGES), "frame").withColumns({"u": u, "v": v, "w": w, **heights})


def shifted(u: Column, v: Column, w: Column) -> dict[str, Column]:
    """x, y and z moved by so many edges."""
    return {"x": F.col("x") + u * F.col("ax") + v * F.col("bx") + w * F.col("cx"), "y": F.col("y") + v * F.col("by") + w * F.col("cy"), "z": F.col("z") + w * F.col("cz")}


def near_images(atoms: DataFrame, radius: float, own: bool) -> DataFrame:
    """(frame, a, b, su, sv, sw): images of part b, by whole edges, that may come within the radius of part a.

    atoms as of in_box_units() with a column part. own: a part's own images, one of each two that lie opposite.
    """
    ends = [f(c).alias(f"{n}{c}") for c in "uvw" for f, n in ((F.min, "l"), (F.max, "h"))]
    bounds = atoms.groupBy("frame", "part").agg(*ends, *(F.first(f"h{c}").alias(f"height{c}") for c in "uvw"))
    a = bounds.select("frame", F.col("part").alias("a"), *(F.col(f"{n}{c}").alias(f"a{n}{c}") for c in "uvw" for n in "lh"), *(F.col(f"height{c}") for c in "uvw"))
    b = bounds.select("frame", F.col("part").alias("b"), *(F.col(f"{n}{c}").alias(f"b{n}{c}") for c in "uvw" for n in "lh"))
    pairs = a.join(b, "frame").where(F.col("a") == F.col("b") if own else F.col("a") < F.col("b"))
    for c in "uvw":
        reach = F.lit(radius) / F.col(f"height{c}")
        first, last = F.ceil(F.col(f"al{c}") - reach - F.col(f"bh{c}")), F.floor(F.col(f"ah{c}") + reach - F.col(f"bl{c}"))
        pairs = pairs.withColumn(f"s{c}", F.explode(F.when(first <= last, F.sequence(first, last))))
    if own:
        pairs = pairs.where("su > 0 OR su = 0 AND (sv > 0 OR sv = 0 AND sw > 0)")
    limits = [(F.col(f"a{n}{c}")).alias(f"a{n}{c}") for c in "uvw" for n in "lh"] + [(F.col(f"b{n}{c}") + F.col(f"s{c}")).alias(f"b{n}{c}") for c in "uvw" for n in "lh"]
    return pairs.select(*_KEYS, *limits)


def image_distances(atoms: DataFrame, radius: float, own: bool = False) -> DataFrame:
    """(frame, a, b, d, su, sv, sw, atom_a, atom_b): for every two parts whose images come within the radius, the least distance.

    The image of b moved by (su, sv, sw) edges is at that distance of a; ties go to the lesser image, then the lesser atoms.
    """
    images = near_images(atoms, radius, own)
    cells = ["kx", "ky", "kz"]
    near = lambda c, of, shift: F.col(c) + shift >= F.col(f"{of}l{c}") - F.lit(radius) / F.col(f"h{c}")
    far = lambda c, of, shift: F.col(c) + shift <= F.col(f"{of}h{c}") + F.lit(radius) / F.col(f"h{c}")
    inside = lambda of, shifts: reduce(Column.__and__, [f(c, of, s) for c, s in zip("uvw", shifts, strict=True) for f in (near, far)])
    left = atoms.withColumnRenamed("part", "a").join(images, ["frame", "a"]).where(inside("b", [F.lit(0)] * 3))
    left = copied(left.select(*_KEYS, F.col("atom").alias("atom_a"), *(F.col(c).alias(f"p{c}") for c in "xyz")), ["px", "py", "pz"], cells, radius)
    moved = atoms.withColumnRenamed("part", "b").join(images, ["frame", "b"]).where(inside("a", [F.col(s) for s in _SHIFT])).withColumns(shifted(*(F.col(s) for s in _SHIFT))).withColumns({n: cell_of(F.col(c), radius) for n, c in zip(cells, "xyz", strict=True)})
    right = moved.select(*_KEYS, F.col("atom").alias("atom_b"), *(F.col(c).alias(f"q{c}") for c in "xyz"), *cells)
    met = left.join(right.hint("merge"), [*_KEYS, *cells]).withColumn("d", distance("p", "q")).where(F.col("d") <= radius)
    return met.groupBy("frame", "a", "b").agg(F.min(F.struct("d", *_SHIFT, "atom_a", "atom_b")).alias("_m")).select("frame", "a", "b", "_m.*")


def _rounds(atoms: DataFrame, first: float, last: float, step: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """Rows of step(atoms, radius), a frame each, of the first radius that settles the frame; step leaves out frames that it does not settle."""
    found, radius = [], first
    while True:
        found.append(cut(step(atoms, radius)))
        if radius >= last:
            break
        atoms = cut(atoms.join(found[-1].select("frame"), "frame", "left_anti"))
        if atoms.isEmpty():
            break
        radius = min(2 * radius, last)
    return reduce(DataFrame.unionByName, found)


def _edge_sum(boxes: DataFrame) -> float:
    """The greatest sum of a box's three edge lengths: no two points are further apart than half of it over images. One row."""
    lengths = F.col("ax") + F.sqrt(F.pow("bx", 2) + F.pow("by", 2)) + F.sqrt(F.pow("cx", 2) + F.pow("cy", 2) + F.pow("cz", 2))
    return boxes.agg(F.max(lengths).alias("m")).first()["m"] or 0.0


def spanning_tree(edges: Column, parts: Column) -> Column:
    """Shifts (part, u, v, w) of the parts that the least edges (d, a, b, su, sv, sw) join to the first part, in the order in which they join."""
    held = lambda placed, part: F.exists(placed, lambda p: p["part"] == part)
    place = lambda part, u, v, w: F.struct(part.alias("part"), u.cast("long").alias("u"), v.cast("long").alias("v"), w.cast("long").alias("w"))

    def join(placed: Column, _: Column) -> Column:
        least = F.array_min(F.filter(edges, lambda e: held(placed, e["a"]) != held(placed, e["b"])))
        from_a = held(placed, least["a"])
        old = F.element_at(F.filter(placed, lambda p: p["part"] == F.when(from_a, least["a"]).otherwise(least["b"])), 1)
        sign = F.when(from_a, 1).otherwise(-1)
        new = place(F.when(from_a, least["b"]).otherwise(least["a"]), *(old[c] + sign * least[f"s{c}"] for c in "uvw"))
        return F.when(least.isNull(), placed).otherwise(F.concat(placed, F.array(new)))

    zero = F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.array(place(F.array_min(parts), zero, zero, zero)), join)


def clustered(coords: DataFrame, boxes: DataFrame, molecule: str, first: float = 0.5) -> DataFrame:
    """coords (frame, molecule, atom, x, y, z) with each molecule whole and all molecules of a frame beside each other.

    Each molecule is made whole. A spanning tree of the least image distances between molecules, atom to atom, joins them, and
    along it each is moved by whole edges to the image nearest to the one it joins; the least molecule stays. `first` is the
    radius that is looked at first: most complexes are joined within it. A frame's tree holds an edge for every two of its
    molecules that are near. Frames without a box are left out; molecules are told apart by value and must not be null.
    """
    whole = cut(made_whole(coords, boxes, molecule))
    atoms = in_box_units(whole.withColumnRenamed(molecule, "part"), boxes)
    parts = atoms.groupBy("frame").agg(F.array_sort(F.collect_set("part")).alias("parts"))  # as many as a frame has molecules

    def step(rest: DataFrame, radius: float) -> DataFrame:
        edges = image_distances(rest, radius).groupBy("frame").agg(F.collect_list(F.struct("d", "a", "b", *_SHIFT)).alias("edges"))
        trees = parts.join(rest.select("frame").distinct(), "frame", "left_semi").join(edges, "frame", "left")
        none = F.array().cast(edges.schema["edges"].dataType)
        return trees.select("frame", F.size("parts").alias("n"), spanning_tree(F.coalesce("edges", none), F.col("parts")).alias("tree")).where(F.size("tree") == F.col("n")).drop("n")

    trees = _rounds(atoms, first, max(first, _edge_sum(boxes) / 2), step)
    moves = trees.select("frame", F.explode("tree").alias("t")).select("frame", F.col("t.part").alias(molecule), F.col("t.u").alias("_u"), F.col("t.v").alias("_v"), F.col("t.w").alias("_w"))
    placed = whole.join(moves, ["frame", molecule]).join(boxes.select("frame", *_EDGES), "frame")
    return placed.withColumns(shifted(F.col("_u"), F.col("_v"), F.col("_w"))).select(*whole.columns)


def self_image(coords: DataFrame, boxes: DataFrame, first: float = 0.5) -> DataFrame:
    """(frame, d, su, sv, sw, atom_a, atom_b): the least distance of a structure to its own images, and where.

    atom_b of the image moved by (su, sv, sw) edges is at that distance of atom_a; of two images that lie opposite, the one
    with the first positive shift is given. An atom's own image is an edge away, so the last radius is the longest first edge. Structures must be whole
    (see clustered). Frames without a box are left out.
    """
    atoms = in_box_units(coords.select("frame", "atom", "x", "y", "z", F.lit(0).alias("part")), boxes)
    longest = boxes.agg(F.max("ax").alias("m")).first()["m"] or 0.0
    return _rounds(cut(atoms), first, max(first, longest), lambda rest, radius: image_distances(rest, radius, own=True).drop("a", "b"))


def longest_internal(coords: DataFrame) -> DataFrame:
    """(frame, longest): the greatest distance between two atoms of each frame.

    The ends of the structure along thirteen directions give a distance that is no less than most; only atoms that could be
    further from another than that, by their distance to the middle, are compared.
    """
    middle = coords.groupBy("frame").agg(*(((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in "xyz"))
    away = coords.join(middle, "frame").withColumn("_r", distance("", "m")).drop("mx", "my", "mz")
    spot = F.struct("x", "y", "z")
    ways = [w for w in np.ndindex(3, 3, 3) if w > (1, 1, 1)]
    along = [sum((F.col(c) * (k - 1) for c, k in zip("xyz", w, strict=True) if k != 1), F.lit(0.0)) for w in ways]
    ends = away.groupBy("frame").agg(F.max("_r").alias("_most"), *(f(spot, x).alias(f"_{n}{k}") for k, x in enumerate(along) for n, f in (("l", F.min_by), ("h", F.max_by))))
    known = F.greatest(*(F.sqrt(sum((F.pow(F.col(f"_l{k}.{c}") - F.col(f"_h{k}.{c}"), 2) for c in "xyz"), F.lit(0.0))) for k in range(len(ways))))
    # A trifle is left for rounding.
    few = away.join(ends.select("frame", "_most", known.alias("_known")), "frame").where(F.col("_r") + F.col("_most") >= F.col("_known") * (1 - 1e-9))
    p, q = (few.select("frame", *(F.col(c).alias(f"{s}{c}") for c in "xyz")) for s in "pq")
    return p.join(q, "frame").groupBy("frame").agg(F.max(distance("p", "q")).alias("longest"))


def image_report(coords: DataFrame, boxes: DataFrame, first: float = 0.5) -> DataFrame:
    """(frame, dist, longest, box_x, box_y, box_z): per frame what the periodic-image check lists: least image distance, greatest internal one, edge lengths."""
    lengths = boxes.select(
        "frame", F.col("ax").alias("box_x"), F.sqrt(F.pow("bx", 2) + F.pow("by", 2)).alias("box_y"),
        F.sqrt(F.pow("cx", 2) + F.pow("cy", 2) + F.pow("cz", 2)).alias("box_z"),
    )
    near = self_image(coords, boxes, first).select("frame", F.col("d").alias("dist"))
    return near.join(longest_internal(coords), "frame").join(lengths, "frame")
