"""Structural operators on atoms, contacts and coordinates: selections, contact fractions, fluctuations, collective variables.

Coordinates are rows (frame, atom, x, y, z). What needs linear algebra of a whole frame takes a row per frame with its
coordinates as an array, many frames to an Arrow batch, and works on all of a batch at once. Joins with topologies and
contact maps carry no hint: Spark sends a side out where its size allows and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.lineage import cut
from fjordframe.functions.ranges import format_ranges
from fjordframe.functions.shipping import mapped
from fjordframe.operators.ordering import lagged, row_index, running_total


def atoms_in(atoms: DataFrame, residues: tuple[int, int] | None = None, names: list[str] | None = None, chains: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Atoms by residue range, names, chains and the beginning of the name."""
    if residues:
        atoms = atoms.where(F.col("resnum").between(*residues))
    if names:
        atoms = atoms.where(F.col("name").isin(names))
    if chains:
        atoms = atoms.where(F.col("chain").isin(chains))
    return atoms.where(F.startswith(F.col("name"), F.lit(prefix))) if prefix else atoms


def copies_by_reset(atoms: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """atoms with copy, which goes up by one wherever the residue number falls."""
    rows = lagged(atoms, order, "resnum", "_before", by)
    fell = F.coalesce((F.col("resnum") < F.col("_before")).cast("int"), F.lit(0))
    return running_total(rows.withColumn("_f", fell), order, "_f", "copy", by=by).drop("_f", "_before")


def renumbered(atoms: DataFrame, order: str) -> DataFrame:
    """atoms with serial counted from 1 in an order, so that a selection's serials are its places."""
    return row_index(atoms.drop("serial"), order, "serial").withColumn("serial", F.col("serial").cast("int"))


def terminal(atoms: DataFrame) -> DataFrame:
    """atoms of the first or last residue of their chain."""
    ends = atoms.groupBy("chain").agg(F.min("resnum").alias("_a"), F.max("resnum").alias("_b"))
    return atoms.join(ends, "chain").where("resnum = _a OR resnum = _b").drop("_a", "_b")


def distance(a: str, b: str) -> Column:
    """Distance of points whose columns begin with a and b."""
    return F.sqrt(sum((F.pow(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in "xyz"), F.lit(0.0)))


def pair_distances(coords: DataFrame, contacts: DataFrame) -> DataFrame:
    """(frame, a, b, ref, weight, dist) for each contact in each frame; contacts are a small table."""
    left = coords.select("frame", F.col("atom").alias("a"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    right = coords.select("frame", F.col("atom").alias("b"), *(F.col(c).alias(f"q{c}") for c in "xyz"))
    return left.join(contacts, "a").join(right, ["frame", "b"]).withColumn("dist", distance("p", "q")).drop(*(f"{s}{c}" for s in "pq" for c in "xyz"))


def contact_switch(dist: Column, ref: Column, beta: float = 50.0, lam: float = 1.0) -> Column:
    """1 / (1 + exp(beta (d - lambda ref)))."""
    return 1 / (1 + F.exp(F.lit(beta) * (dist - F.lit(lam) * ref)))


def native_fraction(coords: DataFrame, contacts: DataFrame, beta: float = 50.0, lam: float = 1.0) -> DataFrame:
    """(frame, q): mean contact switch."""
    return pair_distances(coords, contacts).groupBy("frame").agg(F.avg(contact_switch(F.col("dist"), F.col("ref"), beta, lam)).alias("q"))


def contact_map_value(coords: DataFrame, contacts: DataFrame, beta: float = 50.0, lam: float = 1.0) -> DataFrame:
    """(frame, cmap): weighted sum of contact switches."""
    return pair_distances(coords, contacts).groupBy("frame").agg(F.sum(F.col("weight") * contact_switch(F.col("dist"), F.col("ref"), beta, lam)).alias("cmap"))


def coordination(coords: DataFrame, left: DataFrame, right: DataFrame, r0: float) -> DataFrame:
    """(frame, value): sum over pairs of (1 - (r/r0)^6) / (1 - (r/r0)^12), which is 1 / (1 + (r/r0)^6)."""
    a = coords.join(left.select("atom"), "atom").select("frame", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    b = coords.join(right.select("atom"), "atom").select("frame", *(F.col(c).alias(f"q{c}") for c in "xyz"))
    return a.join(b, "frame").groupBy("frame").agg(F.sum(1 / (1 + F.pow(distance("p", "q") / F.lit(r0), 6))).alias("value"))


def centres(coords: DataFrame, groups: DataFrame) -> DataFrame:
    """(frame, grp, x, y, z): mass-weighted centres; groups has grp, atom, mass."""
    rows = coords.join(groups, "atom")
    return rows.groupBy("frame", "grp").agg(*((F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in "xyz"))


def centre_geometry(points: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """(frame, dist, theta): distance of the centres a and c, and the angle at b, in radians."""
    def of(name: str, s: str) -> DataFrame:
        return points.where(F.col("grp") == name).select("frame", *(F.col(x).alias(f"{s}{x}") for x in "xyz"))

    rows = of(a, "p").join(of(b, "o"), "frame").join(of(c, "q"), "frame")
    dot = sum(((F.col(f"p{x}") - F.col(f"o{x}")) * (F.col(f"q{x}") - F.col(f"o{x}")) for x in "xyz"), F.lit(0.0))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (distance("p", "o") * distance("q", "o"))))
    return rows.select("frame", distance("p", "q").alias("dist"), F.acos(cosine).alias("theta"))


def lower_wall(x: Column, at: float, kappa: float) -> Column:
    return F.when(x < at, F.lit(kappa) * F.pow(x - F.lit(at), 2)).otherwise(0.0)


def upper_wall(x: Column, at: float, kappa: float) -> Column:
    return F.when(x > at, F.lit(kappa) * F.pow(x - F.lit(at), 2)).otherwise(0.0)


def _cells(rows: DataFrame, boxes: DataFrame | None, cutoff: float) -> DataFrame:
    """rows with their place (u, v, w) in the box, or in units of the cutoff, and the cell (_u, _v, _w) of _nu, _nv, _nw it lies in."""
    if boxes is None:
        return rows.select("*", *(F.col(c).alias(u) for c, u in zip("xyz", "uvw", strict=True)), *(F.floor(F.col(c) / F.lit(cutoff)).alias(f"_{u}") for c, u in zip("xyz", "uvw", strict=True)))
    rows = rows.join(boxes, "frame")
    w = F.col("z") / F.col("cz")
    v = (F.col("y") - w * F.col("cy")) / F.col("by")
    u = (F.col("x") - w * F.col("cx") - v * F.col("bx")) / F.col("ax")
    bc = F.sqrt(F.pow(F.col("by") * F.col("cz"), 2) + F.pow(F.col("bx") * F.col("cz"), 2) + F.pow(F.col("bx") * F.col("cy") - F.col("by") * F.col("cx"), 2))
    heights = (F.col("ax") * F.col("by") * F.col("cz") / bc, F.col("by") * F.col("cz") / F.sqrt(F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz")), F.col("cz"))
    rows = rows.select("*", *((p - F.floor(p)).alias(n) for n, p in zip("uvw", (u, v, w), strict=True)), *(F.greatest(F.lit(1), F.floor(h / F.lit(cutoff))).alias(f"_n{n}") for n, h in zip("uvw", heights, strict=True)))
    return rows.select("*", *(F.least(F.floor(F.col(n) * F.col(f"_n{n}")), F.col(f"_n{n}") - 1).alias(f"_{n}") for n in "uvw"))


def made_whole(coords: DataFrame, boxes: DataFrame, molecule: str) -> DataFrame:
    """coords (frame, molecule, atom, x, y, z) with each molecule in one piece: every atom at the image nearest to the atom before.

    boxes as for residue_contacts. Windows run over the atoms of one molecule in one frame.
    """
    placed = coords.join(boxes, "frame")
    w = F.col("z") / F.col("cz")
    v = (F.col("y") - w * F.col("cy")) / F.col("by")
    u = (F.col("x") - w * F.col("cx") - v * F.col("bx")) / F.col("ax")
    placed = placed.withColumns({"_u": u, "_v": v, "_w": w})
    order = Window.partitionBy("frame", molecule).orderBy("atom")
    for n in "uvw":
        jump = F.coalesce(F.rint(F.col(f"_{n}") - F.lag(f"_{n}").over(order)), F.lit(0.0))
        placed = placed.withColumn(f"_j{n}", jump)
    for n in "uvw":
        placed = placed.withColumn(f"_s{n}", F.sum(f"_j{n}").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = F.col("x") - F.col("_su") * F.col("ax") - F.col("_sv") * F.col("bx") - F.col("_sw") * F.col("cx")
    y = F.col("y") - F.col("_sv") * F.col("by") - F.col("_sw") * F.col("cy")
    return placed.select(*(c for c in coords.columns if c not in "xyz"), x.alias("x"), y.alias("y"), (F.col("z") - F.col("_sw") * F.col("cz")).alias("z"))


def residue_contacts(coords: DataFrame, atoms: DataFrame, first: Column, second: Column, cutoff: float, boxes: DataFrame | None = None) -> DataFrame:
    """(frame, n): residue pairs of two selections whose nearest heavy atoms are under the cutoff; 0 where there are none.

    Space is cut into cells no narrower than the cutoff and an atom meets those of the cells around its own. With boxes
    (frame, ax, bx, by, cx, cy, cz: a lower triangular box, angled ones too) distances are to the nearest image, which is exact
    for cutoffs under half the box's least height.
    """
    heavy = coords.join(atoms.where("substring(name, 1, 1) <> 'H'").select("atom", "resnum", "chain", first.alias("_1"), second.alias("_2")), "atom")
    placed = _cells(heavy, boxes, cutoff)
    periodic = boxes is not None
    around = [F.struct(*((F.pmod(F.col(f"_{n}") + o, F.col(f"_n{n}")) if periodic else F.col(f"_{n}") + o).alias(f"_{n}") for n, o in zip("uvw", at, strict=True))) for at in np.ndindex(3, 3, 3) for at in [tuple(k - 1 for k in at)]]
    a = placed.where("_1").select("frame", F.struct("chain", "resnum").alias("ra"), *(F.col(c).alias(f"p{c}") for c in "uvw"), F.explode(F.array_distinct(F.array(*around))).alias("_c")).select("frame", "ra", "pu", "pv", "pw", "_c.*")
    shape = ["ax", "bx", "by", "cx", "cy", "cz"] if periodic else []
    b = placed.where("_2").select("frame", F.struct("chain", "resnum").alias("rb"), *(F.col(c).alias(f"q{c}") for c in "uvw"), *shape, "_u", "_v", "_w")
    u, v, w = (F.col(f"p{c}") - F.col(f"q{c}") for c in "uvw")
    if periodic:
        u, v, w = (d - F.rint(d) for d in (u, v, w))
        u, v, w = u * F.col("ax") + v * F.col("bx") + w * F.col("cx"), v * F.col("by") + w * F.col("cy"), w * F.col("cz")
    near = a.join(b, ["frame", "_u", "_v", "_w"]).where(F.sqrt(u * u + v * v + w * w) < cutoff).select("frame", "ra", "rb").distinct()
    counts = near.groupBy("frame").agg(F.count("*").alias("n"))
    return coords.select("frame").distinct().join(counts, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_fluctuation(values: DataFrame, atom: str, components: list[str], w: str, by: list[str] | None = None) -> DataFrame:
    """(*by, atom, rmsf): root of the weighted mean squared deviation from the weighted mean, in two passes."""
    by = [*(by or []), atom]
    rows = values.where(F.col(w) > 0)
    means = rows.groupBy(*by).agg(*((F.sum(F.col(w) * F.col(c)) / F.sum(w)).alias(f"_m{c}") for c in components))
    square = sum((F.pow(F.col(c) - F.col(f"_m{c}"), 2) for c in components), F.lit(0.0))
    return rows.join(means, by).groupBy(*by).agg(F.sqrt(F.sum(F.col(w) * square) / F.sum(w)).alias("rmsf"))


def walker_error(values: DataFrame, atom: str, components: list[str], w: str, walker: str) -> DataFrame:
    """(atom, err): sample deviation over walkers of their fluctuations; walkers without weight are left out."""
    return weighted_fluctuation(values, atom, components, w, [walker]).groupBy(atom).agg(F.stddev_samp("rmsf").alias("err"))


def segment_means(profile: DataFrame, residue: str, v: str, segments: DataFrame) -> DataFrame:
    """(segment, mean): mean over residue ranges, both ends included; segments has segment, first, last and is small."""
    return profile.join(segments, F.col(residue).between(F.col("first"), F.col("last"))).groupBy("segment").agg(F.avg(v).alias("mean"))


def frame_arrays(coords: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, frame, atoms, xyz): a row per frame, its coordinates in one array in the order of the atoms."""
    atoms = F.array_sort(F.collect_list(F.struct("atom", "x", "y", "z")))  # as many as a structure has
    rows = coords.groupBy(*(by or []), "frame").agg(atoms.alias("_a"))
    xyz = F.flatten(F.transform("_a", lambda a: F.array(a["x"], a["y"], a["z"]))).cast("array<double>")
    return rows.select(*(by or []), "frame", F.transform("_a", lambda a: a["atom"]).alias("atoms"), xyz.alias("xyz"))


def _stacks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, coordinates) of the frames of each number of atoms, coordinates as (frame, atom, 3)."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, np.stack([flat[ends[r] : ends[r + 1]] for r in rows]).reshape(len(rows), -1, 3)


def turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rotations that lay stacks of centred structures a (n, atoms, 3) over b best."""
    u, _, vt = np.linalg.svd(np.swapaxes(a, -1, -2) @ b)
    u = u.copy()
    u[..., :, 2] *= np.sign(np.linalg.det(u @ vt))[..., None]
    return u @ vt


def kabsch(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stacks of structures (n, atoms, 3), moving ones laid over fixed ones, and the root mean square deviations that are left."""
    middle = fixed.mean(axis=-2, keepdims=True)
    a, b = moving - moving.mean(axis=-2, keepdims=True), fixed - middle
    laid = a @ turned(a, b)
    return laid + middle, np.sqrt(((laid - b) ** 2).sum(axis=-1).mean(axis=-1))


def laid_by(moving: np.ndarray, fixed: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Stacks of structures laid over a fixed one by some of their atoms, all atoms moved along."""
    middle, own = fixed[fit].mean(axis=0), moving[:, fit].mean(axis=1, keepdims=True)
    return (moving - own) @ turned(moving[:, fit] - own, fixed[fit] - middle) + middle


def superposed_fluctuation(coords: DataFrame, frames: DataFrame, fit: list[int]) -> DataFrame:
    """(atom, rmsf, err, raw): fluctuations about the weighted mean structure, after two passes of superposition.

    coords (frame, atom, x, y, z) have the same atoms in every frame; frames (frame, w, walker) the weights. Frames without a
    weight above 0 are left out. All frames are laid over the first one by the atoms of fit, then over the weighted mean of
    those; the mean of that pass is the one that fluctuations are about. rmsf is weighted, err the sample deviation of the
    walkers' own (about the same mean), raw not weighted. A pass sums up structures inside tasks; only a mean structure, of as
    many rows as there are atoms, comes to the driver.
    """
    shapes = cut(frame_arrays(coords).join(frames.where("w > 0").select("frame", "w", "walker"), "frame"))
    start = shapes.orderBy("frame").select("atoms", "xyz").first()
    empty = coords.select("atom").where("false").select("atom", *(F.lit(None).cast("double").alias(c) for c in ("rmsf", "err", "raw")))
    if start is None:
        return empty
    atoms, where = start["atoms"], np.flatnonzero(np.isin(start["atoms"], fit))

    def summed(fixed: np.ndarray, about: np.ndarray | None = None) -> DataFrame:
        """(walker, n, w, sums, raw) of each batch: weighted sums of the laid places, or of squared deviations (and unweighted ones)."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                walkers = b["walker"].dictionary_encode()
                weight = b["w"].to_numpy()
                for rows, shapes in _stacks(b["xyz"]):
                    laid = laid_by(shapes, fixed, where)
                    values = laid.reshape(len(rows), -1) if about is None else ((laid - about) ** 2).sum(axis=-1)
                    own = walkers.indices.to_numpy()[rows]
                    for k in np.unique(own):
                        at = own == k
                        sums = [(weight[rows][at, None] * values[at]).sum(axis=0), values[at].sum(axis=0)]
                        lists = [pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s)) for s in sums]
                        yield pa.RecordBatch.from_arrays([walkers.dictionary.take(pa.array([k])), pa.array([int(at.sum())]), pa.array([float(weight[rows][at].sum())]), *lists], names=["walker", "n", "w", "sums", "raw"])

        return shapes.select("w", "walker", "xyz").transform(mapped, add, f"walker {shapes.schema['walker'].dataType.simpleString()}, n long, w double, sums array<double>, raw array<double>")

    def mean(fixed: np.ndarray) -> np.ndarray:
        totals = summed(fixed).select("w", F.posexplode("sums").alias("k", "s")).groupBy("k").agg((F.sum("s") / F.sum("w")).alias("m"))
        return np.array([r["m"] for r in totals.orderBy("k").collect()]).reshape(-1, 3)

    first = mean(np.array(start["xyz"]).reshape(-1, 3))
    parts = summed(first, mean(first)).select("walker", "n", "w", F.posexplode(F.arrays_zip("sums", "raw")).alias("k", "v"))
    walkers = parts.groupBy("walker", "k").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("v.sums").alias("s"), F.sum("v.raw").alias("r"))
    kind = coords.schema["atom"].dataType
    names = coords.sparkSession.createDataFrame(list(enumerate(atoms)), f"k int, atom {kind.simpleString()}")
    out = walkers.groupBy("k").agg(F.sqrt(F.sum("s") / F.sum("w")).alias("rmsf"), F.stddev_samp(F.sqrt(F.col("s") / F.col("w"))).alias("err"), F.sqrt(F.sum("r") / F.sum("n")).alias("raw"))
    return out.join(names, "k").select("atom", "rmsf", "err", "raw")


def superposed(coords: DataFrame, reference: pd.DataFrame) -> DataFrame:
    """coords of each frame laid over a reference structure (atom, x, y, z), with rmsd; atoms that it lacks are left out."""
    fixed = reference.sort_values("atom")
    atoms, spots = fixed["atom"].tolist(), fixed[["x", "y", "z"]].to_numpy(dtype=float)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, shapes in _stacks(b["xyz"]):
                laid, rmsd = kabsch(shapes, spots[None])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 3 * shapes.shape[1]), pa.array(laid.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b["frame"].take(pa.array(rows)), b["atoms"].take(pa.array(rows)), flat, pa.array(rmsd)], names=["frame", "atoms", "xyz", "rmsd"])

    shapes = frame_arrays(coords.where(F.col("atom").isin(atoms)))
    kind = ", ".join(f"{c} {shapes.schema[c].dataType.simpleString()}" for c in ("frame", "atoms", "xyz"))
    out = shapes.transform(mapped, lay, f"{kind}, rmsd double").select("frame", "rmsd", "xyz", F.posexplode("atoms").alias("_p", "atom"))
    return out.select("frame", "atom", *(F.get("xyz", F.col("_p") * 3 + k).alias(c) for k, c in enumerate("xyz")), "rmsd")


def pair_deviations(pairs: DataFrame) -> DataFrame:
    """pairs with d in place of p and q, two structures as arrays: the root mean square deviation once superposed."""
    rest = [c for c in pairs.columns if c not in ("p", "q")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.zeros(b.num_rows)
            for rows, shapes in _stacks(b["p"]):
                d[rows] = kabsch(shapes, np.stack([np.asarray(b["q"][int(r)].as_py()).reshape(-1, 3) for r in rows]))[1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(d)], names=[*rest, "d"])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in rest)
    return pairs.transform(mapped, measure, f"{kinds}, d double")


def gyration(coords: DataFrame) -> DataFrame:
    """(frame, rg): radius of gyration."""
    means = coords.groupBy("frame").agg(*(F.avg(c).alias(f"_{c}") for c in "xyz"))
    square = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in "xyz"), F.lit(0.0))
    return coords.join(means, "frame").groupBy("frame").agg(F.sqrt(F.avg(square)).alias("rg"))


def axis_angle(coords: DataFrame, first: list[int], second: list[int]) -> DataFrame:
    """(frame, angle): angle in degrees, 0 to 90, between the main axes of two groups of atoms."""

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            axes = []
            for side in ("p", "q"):
                main = np.zeros((b.num_rows, 3))
                for rows, x in _stacks(b[side]):
                    main[rows] = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)[2][:, 0]
                axes.append(main)
            cosine = np.clip(np.abs((axes[0] * axes[1]).sum(axis=1)), 0, 1)
            yield pa.RecordBatch.from_arrays([b["frame"], pa.array(np.degrees(np.arccos(cosine)))], names=["frame", "angle"])

    p, q = (frame_arrays(coords.where(F.col("atom").isin(atoms))).select("frame", F.col("xyz").alias(n)) for n, atoms in (("p", first), ("q", second)))
    both = p.join(q, "frame")
    return both.transform(mapped, angle, f"frame {both.schema['frame'].dataType.simpleString()}, angle double")


def renamed(atoms: DataFrame, residues: dict[str, str], names: dict[str, str]) -> DataFrame:
    """atoms with residue and atom names replaced."""
    for column, table in (("resname", residues), ("name", names)):
        if table:
            pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
            atoms = atoms.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))
    return atoms


def mutated(atoms: DataFrame, resnum: int, chain: str, resname: str, keep: list[str], placed: DataFrame | None = None) -> DataFrame:
    """atoms with a residue cut down to the kept atoms, renamed, and placed atoms added (same columns), as of side_chain()."""
    here = (F.col("resnum") == resnum) & (F.col("chain") == chain)
    rest = atoms.where(~here | F.col("name").isin(keep)).withColumn("resname", F.when(here, resname).otherwise(F.col("resname")))
    return rest if placed is None else rest.unionByName(placed)


def from_internal(length: float, angle: float, torsion: float) -> tuple[float, float, float]:
    """Place, in the frame of side_chain(), of an atom at a distance from the third frame atom, an angle to the second and a torsion to the first, in degrees."""
    a, t = np.radians(angle), np.radians(torsion)
    return float(-length * np.cos(a)), float(-length * np.sin(a) * np.cos(t)), float(-length * np.sin(a) * np.sin(t))


def aspartate() -> dict[str, tuple[float, float, float]]:
    """Side chain of an aspartate beyond CB: CG straight on from CA, both oxygens in the plane of N, CA and CB. Lengths in A."""
    on, to, half = 1.52, 1.25, np.radians(120.0 / 2)  # fixed values: CB to CG, CG to oxygen, angle between the oxygens
    back, side = to * np.cos(np.pi - half), to * np.sin(np.pi - half)
    return {"CG": (on, 0.0, 0.0), "OD1": (float(on + back), float(side), 0.0), "OD2": (float(on + back), float(-side), 0.0)}


def side_chain(atoms: DataFrame, sites: DataFrame, template: dict[str, tuple[float, float, float]], resname: str, frame: tuple[str, str, str] = ("N", "CA", "CB")) -> DataFrame:
    """(serial, name, resname, chain, resnum, x, y, z): a template's atoms placed on every site (chain, resnum) by its frame atoms.

    Template places are along x, from the second frame atom to the third, which is the origin; along z, the normal of the plane
    with the first; and along y, across. Serials go on from the greatest one, site by site. Of several atoms of one name the
    first by serial counts; sites that lack a frame atom, or whose frame atoms lie on a line, get no atoms.
    """
    spots = [F.min_by(F.when(F.col("name") == name, F.col(c)), F.when(F.col("name") == name, F.col("serial"))).alias(f"{k}{c}") for k, name in zip("nab", frame, strict=True) for c in "xyz"]
    rows = atoms.join(sites.select("chain", "resnum").distinct(), ["chain", "resnum"], "left_semi").groupBy("chain", "resnum").agg(*spots).dropna()
    length = lambda v: F.sqrt(sum((x * x for x in v), F.lit(0.0)))
    unit = lambda v: [F.try_divide(x, length(v)) for x in v]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    def kept(rows: DataFrame, name: str, v: list[Column]) -> tuple[DataFrame, list[Column]]:
        return rows.withColumns({f"_{name}{c}": x for c, x in zip("xyz", v, strict=True)}), [F.col(f"_{name}{c}") for c in "xyz"]

    rows, ex = kept(rows, "e", unit([F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]))
    rows, ez = kept(rows, "f", unit(cross([F.col(f"n{c}") - F.col(f"a{c}") for c in "xyz"], ex)))
    rows, ey = kept(rows.dropna(), "g", cross(ez, ex))
    each = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), *((F.col(f"b{c}") + p * ex[i] + q * ey[i] + r * ez[i]).alias(c) for i, c in enumerate("xyz"))) for k, (name, (p, q, r)) in enumerate(template.items())]
    placed = rows.select("chain", "resnum", F.explode(F.array(*each)).alias("_t")).select("chain", "resnum", "_t.*")
    numbered = row_index(placed.withColumn("_o", F.struct("chain", "resnum", "k")), "_o", "_i")
    last = atoms.agg(F.coalesce(F.max("serial"), F.lit(0)).alias("_m"))  # one row
    out = numbered.join(F.broadcast(last)).withColumn("serial", (F.col("_m") + F.col("_i")).cast("int"))
    return out.select("serial", "name", F.lit(resname).alias("resname"), "chain", "resnum", "x", "y", "z")


def substituted(atoms: DataFrame, sites: DataFrame, resname: str, keep: list[str], template: dict[str, tuple[float, float, float]], frame: tuple[str, str, str] = ("N", "CA", "CB")) -> DataFrame:
    """atoms with the residues of sites (chain, resnum) cut down to the kept atoms, renamed, and given a template's side chain.

    Sites that side_chain() can't place stay as they are. Columns that placed atoms lack are null for them.
    """
    placed = side_chain(atoms, sites, template, resname, frame)
    done = placed.select("chain", "resnum", F.lit(True).alias("_here")).distinct()
    rows = atoms.join(done, ["chain", "resnum"], "left")
    rest = rows.where(F.col("_here").isNull() | F.col("name").isin(keep)).withColumn("resname", F.when(F.col("_here"), resname).otherwise(F.col("resname")))
    return rest.drop("_here").unionByName(placed, allowMissingColumns=True).select(*atoms.columns)


def without_at_start(atoms: DataFrame, names: list[str], chains: list[str] | None = None) -> DataFrame:
    """atoms without those of some names in the first residue of each chain (or of some chains), as terminal phosphates are taken off."""
    wanted = atoms.where(F.col("chain").isin(chains)) if chains else atoms
    firsts = wanted.groupBy("chain").agg(F.min("resnum").alias("_first"))
    met = atoms.join(firsts, "chain", "left")
    return met.where(~(F.col("name").isin(names) & F.coalesce(F.col("resnum") == F.col("_first"), F.lit(False)))).select(*atoms.columns)


def contact_lines(contacts: DataFrame) -> DataFrame:
    """(line): contact-map entries with 1-based atoms and equal weights, numbered by their atoms."""
    total = contacts.agg(F.count("*").alias("_n"))  # one row
    placed = row_index(contacts.withColumn("_key", F.col("a").cast("long") * (1 << 32) + F.col("b")), "_key", "_k", "ref")
    rows = placed.join(F.broadcast(total)).select("_k", (F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"), "ref", (1.0 / F.col("_n")).alias("w"))
    return rows.select(F.format_string("ATOMS%d=%d,%d REFERENCE%d=%.6f WEIGHT%d=%.6f", "_k", "a", "b", "_k", "ref", "_k", "w").alias("line"))


def group_lines(atoms: DataFrame, by: str) -> DataFrame:
    """(grp, line): a group definition per value of a column, its atoms as first-last where they run on, else one by one."""
    groups = atoms.groupBy(F.col(by).alias("grp")).agg(F.collect_set("serial").alias("_s"))  # as many as a group has
    return groups.select("grp", F.format_string("%s: GROUP ATOMS=%s", F.col("grp").cast("string"), format_ranges(F.col("_s"))).alias("line"))
