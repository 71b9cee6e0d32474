"""Secondary structure by hydrogen bonds, and likeness to an ideal helix over windows of residues.

Coordinates are rows (frame, chain, resnum, name, x, y, z) in nm. Residues whose numbers run on without a gap form a run of
their chain; turns, bridges and windows lie inside runs. Windows run over one chain of one frame.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.functions.cells import cell_of, copied
from fjordframe.operators.structure import distance, pair_deviations

#: Charges times the unit factor (kcal nm / mol), limit and floor of the bond energy, length of N-H, and reach of CA to CA.
ENERGY, BOND, FLOOR, NH, REACH = 2.7888, -0.5, -9.9, 0.1, 0.9
_AT = ["frame", "chain"]
#: Atoms of a residue in windows, in this order.
WINDOW_ATOMS = ("N", "CA", "CB", "C", "O")

#: Fixed values of an ideal alpha helix: degrees and nm from residue to residue, and of each atom of a residue its radius, angle and height.
TURN, RISE = 99.7, 0.151
CYLINDER = {"N": (0.1525, -25.6, -0.0928), "CA": (0.2286, 0.0, 0.0), "CB": (0.3380, 15.9, -0.0756), "C": (0.1707, 28.4, 0.1031), "O": (0.2042, 24.4, 0.2206)}


def ideal_helix(residues: int) -> np.ndarray:
    """The atoms (WINDOW_ATOMS of each residue, 3) of an ideal alpha helix along z."""
    k = np.arange(residues)[:, None]
    radius, angle, height = np.array([CYLINDER[name] for name in WINDOW_ATOMS]).T
    phi = np.radians(angle + TURN * k)
    return np.stack([radius * np.cos(phi), radius * np.sin(phi), height + RISE * k], axis=-1).reshape(-1, 3)


def _runs(residues: DataFrame) -> DataFrame:
    """residues with run: the same for residues of a chain whose numbers run on."""
    return residues.withColumn("run", F.col("resnum") - F.row_number().over(Window.partitionBy(*_AT).orderBy("resnum")))


def backbone(coords: DataFrame) -> DataFrame:
    """A row per residue that has N, CA, C and O: (frame, chain, resnum, run, donor, nx ... oz, hx, hy, hz), the hydrogen behind C=O of the residue before.

    The hydrogen is null, and donor false, at the beginning of a run and in proline (if coords have resname).
    """
    names = {"n": "N", "a": "CA", "c": "C", "o": "O"}
    spots = [F.max(F.when(F.col("name") == name, F.col(c))).alias(f"{k}{c}") for k, name in names.items() for c in "xyz"]
    proline = F.max(F.col("resname") == "PRO") if "resname" in coords.columns else F.lit(False)
    rows = _runs(coords.groupBy(*_AT, "resnum").agg(*spots, proline.alias("_p")).dropna(subset=["nx", "ax", "cx", "ox"]))
    before = Window.partitionBy(*_AT, "run").orderBy("resnum")
    rows = rows.withColumns({f"_{k}{c}": F.lag(f"{k}{c}").over(before) for k in "co" for c in "xyz"})
    length = distance("_c", "_o")
    donor = F.col("_cx").isNotNull() & ~F.col("_p")
    hydrogen = {f"h{c}": F.when(donor, F.col(f"n{c}") + NH * (F.col(f"_c{c}") - F.col(f"_o{c}")) / length) for c in "xyz"}
    return rows.withColumns({"donor": donor, **hydrogen}).select(*_AT, "resnum", "run", "donor", *(f"{k}{c}" for k in "nacoh" for c in "xyz"))


def bond_energy() -> Column:
    """Electrostatic energy of N-H (dn, dh) to C=O (ac, ao): at least FLOOR, and FLOOR where atoms all but touch."""
    pairs = {k: distance(a, b) for k, (a, b) in {"on": ("ao", "dn"), "ch": ("ac", "dh"), "oh": ("ao", "dh"), "cn": ("ac", "dn")}.items()}
    energy = ENERGY * (1 / pairs["on"] + 1 / pairs["ch"] - 1 / pairs["oh"] - 1 / pairs["cn"])
    return F.when(F.least(*pairs.values()) < 0.05, F.lit(FLOOR)).otherwise(F.greatest(energy, F.lit(FLOOR)))


def hydrogen_bonds(residues: DataFrame) -> DataFrame:
    """(frame, d_chain, d, d_run, a_chain, a, a_run, energy): bonds under BOND of backbone() rows; of a donor the two strongest.

    Only residues whose CA are within REACH are looked at, by cells (see functions/cells); a residue does not bond to the one before.
    """
    cells = ["kx", "ky", "kz"]
    kept = lambda side, atoms: [F.col("chain").alias(f"{side}_chain"), F.col("resnum").alias(side), F.col("run").alias(f"{side}_run"), *(F.col(f"a{c}").alias(f"{side}a{c}") for c in "xyz"), *(F.col(f"{k}{c}").alias(f"{side}{k}{c}") for k in atoms for c in "xyz")]
    donors = copied(residues.where("donor").select("frame", *kept("d", "nh")), ["dax", "day", "daz"], cells, REACH)
    acceptors = residues.select("frame", *kept("a", "co"), *(cell_of(F.col(f"a{c}"), REACH).alias(n) for n, c in zip(cells, "xyz", strict=True)))
    own = (F.col("a_chain") == F.col("d_chain")) & (F.col("a_run") == F.col("d_run")) & F.col("a").isin(F.col("d"), F.col("d") - 1)
    near = donors.join(acceptors.hint("merge"), ["frame", *cells]).where(~own & (distance("da", "aa") < REACH))
    bonds = near.withColumn("energy", bond_energy()).where(F.col("energy") < BOND)
    best = Window.partitionBy("frame", "d_chain", "d").orderBy("energy", "a_chain", "a")
    return bonds.withColumn("_n", F.row_number().over(best)).where("_n <= 2").select("frame", "d_chain", "d", "d_run", "a_chain", "a", "a_run", "energy")


def bridged(residues: DataFrame, bonds: DataFrame) -> DataFrame:
    """(frame, chain, resnum) of residues in a bridge, parallel or antiparallel, each once."""
    sides = lambda n: bonds.select("frame", *(F.col(c).alias(f"{c}{n}") for c in ("d_chain", "d", "d_run", "a_chain", "a", "a_run")))
    one, two = sides(1), sides(2)
    same = lambda x, y: (F.col(f"{x[0]}_chain{x[1]}") == F.col(f"{y[0]}_chain{y[1]}")) & (F.col(f"{x[0]}_run{x[1]}") == F.col(f"{y[0]}_run{y[1]}"))
    # i - 1 takes a bond of j and j one of i + 1; each takes the other's; i - 1 takes one of j + 1 and j - 1 one of i + 1.
    parallel = one.join(two, ["frame"]).where(same("d1", "a2") & (F.col("d1") == F.col("a2")) & same("a1", "d2") & (F.col("d2") == F.col("a1") + 2)).select("frame", F.struct(F.col("a_chain1").alias("chain"), F.col("a_run1").alias("run"), (F.col("a1") + 1).alias("resnum")).alias("i"), F.struct(F.col("d_chain1").alias("chain"), F.col("d_run1").alias("run"), F.col("d1").alias("resnum")).alias("j"))
    mutual = one.join(two, ["frame"]).where(same("d1", "a2") & (F.col("d1") == F.col("a2")) & same("a1", "d2") & (F.col("d2") == F.col("a1"))).select("frame", F.struct(F.col("a_chain1").alias("chain"), F.col("a_run1").alias("run"), F.col("a1").alias("resnum")).alias("i"), F.struct(F.col("d_chain1").alias("chain"), F.col("d_run1").alias("run"), F.col("d1").alias("resnum")).alias("j"))
    across = one.join(two, ["frame"]).where(same("d1", "a2") & (F.col("a2") == F.col("d1") - 2) & same("a1", "d2") & (F.col("d2") == F.col("a1") + 2)).select("frame", F.struct(F.col("a_chain1").alias("chain"), F.col("a_run1").alias("run"), (F.col("a1") + 1).alias("resnum")).alias("i"), F.struct(F.col("d_chain1").alias("chain"), F.col("d_run1").alias("run"), (F.col("d1") - 1).alias("resnum")).alias("j"))
    apart = (F.col("i.chain") != F.col("j.chain")) | (F.abs(F.col("i.resnum") - F.col("j.resnum")) > 2)
    pairs = reduce(DataFrame.unionByName, (parallel, mutual, across)).where(apart)
    # Both residues have neighbours on either side.
    span = Window.partitionBy(*_AT, "run").orderBy("resnum")
    inner = residues.withColumn("_in", F.lag("resnum").over(span).isNotNull() & F.lead("resnum").over(span).isNotNull()).where("_in").select("frame", F.struct("chain", "run", "resnum").alias("_r"))
    both = pairs.join(inner.withColumnRenamed("_r", "i"), ["frame", "i"], "left_semi").join(inner.withColumnRenamed("_r", "j"), ["frame", "j"], "left_semi")
    return both.select("frame", F.explode(F.array("i", "j")).alias("_r")).select("frame", "_r.chain", "_r.resnum").distinct()


def assigned(residues: DataFrame, bonds: DataFrame) -> DataFrame:
    """(frame, chain, resnum, code) of residues (frame, chain, resnum, run): H, G and I for helices of four, three and five, E in bridges, else -.

    A turn of n lies between i and i + n if i takes a bond of i + n; two turns in a row make a helix of the n residues after the
    first one's begin. H goes before E, and both before G, which holds only where no other was; then I.
    """
    keys = [*_AT, "run"]
    order = Window.partitionBy(*keys).orderBy("resnum")
    rows = residues.select(*keys, "resnum")
    turn = {n: (F.col("d_chain") == F.col("a_chain")) & (F.col("d_run") == F.col("a_run")) & (F.col("d") == F.col("a") + n) for n in (3, 4, 5)}
    turns = bonds.groupBy("frame", F.col("a_chain").alias("chain"), F.col("a").alias("resnum")).agg(*(F.max(c).alias(f"_t{n}") for n, c in turn.items()))
    strands = bridged(residues, bonds).withColumn("_e", F.lit(True))
    no = F.lit(False)
    rows = rows.join(turns, [*_AT, "resnum"], "left").join(strands, [*_AT, "resnum"], "left").fillna(False, [*(f"_t{n}" for n in turn), "_e"])
    starts = {f"_s{n}": F.col(f"_t{n}") & F.coalesce(F.lag(f"_t{n}").over(order), no) for n in turn}
    rows = rows.withColumns(starts)
    holds = lambda start, n: F.max(start).over(order.rowsBetween(1 - n, 0))
    free = lambda taken, n: ~F.max(taken).over(order.rowsBetween(0, n - 1))
    rows = rows.withColumn("_h", holds(F.col("_s4"), 4))
    rows = rows.withColumn("_taken", F.col("_h") | F.col("_e")).withColumn("_s3", F.col("_s3") & free(F.col("_taken"), 3)).withColumn("_g", holds(F.col("_s3"), 3))
    rows = rows.withColumn("_taken", F.col("_taken") | F.col("_g")).withColumn("_s5", F.col("_s5") & free(F.col("_taken"), 5)).withColumn("_i", holds(F.col("_s5"), 5))
    code = F.when(F.col("_h"), "H").when(F.col("_e"), "E").when(F.col("_g"), "G").when(F.col("_i"), "I").otherwise("-")
    return rows.select(*_AT, "resnum", code.alias("code"))


def secondary_structure(coords: DataFrame) -> DataFrame:
    """(frame, chain, resnum, code) by the energies of hydrogen bonds."""
    residues = backbone(coords)
    return assigned(residues, hydrogen_bonds(residues))


def helicity(codes: DataFrame, residues: tuple[int, int] | None = None) -> DataFrame:
    """(frame, helix, strand): shares of residues, all or those of a range, in helices of any kind and in bridges."""
    rows = codes.where(F.col("resnum").between(*residues)) if residues else codes
    share = lambda *of: F.avg(F.col("code").isin(*of).cast("double"))
    return rows.groupBy("frame").agg(share("H", "G", "I").alias("helix"), share("E").alias("strand"))


def window_arrays(coords: DataFrame, size: int, residues: tuple[int, int] | None = None) -> DataFrame:
    """(frame, chain, first, w): the coordinates of each `size` residues in a row in one array, residue by residue in the order of WINDOW_ATOMS.

    Windows that lack an atom, or go over a gap, are left out.
    """
    rows = coords.where(F.col("resnum").between(*residues)) if residues else coords
    spots = [F.max(F.when(F.col("name") == name, F.col(c))).alias(f"_{name}{c}") for name in WINDOW_ATOMS for c in "xyz"]
    each = _runs(rows.groupBy(*_AT, "resnum").agg(*spots).dropna())
    ahead = Window.partitionBy(*_AT, "run").orderBy("resnum").rowsBetween(0, size - 1)
    full = each.withColumn("_w", F.collect_list(F.array(*(f"_{name}{c}" for name in WINDOW_ATOMS for c in "xyz"))).over(ahead)).where(F.size("_w") == size)
    return full.select(*_AT, F.col("resnum").alias("first"), F.flatten("_w").alias("w"))


def window_deviations(windows: DataFrame, ideal: np.ndarray, superpose: bool = False, bonded: float = 0.17) -> DataFrame:
    """windows with d in place of w: the deviation from an ideal window (atoms, 3).

    That of all distances between its atoms, but those that are bonded (under `bonded` in the ideal one); or, superposed, that
    of the atoms' places.
    """
    if superpose:
        q = F.array(*(F.lit(float(x)) for x in ideal.reshape(-1)))
        return pair_deviations(windows.withColumnRenamed("w", "p").withColumn("q", q))
    apart = np.sqrt(((ideal[:, None] - ideal[None]) ** 2).sum(axis=-1))
    wanted = [(i, j, float(apart[i, j])) for i in range(len(ideal)) for j in range(i + 1, len(ideal)) if apart[i, j] > bonded]
    pairs = F.array(*(F.struct(F.lit(3 * i).alias("i"), F.lit(3 * j).alias("j"), F.lit(d).alias("d")) for i, j, d in wanted))
    far = lambda w, p: F.sqrt(sum((F.pow(F.get(w, p["i"] + k) - F.get(w, p["j"] + k), 2) for k in range(3)), F.lit(0.0)))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.pow(far(F.col("w"), p) - p["d"], 2))
    return windows.withColumn("d", F.sqrt(total / len(wanted))).drop("w")


def window_switch(d: Column, r0: float, n: int = 8, m: int = 12) -> Column:
    """(1 - (d/r0)^n) / (1 - (d/r0)^m), and n/m where that has no value."""
    x = d / F.lit(r0)
    return F.when(F.abs(x - 1) < 1e-9, F.lit(n / m)).otherwise((1 - F.pow(x, n)) / (1 - F.pow(x, m)))


def helix_windows(coords: DataFrame, ideal: np.ndarray, residues: tuple[int, int] | None = None, r0: float = 0.08, superpose: bool = False) -> DataFrame:
    """(frame, helix): sum over windows of the switched deviation from the ideal helix; 0 for frames without a whole window.

    ideal has a window's atoms, residue by residue in the order of WINDOW_ATOMS.
    """
    windows = window_deviations(window_arrays(coords, len(ideal) // len(WINDOW_ATOMS), residues), ideal, superpose)
    sums = windows.groupBy("frame").agg(F.sum(window_switch(F.col("d"), r0)).alias("helix"))
    return coords.select("frame").distinct().join(sums, "frame", "left").select("frame", F.coalesce("helix", F.lit(0.0)).alias("helix"))
