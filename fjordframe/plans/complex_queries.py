"""Queries on complexes in periodic boxes: embeddings in the role of structures of two or three molecules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordframe.operators import helices as H
from fjordframe.operators import periodic as P
from fjordframe.operators import runs as R
from fjordframe.operators import structure as A
from fjordframe.plans.standin import r, rounded
from fjordframe.plans.structure_queries import _COORDS, _coords

#: Edges of an angled box that structures are larger than, and of one that they fit in.
SMALL = {"ax": 0.45, "bx": 0.1, "by": 0.4, "cx": -0.05, "cy": 0.08, "cz": 0.38}
LARGE = {"ax": 0.9, "bx": 0.2, "by": 0.8, "cx": -0.1, "cy": 0.15, "cz": 0.7}


def _boxes(coords, edges):
    return coords.select("frame").distinct().select("frame", *(F.lit(v).alias(k) for k, v in edges.items()))


def _complex(spark, d):
    """Two molecules in even frames and three in odd ones, each some boxes away."""
    c = _coords(spark, d)
    molecule = F.when(F.col("frame") % 2 == 0, F.floor(F.col("atom") / 11)).otherwise(F.floor(F.col("atom") / 8)).cast("int")
    n = molecule * (F.col("frame") % 5 - 2)
    edges = {k: F.lit(v) for k, v in SMALL.items()}
    moved = c.withColumn("molecule", molecule).withColumns(edges).withColumns(P.shifted(n, -n, molecule))
    return moved.select("frame", "molecule", "atom", "x", "y", "z")


def complex_clustered(spark, d):
    c = _complex(spark, d)
    return rounded(P.clustered(c, _boxes(c, SMALL), "molecule", 0.1), 5)


def self_image_distance(spark, d):
    c = _coords(spark, d)
    return rounded(P.self_image(c, _boxes(c, LARGE), 0.1).select("frame", "d", "su", "sv", "sw", "atom_a", "atom_b"), 5)


def image_report(spark, d):
    c = _coords(spark, d)
    return rounded(P.image_report(c, _boxes(c, LARGE), 0.1), 5)


def image_verdict(spark, d):
    """Closest approach to an own image of each walker, the longest time under the cut-off, and the verdict of all."""
    c = _coords(spark, d)
    near = P.self_image(c, _boxes(c, LARGE), 0.1).select((F.col("frame") % 6).cast("int").alias("walker"), F.col("frame").cast("double").alias("t"), "d")
    runs = R.longest_run(near, ["walker"], "t", F.col("d") < 0.35)
    lows = near.groupBy("walker").agg(F.min("d").alias("low"))
    return rounded(R.contact_verdict(runs, lows, ["walker"], 0.35, 20.0), 5)


def _template():
    """(chain, resnum, name, resname, m, x, y, z): an ideal helix of 14 residues with a proline, and one of ten with a gap in their numbers beside it."""
    rows = []
    for chain, size, away in (("A", 14, 0.0), ("B", 10, 0.95)):
        for k, (x, y, z) in enumerate(H.ideal_helix(size).tolist()):
            residue = k // 5 + 1
            rows.append((chain, residue + (chain == "B" and residue > 6), H.WINDOW_ATOMS[k % 5], "PRO" if (chain, residue) == ("A", 9) else "ALA", len(rows), round(x + away, 6), round(y, 6), round(z, 6)))
    return rows


NOISE = 0.35


def _peptides(spark, d):
    """Each embedding moves the template's atoms, its components taken again and again."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) > 0")
    names = ("chain", "resnum", "name", "resname", "m", "x", "y", "z")
    atoms = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, row, strict=True))) for row in _template())))
    moved = lambda c, k: (F.col(c) + NOISE * F.coalesce(F.get("embedding", (F.col("m") * 3 + k) % F.size("embedding")).cast("double"), F.lit(0.0))).alias(c)
    return v.select(F.col("vec_id").alias("frame"), "embedding", atoms.alias("t")).select("frame", "embedding", "t.*").select("frame", "chain", "resnum", "name", "resname", *(moved(c, k) for k, c in enumerate("xyz")))


def hydrogen_bonds(spark, d):
    return rounded(H.hydrogen_bonds(H.backbone(_peptides(spark, d))).select("frame", "d_chain", "d", "a_chain", "a", "energy"), 5)


def secondary_codes(spark, d):
    return H.secondary_structure(_peptides(spark, d))


def helix_shares(spark, d):
    return rounded(H.helicity(H.secondary_structure(_peptides(spark, d)), (2, 13)))


def helix_windows(spark, d):
    return rounded(H.helix_windows(_peptides(spark, d), H.ideal_helix(6), (2, 14)))


def helix_windows_superposed(spark, d):
    return rounded(H.helix_windows(_peptides(spark, d), H.ideal_helix(6), (2, 14), superpose=True))


def superposed_rmsf(spark, d):
    """Fluctuations after two passes over the first eight atoms, weighted by label (0: left out), six walkers."""
    c = _coords(spark, d)
    frames = c.select("frame", F.col("label").cast("double").alias("w"), (F.col("frame") % 6).cast("int").alias("walker")).distinct()
    return rounded(A.superposed_fluctuation(c.select("frame", "atom", "x", "y", "z"), frames, list(range(8))))


def _edges(box):
    """by is a word of SQL, so it goes as yb."""
    return ", ".join(f"{v}::DOUBLE AS {k.replace('by', 'yb')}" for k, v in box.items())


_MOLECULES = f"""(SELECT frame, m AS molecule, atom, x + n * ax - n * bx + m * cx AS x, y - n * yb + m * cy AS y, z + m * cz AS z FROM (
  SELECT *, m * (frame % 5 - 2) AS n, {_edges(SMALL)} FROM (SELECT *, (CASE WHEN frame % 2 = 0 THEN atom // 11 ELSE atom // 8 END)::INTEGER AS m FROM {_COORDS})))"""
_UNITS = "*, (x - (z / cz) * cx - ((y - (z / cz) * cy) / yb) * bx) / ax AS u, (y - (z / cz) * cy) / yb AS v, z / cz AS w"
_FAR = "sqrt(pow(a.x - b.x - i * b.ax - j * b.bx - k * b.cx, 2) + pow(a.y - b.y - j * b.yb - k * b.cy, 2) + pow(a.z - b.z - k * b.cz, 2))"
_OWN = f"(SELECT a.frame, min(struct_pack(d := {_FAR}, su := i, sv := j, sw := k, atom_a := a.atom, atom_b := b.atom)) AS m FROM (SELECT *, {_edges(LARGE)} FROM {_COORDS}) a JOIN (SELECT *, {_edges(LARGE)} FROM {_COORDS}) b ON a.frame = b.frame, range(-2, 3) r1(i), range(-2, 3) r2(j), range(-2, 3) r3(k) WHERE i > 0 OR i = 0 AND (j > 0 OR j = 0 AND k > 0) GROUP BY a.frame)"

_ATOMS = "(VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{e}', {m}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for a, b, c, e, m, x, y, z in _template()) + ") t(chain, resnum, name, resname, m, x, y, z)"
_PEPTIDES = "(SELECT vec_id AS frame, chain, resnum, name, resname, " + ", ".join(f"{c} + {NOISE}::DOUBLE * coalesce(embedding[(m * 3 + {k}) % len(embedding) + 1]::DOUBLE, 0) AS {c}" for k, c in enumerate("xyz")) + f" FROM embeddings, {_ATOMS} WHERE len(embedding) > 0)"
_APART = lambda a, b: f"sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2) + pow({a}z - {b}z, 2))"
_WIDE = ", ".join(f"max({c}) FILTER (WHERE name = '{name}') AS {k}{c}" for k, name in (("n", "N"), ("a", "CA"), ("c", "C"), ("o", "O")) for c in "xyz")
_RUN = "resnum - row_number() OVER (PARTITION BY frame, chain ORDER BY resnum) AS run"
_BONDS = f"""r0 AS (SELECT frame, chain, resnum, bool_or(resname = 'PRO') AS pro, {_WIDE} FROM {_PEPTIDES} GROUP BY ALL), r1 AS (SELECT *, {_RUN} FROM r0),
r2 AS (SELECT *, {", ".join(f"lag({k}{c}) OVER (PARTITION BY frame, chain, run ORDER BY resnum) AS p{k}{c}" for k in "co" for c in "xyz")} FROM r1),
res AS MATERIALIZED (SELECT *, {", ".join(f"n{c} + 0.1 * (pc{c} - po{c}) / {_APART('pc', 'po')} AS h{c}" for c in "xyz")} FROM r2),
en AS (SELECT d.frame, d.chain AS d_chain, d.resnum AS d, d.run AS d_run, a.chain AS a_chain, a.resnum AS a, a.run AS a_run,
  CASE WHEN least({_APART('a.o', 'd.n')}, {_APART('a.c', 'd.h')}, {_APART('a.o', 'd.h')}, {_APART('a.c', 'd.n')}) < 0.05 THEN -9.9 ELSE greatest(-9.9, 2.7888::DOUBLE * (1 / {_APART('a.o', 'd.n')} + 1 / {_APART('a.c', 'd.h')} - 1 / {_APART('a.o', 'd.h')} - 1 / {_APART('a.c', 'd.n')})) END AS energy
  FROM res d JOIN res a ON d.frame = a.frame AND d.hx IS NOT NULL AND NOT d.pro AND NOT (a.chain = d.chain AND a.run = d.run AND a.resnum IN (d.resnum, d.resnum - 1)) WHERE {_APART('d.a', 'a.a')} < 0.9),
bond AS MATERIALIZED (SELECT * FROM en WHERE energy < -0.5 QUALIFY row_number() OVER (PARTITION BY frame, d_chain, d ORDER BY energy, a_chain, a) <= 2)"""
_BETWEEN = "FROM bond p JOIN bond q ON p.frame = q.frame AND p.d_chain = q.a_chain AND p.d_run = q.a_run AND p.a_chain = q.d_chain AND p.a_run = q.d_run"
_SIDE = "p.frame, p.a_chain AS ci, p.a_run AS ri, {i} AS i, p.d_chain AS cj, p.d_run AS rj, {j} AS j"
_STARTS = ", ".join(f"coalesce(t{n}, false) AND coalesce(lag(t{n}) OVER (PARTITION BY frame, chain, run ORDER BY resnum), false) AS s{n}" for n in (3, 4, 5))


def _over(what, frame):
    return f"coalesce(bool_or({what}) OVER (PARTITION BY frame, chain, run ORDER BY resnum ROWS BETWEEN {frame}), false)"


_CODES = f"""WITH {_BONDS},
pair AS (SELECT {_SIDE.format(i="p.a + 1", j="p.d")} {_BETWEEN} AND q.a = p.d AND q.d = p.a + 2 UNION ALL SELECT {_SIDE.format(i="p.a", j="p.d")} {_BETWEEN} AND q.a = p.d AND q.d = p.a
  UNION ALL SELECT {_SIDE.format(i="p.a + 1", j="p.d - 1")} {_BETWEEN} AND q.a = p.d - 2 AND q.d = p.a + 2),
mid AS (SELECT frame, chain, run, resnum FROM res QUALIFY lag(resnum) OVER (PARTITION BY frame, chain, run ORDER BY resnum) IS NOT NULL AND lead(resnum) OVER (PARTITION BY frame, chain, run ORDER BY resnum) IS NOT NULL),
good AS (SELECT pair.* FROM pair JOIN mid m ON pair.frame = m.frame AND ci = m.chain AND ri = m.run AND i = m.resnum JOIN mid o ON pair.frame = o.frame AND cj = o.chain AND rj = o.run AND j = o.resnum WHERE ci <> cj OR abs(i - j) > 2),
strand AS (SELECT frame, ci AS chain, i AS resnum FROM good UNION SELECT frame, cj, j FROM good),
turn AS (SELECT frame, a_chain AS chain, a AS resnum, {", ".join(f"bool_or(d_chain = a_chain AND d_run = a_run AND d = a + {n}) AS t{n}" for n in (3, 4, 5))} FROM bond GROUP BY ALL),
k0 AS (SELECT res.frame, res.chain, res.run, res.resnum, t3, t4, t5, strand.resnum IS NOT NULL AS e FROM res LEFT JOIN turn USING (frame, chain, resnum) LEFT JOIN strand USING (frame, chain, resnum)),
k1 AS (SELECT *, {_STARTS} FROM k0), k2 AS (SELECT *, {_over("s4", "3 PRECEDING AND CURRENT ROW")} AS h FROM k1),
k3 AS (SELECT *, s3 AND NOT {_over("h OR e", "CURRENT ROW AND 2 FOLLOWING")} AS g0 FROM k2), k4 AS (SELECT *, {_over("g0", "2 PRECEDING AND CURRENT ROW")} AS g FROM k3),
k5 AS (SELECT *, s5 AND NOT {_over("h OR e OR g", "CURRENT ROW AND 4 FOLLOWING")} AS i0 FROM k4), k6 AS (SELECT *, {_over("i0", "4 PRECEDING AND CURRENT ROW")} AS i FROM k5),
code AS (SELECT frame, chain, resnum, CASE WHEN h THEN 'H' WHEN e THEN 'E' WHEN g THEN 'G' WHEN i THEN 'I' ELSE '-' END AS code FROM k6)"""
_IDEAL = H.ideal_helix(6)
_FIXED = [(i, j, float(((_IDEAL[i] - _IDEAL[j]) ** 2).sum() ** 0.5)) for i in range(30) for j in range(i + 1, 30)]
_FIXED = [p for p in _FIXED if p[2] > 0.17]
_WINDOWS = f"""WITH r0 AS (SELECT frame, chain, resnum, count(DISTINCT name) AS n FROM {_PEPTIDES} WHERE resnum BETWEEN 2 AND 14 GROUP BY ALL), r1 AS (SELECT *, {_RUN} FROM r0 WHERE n = 5),
w AS (SELECT a.frame, a.chain, a.resnum AS first FROM r1 a JOIN r1 b ON a.frame = b.frame AND a.chain = b.chain AND a.run = b.run AND b.resnum = a.resnum + 5),
p AS MATERIALIZED (SELECT w.frame, w.chain, first, (c.resnum - first) * 5 + list_position(['N', 'CA', 'CB', 'C', 'O'], name) - 1 AS i, x, y, z FROM w JOIN {_PEPTIDES} c ON c.frame = w.frame AND c.chain = w.chain AND c.resnum BETWEEN first AND first + 5),
d AS (SELECT a.frame, a.chain, a.first, sqrt(sum(pow({_APART("a.", "b.")} - t.d, 2)) / {len(_FIXED)}) / 0.08::DOUBLE AS s FROM (VALUES {", ".join(map(str, _FIXED))}) t(i, j, d) JOIN p a ON a.i = t.i JOIN p b ON b.i = t.j AND a.frame = b.frame AND a.chain = b.chain AND a.first = b.first GROUP BY ALL)
SELECT f.frame, {r("coalesce(h, 0)", "helix")} FROM (SELECT vec_id AS frame FROM embeddings WHERE len(embedding) > 0) f LEFT JOIN (SELECT frame, sum(CASE WHEN abs(s - 1) < 1e-9 THEN 8 / 12.0::DOUBLE ELSE (1 - pow(s, 8)) / (1 - pow(s, 12)) END) AS h FROM d GROUP BY 1) g ON f.frame = g.frame"""

QUERIES = {f.__name__: f for f in (complex_clustered, self_image_distance, image_report, image_verdict, hydrogen_bonds, secondary_codes, helix_shares, helix_windows, helix_windows_superposed, superposed_rmsf)}
ORACLES = {
    "hydrogen_bonds": f"WITH {_BONDS} SELECT frame, d_chain, d, a_chain, a, {r('energy', 'energy', 5)} FROM bond",
    "secondary_codes": f"{_CODES} SELECT * FROM code",
    "helix_shares": f"{_CODES} SELECT frame, {r("avg((code IN ('H', 'G', 'I'))::INTEGER)", 'helix')}, {r("avg((code = 'E')::INTEGER)", 'strand')} FROM code WHERE resnum BETWEEN 2 AND 13 GROUP BY frame",
    "helix_windows": _WINDOWS,
    "complex_clustered": f"""WITH RECURSIVE f AS (SELECT {_UNITS} FROM (SELECT *, {_edges(SMALL)} FROM {_MOLECULES})),
j AS (SELECT *, {", ".join(f"coalesce(round_even({n} - lag({n}) OVER (PARTITION BY frame, molecule ORDER BY atom), 0), 0) AS j{n}" for n in "uvw")} FROM f),
t AS (SELECT *, {", ".join(f"sum(j{n}) OVER (PARTITION BY frame, molecule ORDER BY atom) AS s{n}" for n in "uvw")} FROM j),
s AS MATERIALIZED (SELECT frame, molecule, atom, ax, bx, yb, cx, cy, cz, x - su * ax - sv * bx - sw * cx AS x, y - sv * yb - sw * cy AS y, z - sw * cz AS z, u - su AS u, v - sv AS v, w - sw AS w FROM t),
c AS (SELECT frame, molecule, avg(u) AS u, avg(v) AS v, avg(w) AS w FROM s GROUP BY 1, 2),
o AS MATERIALIZED (SELECT p.frame, p.molecule AS ma, q.molecule AS mb, (round_even(p.u - q.u, 0) + i)::BIGINT AS i, (round_even(p.v - q.v, 0) + j)::BIGINT AS j, (round_even(p.w - q.w, 0) + k)::BIGINT AS k
  FROM c p JOIN c q ON p.frame = q.frame AND p.molecule < q.molecule, range(-2, 3) r1(i), range(-2, 3) r2(j), range(-2, 3) r3(k)),
e AS MATERIALIZED (SELECT o.frame, ma, mb, min(struct_pack(d := {_FAR}, su := i, sv := j, sw := k)) AS m FROM o JOIN s a ON a.frame = o.frame AND a.molecule = ma JOIN s b ON b.frame = o.frame AND b.molecule = mb GROUP BY ALL),
p AS (SELECT frame, 1 AS step, [struct_pack(part := min(molecule), u := 0::BIGINT, v := 0::BIGINT, w := 0::BIGINT)] AS placed FROM s GROUP BY frame
  UNION ALL SELECT frame, step + 1, list_append(any_value(placed), arg_min(fresh, key)) FROM (
    SELECT frame, step, placed, struct_pack(d := m.d, a := ma, b := mb) AS key, CASE WHEN pa IS NOT NULL THEN struct_pack(part := mb, u := pa.u + m.su, v := pa.v + m.sv, w := pa.w + m.sw) ELSE struct_pack(part := ma, u := pb.u - m.su, v := pb.v - m.sv, w := pb.w - m.sw) END AS fresh
    FROM (SELECT p.frame, step, placed, ma, mb, m, list_filter(placed, lambda q: q.part = ma)[1] AS pa, list_filter(placed, lambda q: q.part = mb)[1] AS pb FROM p JOIN e ON p.frame = e.frame) WHERE (pa IS NULL) <> (pb IS NULL)) GROUP BY frame, step),
l AS (SELECT frame, unnest(arg_max(placed, step)) AS t FROM p GROUP BY frame)
SELECT s.frame, molecule, atom, round(x + t.u * ax + t.v * bx + t.w * cx, 5) AS x, round(y + t.v * yb + t.w * cy, 5) AS y, round(z + t.w * cz, 5) AS z FROM s JOIN l ON s.frame = l.frame AND s.molecule = l.t.part""",
    "self_image_distance": f"SELECT frame, round(m.d, 5) AS d, m.su AS su, m.sv AS sv, m.sw AS sw, m.atom_a AS atom_a, m.atom_b AS atom_b FROM {_OWN}",
    "image_report": f"""SELECT o.frame, {r("m.d", "dist", 5)}, {r("longest", "longest", 5)}, {r("sqrt(pow(0.9::DOUBLE, 2))", "box_x", 5)}, {r("sqrt(pow(0.2::DOUBLE, 2) + pow(0.8::DOUBLE, 2))", "box_y", 5)}, {r("sqrt(pow(0.1::DOUBLE, 2) + pow(0.15::DOUBLE, 2) + pow(0.7::DOUBLE, 2))", "box_z", 5)}
FROM {_OWN} o JOIN (SELECT a.frame, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS longest FROM {_COORDS} a JOIN {_COORDS} b ON a.frame = b.frame GROUP BY 1) l ON o.frame = l.frame""",
    "image_verdict": f"""WITH f AS (SELECT (frame % 6)::INTEGER AS walker, frame::DOUBLE AS t, m.d AS d FROM {_OWN}), a AS (SELECT walker, t, d, d < 0.35 AS ok, t - lag(t) OVER (PARTITION BY walker ORDER BY t) AS dt FROM f), b AS (SELECT *, sum((NOT ok)::INTEGER) OVER (PARTITION BY walker ORDER BY t) AS g FROM a),
c AS (SELECT walker, max(n) AS n FROM (SELECT walker, g, count(*) FILTER (WHERE ok) AS n FROM b GROUP BY 1, 2) GROUP BY 1), s AS (SELECT walker, median(dt) AS step, min(d) AS low FROM a GROUP BY 1),
v AS (SELECT walker, low, n AS rows, step, n * step AS time, n * step > 20.0 AS lasting FROM c JOIN s USING (walker))
SELECT walker, round(low, 5) AS low, rows, round(step, 5) AS step, round(time, 5) AS time, lasting, CASE WHEN min(low) OVER () >= 0.35 THEN 'clear' WHEN NOT bool_or(lasting) OVER () THEN 'transient' ELSE 'sustained' END AS verdict FROM v""",
}
