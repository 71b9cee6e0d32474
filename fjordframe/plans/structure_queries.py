"""Structural queries: embeddings in the role of structures, and small in-code tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordframe.functions.ranges import format_ranges, parse_ranges
from fjordframe.operators import basins as B
from fjordframe.operators import selection as S
from fjordframe.operators import structure as A
from fjordframe.plans.source_queries import ATOMS as ATOM_ROWS
from fjordframe.plans.source_queries import atoms
from fjordframe.plans.standin import r, rounded

ATOMS = 22


def _coords(spark, d):
    """Each embedding as atoms of three coordinates, 22 of 64 components; what lacks of the last is zero."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) > 0")
    triple = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 3).cast("int") - 1), lambda k: F.struct(k.alias("atom"), *(F.coalesce(F.get("embedding", (k * 3 + c).cast("int")).cast("double"), F.lit(0.0)).alias(n) for c, n in enumerate("xyz")))))
    return v.select(F.col("vec_id").alias("frame"), "label", triple.alias("a")).select("frame", "label", "a.*")


_COORDS = "(SELECT vec_id AS frame, label, k::INTEGER AS atom, coalesce(embedding[k * 3 + 1]::DOUBLE, 0) AS x, coalesce(embedding[k * 3 + 2]::DOUBLE, 0) AS y, coalesce(embedding[k * 3 + 3]::DOUBLE, 0) AS z FROM (SELECT *, unnest(range((len(embedding) + 2) // 3)) AS k FROM embeddings))"


def contacts(spark, d):
    every = _coords(spark, d).withColumn("resnum", F.col("atom"))
    return rounded(S.nearby_pairs(every, "atom", "resnum", ("x", "y", "z"), 0.25, 4, ["frame"]))


def q_mean(spark, d):
    c = _coords(spark, d)
    one = c.where("frame = 0").withColumn("resnum", F.col("atom"))
    ref = S.nearby_pairs(one, "atom", "resnum", ("x", "y", "z"), 0.25, 4).withColumnRenamed("dist", "ref").withColumn("weight", F.lit(1.0))
    return rounded(A.native_fraction(c, ref, 10.0))


def weighted_rmsf(spark, d):
    return rounded(A.weighted_fluctuation(_coords(spark, d).withColumn("w", (F.col("label") + 1.0)), "atom", ["x", "y", "z"], "w"))


def rmsf_walker_err(spark, d):
    return rounded(A.walker_error(_coords(spark, d).withColumn("w", (F.col("label") + 1.0)), "atom", ["x", "y", "z"], "w", "label"))


def gyration(spark, d):
    return rounded(A.gyration(_coords(spark, d)))


def segment_means(spark, d):
    profile = A.weighted_fluctuation(_coords(spark, d).withColumn("w", F.lit(1.0)), "atom", ["x", "y", "z"], "w")
    segments = spark.sql("SELECT * FROM VALUES ('a', 0, 5), ('b', 6, 12), ('c', 13, 21) AS s(segment, first, last)")
    return rounded(A.segment_means(profile, "atom", "rmsf", segments))


def coordination(spark, d):
    atoms = spark.range(ATOMS).select(F.col("id").cast("int").alias("atom"))
    return rounded(A.coordination(_coords(spark, d), atoms.where("atom < 8"), atoms.where("atom >= 12"), 0.2))


def medoid(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(B.medoids(v, "label", "vec_id", "v"))


def medoid_of_drawn(spark, d):
    """At most 20 members of a state are drawn and compared."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(B.medoids(v, "label", "vec_id", "v", most=20))


def structural_medoid(spark, d):
    return B.structural_medoids(_coords(spark, d), "label", 12).select("label", "frame", F.round("total", 5).alias("total"))


def superposed_rmsd(spark, d):
    """Every structure laid over structure 0: its deviation and the spread of its laid atoms about the reference's centre."""
    c = _coords(spark, d)
    reference = c.where("frame = 0").select("atom", "x", "y", "z").toPandas()  # one structure
    laid = A.superposed(c, reference)
    return laid.groupBy("frame").agg(F.round(F.max("rmsd"), 6).alias("rmsd"), F.round(F.avg("x"), 6).alias("x"), F.count("*").alias("n"))


def axis_angle(spark, d):
    return rounded(A.axis_angle(_coords(spark, d), list(range(8)), list(range(12, 21))))


def contact_map_value(spark, d):
    contacts = spark.range(6).select(F.col("id").cast("int").alias("a"), (F.col("id") * 2 + 8).cast("int").alias("b"), (F.col("id") / 20 + 0.1).alias("ref"), ((F.col("id") + 1) / 21).alias("weight"))
    return rounded(A.contact_map_value(_coords(spark, d), contacts, 10.0, 1.2))


def centre_geometry(spark, d):
    groups = spark.range(15).select(F.element_at(F.array(F.lit("p"), F.lit("o"), F.lit("q")), (F.floor(F.col("id") / 5) + 1).cast("int")).alias("grp"), F.col("id").cast("int").alias("atom"), (F.col("id") % 3 + 1.0).alias("mass"))
    return rounded(A.centre_geometry(A.centres(_coords(spark, d), groups), "p", "o", "q"))


def walls(spark, d):
    c = _coords(spark, d).groupBy("frame").agg(F.avg("x").alias("m"))
    return rounded(c.select("frame", A.lower_wall(F.col("m"), 0.01, 5000.0).alias("lower"), A.upper_wall(F.col("m"), 0.005, 5000.0).alias("upper")))


def _residue_atoms(spark):
    return spark.range(ATOMS).select(F.col("id").cast("int").alias("atom"), F.floor(F.col("id") / 3).cast("int").alias("resnum"), F.when(F.col("id") < 12, "A").otherwise("B").alias("chain"), F.when(F.col("id") % 5 == 4, "HX").otherwise("CX").alias("name"))


def residue_contacts(spark, d):
    return A.residue_contacts(_coords(spark, d), _residue_atoms(spark), F.col("chain") == "A", F.col("chain") == "B", 0.25)


def residue_contacts_periodic(spark, d):
    """Distances to the nearest image in an angled box that is smaller than the structures."""
    boxes = _coords(spark, d).select("frame").distinct().select("frame", F.lit(0.6).alias("ax"), F.lit(0.1).alias("bx"), F.lit(0.55).alias("by"), F.lit(-0.05).alias("cx"), F.lit(0.08).alias("cy"), F.lit(0.5).alias("cz"))
    return A.residue_contacts(_coords(spark, d), _residue_atoms(spark), F.col("chain") == "A", F.col("chain") == "B", 0.2, boxes)


def whole_molecules(spark, d):
    """Structures in a box smaller than they are, each atom beside the one before."""
    boxes = _coords(spark, d).select("frame").distinct().select("frame", F.lit(0.3).alias("ax"), F.lit(0.05).alias("bx"), F.lit(0.28).alias("by"), F.lit(-0.02).alias("cx"), F.lit(0.04).alias("cy"), F.lit(0.26).alias("cz"))
    return rounded(A.made_whole(_coords(spark, d).withColumn("chain", F.col("atom") >= 11).drop("label"), boxes, "chain"), 5)


def atom_groups(spark, d):
    return A.atoms_in(atoms(spark, d), (5, 60), ["CA", "N"], ["A", "B"], "C").select("serial", "name", "chain", "resnum")


def copies_by_reset(spark, d):
    return A.copies_by_reset(atoms(spark, d), "row").groupBy("copy").agg(F.count("*").alias("n"), F.min("row").alias("first"))


def terminal_atoms(spark, d):
    return A.terminal(atoms(spark, d)).select("serial", "chain", "resnum")


def renamed_atoms(spark, d):
    return A.renamed(atoms(spark, d), {"DA": "DA5", "ALA": "GLY"}, {"HB": "H1"}).groupBy("resname", "name").count()


def mutated_atoms(spark, d):
    a = atoms(spark, d)
    placed = a.where("row = 1").withColumns({"serial": F.lit(99_999), "name": F.lit("OG"), "resname": F.lit("SER"), "resnum": F.lit(21), "chain": F.lit("A")})
    return A.mutated(a, 21, "A", "SER", ["N", "CA", "C"], placed).where("resnum = 21").select("serial", "name", "resname", "chain")


#: Residues that are changed, and what stands for CB in stand-in atoms.
SITES, FRAME = "chain = 'A' AND resnum % 5 = 3", ("N", "CA", "C")


def side_chains(spark, d):
    """An aspartate's side chain on every fifth residue of a chain."""
    a = atoms(spark, d)
    return rounded(A.side_chain(a, a.where(SITES), A.aspartate(), "ASP", FRAME), 4)


def substituted_atoms(spark, d):
    a = atoms(spark, d)
    return rounded(A.substituted(a, a.where(SITES), "ASP", ["N", "CA", "C"], A.aspartate(), FRAME).drop("row"), 4)


def without_terminal_atoms(spark, d):
    return A.without_at_start(atoms(spark, d), ["N", "HB"], ["B", "C"]).select("serial", "chain", "name")


def ranges_text(spark, d):
    """Texts of ranges over each part's key, parsed and written again: two ranges, three numbers out of order, and one range."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("int").alias("k"))
    text = F.when(F.col("k") % 3 == 0, F.format_string("%d-%d,%d-%d", F.col("k"), F.col("k") + 4, F.col("k") + 8, F.col("k") + 9)).when(F.col("k") % 3 == 1, F.format_string("%d-%d,%d,%d", F.col("k"), F.col("k"), F.col("k") + 6, F.col("k") + 4)).otherwise(F.format_string("%d-%d", F.col("k"), F.col("k") + F.col("k") % 7))
    rows = p.select(text.alias("text"))
    return rows.select("text", F.size(parse_ranges(F.col("text"))).alias("n"), format_ranges(parse_ranges(F.col("text"))).alias("back"))


_W = f"(SELECT *, label + 1.0::DOUBLE AS w FROM {_COORDS})"


def _rmsf(source: str, by: str) -> str:
    return f"(SELECT {by}, sqrt(sum(w * (pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) / sum(w)) AS rmsf FROM {source} JOIN (SELECT {by}, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM {source} GROUP BY ALL) USING ({by}) GROUP BY {by})"


_D = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
_PAIRS = f"(SELECT a.atom AS a, b.atom AS b, {_D} AS dist FROM {_COORDS} a JOIN {_COORDS} b ON a.frame = 0 AND b.frame = 0 AND a.atom < b.atom AND b.atom - a.atom >= 4 WHERE {_D} < 0.25)"

QUERIES = {f.__name__: f for f in (contacts, q_mean, weighted_rmsf, rmsf_walker_err, gyration, segment_means, coordination, medoid, medoid_of_drawn, structural_medoid, superposed_rmsd, axis_angle, contact_map_value, centre_geometry, walls, residue_contacts, residue_contacts_periodic, whole_molecules, atom_groups, copies_by_reset, terminal_atoms, renamed_atoms, mutated_atoms, side_chains, substituted_atoms, without_terminal_atoms, ranges_text)}
_MEDOID = "SELECT label, a AS vec_id, round(total, 6) AS total FROM (SELECT p.label, p.vec_id AS a, sum(sqrt(list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda e: pow(e[1]::DOUBLE - e[2]::DOUBLE, 2))))) AS total FROM {e} p JOIN {e} q ON p.label = q.label GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY label ORDER BY total, a) = 1"
_DRAWN = f"(SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY ln(((('0x' || substr(md5('42:' || vec_id), 1, 13))::BIGINT >> 2) + 1) / {float((1 << 50) + 1)!r}::DOUBLE) DESC, vec_id) <= 20)"
_CENTRES = f"(SELECT frame, (['p', 'o', 'q'])[atom // 5 + 1] AS grp, " + ", ".join(f"sum((atom % 3 + 1) * {c}) / sum(atom % 3 + 1) AS {c}" for c in "xyz") + f" FROM {_COORDS} WHERE atom < 15 GROUP BY 1, 2)"
_RES = f"(SELECT frame, atom // 3 AS res, atom < 12 AS a, x, y, z FROM {_COORDS} WHERE atom % 5 <> 4)"
_IMAGE = "sqrt(pow(a.x - b.x + i * 0.6 + j * 0.1 - k * 0.05, 2) + pow(a.y - b.y + j * 0.55 + k * 0.08, 2) + pow(a.z - b.z + k * 0.5, 2))"


def _near(distance: str, images: str, cutoff: float) -> str:
    return f"SELECT f.frame, coalesce(n, 0) AS n FROM (SELECT DISTINCT vec_id AS frame FROM embeddings) f LEFT JOIN (SELECT a.frame, count(DISTINCT a.res * 100 + b.res) AS n FROM {_RES} a JOIN {_RES} b ON a.frame = b.frame AND a.a AND NOT b.a {images} WHERE {distance} < {cutoff} GROUP BY 1) c ON c.frame = f.frame"


_SPOTS = ", ".join(f"min_by({c}, serial) FILTER (WHERE name = '{name}') AS {k}{c}" for k, name in (("n", "N"), ("a", "CA"), ("b", "C")) for c in "xyz")
_PLACED = f"""p AS (SELECT chain, resnum, {_SPOTS} FROM {ATOM_ROWS} WHERE chain = 'A' AND resnum % 5 = 3 GROUP BY ALL), e AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2) + pow(bz - az, 2)) AS l FROM p WHERE nx IS NOT NULL AND ax IS NOT NULL AND bx IS NOT NULL),
f AS (SELECT *, (bx - ax) / l AS ex, (b_y - ay) / l AS ey, (bz - az) / l AS ez FROM e), g AS (SELECT *, (ny - ay) * ez - (nz - az) * ey AS cx, (nz - az) * ex - (nx - ax) * ez AS cy, (nx - ax) * ey - (ny - ay) * ex AS cz FROM f),
h AS (SELECT *, cx / sqrt(cx * cx + cy * cy + cz * cz) AS zx, cy / sqrt(cx * cx + cy * cy + cz * cz) AS zy, cz / sqrt(cx * cx + cy * cy + cz * cz) AS zz FROM g), i AS (SELECT *, zy * ez - zz * ey AS yx, zz * ex - zx * ez AS yy, zx * ey - zy * ex AS yz FROM h),
placed AS (SELECT ((SELECT max(serial) FROM {ATOM_ROWS}) + row_number() OVER (ORDER BY chain, resnum, k))::INTEGER AS serial, name, 'ASP' AS resname, chain, resnum, bx + u * ex + v * yx AS x, b_y + u * ey + v * yy AS y, bz + u * ez + v * yz AS z
  FROM i, (VALUES (0, 'CG', 1.52::DOUBLE, 0::DOUBLE), (1, 'OD1', 1.52::DOUBLE + 1.25::DOUBLE * cos(radians(120)), 1.25::DOUBLE * sin(radians(120))), (2, 'OD2', 1.52::DOUBLE + 1.25::DOUBLE * cos(radians(120)), -1.25::DOUBLE * sin(radians(120)))) t(k, name, u, v))""".replace("by,", "b_y,").replace("AS by", "AS b_y")
ORACLES = {
    "side_chains": f"WITH {_PLACED} SELECT serial, name, resname, chain, resnum, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM placed",
    "substituted_atoms": f"WITH {_PLACED} SELECT serial, name, CASE WHEN k.chain IS NULL THEN resname ELSE 'ASP' END AS resname, a.chain, a.resnum, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM {ATOM_ROWS} a LEFT JOIN (SELECT DISTINCT chain, resnum FROM placed) k ON a.chain = k.chain AND a.resnum = k.resnum WHERE k.chain IS NULL OR name IN ('N', 'CA', 'C') UNION ALL SELECT serial, name, resname, chain, resnum, round(x, 4), round(y, 4), round(z, 4) FROM placed",
    "without_terminal_atoms": f"SELECT serial, chain, name FROM {ATOM_ROWS} QUALIFY NOT (chain IN ('B', 'C') AND name IN ('N', 'HB') AND resnum = min(resnum) OVER (PARTITION BY chain))",
    "medoid_of_drawn": _MEDOID.format(e=_DRAWN),
    "contact_map_value": f"SELECT a.frame, {r(f'sum((p.id + 1) / 21.0::DOUBLE / (1 + exp(10 * ({_D} - 1.2::DOUBLE * (p.id / 20.0::DOUBLE + 0.1::DOUBLE)))))', 'cmap')} FROM range(6) p(id) JOIN {_COORDS} a ON a.atom = p.id JOIN {_COORDS} b ON b.frame = a.frame AND b.atom = p.id * 2 + 8 GROUP BY 1",
    "centre_geometry": f"""WITH c AS (SELECT * FROM {_CENTRES}), v AS (SELECT p.frame, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS dist, (p.x - o.x) * (q.x - o.x) + (p.y - o.y) * (q.y - o.y) + (p.z - o.z) * (q.z - o.z) AS dot,
sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2) + pow(p.z - o.z, 2)) * sqrt(pow(q.x - o.x, 2) + pow(q.y - o.y, 2) + pow(q.z - o.z, 2)) AS n FROM c p JOIN c o USING (frame) JOIN c q USING (frame) WHERE p.grp = 'p' AND o.grp = 'o' AND q.grp = 'q')
SELECT frame, round(dist, 6) AS dist, round(acos(greatest(-1, least(1, dot / n))), 6) AS theta FROM v""",
    "walls": f"SELECT frame, round(CASE WHEN m < 0.01 THEN 5000 * pow(m - 0.01::DOUBLE, 2) ELSE 0 END, 6) AS lower, round(CASE WHEN m > 0.005 THEN 5000 * pow(m - 0.005::DOUBLE, 2) ELSE 0 END, 6) AS upper FROM (SELECT frame, avg(x) AS m FROM {_COORDS} GROUP BY 1)",
    "residue_contacts": _near(_D, "", 0.25),
    "residue_contacts_periodic": _near(_IMAGE, ", range(-4, 5) u(i), range(-4, 5) v(j), range(-4, 5) w(k)", 0.2),
    "whole_molecules": f"""WITH f AS (SELECT *, atom >= 11 AS chain, z / 0.26::DOUBLE AS w FROM {_COORDS}), g AS (SELECT *, (y - w * 0.04::DOUBLE) / 0.28::DOUBLE AS v FROM f), h AS (SELECT *, (x - w * -0.02::DOUBLE - v * 0.05::DOUBLE) / 0.3::DOUBLE AS u FROM g),
j AS (SELECT *, {", ".join(f"coalesce(round_even({n} - lag({n}) OVER (PARTITION BY frame, chain ORDER BY atom), 0), 0) AS j{n}" for n in "uvw")} FROM h),
s AS (SELECT *, {", ".join(f"sum(j{n}) OVER (PARTITION BY frame, chain ORDER BY atom) AS s{n}" for n in "uvw")} FROM j)
SELECT frame, chain, atom, round(x - su * 0.3::DOUBLE - sv * 0.05::DOUBLE - sw * -0.02::DOUBLE, 5) AS x, round(y - sv * 0.28::DOUBLE - sw * 0.04::DOUBLE, 5) AS y, round(z - sw * 0.26::DOUBLE, 5) AS z FROM s""",
    "atom_groups": f"SELECT serial, name, chain, resnum FROM {ATOM_ROWS} WHERE resnum BETWEEN 5 AND 60 AND name = 'CA' AND chain IN ('A', 'B')",
    "copies_by_reset": f"SELECT copy, count(*) AS n, min(row) AS first FROM (SELECT row, sum(f) OVER (ORDER BY row)::BIGINT AS copy FROM (SELECT row, coalesce(resnum < lag(resnum) OVER (ORDER BY row), false)::INTEGER AS f FROM {ATOM_ROWS})) GROUP BY 1",
    "terminal_atoms": f"SELECT serial, chain, resnum FROM {ATOM_ROWS} QUALIFY resnum IN (min(resnum) OVER (PARTITION BY chain), max(resnum) OVER (PARTITION BY chain))",
    "renamed_atoms": f"SELECT CASE resname WHEN 'DA' THEN 'DA5' WHEN 'ALA' THEN 'GLY' ELSE resname END AS resname, CASE name WHEN 'HB' THEN 'H1' ELSE name END AS name, count(*) AS count FROM {ATOM_ROWS} GROUP BY 1, 2",
    "mutated_atoms": f"SELECT serial, name, CASE WHEN chain = 'A' THEN 'SER' ELSE resname END AS resname, chain FROM {ATOM_ROWS} WHERE resnum = 21 AND (chain <> 'A' OR name IN ('N', 'CA', 'C')) UNION ALL VALUES (99999, 'OG', 'SER', 'A')",
    "contacts": f"SELECT frame, a.atom AS a, b.atom AS b, {r(_D, 'dist')} FROM {_COORDS} a JOIN {_COORDS} b USING (frame) WHERE a.atom < b.atom AND b.atom - a.atom >= 4 AND {_D} < 0.25",
    "q_mean": f"SELECT a.frame, {r(f'avg(1 / (1 + exp(10 * ({_D} - p.dist))))', 'q')} FROM {_COORDS} a JOIN {_COORDS} b USING (frame) JOIN {_PAIRS} p ON a.atom = p.a AND b.atom = p.b GROUP BY 1",
    "weighted_rmsf": f"SELECT atom, {r('rmsf', 'rmsf')} FROM {_rmsf(_W, 'atom')}",
    "rmsf_walker_err": f"SELECT atom, {r('stddev_samp(rmsf)', 'err')} FROM {_rmsf(_W, 'label, atom')} GROUP BY atom",
    "gyration": f"SELECT frame, {r('sqrt(var_pop(x) + var_pop(y) + var_pop(z))', 'rg')} FROM {_COORDS} GROUP BY frame",
    "segment_means": f"SELECT segment, {r('avg(rmsf)', 'mean')} FROM {_rmsf(f'(SELECT *, 1.0::DOUBLE AS w FROM {_COORDS})', 'atom')} JOIN (VALUES ('a', 0, 5), ('b', 6, 12), ('c', 13, 21)) s(segment, first, last) ON atom BETWEEN first AND last GROUP BY segment",
    "coordination": f"SELECT a.frame, {r(f'sum(1 / (1 + pow({_D} / 0.2::DOUBLE, 6)))', 'value')} FROM {_COORDS} a JOIN {_COORDS} b USING (frame) WHERE a.atom < 8 AND b.atom >= 12 GROUP BY 1",
    "medoid": f"SELECT label, a AS vec_id, {r('total', 'total')} FROM (SELECT p.label, p.vec_id AS a, sum(sqrt(list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda e: pow(e[1]::DOUBLE - e[2]::DOUBLE, 2))))) AS total FROM embeddings p JOIN embeddings q ON p.label = q.label GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY label ORDER BY total, a) = 1",
    "ranges_text": """SELECT CASE k % 3 WHEN 0 THEN k || '-' || k + 4 || ',' || k + 8 || '-' || k + 9 WHEN 1 THEN k || '-' || k || ',' || k + 6 || ',' || k + 4 ELSE k || '-' || k + k % 7 END AS text, CASE k % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE k % 7 + 1 END::INTEGER AS n,
CASE k % 3 WHEN 0 THEN array_to_string(list_concat(range(k, k + 5), [k + 8, k + 9]), ',') WHEN 1 THEN k || ',' || k + 4 || ',' || k + 6 ELSE CASE WHEN k % 7 = 0 THEN k::VARCHAR ELSE k || '-' || k + k % 7 END END AS back FROM (SELECT p_partkey AS k FROM part)""",
}
