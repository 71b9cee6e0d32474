"""Reader and writer queries: driver tables are written as text in the formats of the readers, and read back.

Each query writes into a folder of its own under spark.checkpoint.dir. Every fiftieth or so line is malformed on purpose;
the DuckDB counterparts leave the same rows out.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordframe.functions.lineage import shared_folder
from fjordframe.functions.ranges import bend_degrees
from fjordframe.operators import hist as H
from fjordframe.operators import runs as R
from fjordframe.operators import structure as A
from fjordframe.operators.ordering import ROWS
from fjordframe.plans.standin import AX, FRAMES, KBT, frames, r, rounded
from fjordframe.plans.surface_queries import _VGRID, GX, GY, _walker_grid
from fjordframe.sources import sinks
from fjordframe.sources import text as S
from fjordframe.sources.trajectory import atom_rows, boxes_of, read_trajectory, write_trajectory


def _folder(spark, name):
    return f"{shared_folder(spark)}/fjordframe-{name}-{uuid.uuid4().hex}"


def _text(lines, order, path, head=""):
    """Lines of a table (value, order), in order over a folder's files, about ROWS lines each; head comes first."""
    rows = lines.select(F.col(order).alias("_o"), "value")
    rows = rows.unionByName(lines.sparkSession.createDataFrame([(-1 - k, line) for k, line in enumerate(reversed(head.splitlines()))], "_o long, value string")) if head else rows
    parts = lines.count() // ROWS + 1
    (rows.repartitionByRange(parts, "_o") if parts > 1 else rows.coalesce(1)).sortWithinPartitions("_o").select("value").write.text(path)
    return path


def _broken(row, whole, short, odd):
    """Every 50th line is short and every 50th of another kind odd."""
    return F.when(row % 50 == 7, short).when(row % 50 == 9, odd).otherwise(whole)


def _series(spark, d):
    """Frames as text, a file per walker: time in ps, x, y, w."""
    f = frames(spark, d).withColumn("ps", F.rint(F.col("t") * 1000))
    whole = F.concat_ws(" ", "ps", "x", "y", "w")
    lines = f.select("walker", "row", _broken(F.col("row"), whole, F.concat_ws(" ", "ps", "x"), F.concat_ws(" ", "ps", F.lit("nan"), "y", "w")).alias("value"))
    path = _folder(spark, "colvar")
    lines.repartition("walker").sortWithinPartitions("walker", "row").select("walker", "value").write.partitionBy("walker").text(path)
    return f"{path}/walker=*"


_PS = "round_even(t * 1000, 0)"
_KEPT = "row % 50 NOT IN (7, 9)"


def read_series(spark, d):
    rows = S.read_series(spark, _series(spark, d), {"x": 1, "w": 3})
    return rounded(rows.select("walker", "t", "x", "w"))


def read_series_sums(spark, d):
    return rounded(S.read_series(spark, _series(spark, d), {"s": [1, 2], "w": 3}).select("walker", "t", "s"))


def read_capped(spark, d):
    return rounded(S.read_capped(spark, _series(spark, d), {"x": 1}, 300_000.0).groupBy("walker").agg(F.count("*").alias("n"), F.max("t").alias("t")))


def last_time(spark, d):
    """From the files' last blocks."""
    rows = S.last_times(spark, _series(spark, d), {"x": 1, "y": 2, "w": 3})
    return rounded(rows.select(S.walker_of(F.col("file")).alias("walker"), "t"))


def cached_stride(spark, d):
    """Every 7th row of each file after parsing, made once and read from the cache the second time."""
    path, source = _folder(spark, "cache"), _series(spark, d)
    made = []

    def make():
        made.append(1)
        rows = S.read_series(spark, source, {"x": 1, "w": 3})
        return R.every_nth(rows, ["walker"], "row", 7).select("walker", "t", "x")

    key = [{"x": 1, "w": 3}, 7]
    sinks.cached(spark, path, key, make, source)
    out = sinks.cached(spark, path, key, make, source)
    return rounded(out.withColumn("made", F.lit(len(made))))


def cached_files(spark, d):
    """Series cached file by file: after one walker's file has changed, that one alone is read again."""
    f = frames(spark, d).withColumn("value", F.concat_ws(" ", F.rint(F.col("t") * 1000), "x", "y", "w"))
    source, path, made = _folder(spark, "colvar"), _folder(spark, "cache"), []
    for k in range(6):
        f.where(F.col("walker") == k).coalesce(1).sortWithinPartitions("row").select("value").write.text(f"{source}/walker={k}")

    def make(files):
        made.append(len(files))
        return S.read_series(spark, files, {"x": 1, "w": 3}).select("file", "walker", "t", "x")

    read = lambda: sinks.cached_by_file(spark, path, [{"x": 1, "w": 3}], f"{source}/walker=*", make)
    before = read().groupBy("walker").agg(F.count("*").alias("before"))
    read()
    f.where("walker = 3 AND row % 3 > 0").coalesce(1).sortWithinPartitions("row").select("value").write.mode("overwrite").text(f"{source}/walker=3")
    after = read().groupBy("walker").agg(F.count("*").alias("after"), F.sum("x").alias("x"))
    return rounded(before.join(after, "walker").withColumn("read", F.lit(",".join(map(str, made)))), 4)


def _with_header(spark, d):
    f = frames(spark, d).withColumn("theta", F.radians("y"))
    whole = F.concat_ws(" ", "t", "theta", "x", "w")
    lines = f.select("row", _broken(F.col("row"), whole, F.concat_ws(" ", "t", "theta"), F.concat_ws(" ", whole, F.lit("9"))).alias("value"))
    return _text(lines, "row", _folder(spark, "headed"), "#! FIELDS time theta cmap q_A\n# another line of the header\n" + "\n".join(f"#! SET k{k} 0" for k in range(250)))


def read_with_header(spark, d):
    rows = S.read_with_header(spark, _with_header(spark, d), {"time": "t", "cmap": "contacts"}, ["theta"])
    return rounded(rows.select("t", bend_degrees(F.col("theta")).alias("bend"), "contacts", "q_A"))


def missing_series(spark, d):
    """Eight walkers are asked for; a file that is not there reads as nothing."""
    path = _folder(spark, "walkers")
    lines = frames(spark, d).select("walker", "row", F.concat_ws(" ", "t", "x").alias("value"))
    heads = lines.select("walker").distinct().select("walker", F.lit(-1).cast("long").alias("row"), F.lit("#! FIELDS time x").alias("value"))
    lines.unionByName(heads).repartition("walker").sortWithinPartitions("walker", "row").select("walker", "value").write.partitionBy("walker").text(path)
    found = {k: S.read_with_header(spark, f"{path}/walker={k}", missing_ok=True) for k in range(8)}
    parts = [rows.agg(F.lit(k).alias("walker"), F.lit(False).alias("missing"), F.count("*").alias("n")) for k, rows in found.items() if rows is not None]
    lost = spark.createDataFrame([(k, True, 0) for k, rows in found.items() if rows is None], "walker int, missing boolean, n long")
    return reduce(DataFrame.unionByName, parts, lost)


def copies_of(spark, d):
    rows = S.read_with_header(spark, _with_header(spark, d), {"time": "t"}).drop("row", "theta")
    return rounded(S.copies_of(rows, ["t"]))


def header_lines(spark, d):
    path = _with_header(spark, d)
    return spark.createDataFrame([(len(S.header(spark, path)), ",".join(S.header_fields(spark, path)))], "n long, fields string")


def skipped_lines(spark, d):
    return S.skipped_lines(spark, _series(spark, d), 2)


def _hills(spark, d):
    f = frames(spark, d).where("kind = 'purchase'")
    path = _folder(spark, "hills")
    line = F.concat_ws(" ", "t", "x", "y", F.lit("8.0"), F.lit("4.0"), "w", F.col("walker") + 10, F.lit("1"))
    f.select("walker", "row", line.alias("value")).repartition("walker").sortWithinPartitions("walker", "row").select("walker", "value").write.partitionBy("walker").text(path)
    return f"{path}/walker=*"


def read_hills(spark, d):
    h = S.read_hills(spark, _hills(spark, d), 2)
    return rounded(h.select("walker", "t", F.col("centre")[0].alias("c1"), F.col("centre")[1].alias("c2"), F.col("sigma")[1].alias("s2"), "height"))


def first_bias_factor(spark, d):
    """From the files' first blocks."""
    return S.first_bias_factors(spark, _hills(spark, d), 2).select(S.walker_of(F.col("file")).alias("walker"), "gamma")


def read_grid(spark, d):
    """A surface in scrambled rows; indices are places among the axis values that occur."""
    f = _walker_grid(spark, d).where("walkers >= 2").select(GX.centre(F.col("i")).alias("x"), GY.centre(F.col("j")).alias("y"), "mean")
    lines = f.select(F.xxhash64("x", "y").alias("o"), F.concat_ws(" ", "x", "y", "mean").alias("value"))
    return rounded(S.read_grid(spark, _text(lines, "o", _folder(spark, "grid"), "#! FIELDS x y f"), 2))


def read_table(spark, d):
    """A table with its sixth column, and one without it: null there."""
    g = _walker_grid(spark, d)
    parts = []
    for k, columns in enumerate((["i", "j", "mean", "std", "n", "walkers"], ["i", "j", "mean", "std", "n"])):
        lines = g.select((F.col("i") * 1000 + F.col("j")).alias("o"), F.concat_ws(" ", *columns).alias("value"))
        path = _text(lines, "o", _folder(spark, "table"), "# i j F_mean(kJ/mol)")
        parts.append(S.read_table(spark, path, ["i", "j", "mean", "std", "n"], ["walkers"]).drop("row").withColumn("part", F.lit(k)))
    return parts[0].unionByName(parts[1])


def read_medoids(spark, d):
    f = frames(spark, d)
    lines = f.select("row", F.concat_ws(" ", F.col("walker") + 1, "walker", "t", "x").alias("value"))
    return rounded(S.read_medoids(spark, _text(lines, "row", _folder(spark, "medoids"), "# state replica time_ps x"), ["x"]))


def read_saved(spark, d):
    """Three names, one of which lacks a part: it is left out."""
    g = _walker_grid(spark, d).select("i", "j", "mean")
    lines = g.select((F.col("i") * 1000 + F.col("j")).alias("o"), F.concat_ws(" ", "i", "mean").alias("value"))
    here = [_text(lines.where(F.col("o") % 3 == k), "o", _folder(spark, "saved")) for k in range(3)]
    paths = {"a": here[:2], "b": [here[2]], "c": [here[0], f"{here[0]}-lost"]}
    return S.read_saved(spark, paths, ["x", "f"]).drop("row")


def read_xvg(spark, d):
    f = frames(spark, d)
    path = _text(f.select("row", F.concat_ws(" ", "t", "x", "y").alias("value")), "row", _folder(spark, "xvg"), "# made\n@ title \"a\"\n@ s0 legend")
    return rounded(S.read_xvg(spark, path, ["t", "dmin", "dmax"]).drop("row"))


def atoms(spark, d):
    """(row, serial, name, resname, chain, resnum, x, y, z): parts in the role of atoms; serials go on from 0 after 99,999, as in the formats."""
    p = spark.read.parquet(f"{d}/part.parquet")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    spot = lambda by: F.round(F.col("p_retailprice") % by, 3)
    return p.select(
        F.col("p_partkey").alias("row"), (F.col("p_partkey") % 100_000).cast("int").alias("serial"), pick(["N", "CA", "C", "O", "HB"], F.col("p_partkey") % 5).alias("name"),
        pick(["ALA", "DA", "DG"], F.col("p_size") % 3).alias("resname"), pick(["A", "B", "C"], F.col("p_size") % 3).alias("chain"), (F.col("p_partkey") % 97 + 1).cast("int").alias("resnum"),
        spot(9.7).alias("x"), spot(7.3).alias("y"), spot(5.9).alias("z"),
    )


ATOMS = """(SELECT p_partkey AS row, (p_partkey % 100000)::INTEGER AS serial, (['N', 'CA', 'C', 'O', 'HB'])[p_partkey % 5 + 1] AS name, (['ALA', 'DA', 'DG'])[p_size % 3 + 1] AS resname,
(['A', 'B', 'C'])[p_size % 3 + 1] AS chain, (p_partkey % 97 + 1)::INTEGER AS resnum, round(p_retailprice % 9.7::DOUBLE, 3) AS x, round(p_retailprice % 7.3::DOUBLE, 3) AS y, round(p_retailprice % 5.9::DOUBLE, 3) AS z FROM part)"""


def read_pdb(spark, d):
    lines = sinks.pdb_lines(atoms(spark, d)).select("row", F.when(F.col("row") % 50 == 7, "ATOM  broken").otherwise(F.col("line")).alias("value"))
    return S.read_pdb(spark, _text(lines, "row", _folder(spark, "pdb"), "REMARK a\nTITLE b")).drop("row")


def read_gro(spark, d):
    line = F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", "resnum", "resname", "name", "serial", "x", "y", "z")
    lines = atoms(spark, d).select("row", line.alias("value")).unionByName(spark.createDataFrame([(10**15, "   5.00000   5.00000   5.00000")], "row long, value string"))
    return S.read_gro(spark, _text(lines, "row", _folder(spark, "gro"), "title of it\n  999")).drop("row").withColumnRenamed("index", "serial")


def gro_frames(spark, d):
    """A text trajectory: each embedding a frame of atoms, two a residue."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) > 0").withColumn("n", F.ceil(F.size("embedding") / 3).cast("int"))
    spot = lambda k, c: F.coalesce(F.get("embedding", k * 3 + c).cast("double"), F.lit(0.0))
    atom = lambda k: F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.floor(k / 2) + 1, F.lit("ALA"), F.lit("CA"), k + 1, *(spot(k, c) for c in range(3)))
    head, box = F.array(F.format_string("made up t= %.5f step= 0", F.col("vec_id") / 2), F.format_string("%5d", "n")), F.array(F.lit("   5.00000   5.00000   5.00000"))
    block = F.concat(head, F.transform(F.sequence(F.lit(0), F.col("n") - 1), atom), box)
    lines = v.select(F.col("vec_id"), F.posexplode(block).alias("k", "value")).select((F.col("vec_id") * 100_000 + F.col("k")).alias("o"), "value")
    return rounded(S.read_gro_frames(spark, _text(lines, "o", _folder(spark, "frames"))).drop("resname", "name"), 3)


def pdb_models(spark, d):
    """A file of several models, a label of the embeddings each, with all atoms of its members."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) > 0")
    v = v.select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.explode(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 3).cast("int") - 1)).alias("k"))
    spots = [F.coalesce(F.get("embedding", F.col("k") * 3 + c).cast("double"), F.lit(0.0)) for c in range(3)]
    atom = F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f", (F.col("vec_id") * 22 + F.col("k")) % 100_000, F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("label") + 1, *spots)
    models = v.select("label").distinct().select((F.col("label") * 10**15 - 1).alias("o"), F.format_string("MODEL     %4d", F.col("label") + 1).alias("value"))
    lines = v.select((F.col("label") * 10**15 + F.col("vec_id") * 100_000 + F.col("k")).alias("o"), atom.alias("value")).unionByName(models)
    return rounded(S.read_models(spark, _text(lines, "o", _folder(spark, "models"), "REMARK a")).select("frame", "serial", "resnum", "x", "y", "z"), 3)


def _trajectory(spark, d):
    """Embeddings as frames of a binary trajectory: time in halves of the id, an angled box of the label's size."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) > 0")
    edge = F.col("label") + 1.0
    xyz = F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 3).cast("int") * 3 - 1), lambda k: F.coalesce(F.get("embedding", k), F.lit(0.0)).cast("float"))
    box = F.array(edge, F.lit(0.0), F.lit(0.0), edge / 4, edge, F.lit(0.0), edge / 8, edge / 2, edge)
    path = _folder(spark, "trajectory")
    write_trajectory(v.select(F.col("vec_id").cast("int").alias("step"), (F.col("vec_id") / 2).alias("t"), box.alias("box"), xyz.alias("xyz")), path)
    return path


def trajectory_frames(spark, d):
    """Chosen atoms of all frames of a binary trajectory, read in small ranges."""
    found = read_trajectory(spark, _trajectory(spark, d), atoms="2-5,22", range=100_000)
    return rounded(atom_rows(found, "step", "t"))


def trajectory_boxes(spark, d):
    return rounded(boxes_of(read_trajectory(spark, _trajectory(spark, d)), "step"))


def thermo_terms(spark, d):
    f = frames(spark, d).groupBy("kind").agg(F.round(F.avg("x"), 3).alias("a"), F.round(F.max("x"), 3).alias("b"), F.count("*").alias("n"))
    lines = f.select(F.xxhash64("kind").alias("o"), F.concat_ws("  ", F.initcap("kind"), "a", "b", "n", F.lit("0.5"), F.lit("(K)")).alias("value"))
    return S.read_thermo(spark, _text(lines, "o", _folder(spark, "energy"), "Energy  Average  Err.Est.  RMSD  Tot-Drift\n-----"), ["Purchase", "View", "Click"])


def text_section(spark, d):
    """The lines of an input between two labels, with one text in them replaced."""
    f = frames(spark, d)
    label = F.when(F.col("row") == 100, "tail: ").when(F.col("row") == 400, "wall: ").otherwise("")
    lines = f.select("row", F.concat(label, F.concat_ws(" ", F.concat(F.lit("c"), "row", F.lit(":")), "kind", "walker")).alias("value"))
    return S.text_section(spark, _text(lines, "row", _folder(spark, "input")), "tail:", "wall:", {"purchase": "bought"}).select("value")


def renumbered_atoms(spark, d):
    return A.renumbered(A.atoms_in(atoms(spark, d), chains=["B"]), "row").select("serial", "row")


def _contacts(spark, d):
    a = atoms(spark, d).select((F.col("row") - 1).cast("int").alias("a"), F.col("resnum").alias("b"), F.col("x").alias("ref"))
    return a


def read_contacts(spark, d):
    lines = _contacts(spark, d).select(F.col("a").alias("o"), F.concat_ws(" ", "a", "b", "ref").alias("value"))
    return S.read_contacts(spark, _text(lines, "o", _folder(spark, "contacts"), "# a b ref"))


def contact_block(spark, d):
    """The text block of a contact list, read back: atoms from 1, equal weights."""
    lines = A.contact_lines(_contacts(spark, d)).select(F.xxhash64("line").alias("o"), F.col("line").alias("value"))
    return rounded(S.read_contact_block(spark, _text(lines, "o", _folder(spark, "block"))))


def group_lines(spark, d):
    """Groups of runs of atoms that lie together, and of every residue's atoms, which do not."""
    a = atoms(spark, d)
    runs = a.withColumn("g", F.concat(F.lit("run"), F.floor(F.col("row") / 7).cast("string")))
    return A.group_lines(runs.unionByName(a.withColumn("g", F.concat(F.col("chain"), "resnum"))), "g")


def export_surface(spark, d):
    """Both text layouts of a surface on the full grid, read back."""
    g = _walker_grid(spark, d).select("i", "j", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "n", "walkers")
    parts = []
    for narrow in (False, True):
        sinks.export_surface(g if not narrow else g.drop("walkers"), path := _folder(spark, "surface"), GX, GY, "a surface\ncv1 cv2 F_mean F_std count", narrow)
        names = ["cv1", "cv2"]
        parts.append(S.read_table(spark, path, names, ["mean", "std", "n", "walkers"]).drop("row").withColumn("narrow", F.lit(narrow)))
    both = parts[0].unionByName(parts[1])
    return both.select("cv1", "cv2", F.nanvl("mean", F.lit(None).cast("double")).alias("mean"), F.nanvl("std", F.lit(None).cast("double")).alias("std"), "n", "walkers", "narrow")


def export_profile(spark, d):
    """A 1D table with a header, and how many lines its header has."""
    f = H.fes_1d(frames(spark, d), F.col("x"), F.col("w"), AX, KBT).where("f IS NOT NULL").select("k", F.round("f", 3).alias("f"))
    sinks.export_text(f, path := _folder(spark, "profile"), ["k"], f"kBT {KBT}\nwindow 0 500\nk f")
    return S.read_table(spark, path, ["k", "f"]).drop("row").withColumn("head", F.lit(len(S.header(spark, path))))


def archived_view(spark, d):
    """The archive holds the full range; the mask is a view of it."""
    sinks.archive(_walker_grid(spark, d), path := _folder(spark, "archive"), ["i", "j"], {"grid": {"kbt": KBT}})
    whole = spark.read.parquet(path)
    masked = whole.where("std <= 1.6 AND n >= 5")
    return masked.groupBy("i").agg(F.count("*").alias("n"), F.round(F.min("mean"), 6).alias("low")).withColumn("whole", F.lit(whole.count()))


def meta_upsert(spark, d):
    """Entries of one run stay when another one writes its own."""
    path = _folder(spark, "meta")
    n = frames(spark, d).count()
    sinks.upsert_meta(spark, path, {"A": {"n": n, "kbt": KBT}, "B": {"n": 1}})
    sinks.upsert_meta(spark, path, {"A": {"n": n + 1}, "C": {"ok": True}})
    found = S.read_meta(spark, path)
    return spark.createDataFrame([(k, str(i), str(v)) for k, e in found.items() for i, v in e.items()], "panel string, entry string, value string")


QUERIES = {f.__name__: f for f in (read_series, read_series_sums, read_capped, last_time, cached_stride, cached_files, read_with_header, missing_series, copies_of, header_lines, skipped_lines, read_hills, first_bias_factor, read_grid, read_table, read_medoids, read_saved, read_xvg, read_pdb, read_gro, gro_frames, pdb_models, trajectory_frames, trajectory_boxes, thermo_terms, text_section, renumbered_atoms, read_contacts, contact_block, group_lines, export_surface, export_profile, archived_view, meta_upsert)}
_SERIES = f"(SELECT walker, row, {_PS} AS ps, x, y, w FROM {FRAMES} WHERE {_KEPT})"
_HEADED = f"(SELECT * FROM {FRAMES} WHERE {_KEPT})"
ORACLES = {
    "read_series": f"SELECT walker, {r('ps * 0.001::DOUBLE', 't')}, {r('x', 'x')}, {r('w', 'w')} FROM {_SERIES}",
    "read_series_sums": f"SELECT walker, {r('ps * 0.001::DOUBLE', 't')}, {r('x + y', 's')} FROM {_SERIES}",
    "read_capped": f"SELECT walker, count(*) AS n, {r('max(ps)', 't')} FROM (SELECT walker, row, {_PS} AS ps FROM {FRAMES} WHERE row % 50 <> 9) WHERE ps <= 300000 GROUP BY 1",
    "last_time": f"SELECT walker, {r('max_by(ps, row) * 0.001::DOUBLE', 't')} FROM {_SERIES} GROUP BY 1",
    "cached_stride": f"SELECT walker, {r('ps * 0.001::DOUBLE', 't')}, {r('x', 'x')}, 1::INTEGER AS made FROM {_SERIES} QUALIFY (row_number() OVER (PARTITION BY walker ORDER BY row) - 1) % 7 = 0",
    "cached_files": f"SELECT walker, count(*) AS before, count(*) FILTER (WHERE walker <> 3 OR row % 3 > 0) AS after, {r('sum(x) FILTER (WHERE walker <> 3 OR row % 3 > 0)', 'x', 4)}, '6,1' AS read FROM {FRAMES} GROUP BY 1",
    "read_with_header": f"SELECT {r('t', 't')}, {r('180 - y', 'bend')}, {r('x', 'contacts')}, {r('w', 'q_A')} FROM {_HEADED}",
    "missing_series": f"SELECT k::INTEGER AS walker, max(row) IS NULL AS missing, count(row) AS n FROM range(8) r(k) LEFT JOIN {FRAMES} f ON f.walker = k GROUP BY k",
    "copies_of": f"SELECT {r('t', 't')}, 'cmap' AS observable, '' AS copy, {r('x', 'value')} FROM {_HEADED} UNION ALL SELECT round(t, 6), 'q', 'A', round(w, 6) FROM {_HEADED}",
    "header_lines": "SELECT 252::BIGINT AS n, 'time,theta,cmap,q_A' AS fields",
    "skipped_lines": f"SELECT count(*) FILTER (WHERE row % 50 <> 7) AS kept, count(*) FILTER (WHERE row % 50 = 7) AS skipped FROM {FRAMES}",
    "read_hills": f"SELECT walker, {r('t', 't')}, {r('x', 'c1')}, {r('y', 'c2')}, 4.0::DOUBLE AS s2, {r('w', 'height')} FROM {FRAMES} WHERE kind = 'purchase'",
    "first_bias_factor": f"SELECT DISTINCT walker, walker + 10.0::DOUBLE AS gamma FROM {FRAMES} WHERE kind = 'purchase'",
    "read_grid": f"SELECT (dense_rank() OVER (ORDER BY x) - 1)::INTEGER AS i, (dense_rank() OVER (ORDER BY y) - 1)::INTEGER AS j, x, y, f FROM (SELECT (i + 0.5::DOUBLE) * {GX.step}::DOUBLE AS x, (j + 0.5::DOUBLE) * {GY.step}::DOUBLE AS y, mean AS f FROM {_VGRID} WHERE walkers >= 2)",
    "read_table": f"SELECT i::DOUBLE AS i, j::DOUBLE AS j, mean, std, n::DOUBLE AS n, CASE WHEN part = 0 THEN walkers::DOUBLE END AS walkers, part::INTEGER AS part FROM {_VGRID}, range(2) r(part)",
    "read_medoids": f"SELECT (walker + 1)::INTEGER AS state, walker AS replica, {r('t', 'time')}, {r('x', 'x')} FROM {FRAMES}",
    "read_saved": f"SELECT CASE WHEN (i * 1000 + j) % 3 < 2 THEN 'a' ELSE 'b' END AS name, CASE WHEN (i * 1000 + j) % 3 = 1 THEN 1 ELSE 0 END::INTEGER AS part, i::DOUBLE AS x, mean AS f FROM {_VGRID}",
    "read_xvg": f"SELECT {r('t', 't')}, {r('x', 'dmin')}, {r('y', 'dmax')} FROM {FRAMES}",
    "read_pdb": f"SELECT serial, name, resname, chain, resnum, x, y, z FROM {ATOMS} WHERE row % 50 <> 7",
    "read_gro": f"SELECT serial, name, resname, resnum, x, y, z FROM {ATOMS}",
    "gro_frames": "SELECT (dense_rank() OVER (ORDER BY vec_id) - 1) AS frame, vec_id / 2.0::DOUBLE AS t, (k // 2 + 1)::INTEGER AS resnum, (k + 1)::INTEGER AS atom, round(coalesce(embedding[3 * k + 1]::DOUBLE, 0), 3) AS x, round(coalesce(embedding[3 * k + 2]::DOUBLE, 0), 3) AS y, round(coalesce(embedding[3 * k + 3]::DOUBLE, 0), 3) AS z FROM (SELECT *, unnest(range((len(embedding) + 2) // 3)) AS k FROM embeddings)",
    "pdb_models": "SELECT dense_rank() OVER (ORDER BY label) - 1 AS frame, ((vec_id * 22 + k) % 100000)::INTEGER AS serial, (label + 1)::INTEGER AS resnum, round(coalesce(embedding[3 * k + 1]::DOUBLE, 0), 3) AS x, round(coalesce(embedding[3 * k + 2]::DOUBLE, 0), 3) AS y, round(coalesce(embedding[3 * k + 3]::DOUBLE, 0), 3) AS z FROM (SELECT *, unnest(range((len(embedding) + 2) // 3)) AS k FROM embeddings)",
    "trajectory_frames": "SELECT vec_id::INTEGER AS step, vec_id / 2.0::DOUBLE AS t, (k + 1)::INTEGER AS atom, " + ", ".join(f"round(coalesce(embedding[3 * k + {c + 1}]::DOUBLE, 0), 6) AS {n}" for c, n in enumerate("xyz")) + " FROM (SELECT *, unnest(range((len(embedding) + 2) // 3)) AS k FROM embeddings) WHERE k BETWEEN 1 AND 4 OR k = 21",
    "trajectory_boxes": "SELECT vec_id::INTEGER AS step, label + 1.0::DOUBLE AS ax, (label + 1) / 4.0::DOUBLE AS bx, label + 1.0::DOUBLE AS \"by\", (label + 1) / 8.0::DOUBLE AS cx, (label + 1) / 2.0::DOUBLE AS cy, label + 1.0::DOUBLE AS cz FROM embeddings WHERE len(embedding) > 0",
    "thermo_terms": f"SELECT upper(kind[1]) || kind[2:] AS term, round(avg(x), 3) AS average, round(max(x), 3) AS error, count(*)::DOUBLE AS rmsd, 0.5::DOUBLE AS drift FROM {FRAMES} WHERE kind IN ('purchase', 'view', 'click') GROUP BY kind",
    "text_section": f"SELECT CASE row WHEN 100 THEN 'tail: ' ELSE '' END || 'c' || row || ': ' || CASE kind WHEN 'purchase' THEN 'bought' ELSE kind END || ' ' || walker AS value FROM {FRAMES} WHERE row BETWEEN 100 AND 399",
    "renumbered_atoms": f"SELECT row_number() OVER (ORDER BY row)::INTEGER AS serial, row FROM {ATOMS} WHERE chain = 'B'",
    "read_contacts": f"SELECT (row - 1)::INTEGER AS a, resnum AS b, x AS ref FROM {ATOMS}",
    "contact_block": f"SELECT row::INTEGER AS a, resnum + 1 AS b, x AS ref, {r('1.0::DOUBLE / count(*) OVER ()', 'weight')} FROM {ATOMS}",
    "group_lines": f"""SELECT g AS grp, g || ': GROUP ATOMS=' || CASE WHEN count(DISTINCT serial) > 1 AND max(serial) - min(serial) + 1 = count(DISTINCT serial) THEN min(serial) || '-' || max(serial) ELSE array_to_string(list_sort(list(DISTINCT serial)), ',') END AS line
FROM (SELECT serial, 'run' || row // 7 AS g FROM {ATOMS} UNION ALL SELECT serial, chain || resnum FROM {ATOMS}) GROUP BY g""",
    "export_surface": f"""SELECT (a.i + 0.5::DOUBLE) * {GX.step}::DOUBLE AS cv1, (b.j + 0.5::DOUBLE) * {GY.step}::DOUBLE AS cv2, round(mean, 3) AS mean, round(std, 3) AS std, coalesce(n, 0)::DOUBLE AS n,
CASE WHEN NOT narrow THEN coalesce(walkers, 0)::DOUBLE END AS walkers, narrow FROM range({GX.n}) a(i), range({GY.n}) b(j), (VALUES (true), (false)) v(narrow) LEFT JOIN {_VGRID} g ON g.i = a.i AND g.j = b.j""",
    "export_profile": f"SELECT k::DOUBLE AS k, round(f - min(f) OVER (), 3) AS f, 3::INTEGER AS head FROM (SELECT {AX.sql('x')} AS k, -{KBT}::DOUBLE * ln(sum(w)) AS f FROM {FRAMES} GROUP BY 1) WHERE k IS NOT NULL",
    "archived_view": f"SELECT i, count(*) AS n, {r('min(mean)', 'low')}, (SELECT count(*) FROM {_VGRID})::INTEGER AS whole FROM {_VGRID} WHERE std <= 1.6 AND n >= 5 GROUP BY i",
    "meta_upsert": f"SELECT * FROM (SELECT 'A' AS panel, 'n' AS entry, (count(*) + 1)::VARCHAR AS value FROM {FRAMES} UNION ALL VALUES ('A', 'kbt', '{KBT}'), ('B', 'n', '1'), ('C', 'ok', 'True'))",
}
