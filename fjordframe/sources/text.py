"""Tolerant readers of text series, hills, grids and structures, all over spark.read.text.

A series line is split on blanks; lines that begin with a comment mark, are short, or hold anything but finite
numbers in the wanted columns are left out. File order is kept as (file, row), where row grows from line to line of a file
however Spark packs its parts, and from file to file of a folder; a column `walker` comes from the file name's number.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.operators.ordering import row_index, running_total
from fjordframe.sources.ends import HEAD, TAIL, _opened, at_ends, end_lines, files_of, first_of_file, last_of_file

_COMMENT = r"^\s*[#!@]"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, row): lines in file order inside each file, and over files in the order of their paths."""
    files = files_of(spark, paths)
    text = spark.read.text(paths).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    first = F.lit(0)
    if len(files) > 1:  # a row a file
        sizes = [-(-length // 4096) for _, length, _ in files]
        begins = spark.createDataFrame([(name, at) for (name, *_), at in zip(files, accumulate(sizes, initial=0), strict=False)], "_name string, _first long")
        plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))  # Spark writes blanks and the like as in a URL
        text, first = text.join(F.broadcast(begins), F.regexp_replace(plain, "^file:/+", "file:///") == F.col("_name"), "left"), F.coalesce("_first", F.lit(0))
    # By the part of the file (none is under 4096 bytes but the last), then by the line's place in the task.
    place = F.shiftleft(F.floor(F.col("_start") / 4096) + first, 33) + F.col("_id").bitwiseAND((1 << 33) - 1)
    return text.select("value", "file", place.alias("row"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob, names any file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def found_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The paths of a glob, sorted; none is an error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    paths = sorted(f.getPath().toString() for f in found or [])
    if not paths:
        raise FileNotFoundError(f"no file matches {pattern}")
    return paths


def walker_of(file: Column) -> Column:
    """The number at the end of a file name, or of its folder's where the file is a part of a written table."""
    file = F.regexp_replace(file, r"/part-[^/]*$", "")
    return F.try_to_number(F.regexp_extract(file, r"(\d+)\D*$", 1), F.lit("999999")).cast("int")


def _fields(text: DataFrame) -> DataFrame:
    return text.where(~F.col("value").rlike(_COMMENT)).withColumn("_p", F.split(F.trim("value"), r"\s+"))


def _number(place: int) -> Column:
    return F.expr(f"try_cast(try_element_at(_p, {place + 1}) AS DOUBLE)")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def read_series(spark: SparkSession, paths: str | list[str], columns: dict[str, int | list[int]], time: int = 0, scale: float = 1e-3) -> DataFrame:
    """(file, row, walker, t, *columns): columns by place, a list of places being summed; time times scale (ps to ns)."""
    return _series(lines(spark, paths), columns, time, scale)


def _series(text: DataFrame, columns: dict[str, int | list[int]], time: int, scale: float) -> DataFrame:
    rows = _fields(text)
    values = {name: sum((_number(p) for p in (places if isinstance(places, list) else [places])), F.lit(0.0)) for name, places in columns.items()}
    out = rows.select("file", "row", walker_of(F.col("file")).alias("walker"), (_number(time) * scale).alias("t"), *(v.alias(n) for n, v in values.items()))
    return out.where(_finite(F.col("t"))).where(" AND ".join(f"{n} IS NOT NULL AND NOT isnan({n}) AND abs({n}) < double('inf')" for n in columns) or "true")


def header(spark: SparkSession, path: str, marks: str = "#!@") -> list[str]:
    """The leading comment lines of a file, however many, from its first blocks; of a folder, those of its first file.

    A file of comments only is its own header, and comes to the driver.
    """
    files = files_of(spark, path)[:1]
    plain = ~F.substring(F.ltrim("value"), 1, 1).isin(list(marks))
    size, names = HEAD, [name for name, *_ in files]
    while True:
        text = end_lines(spark, files, size) if all(map(_opened, names)) else lines(spark, names)
        first = text.where(plain).agg(F.min("row").alias("r")).first()["r"]
        if first is not None or not any(length > size for _, length, _ in files):
            break
        size *= 2
    head = text if first is None else text.where(F.col("row") < first)
    return [r["value"] for r in head.orderBy("row").collect()]


def header_fields(spark: SparkSession, path: str) -> list[str]:
    """Column names of a `#! FIELDS ...` header, or of the last comment line with (units) taken off."""
    head = header(spark, path)
    for line in head:
        parts = line.replace("#!", " ").split()
        if parts[:1] == ["FIELDS"]:
            return parts[1:]
    return [n.partition("(")[0] for n in head[-1].lstrip("#!@ ").split()] if head else []


def read_with_header(spark: SparkSession, path: str, rename: dict[str, str] | None = None, required: list[str] | None = None, missing_ok: bool = False) -> DataFrame | None:
    """A series whose names come from its header; short or half-written lines are left out. Missing required names are an error.

    A file that is not there is an error too, or None with missing_ok.
    """
    if missing_ok and not exists(spark, path):
        return None
    names = header_fields(spark, path)
    if missing := set(required or []) - set(names):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    rows = _fields(lines(spark, path)).where(F.size("_p") == len(names))
    out = rows.select("row", *(_number(k).alias((rename or {}).get(n, n)) for k, n in enumerate(names)))
    return out.dropna()


def skipped_lines(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(value column, skipped): how many data lines lack a number at a place."""
    return _fields(lines(spark, path)).agg(F.count(_number(column)).alias("kept"), F.count_if(_number(column).isNull()).alias("skipped"))


def read_hills(spark: SparkSession, paths: str | list[str], dimensions: int) -> DataFrame:
    """(file, row, walker, t, centre[], sigma[], height, biasf) with time as stored; a glob without files is an error."""
    paths = found_paths(spark, paths) if isinstance(paths, str) else paths
    return _hills(lines(spark, paths), dimensions)


def _hills(text: DataFrame, d: int) -> DataFrame:
    out = _fields(text).select(
        "file", "row", walker_of(F.col("file")).alias("walker"), _number(0).alias("t"),
        F.array(*(_number(1 + k) for k in range(d))).alias("centre"), F.array(*(_number(1 + d + k) for k in range(d))).alias("sigma"),
        _number(1 + 2 * d).alias("height"), _number(2 + 2 * d).alias("biasf"),
    )
    return out.where("t IS NOT NULL AND height IS NOT NULL")


def first_bias_factor(hills: DataFrame) -> DataFrame:
    """(file, gamma): the bias factor of each file's first row."""
    return hills.groupBy("file").agg(F.min_by("biasf", "row").alias("gamma"))


def first_bias_factors(spark: SparkSession, paths: str | list[str], dimensions: int) -> DataFrame:
    """(file, gamma): the bias factor of each file's first row, from the files' first blocks."""
    find = lambda text: first_of_file(_hills(text, dimensions), "biasf").withColumnRenamed("biasf", "gamma")
    return at_ends(spark, paths, HEAD, find, lambda names: lines(spark, names))


def last_times(spark: SparkSession, paths: str | list[str], columns: dict[str, int | list[int]], time: int = 0, scale: float = 1e-3) -> DataFrame:
    """(file, t): the time of each file's last row that read_series() would read, from the files' last blocks."""
    return at_ends(spark, paths, -TAIL, lambda text: last_of_file(_series(text, columns, time, scale), "t"), lambda names: lines(spark, names))


def last_time(series: DataFrame) -> DataFrame:
    """(file, t): the time of each file's last row."""
    return series.groupBy("file").agg(F.max_by("t", "row").alias("t"))


def read_capped(spark: SparkSession, paths: str | list[str], columns: dict[str, int | list[int]], cap: float, scale: float = 1.0) -> DataFrame:
    """A series up to a last time, which rounding must not cut off."""
    return read_series(spark, paths, columns, scale=scale).where(F.col("t") <= F.lit(cap) + 1e-6)


def read_saved(spark: SparkSession, paths: dict[str, list[str]], names: list[str]) -> DataFrame:
    """(name, part, row, *names): tables saved under each name, one or more parts; a name whose parts are not all there is left out."""
    here = {name: parts for name, parts in paths.items() if all(exists(spark, p) for p in parts)}
    tables = [read_table(spark, p, names).select(F.lit(name).alias("name"), F.lit(k).alias("part"), "row", *names) for name, parts in here.items() for k, p in enumerate(parts)]
    if not tables:
        return spark.createDataFrame([], "name string, part int, row long, " + ", ".join(f"{n} double" for n in names))
    return reduce(DataFrame.unionByName, tables)


def read_table(spark: SparkSession, path: str, names: list[str], optional: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """(row, *names, *optional): columns of a text table by place; an optional column that the table lacks is null.

    A required one that it lacks is an error.
    """
    rows = _fields(lines(spark, path))
    every = [*names, *(optional or [])]
    width = rows.agg(F.max(F.size("_p")).alias("w")).first()["w"] or 0
    if lacking := [n for k, n in enumerate(every) if k >= width and n in (required or [])]:
        raise ValueError(f"{path} lacks {lacking}")
    return rows.select("row", *(_number(k).alias(n) for k, n in enumerate(every))).dropna(subset=names)


def read_medoids(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(state, replica, time, *names) of a table of chosen frames."""
    rows = read_table(spark, path, ["state", "replica", "time", *names])
    return rows.withColumn("state", F.col("state").cast("int")).withColumn("replica", F.col("replica").cast("int")).drop("row")


def read_meta(spark: SparkSession, path: str) -> dict:
    """A provenance document, empty where there is none."""
    if not exists(spark, path):
        return {}
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one small document


def read_grid(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(i[, j], x[, y], f): a surface in long rows; indices are places among the distinct axis values."""
    names = ["x", "y"][:dimensions]
    rows = _fields(lines(spark, path)).select(*(_number(k).alias(n) for k, n in enumerate(names)), _number(dimensions).alias("f")).dropna(subset=names)
    for index, n in zip(["i", "j"], names, strict=False):
        place = row_index(rows.select(n).distinct(), n, index).withColumn(index, (F.col(index) - 1).cast("int"))
        rows = rows.join(place, n)
    return rows.select(*["i", "j"][:dimensions], *names, "f")


def read_xvg(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns of an xvg table; lines that begin with # or @ are left out."""
    rows = _fields(lines(spark, path))
    return rows.select("row", *(_number(k).alias(n) for k, n in enumerate(names))).dropna()


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM rows: serial, name, resname, chain, resnum, x, y, z; lines whose numbers do not parse are left out."""
    return _pdb_atoms(lines(spark, path), ["row"])


def _pdb_atoms(text: DataFrame, keep: list[str]) -> DataFrame:
    v = lambda a, n: F.trim(F.substring("value", a, n))
    number = lambda a, n, kind: F.expr(f"try_cast(trim(substring(value, {a}, {n})) AS {kind})")
    return text.where(F.startswith("value", F.lit("ATOM"))).select(
        *keep, number(7, 5, "INT").alias("serial"), v(13, 4).alias("name"), v(18, 3).alias("resname"), F.substring("value", 22, 1).alias("chain"),
        number(23, 4, "INT").alias("resnum"), *(number(31 + 8 * k, 8, "DOUBLE").alias(c) for k, c in enumerate("xyz")),
    ).dropna(subset=["serial", "resnum", "x", "y", "z"])


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """Atom rows: resnum, resname, name, index, x, y, z; title, count, box and lines that do not parse are left out."""
    v = lambda a, n: F.trim(F.substring("value", a, n))
    number = lambda a, n, kind: F.expr(f"try_cast(trim(substring(value, {a}, {n})) AS {kind})")
    rows = lines(spark, path).select(
        "row", number(1, 5, "INT").alias("resnum"), v(6, 5).alias("resname"), v(11, 5).alias("name"), number(16, 5, "INT").alias("index"),
        *(number(21 + 8 * k, 8, "DOUBLE").alias(c) for k, c in enumerate("xyz")),
    )
    return rows.dropna()


def _numbered(text: DataFrame, title: Column) -> DataFrame:
    """text with frame, the number of title lines up to each line, less one; lines before the first have -1."""
    return running_total(text.withColumn("_t", title.cast("int")), "row", "_t", "_f").withColumn("frame", F.col("_f") - 1).drop("_t", "_f")


def read_gro_frames(spark: SparkSession, path: str) -> DataFrame:
    """(frame, t, resnum, resname, name, atom, x, y, z) of a text trajectory, whose frames begin with a title that holds t= time.

    Counts, boxes and lines that do not parse are left out.
    """
    pattern = r"t=\s*([-+0-9.eE]+)"
    text = _numbered(lines(spark, path), F.col("value").rlike(pattern))
    times = text.where(F.col("value").rlike(pattern)).select("frame", F.expr(f"try_cast(regexp_extract(value, '{pattern}', 1) AS DOUBLE)".replace("\\", "\\\\")).alias("t"))
    number = lambda a, n, kind: F.expr(f"try_cast(trim(substring(value, {a}, {n})) AS {kind})")
    v = lambda a, n: F.trim(F.substring("value", a, n))
    atoms = text.where(~F.col("value").rlike(pattern)).select(
        "frame", number(1, 5, "INT").alias("resnum"), v(6, 5).alias("resname"), v(11, 5).alias("name"), number(16, 5, "INT").alias("atom"),
        *(number(21 + 8 * k, 8, "DOUBLE").alias(c) for k, c in enumerate("xyz")),
    ).dropna()
    return atoms.join(times, "frame")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(frame, serial, name, resname, chain, resnum, x, y, z) of a PDB file with several models, numbered from 0."""
    text = _numbered(lines(spark, path), F.startswith("value", F.lit("MODEL ")))
    return _pdb_atoms(text, ["frame"])


def text_section(spark: SparkSession, path: str, first: str, last: str, replace: dict[str, str] | None = None) -> DataFrame:
    """(row, value): the lines of an input file from the first that begins with `first` up to the next that begins with `last`.

    replace changes texts inside the lines, each as it is written. A file without either line is an error.
    """
    text = lines(spark, path).select("row", "value")
    begin = text.where(F.startswith("value", F.lit(first))).agg(F.min("row").alias("r")).first()["r"]
    end = None if begin is None else text.where(F.startswith("value", F.lit(last)) & (F.col("row") > begin)).agg(F.min("row").alias("r")).first()["r"]
    if end is None:
        raise ValueError(f"{path} has no lines from {first!r} to {last!r}")
    value = F.col("value")
    for old, new in (replace or {}).items():
        value = F.replace(value, F.lit(old), F.lit(new))
    return text.where(F.col("row").between(begin, end - 1)).select("row", value.alias("value"))


def read_thermo(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(term, average, error, rmsd, drift): the lines of a thermodynamic summary that begin with one of the terms."""
    rows = lines(spark, path).withColumn("_p", F.split(F.trim("value"), r"\s+"))
    names = ["average", "error", "rmsd", "drift"]
    return rows.where(F.get("_p", F.lit(0)).isin(terms)).select(F.get("_p", F.lit(0)).alias("term"), *(_number(k).alias(n) for k, n in enumerate(names, 1))).dropna()


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, ref) of a 0-based contact list."""
    rows = _fields(lines(spark, path)).select(_number(0).cast("int").alias("a"), _number(1).cast("int").alias("b"), _number(2).alias("ref"))
    return rows.dropna()


def read_contact_block(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, ref, weight) of contact-map entries with 1-based atoms."""
    get = lambda pattern, kind: F.expr(f"try_cast(nullif(regexp_extract(value, '{pattern}', 1), '') AS {kind})")
    rows = spark.read.text(path).select(
        get(r"ATOMS\\d+=(\\d+)", "INT").alias("a"), get(r"ATOMS\\d+=\\d+,(\\d+)", "INT").alias("b"),
        F.coalesce(get(r"REFERENCE\\d+=([-\\d.eE]+)", "DOUBLE"), get(r"SWITCH\\d+=\\{.*REF=([-\\d.eE]+)", "DOUBLE"), get(r"REF=([-\\d.eE]+)", "DOUBLE")).alias("ref"), get(r"WEIGHT\\d+=([-\\d.eE]+)", "DOUBLE").alias("weight"),
    )
    return rows.where("a IS NOT NULL AND b IS NOT NULL")


def copies_of(wide: DataFrame, keep: list[str]) -> DataFrame:
    """Long rows (keep, observable, copy, value): columns named like name_A are split into name and copy."""
    rest = [c for c in wide.columns if c not in keep]
    long = wide.unpivot(keep, rest, "_name", "value")
    parts = F.regexp_extract("_name", "^(.*)_([A-D])$", 1)
    return long.withColumn("observable", F.when(parts != "", parts).otherwise(F.col("_name"))).withColumn("copy", F.regexp_extract("_name", "^(.*)_([A-D])$", 2)).drop("_name")
