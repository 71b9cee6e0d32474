"""Writers: parquet archives, text exports, provenance, and recompute-unless-newer tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.functions.binning import Axis
from fjordframe.operators.hist import dense
from fjordframe.sources.ends import files_of


def archive(table: DataFrame, path: str, order: list[str], meta: dict | None = None) -> None:
    """The full-range table as parquet in row-major order, with its metadata beside it. Masks are views, not writes."""
    table.orderBy(*order).write.mode("overwrite").parquet(path)
    if meta is not None:
        upsert_meta(table.sparkSession, f"{path}.meta", meta)


#: The layouts of a 2D surface's text export: the formats of x, y, mean, std and count, and of walkers where there are any.
WIDE, NARROW = ["%14.6g"] * 6, ["%9.5f", "%10.4f", "%12.4f", "%10.4f", "%10.0f"]


def export_text(table: DataFrame, path: str, order: list[str], header: str = "", formats: list[str] | None = None) -> None:
    """Columns as text, %14.6g unless formats are given, with a comment header, one file, in order; null as nan."""
    formats = formats or ["%14.6g"] * len(table.columns)
    shown = lambda c, f: F.when(F.col(c).isNull(), F.lit("nan")).otherwise(F.format_string(f, F.col(c).cast("double")))
    row = F.concat_ws(" ", *(shown(c, f) for c, f in zip(table.columns, formats, strict=False)))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    body = table.select(F.lit(len(header.splitlines())).alias("_h"), *keys, row.alias("value"))
    if header:
        kinds = ", ".join(f"_k{i} {table.schema[c].dataType.simpleString()}" for i, c in enumerate(order))
        head = table.sparkSession.createDataFrame([(k, *[None] * len(order), f"# {line}") for k, line in enumerate(header.splitlines())], f"_h int, {kinds}, value string")
        body = head.unionByName(body)
    # One file is what a text export is; tables for it are grids and profiles.
    body.repartition(1).sortWithinPartitions("_h", *(f"_k{i}" for i in range(len(order)))).select("value").write.mode("overwrite").text(path)


def export_surface(surface: DataFrame, path: str, ax: Axis, ay: Axis, header: str = "", narrow: bool = False) -> None:
    """A surface (i, j, mean, std, n[, walkers]) as long text on the full grid, x outermost: cv1 cv2 mean std count [walkers]."""
    more = [c for c in ("walkers",) if c in surface.columns]
    rows = dense(surface, {"i": ax, "j": ay}).select(ax.centre(F.col("i")).alias("cv1"), ay.centre(F.col("j")).alias("cv2"), "mean", "std", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["n", *more]))
    export_text(rows, path, ["cv1", "cv2"], header, NARROW if narrow else WIDE)


def upsert_meta(spark: SparkSession, path: str, entries: dict) -> dict:
    """Merge entries into a JSON document, keeping the others; nested dictionaries merge key by key."""
    def merge(old: dict, new: dict) -> dict:
        return old | {k: merge(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())) if files.exists(hadoop) else {}
    merged = merge(old, json.loads(json.dumps(entries, default=float)))
    spark.createDataFrame([(json.dumps(merged),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return merged


def _fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached(spark: SparkSession, path: str, key: list, make: Callable[[], DataFrame], sources: str | list[str] | None = None) -> DataFrame:
    """The table of make(), kept under path by a fingerprint of key (column names and places, stride) and of the sources' files.

    A file counts by its path, length and time of change, so that a source that changes is read again.
    """
    place = f"{path}/{_fingerprint(key, files_of(spark, sources) if sources else [])}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def cached_by_file(spark: SparkSession, path: str, key: list, sources: str | list[str], make: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The rows of make(files), a table with a column file, over all files of the sources; files that did not change come from the cache.

    Rows of files not met before, or changed since (by path, length, time or key), are written beside the others in one job and
    then listed; what an interrupted job left is not listed and so never read. Rows of files that are gone stay in the
    folder and are left out.
    """
    files = {_fingerprint(key, f): f[0] for f in files_of(spark, sources)}
    known = {r["entry"]: r["folder"] for r in spark.read.parquet(f"{path}/listed").collect()} if _exists(spark, f"{path}/listed/_SUCCESS") else {}  # a row a file
    fresh = {entry: name for entry, name in files.items() if entry not in known}
    if fresh:
        folder = f"{path}/rows-{uuid.uuid4().hex}"
        names = spark.createDataFrame([(name, entry) for entry, name in fresh.items()], "_name string, _entry string")
        rows = make(list(fresh.values()))
        rows.join(names, F.regexp_replace("file", "^file:/+", "file:///") == F.col("_name")).drop("_name").write.partitionBy("_entry").parquet(folder)
        spark.createDataFrame([(entry, folder) for entry in fresh], "entry string, folder string").coalesce(1).write.mode("append").parquet(f"{path}/listed")
        known |= dict.fromkeys(fresh, folder)
    if not files:
        return make([])
    wanted = spark.createDataFrame([(entry, known[entry]) for entry in files], "_entry string, _folder string")
    parts = [spark.read.parquet(folder).withColumn("_folder", F.lit(folder)) for folder in sorted({known[e] for e in files})]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.join(wanted, ["_entry", "_folder"], "left_semi").drop("_entry", "_folder")


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(row, line): atoms as PDB ATOM records."""
    return atoms.select("row", F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f", "serial", "name", "resname", "chain", "resnum", "x", "y", "z").alias("line"))
