"""First and last lines of files by range reads, a file to a row of tasks, so that long files are not read through.

Lines keep their byte offset in the file as row, and go through the same parsing as lines of whole files. Where a block does
not hold what is looked for (a longer header, unreadable rows at the end), those files alone are read again with twice the
block. Compressed files, and stores that Arrow does not open, are read through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.functions.shipping import mapped

#: Bytes read first from the beginning and from the end of a file.
HEAD, TAIL = 1 << 16, 1 << 13
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
_LINES = "value string, file string, row long, read long"


def files_of(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int, int]]:
    """(path, length, time of the last change) of every file that paths, globs or folders name, hidden ones left out, by path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, tuple[str, int, int]] = {}

    def add(system: object, status: object, top: bool) -> None:
        path = status.getPath()
        if not top and path.getName()[:1] in "._":
            return
        if status.isDirectory():
            for inner in system.listStatus(path):
                add(system, inner, False)
        else:
            name = re.sub(r"^file:/+", "file:///", path.toString())
            found[name] = (name, status.getLen(), status.getModificationTime())

    for pattern in [paths] if isinstance(paths, str) else paths:
        place = jvm.org.apache.hadoop.fs.Path(pattern)
        system = place.getFileSystem(conf)
        for status in system.globStatus(place) or []:
            add(system, status, True)
    return sorted(found.values())


def _opened(name: str) -> bool:
    """Whether ranges of a file can be read."""
    try:
        fs.FileSystem.from_uri(name)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return not name.endswith(_PACKED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, length, size in zip(*(b[c].to_pylist() for c in ("file", "length", "size")), strict=True):
            system, path = fs.FileSystem.from_uri(name)
            first = max(0, length + size) if size < 0 else 0  # a negative size is from the end
            last = length if size < 0 else min(length, size)
            with system.open_input_file(path) as source:
                raw = source.read_at(last - first, first)
            begin, lines = 0, []
            if first:  # a line that begins before the block is left out
                begin = raw.find(b"\n") + 1 or len(raw)
            while begin < len(raw):
                end = raw.find(b"\n", begin)
                if end < 0 and last < length:
                    break
                end = len(raw) if end < 0 else end
                lines.append((raw[begin:end].removesuffix(b"\r").decode(errors="replace"), first + begin))
                begin = end + 1
            texts, rows = zip(*lines, strict=True) if lines else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array([last - first] * len(rows), pa.int64())], names=["value", "file", "row", "read"])


def end_lines(spark: SparkSession, files: list[tuple[str, int, int]], size: int) -> DataFrame:
    """(value, file, row, read): the whole lines in the first `size` bytes of each file, or the last -size ones; read: bytes of the file that were read."""
    if not files:
        return spark.createDataFrame([], _LINES)
    rows = spark.createDataFrame([(name, length, size) for name, length, _ in files], "file string, length long, size long")
    return rows.repartition(min(len(files), 1000), "file").transform(mapped, _read, _LINES)


def at_ends(spark: SparkSession, paths: str | list[str], size: int, find: Callable[[DataFrame], DataFrame], whole: Callable[[list[str]], DataFrame]) -> DataFrame:
    """find() over the lines at one end of every file: a row a file, with its name; files without one are looked at again with a larger block.

    whole reads files through, where ranges can't be read.
    """
    files = files_of(spark, paths)
    through = [name for name, *_ in files if not _opened(name)]
    left, parts = [f for f in files if f[0] not in set(through)], []
    if through:
        parts.append(find(whole(through)))
    while left:
        found = find(end_lines(spark, left, size)).persist()
        parts.append(found)
        settled = {r["file"] for r in found.select("file").collect()}  # as many as files
        left = [f for f in left if f[0] not in settled and f[1] > abs(size)]
        size *= 2
    return reduce(DataFrame.unionByName, parts) if parts else find(spark.createDataFrame([], _LINES))


def last_of_file(rows: DataFrame, *columns: str) -> DataFrame:
    """(file, *columns) of each file's last row."""
    return rows.groupBy("file").agg(*(F.max_by(c, "row").alias(c) for c in columns))


def first_of_file(rows: DataFrame, *columns: str) -> DataFrame:
    """(file, *columns) of each file's first row."""
    return rows.groupBy("file").agg(*(F.min_by(c, "row").alias(c) for c in columns))
