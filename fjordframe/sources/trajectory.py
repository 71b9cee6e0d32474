"""Binary trajectories (the uncompressed big-endian format) as a data source: spark.read.format("trr").

A file is cut into byte ranges; a task reads the frames that begin in its range, the first of which it finds by the signature that
every frame begins with, so no index is made and long files are read by many tasks. Of each frame the header, the box and the chosen
atoms' bytes are read, velocities and forces are skipped. Both precisions are read; single precision is written.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from fjordframe.functions.shipping import shipped

# Fixed values of the format: number and name that a frame begins with, and the order of its header's sizes.
SIGNATURE = struct.pack(">iii", 1993, 13, 12) + b"GMX_trn_file"
SIZES = ("ir", "e", "box", "vir", "pres", "top", "sym", "x", "v", "f")
_HEAD = struct.Struct(">13i")
#: Bytes of a task's range, and those read at once while looking for a signature.
RANGE, LOOK = 64 << 20, 1 << 20
#: Coordinates that are sent to Spark at once.
BATCH = 1 << 20
SCHEMA = "file string, place long, step int, t double, box array<double>, atoms array<int>, xyz array<float>"


@dataclass
class Header:
    sizes: dict[str, int]
    atoms: int
    step: int
    real: str  # the numpy type of its numbers
    t: float
    length: int  # of the header itself

    @property
    def body(self) -> int:
        return sum(self.sizes.values())


def header_of(raw: bytes) -> Header | None:
    """The header that raw begins with; None if it is none."""
    at = len(SIGNATURE)
    if not raw.startswith(SIGNATURE) or len(raw) < at + _HEAD.size:
        return None
    *sizes, atoms, step, _ = _HEAD.unpack_from(raw, at)
    named = dict(zip(SIZES, sizes, strict=True))
    if atoms < 0 or min(sizes) < 0:
        return None
    width = named["box"] // 9 or (max(named["x"], named["v"], named["f"]) // (3 * atoms) if atoms else 4) or 4
    if width not in (4, 8) or any(named[c] not in (0, 3 * atoms * width) for c in "xvf"):
        return None
    end = at + _HEAD.size + 2 * width
    if len(raw) < end:
        return None
    (t,) = struct.unpack_from(">f" if width == 4 else ">d", raw, at + _HEAD.size)
    return Header(named, atoms, step, f">f{width}", t, end)


def frame_bytes(step: int, t: float, box: list[float] | None, xyz: np.ndarray) -> bytes:
    """A frame of coordinates in single precision."""
    sizes = dict.fromkeys(SIZES, 0) | {"x": xyz.size * 4, "box": 36 if box else 0}
    head = SIGNATURE + _HEAD.pack(*sizes.values(), xyz.size // 3, step, 0) + struct.pack(">ff", t, 0.0)
    return head + (np.asarray(box, ">f4").tobytes() if box else b"") + np.asarray(xyz, ">f4").tobytes()


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path, a folder or a pattern in its last parts names."""
    system, place = _system(path)
    base = re.split(r"/[^/]*[*?\[]", place)[0]
    found = system.get_file_info(base)
    if found.type == fs.FileType.File:
        return [(base, found.size)]
    inside = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    files = [(f.path, f.size) for f in inside if f.type == fs.FileType.File and f.base_name[:1] not in "._"]
    return sorted(f for f in files if base == place.rstrip("/") or fnmatch.fnmatch(f[0], place) or fnmatch.fnmatch(f[0], f"{place}/*"))


@dataclass
class Range(InputPartition):
    file: str
    first: int
    last: int

    def __init__(self, file: str, first: int, last: int):
        super().__init__(None)
        self.file, self.first, self.last = file, first, last


class TrajectoryReader(DataSourceReader):
    """options: path; atoms (places from 1, as "1-20,31", all if none), begin and end (times, both included), range (bytes)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.begin, self.end = float(options.get("begin", "-inf")), float(options.get("end", "inf"))
        self.range = int(options.get("range", RANGE))
        self.atoms = None
        if options.get("atoms"):
            parts = [p.split("-") for p in options["atoms"].split(",")]
            self.atoms = np.unique(np.concatenate([np.arange(int(p[0]), int(p[-1]) + 1) for p in parts]))

    def partitions(self) -> list[InputPartition]:
        return [Range(name, at, min(at + self.range, size)) for name, size in _files(self.path) for at in range(0, size, self.range)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file, no range
            return
        system, _ = _system(self.path)
        rows, size = [], 0
        with system.open_input_file(part.file) as source:
            at = self._first(source, part)
            while at is not None and at < part.last:
                head = header_of(source.read_at(len(SIGNATURE) + _HEAD.size + 16, at))
                if head is None or at + head.length + head.body > source.size():  # half a frame at the end of a live run
                    break
                if self.begin <= head.t <= self.end and head.sizes["x"]:
                    rows.append(self._frame(source, part.file, at, head))
                    size += len(rows[-1][-1])
                    if size > BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
                at += head.length + head.body
        if rows:
            yield _batch(rows)

    @staticmethod
    def _first(source: pa.NativeFile, part: Range) -> int | None:
        """Where the first frame begins that begins in the range."""
        at = part.first
        while at < part.last:
            raw = source.read_at(LOOK + len(SIGNATURE) + _HEAD.size + 16, at)
            found = raw.find(SIGNATURE)
            while 0 <= found < LOOK:
                if header_of(raw[found:]):
                    return at + found if at + found < part.last else None
                found = raw.find(SIGNATURE, found + 1)
            at += LOOK
        return None

    def _frame(self, source: pa.NativeFile, file: str, at: int, head: Header) -> tuple:
        width, place = int(head.real[-1]), at + head.length
        box = None
        for name in SIZES[: SIZES.index("x")]:
            if name == "box" and head.sizes["box"]:
                box = np.frombuffer(source.read_at(9 * width, place), head.real).astype(float).tolist()
            place += head.sizes[name]
        atoms = np.arange(1, head.atoms + 1) if self.atoms is None else self.atoms[self.atoms <= head.atoms]
        if not len(atoms):
            return file, at, head.step, head.t, box, atoms.astype(np.int32), np.zeros(0, np.float32)
        # From the first to the last chosen atom.
        raw = np.frombuffer(source.read_at(3 * width * int(atoms[-1] - atoms[0] + 1), place + 3 * width * int(atoms[0] - 1)), head.real)
        return file, at, head.step, head.t, box, atoms.astype(np.int32), raw.reshape(-1, 3)[atoms - atoms[0]].reshape(-1).astype(np.float32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float32())]
    names = ["file", "place", "step", "t", "box", "atoms", "xyz"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    file: str


class TrajectoryWriter(DataSourceWriter):
    """Writes rows (step, t, box, xyz), in their order, into a file a task; files of failed attempts are taken away."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.attempt = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, place = _system(self.path)
        system.create_dir(place, recursive=True)
        name = f"part-{task.partitionId():05d}-{self.attempt}-{task.taskAttemptId()}.trr"
        with system.open_output_stream(f"{place}/.{name}") as out:
            for r in rows:
                out.write(frame_bytes(r["step"], r["t"], r["box"], np.asarray(r["xyz"])))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = _system(self.path)
        done = {m.file for m in messages if m}
        for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            old = f.base_name.endswith(".trr") and f.base_name[:1] != "." and self.overwrite
            if old or (self.attempt in f.base_name and f.base_name[1:] not in done):
                system.delete_file(f.path)
        for name in done:
            system.move(f"{place}/.{name}", f"{place}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, place = _system(self.path)
        for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if self.attempt in f.base_name:
                system.delete_file(f.path)


class TrajectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return TrajectoryReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return TrajectoryWriter(self.options["path"], overwrite)


def read_trajectory(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file, place, step, t, box, atoms, xyz): frames of binary trajectories; options as of TrajectoryReader."""
    shipped(spark)
    spark.dataSource.register(TrajectorySource)
    return spark.read.format("trr").options(**options).load(path)


def write_trajectory(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames (step int, t, box or null, xyz) as binary trajectories, a file a partition, in the order of its rows."""
    shipped(frames.sparkSession)
    frames.sparkSession.dataSource.register(TrajectorySource)
    frames.select("step", "t", "box", "xyz").write.format("trr").mode(mode).save(path)


def atom_rows(frames: DataFrame, *keep: str) -> DataFrame:
    """(*keep, atom, x, y, z) of read_trajectory() frames."""
    rows = frames.select(*keep, "xyz", F.posexplode("atoms").alias("_k", "atom"))
    return rows.select(*keep, "atom", *(F.get("xyz", F.col("_k") * 3 + k).cast("double").alias(c) for k, c in enumerate("xyz")))


def boxes_of(frames: DataFrame, *keep: str) -> DataFrame:
    """(*keep, ax, bx, by, cx, cy, cz) of frames with a box, as the periodic operators take them."""
    return frames.where("box IS NOT NULL").select(*keep, *(F.get("box", F.lit(k)).alias(c) for c, k in (("ax", 0), ("bx", 3), ("by", 4), ("cx", 6), ("cy", 7), ("cz", 8))))
