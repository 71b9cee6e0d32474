"""Time-dependent weights of a run that is still going on, and its growing text files as a stream.

live_weights() follows time_dependent_weights() batch by batch: rows wait until the watermark passes their batch's edge, then the
batch's hills go onto the grid, an offset is computed where one is due, and the frames that waited for the edge are evaluated. State
is a grid a group and the rows of open batches, kept by Spark (its RocksDB state store is needed), so a query that is
started again from its checkpoint goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fjordframe.functions.binning import Axis
from fjordframe.functions.shipping import shipped
from fjordframe.sources.trajectory import _files, _system

_GRID = "v array<double>, c double, mark int"
_ROW = "b int, hill boolean, id long, t double, x array<double>, sigma array<double>, height double"
OUT = "id long, t double, v double, c double, e double"


class BiasGrid:
    """A grid of deposited hills, and its offset."""

    def __init__(self, axes: list[Axis], values: np.ndarray | None = None):
        self.axes, self.shape = axes, tuple(a.n + 1 for a in axes)
        self.values = np.zeros(self.shape) if values is None else values.reshape(self.shape)

    def add(self, centre: list[float], sigma: list[float], height: float, cutoff: float) -> None:
        """A product of kernels on the points within cutoff sigmas on every axis."""
        bump, where = np.array(height), []
        for a, c, w in zip(self.axes, centre, sigma, strict=True):
            near, reach = np.rint((c - a.lo) / a.step), ceil(cutoff * w / a.step)
            points = np.arange(max(near - reach, 0), min(near + reach, a.n) + 1)
            delta = points * a.step + a.lo - c
            bump = np.multiply.outer(bump, np.exp(-delta * delta / (2 * w * w)))
            where.append(points.astype(int))
        self.values[np.ix_(*where)] += bump

    def at(self, x: np.ndarray) -> np.ndarray:
        """Multilinear values at points (n, axes), clamped to the axes."""
        low, part = [], []
        for a, c in zip(self.axes, x.T, strict=True):
            place = np.clip((c - a.lo) / a.step, 0, a.n)
            low.append(np.minimum(np.floor(place), a.n - 1).astype(int))
            part.append(place - low[-1])
        out = np.zeros(len(x))
        for up in product((0, 1), repeat=len(self.axes)):
            share = np.prod([p if u else 1 - p for u, p in zip(up, part, strict=True)], axis=0)
            out += share * self.values[tuple(k + u for k, u in zip(low, up, strict=True))]
        return out

    def offset(self, gamma: float, kbt: float) -> float:
        """c = kT (log sum exp(g v / kT) - log sum exp(v / (gamma - 1) / kT)) with g = gamma / (gamma - 1)."""
        v = self.values.reshape(-1) / kbt
        lse = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
        return kbt * float(lse(gamma / (gamma - 1) * v) - lse(v / (gamma - 1)))


class LiveWeights(StatefulProcessor):
    """Rows (id, hill, t, x, sigma, height) of one group; see live_weights()."""

    def __init__(self, axes: list[Axis], gamma: float, kbt: float, batch: float, checkpoint: float, cutoff: float, origin_ms: int, unit_ms: float):
        self.axes, self.gamma, self.kbt, self.batch, self.cutoff = axes, gamma, kbt, batch, cutoff
        self.every, self.origin_ms, self.unit_ms = ceil(round(checkpoint / batch, 9)), origin_ms, unit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grid = handle.getValueState("grid", _GRID)
        self.waiting = handle.getListState("waiting", _ROW)

    def _edge_ms(self, b: int) -> int:
        return ceil(self.origin_ms + b * self.batch * self.unit_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        edges = set()
        for table in rows:
            hill = table["hill"].to_numpy(bool)
            t = table["t"].to_numpy()
            b = np.where(hill, np.maximum(1, np.ceil(t / self.batch)), np.floor(t / self.batch) + 1).astype(int)
            edges |= set(b.tolist())
            floats = lambda x: None if x is None else [float(v) for v in x]
            self.waiting.appendList([(int(k), bool(h), int(i), float(s), floats(x), floats(w), None if pd.isna(g) else float(g)) for k, h, i, s, x, w, g in zip(b, hill, table["id"], t, table["x"], table["sigma"], table["height"], strict=True)])
        for b in edges:
            self.handle.registerTimer(self._edge_ms(b))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        """All batches whose edge the watermark has passed, in order; their other timers then find nothing."""
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due = [r for r in rows if self._edge_ms(r[0]) <= now]
        if not due:
            return
        if left := [r for r in rows if self._edge_ms(r[0]) > now]:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        values, c, mark = self.grid.get() if self.grid.exists() else (None, 0.0, None)
        grid = BiasGrid(self.axes, None if values is None else np.array(values))
        for b in sorted({r[0] for r in due}):
            hills = sorted((r for r in due if r[0] == b and r[1]), key=lambda r: (r[3], r[2]))
            for _, _, _, _, x, sigma, height in hills:
                grid.add(x, sigma, height, self.cutoff)
            if hills and (mark is None or b >= mark + self.every):
                c, mark = grid.offset(self.gamma, self.kbt), b
            frames = [r for r in due if r[0] == b and not r[1]]
            if frames:
                v = grid.at(np.array([r[4] for r in frames], float))
                yield pd.DataFrame({"id": [r[2] for r in frames], "t": [r[3] for r in frames], "v": v, "c": c, "e": (v - c) / self.kbt})
        self.grid.update((grid.values.reshape(-1).tolist(), c, mark))

    def close(self) -> None:
        pass


def live_weights(rows: DataFrame, ts: str, by: str, axes: list[Axis], gamma: float, kbt: float, batch: float, checkpoint: float, late: str, origin: str, unit_seconds: float, cutoff: float = 4.0) -> DataFrame:
    """(by, id, t, v, c, e) of a stream's frames: bias, offset and e = (v - c) / kT at each, once its batch is over.

    rows: a stream of hills and frames (by, id, ts, hill, t, x[], sigma[], height), t in units of unit_seconds since origin (a
    timestamp). Hills of one batch are added by time. w is exp(e) over its maximum, which is known at the end only (see
    normalised). Rows later than `late` behind the furthest row of any group are left out by Spark. Batches that are open when a
    stream ends come out once a later row moves the watermark on.
    """
    shipped(rows.sparkSession)
    start = rows.sparkSession.sql(f"SELECT unix_millis(timestamp'{origin}') AS m").first()["m"]
    live = rows.withWatermark(ts, late).select(by, ts, "id", "hill", "t", "x", "sigma", "height")
    processor = LiveWeights(axes, gamma, kbt, batch, checkpoint, cutoff, start, unit_seconds * 1000)
    kind = live.schema[by].dataType.simpleString()
    keyed = _Keyed(processor, by)
    return live.groupBy(by).transformWithStateInPandas(statefulProcessor=keyed, outputStructType=f"{by} {kind}, {OUT}", outputMode="append", timeMode="eventTime")


class _Keyed(StatefulProcessor):
    """Adds the group's name to a processor's rows."""

    def __init__(self, inner: StatefulProcessor, name: str):
        self.inner, self.name = inner, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        for out in self.inner.handleInputRows(key, rows, timerValues):
            yield out.assign(**{self.name: key[0]})[[self.name, *out.columns]]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        for out in self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield out.assign(**{self.name: key[0]})[[self.name, *out.columns]]

    def close(self) -> None:
        self.inner.close()


class TailReader(SimpleDataSourceStreamReader):
    """The whole lines that files have grown by; a last half line waits for its end. Offsets are bytes a file."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most", 16 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def _grown(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        system, _ = _system(self.path)
        begun, stop = json.loads(start["files"]), None if end is None else json.loads(end["files"])
        rows, places = [], dict(begun)
        for name, size in _files(self.path) if stop is None else [(n, 0) for n in stop]:
            first = begun.get(name, 0)
            last = min(size, first + self.most) if stop is None else stop[name]
            if last <= first:
                continue
            with system.open_input_file(name) as source:
                raw = source.read_at(last - first, first)
            whole = raw[: raw.rfind(b"\n") + 1]
            at = first
            for line in whole.split(b"\n")[:-1]:
                rows.append((line.removesuffix(b"\r").decode(errors="replace"), name, at))
                at += len(line) + 1
            places[name] = at
        return rows, {"files": json.dumps(places, sort_keys=True)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._grown(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._grown(start, end)[0])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return "value string, file string, place long"

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:  # noqa: N802
        return TailReader(self.options)


def growing_lines(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """A stream of (value, file, place): lines of text files as they grow, up to `most` bytes a file at once, half lines held back."""
    shipped(spark)
    spark.dataSource.register(TailSource)
    return spark.readStream.format("growing_text").option("most", most).load(path)


def normalised(weights: DataFrame) -> DataFrame:
    """Collected live_weights() rows with w = exp(e) over its maximum, as the batch operator has it."""
    top = weights.agg(F.max("e").alias("_m"))  # one row
    return weights.join(F.broadcast(top)).withColumn("w", F.exp(F.col("e") - F.col("_m"))).drop("_m")
