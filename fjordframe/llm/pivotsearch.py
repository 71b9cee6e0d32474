"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it, and the keys are sorted, so that a pivot's vectors
lie in annuli of growing distance; a stretch of the sorted vectors of one pivot makes a block, with its least and largest
distance and its largest norm. For a query at distance d from the pivot, the triangle inequality bounds the distance
to every vector of an annulus from below, and with the norms the inner product from above:
2 q.v = |q|^2 + |v|^2 - |q - v|^2; it is also at most |q| |v|.

A query takes the blocks in the order of their bounds, best first, in rounds: FIRST blocks, then GROWTH times as many, and
so on. Each round raises its k-th score, and it stops before the first block whose bound does not reach that score. So
results are exact; where bounds do not help, every block is visited. Rounds number log(blocks) at most.

The directory of blocks has at most DIRECTORY rows and one for each pivot and task, as blocks grow with the table; it goes
to every task. In a round only the vectors of wanted blocks and the queries that want them are dealt out by block; a block
that more than VISITS queries want is dealt out several times, to a part of the queries each. A task holds one block and
one Arrow batch of queries. PIVOTS vectors at most, one for every BLOCK of them, least by hash, serve as pivots: a bounded
sample that decides speed, not results.

Components are floor(1024 * x), and scores are exact while sums stay below 2**63. Vectors that are null, empty, or hold null
or non-finite components take no part, nor do rows with a null id. Vectors of different lengths have no inner product: each
length is searched by itself. Every row is its own: a query's own row is no candidate, all other rows are, whatever their
ids; rows that repeat an id are listed each, and each row with a query's id gets its own k results. Other columns, of any
name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.llm.common import discard, mapped, written

PIVOTS, BLOCK, DIRECTORY = 64, 1024, 1 << 17
FIRST, GROWTH, VISITS = 16, 8, 4096
#: Queries whose bounds a task works out at once.
_AT_ONCE = 64


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<i8").reshape(-1, width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    near = np.arange(len(scores))
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by floats, which is faster, where every sum stays exact."""
    q, v = queries.astype(float), vectors.astype(float)
    if (q * q).sum(axis=1).max(initial=0) * (v * v).sum(axis=1).max(initial=0) < 2.0**104:
        return (q @ v.T).astype(np.int64)
    return queries @ vectors.T


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): integer components of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.size("embedding") > 0
    sound &= F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 1024)).alias("v"))


class Pivots:
    def __init__(self, rows: np.ndarray):
        self.rows, self.width = rows, rows.shape[1]
        self.norms = (rows.astype(float) ** 2).sum(axis=1)

    def distances(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(float)
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + self.norms - 2 * x @ self.rows.T.astype(float), 0))


class Directory:
    """Blocks by number: pivot, least and largest distance to it, and largest squared norm."""

    def __init__(self, pivots: Pivots, block: np.ndarray, pivot: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray):
        self.pivots, self.block, self.pivot, self.near, self.far, self.norm = pivots, block, pivot, near, far, norm

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """What the score of each query with any vector of each block is at most, with room for rounding."""
        d = self.pivots.distances(v)[:, self.pivot]
        own = (v.astype(float) ** 2).sum(axis=1)[:, None]
        gap = np.maximum(np.maximum(self.near - d, d - self.far), 0)
        slack = 1e-6 * (1 + own + self.norm + gap * gap)
        return np.minimum((own + self.norm - gap * gap) / 2, np.sqrt(own * self.norm)) + slack

    def wanted(self, v: np.ndarray, floors: np.ndarray, done: int, upto: int) -> Iterator[np.ndarray]:
        """For each query, the blocks from place `done` to `upto` in the order of its bounds that may reach its floor."""
        for at in range(0, len(v), _AT_ONCE):
            bounds = self.bounds(v[at : at + _AT_ONCE])
            for row, floor in zip(bounds, floors[at : at + _AT_ONCE], strict=True):
                order = np.argsort(-row, kind="stable")[done:upto]
                yield self.block[order[row[order] >= floor]]


def _keyed(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows with the nearest pivot, the distance to it, and the vector as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["v"].flatten().to_numpy().reshape(-1, shared.value.width)
            d = shared.value.distances(v)
            nearest = d.argmin(axis=1)
            raw = v.astype("<i8")
            yield pa.RecordBatch.from_arrays([b["rid"], b["vec_id"], b["is_query"], pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest]), pa.array([x.tobytes() for x in raw], pa.binary())], names=["rid", "vec_id", "is_query", "pivot", "distance", "v"])

    return rows.select("rid", "vec_id", "is_query", "v").transform(mapped, key, "rid long, vec_id long, is_query boolean, pivot int, distance double, v binary")


def _blocked(ordered: DataFrame, width: int, size: int) -> DataFrame:
    """Sorted rows with the number of their block: `size` rows in a row of one pivot in one task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pivot, taken = (TaskContext.get().partitionId() << 32) - 1, -1, size
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            pivots = b["pivot"].to_numpy()
            at = 0
            while at < len(pivots):
                if pivots[at] != pivot or taken == size:
                    block, pivot, taken = block + 1, pivots[at], 0
                other = np.flatnonzero(pivots[at:] != pivot)
                to = min(at + size - taken, at + int(other[0]) if len(other) else len(pivots))
                out[at:to] = block
                at, taken = to, taken + to - at
            norms = (_matrix(b["v"], width).astype(float) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out), *(b[c] for c in ("rid", "vec_id", "is_query", "pivot", "distance")), pa.array(norms), b["v"]], names=["block", "rid", "vec_id", "is_query", "pivot", "distance", "norm", "v"])

    return ordered.transform(mapped, number, "block long, rid long, vec_id long, is_query boolean, pivot int, distance double, norm double, v binary")


def _scored(width: int, k: int):
    """Rows of a block come before the queries that want it: each query's best of the block, no worse than its floor."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for b in batches:
            keys = list(zip(b["block"].to_pylist(), b["part"].to_pylist(), b["asks"].to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                s, (block, part, asks) = b.slice(x, y - x), keys[x]
                v, rids, ids = _matrix(s["v"], width), s["rid"].to_numpy(), s["vec_id"].to_numpy()
                if not asks:
                    if now != (block, part):
                        now, parts = (block, part), []
                    parts.append((rids, ids, v))
                    held = None
                    continue
                held = held or tuple(map(np.concatenate, zip(*parts, strict=True)))
                out: list[list[np.ndarray]] = [[], [], [], []]
                for rid, own, floor, scores in zip(rids, ids, s["floor"].to_pylist(), _products(v, held[2]), strict=True):
                    near = np.flatnonzero((held[0] != rid) & (scores >= floor if floor is not None else True))
                    best = near[_best(scores[near], held[1][near], k)]
                    for column, c in zip(out, (np.full(len(best), rid), np.full(len(best), own), held[1][best], scores[best]), strict=True):
                        column.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["qrid", "query_id", "vec_id", "score"])

    return score


def _searched(rows: DataFrame, n: int, width: int, k: int, stats: dict | None) -> DataFrame:
    """(qrid, query_id, vec_id, score): the k best candidates of each query among the n vectors of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id", "rid"), "rid").limit(min(PIVOTS, n // BLOCK + 1)).collect()
    pivots = Pivots(np.array(sorted({tuple(r["v"]) for r in sample}), np.int64))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(BLOCK, n // DIRECTORY + 1)
    ordered = _keyed(rows, pivots).repartitionByRange(parts, "pivot", "distance", "rid").sortWithinPartitions("pivot", "distance", "rid")
    index = written(_blocked(ordered, width, size), "index")
    edges = index.groupBy("block", "pivot").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("norm")).orderBy("block").toArrow()
    names = [edges[c].to_numpy() for c in ("block", "pivot", "near", "far", "norm")]
    directory = spark.sparkContext.broadcast(Directory(pivots, *names))
    queries = index.where("is_query").select("rid", "vec_id", "v")
    if stats is not None:
        stats["pairs"] = stats.get("pairs", 0) + queries.count() * len(names[0])

    def plan(done: int, upto: int):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                floors = np.array([-np.inf if f is None else float(f) for f in b["floor"].to_pylist()])
                blocks = list(directory.value.wanted(_matrix(b["v"], width), floors, done, upto))
                of = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in blocks]))
                wanted = pa.array(np.concatenate([np.zeros(0, np.int64), *blocks]))
                yield pa.RecordBatch.from_arrays([wanted, *(b[c].take(of) for c in ("rid", "vec_id", "floor", "v"))], names=["block", "rid", "vec_id", "floor", "v"])

        return emit

    best, done, upto = None, 0, FIRST
    while True:
        floor = F.lit(None).cast("long").alias("floor")
        asked = queries.select("rid", "vec_id", "v", floor)
        if best is not None:
            floors = best.groupBy(F.col("qrid").alias("rid")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            asked = queries.join(floors, "rid", "left").select("rid", "vec_id", "v", "floor")
        visits = written(asked.transform(mapped, plan(done, upto), "block long, rid long, vec_id long, floor long, v binary"), "visits")
        counts = visits.groupBy("block").agg(F.count("*").alias("n"))
        made = visits.count()
        if stats is not None:
            stats["visits"] = stats.get("visits", 0) + made
        if made:
            copies = counts.select("block", F.ceil(F.col("n") / VISITS).cast("int").alias("copies"))
            # At most one row a block: DIRECTORY rows and one for each pivot and task.
            held = index.join(F.broadcast(copies), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            asks = visits.join(F.broadcast(copies), "block").withColumn("part", F.pmod(F.hash("rid"), F.col("copies")))
            both = held.select("block", "part", F.lit(False).alias("asks"), "rid", "vec_id", F.lit(None).cast("long").alias("floor"), "v").unionByName(asks.select("block", "part", F.lit(True).alias("asks"), "rid", "vec_id", "floor", "v"))
            found = both.repartition(parts, "block", "part").sortWithinPartitions("block", "part", "asks").transform(mapped, _scored(width, k), "qrid long, query_id long, vec_id long, score long")
            place = F.row_number().over(Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id"))
            old = best
            best = written((found if old is None else found.unionByName(old)).withColumn("_r", place).where(F.col("_r") <= k).drop("_r"), "best")
            discard(old)
        discard(visits)
        done, upto = upto, upto * (GROWTH + 1)
        if not made or done >= len(names[0]):
            break
    if best is not None:
        return best
    return spark.createDataFrame([], "qrid long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates. is_query is a condition over vec_id.

    stats, if given, gets `pairs`, the number of (query, block) pairs, and `visits`, how many of them were searched.
    """
    asks = F.coalesce(is_query, F.lit(False)).alias("is_query")
    # Written once, so that a row keeps its number.
    rows = written(scaled(vectors).select(F.monotonically_increasing_id().alias("rid"), "vec_id", asks, "v"), "vectors")
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.max("is_query").alias("asked"), F.count("*").alias("n")).where("asked").orderBy("w").collect()
    found = [_searched(rows.where(F.size("v") == r["w"]), r["n"], r["w"], k, stats) for r in widths]
    every = reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "qrid long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", place).select("query_id", "rank", "vec_id", "score")
