"""Shared folder, written intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.functions.lineage import shared_folder
from fjordframe.functions.shipping import mapped as mapped
from fjordframe.functions.shipping import released, shipped

#: Hash slots that part rows of nearly equal counts.
SLOTS = 1 << 14


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/fjordframe-{name}-{uuid.uuid4().hex}"


#: Paths written inside each open scratch() of this thread, the innermost last.
_scratches: ContextVar[tuple[list[str], ...]] = ContextVar("scratches", default=())


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors. options: the writer's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if opened := _scratches.get():
        opened[-1].append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fjordframe_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a written() table that a later written table has replaced; other tables stay."""
    if path := getattr(df, "_fjordframe_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, every table written inside, unless it was written through kept()."""
    own: list[str] = []
    token = _scratches.set((*_scratches.get(), own))
    try:
        yield
    finally:
        _scratches.reset(token)
        for path in own:
            _delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """written(), for a result that outlives the scratch() around it (and goes with the one around that)."""
    token = _scratches.set(_scratches.get()[:-1])
    try:
        return written(df, name)
    finally:
        _scratches.reset(token)


def id_fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def text_column(spark: SparkSession, f: Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.Array]], kind: str, *columns: str) -> Column:
    """A column that f gives for each row's columns, in Arrow batches; other columns, of any name and type, stay where they are.

    It is not deterministic for the optimizer, which would else work it out again for a filter on it.
    """
    shipped(spark)

    def run(arrays: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from f(arrays if len(columns) > 1 else ((a,) for a in arrays))
        released()

    hint = tuple[pa.Array, ...] if len(columns) > 1 else pa.Array
    run.__annotations__ = {"arrays": Iterator[hint], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()(*columns)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of the given schema from arrays, Arrow or numpy."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=t.type) for c, t in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (with a column n) of highest n, at most so many; ties go by a hash of the row.

    A histogram of n by steps of a 64th of an octave (about 4000 at most) gives the step where the limit falls. All rows
    above it stay; of the rows in it, those of as many hash slots (SLOTS in all) as fit, so that no sort is needed.
    """
    step = F.floor(F.log2("n") * 64)
    total, edge = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        if total + r["rows"] > most:
            edge = r["step"]
            break
        total += r["rows"]
    if edge is None:
        return counts
    slot = F.pmod(F.xxhash64(*counts.columns), F.lit(SLOTS))
    last = 0
    for r in counts.where(step == edge).groupBy(slot.alias("slot")).agg(F.count("*").alias("rows")).orderBy("slot").collect():
        total += r["rows"]
        if total > most:
            break
        last = r["slot"] + 1
    return counts.where((step > edge) | ((step == edge) & (slot < last)))
