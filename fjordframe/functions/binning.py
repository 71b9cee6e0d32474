"""Histogram bins as column expressions: [e_i, e_i+1), the last bin closed, values outside dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """n bins between lo and hi."""

    lo: float
    hi: float
    n: int

    @property
    def step(self) -> float:
        return (self.hi - self.lo) / self.n

    def index(self, x: Column) -> Column:
        """Bin of x, null outside. Edges are k * step + lo, and a quotient that rounds over an edge is put right."""
        lo, hi, step, n = F.lit(float(self.lo)), F.lit(float(self.hi)), F.lit(self.step), self.n
        k = F.least(F.floor((x - lo) / step), F.lit(n - 1))
        moved = F.when(x == hi, n - 1).when(x < k * step + lo, k - 1).when((k < n - 1) & (x >= (k + 1) * step + lo), k + 1).otherwise(k)
        return F.when((x >= lo) & (x <= hi), moved).cast("int")

    def clipped(self, x: Column) -> Column:
        """Bin of x with values outside folded into the end bins."""
        k = F.floor((x - F.lit(float(self.lo))) / F.lit(self.step))
        return F.least(F.greatest(k, F.lit(0)), F.lit(self.n - 1)).cast("int")

    def centre(self, k: Column) -> Column:
        """Centre of bin k."""
        return (k + 0.5) * F.lit(self.step) + F.lit(float(self.lo))

    def sql(self, x: str) -> str:
        """index() as DuckDB SQL."""
        lo, hi, step = (f"({v!r})::DOUBLE" for v in (float(self.lo), float(self.hi), self.step))
        k = f"least(floor(({x} - {lo}) / {step}), {self.n - 1})"
        return (
            f"(CASE WHEN {x} >= {lo} AND {x} <= {hi} THEN CASE WHEN {x} = {hi} THEN {self.n - 1} WHEN {x} < {k} * {step} + {lo} THEN {k} - 1 "
            f"WHEN {k} < {self.n - 1} AND {x} >= ({k} + 1) * {step} + {lo} THEN {k} + 1 ELSE {k} END END)::INTEGER"
        )
