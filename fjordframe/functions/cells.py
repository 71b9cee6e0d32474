"""Cells of space that points meet in: a point lies in one cell, and is copied to all cells that come within a reach of it.

Cells are WIDE reaches wide, so a point has few copies (3.4 on average, 27 were cells as wide as the reach). Their middle, not
their corner, is at the origin, where centred structures lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a cell in reaches.
WIDE = 4


def cell_of(c: Column, reach: float) -> Column:
    """The cell of a coordinate along its axis."""
    return F.floor(c / F.lit(WIDE * reach) + F.lit(0.5))


def copied(rows: DataFrame, xyz: list[str], names: list[str], reach: float) -> DataFrame:
    """rows once for every cell (names) that comes within the reach of their place (xyz); a trifle is left for rounding."""
    r = reach * (1 + 1e-9)
    ends = [(cell_of(F.col(c) - F.lit(r), reach), cell_of(F.col(c) + F.lit(r), reach)) for c in xyz]
    return reduce(lambda df, axis: df.withColumn(axis[0], F.explode(F.sequence(*axis[1]))), zip(names, ends, strict=True), rows)
