"""Residue range texts and angle helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ranges(text: Column) -> Column:
    """'27-42,48-61' as a sorted array of the integers it names."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "-"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p[0].cast("int"), F.element_at(p, -1).cast("int"))))))


def format_ranges(values: Column) -> Column:
    """'first-last' for consecutive integers, otherwise all of them with commas."""
    v = F.array_sort(F.array_distinct(values))
    whole = F.element_at(v, -1) - F.element_at(v, 1) + 1 == F.size(v)
    return F.when(F.size(v) == 0, "").when(whole & (F.size(v) > 1), F.concat_ws("-", F.element_at(v, 1).cast("string"), F.element_at(v, -1).cast("string"))).otherwise(F.array_join(v.cast("array<string>"), ","))


def bend_degrees(theta: Column) -> Column:
    """Bend in degrees of an opening angle in radians."""
    return F.lit(180.0) - F.degrees(theta)
