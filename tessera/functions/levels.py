"""Integer keys of cells on dyadic levels. Shifts floor, for negative keys too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
CELL = ["level", *AXES]


def down(x: str | Column, steps: Column | int) -> Column:
    """x on a level coarser by `steps`, which may differ from row to row."""
    return F.shiftright(x, steps) if isinstance(steps, int) else F.call_function("shiftright", F.col(x) if isinstance(x, str) else x, steps)


def coarse_end(x: Column, steps: int) -> Column:
    """An exclusive end on a coarser level: rounded up, so that every cell which touches the interval is in."""
    return F.shiftright(x - 1, steps) + 1


def length(level: Column) -> Column:
    """Side of a cell on a level of the unit grid."""
    return F.pow(F.lit(2.0), -level)


def centre(level: Column, x: Column) -> Column:
    return (x + F.lit(0.5)) * length(level)
