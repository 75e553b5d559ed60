"""Fields: value columns on cells (level, i, j, k). Arithmetic on them is plain Column arithmetic."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL, centre, length


def make_field(cells: DataFrame, value: Column | float, name: str = "u") -> DataFrame:
    """A field from a constant or an expression of the cell's centre (see `centres`)."""
    return cells.select(*CELL, (value if isinstance(value, Column) else F.lit(value)).alias(name))


def centres(dim: int) -> list[Column]:
    return [centre(F.col("level"), F.col(a)) for a in AXES[:dim]]


def quadrature(dim: int, points: int, f) -> Column:
    """Mean of f(x, ...) over a cell by Gauss-Legendre points on each axis."""
    x, w = np.polynomial.legendre.leggauss(points)
    h, mid = length(F.col("level")), centres(dim)
    terms = [f(*(m + F.lit(float(x[p]) / 2) * h for m, p in zip(mid, at))) * float(np.prod([w[p] / 2 for p in at])) for at in product(range(points), repeat=dim)]
    return reduce(lambda a, b: a + b, terms)


def equal(a: DataFrame, b: DataFrame, names: list[str], tolerance: float = 1e-15) -> bool:
    """Whether both have the same cells, and the same values but for `tolerance` (0 for integers)."""
    both = a.select(*CELL, *(F.col(n).alias(f"a_{n}") for n in names), F.lit(1).alias("in_a")).join(b.select(*CELL, *(F.col(n).alias(f"b_{n}") for n in names), F.lit(1).alias("in_b")), CELL, "full")
    off = reduce(lambda x, y: x | y, [F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) > tolerance for n in names])
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | off).isEmpty()


def copy(target: DataFrame, source: DataFrame, where: DataFrame, names: list[str]) -> DataFrame:
    """target with the values of `source` on the cells `where`; all fields in one pass."""
    new = source.join(where.select(*CELL), CELL, "left_semi").select(*CELL, *(F.col(n).alias(f"new_{n}") for n in names), F.lit(True).alias("hit"))
    return target.join(new, CELL, "left").select(*CELL, *(F.when(F.col("hit"), F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) for n in names))


def l2_error(field: DataFrame, exact, dim: int, relative: bool = False, points: int = 4, name: str = "u") -> float:
    """Square root of the integral of (exact - u)^2 over the cells."""
    volume = F.pow(length(F.col("level")), F.lit(dim))
    row = field.agg(F.sum(quadrature(dim, points, lambda *x: (exact(*x) - F.col(name)) ** 2) * volume).alias("e"), F.sum(quadrature(dim, points, lambda *x: exact(*x) ** 2) * volume).alias("n")).first()
    return float((row.e / row.n if relative else row.e) ** 0.5)


def convergence_order(coarse_error: float, fine_error: float) -> float:
    return log2(coarse_error / fine_error)


def nan_cells(field: DataFrame, *names: str) -> DataFrame:
    """Cells whose value is not a number, or missing."""
    return field.where(reduce(lambda a, b: a | b, [F.isnan(n) | F.col(n).isNull() for n in names]))


def extract(field: DataFrame, where: DataFrame) -> DataFrame:
    """The field on some cells, in canonical order."""
    return field.join(where.select(*CELL), CELL, "left_semi").orderBy("level", "k", "j", "i")
