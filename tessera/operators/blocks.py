"""Systems of several unknowns, with rows for borders, solved together by a block factorisation as preconditioner.

An unknown is a struct (block, level, i, j, k). The value beyond a face of the border is an unknown too, of a block for its
direction and named by the cell inside, so that no two faces share one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import CELL, length
from tessera.functions.stencils import directions

from .mesh import border_leaves, interfaces
from .multigrid import diagonal, times, two_steps
from .solve import _id_of, bicgstab, matrix_sum, product


def unknown(block: int, cell: Column | None = None) -> Column:
    of = (lambda c: F.col(c)) if cell is None else (lambda c: cell[c])
    return F.struct(F.lit(block).alias("block"), *(of(c).alias(c) for c in CELL))


def entries(block_row: int, block_col: int, matrix: DataFrame) -> DataFrame:
    """A matrix between cells as part of a block system."""
    return matrix.select(unknown(block_row, F.col("row")).alias("row"), unknown(block_col, F.col("col")).alias("col"), "value")


def diffusion(leaves: DataFrame, dim: int, block: int, k: float = 1.0, shift: float = 0.0) -> DataFrame:
    """shift * u - div(k grad u) of one unknown, scaled by cell volumes, without what passes the borders."""
    c = F.lit(k) * F.pow(length(F.col("level")), F.lit(dim - 2))
    found = interfaces(leaves, dim).select(_id_of("l").alias("l"), _id_of("r").alias("r"), c.alias("c"))
    pairs = (("l", "l", 1), ("r", "r", 1), ("l", "r", -1), ("r", "l", -1))
    inner = found.select(F.inline(F.array(*(F.struct(unknown(block, F.col(a)).alias("row"), unknown(block, F.col(b)).alias("col"), (F.col("c") * s).alias("value")) for a, b, s in pairs))))
    return inner.unionByName(mass(leaves, dim, block, block, shift)) if shift else inner


def mass(leaves: DataFrame, dim: int, row: int, col: int, factor: float) -> DataFrame:
    """factor * volume on the diagonal of a block."""
    return leaves.select(unknown(row).alias("row"), unknown(col).alias("col"), (F.lit(float(factor)) * F.pow(length(F.col("level")), F.lit(dim))).alias("value"))


def border_rows(leaves: DataFrame, dim: int, block: int, first: int, min_level: int, condition: Callable, k: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The equations at borders: entries of the system, and the right side (id, v) of the border's own rows.

    condition(axis, side) gives ("value" or "slope", g): the mean of both sides of the face, or the outward slope, is g, a
    number or an expression of the cell's columns. The unknown beyond a face is of block `first` + 2 * axis + (side > 0);
    the cell's own row gets the flux through the face. Border rows are scaled like the flux.
    """
    parts, right = [], []
    h = length(F.col("level"))
    c = F.lit(k) * F.pow(h, F.lit(dim - 2))
    for d in directions(dim):
        axis = next(a for a in range(3) if d[a])
        kind, g = condition(axis, d[axis])
        here, beyond = unknown(block), unknown(first + 2 * axis + (d[axis] > 0))
        edge = border_leaves(leaves, min_level, d)
        own, scale = (1, F.lit(2.0)) if kind == "value" else (-1, h)
        terms = ((here, here, c), (here, beyond, -c), (beyond, here, own * c), (beyond, beyond, c))
        parts.append(edge.select(F.inline(F.array(*(F.struct(a.alias("row"), b.alias("col"), v.alias("value")) for a, b, v in terms)))))
        right.append(edge.select(beyond.alias("id"), ((F.lit(float(g)) if isinstance(g, (int, float)) else g) * scale * c).alias("v")))
    union = lambda x: reduce(DataFrame.unionByName, x)
    return union(parts), union(right)


def schur_inverse(matrix: DataFrame, second: list[int], weight: float = 0.8) -> DataFrame:
    """An approximate inverse of [[A, B], [C, D]] by its block factorisation, as a matrix; the blocks in `second` are the lower ones.

    A stands for its diagonal, which must be full; the complement S = D - C diag(A)^-1 B is assembled and two damped steps
    stand for its inverse. So entries reach two neighbours of the complement, and applying it is one product.
    """
    low = lambda side: F.col(f"{side}.block").isin(second)
    a, b, c, d = (matrix.where(r & s) for r, s in ((~low("row"), ~low("col")), (~low("row"), low("col")), (low("row"), ~low("col")), (low("row"), low("col"))))
    head = diagonal(a).select(F.col("id").alias("row"), F.col("id").alias("col"), (1 / F.col("d")).alias("value")).checkpoint()
    minus = lambda m: m.withColumn("value", -F.col("value"))
    right = minus(times(head, b)).checkpoint()
    left = minus(times(c, head)).checkpoint()
    tail = two_steps(matrix_sum(d, times(c, right)).checkpoint(), weight).checkpoint()
    upper = times(right, tail).checkpoint()
    return matrix_sum(head, times(upper, left), upper, times(tail, left), tail).checkpoint()


def solve(matrix: DataFrame, rhs: DataFrame, second: list[int], tolerance: float = 1e-8, rounds: int = 200, precondition: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The solution (id, v) of a block system; unknowns that `rhs` does not name have a right side of zero.

    Repeated entries of the matrix, and of rhs, are summed. precondition: instead
    of schur_inverse.
    """
    matrix = matrix_sum(matrix).checkpoint()
    full = matrix.select(F.col("row").alias("id"), F.lit(0.0).alias("v")).unionByName(rhs.select("id", "v")).groupBy("id").agg(F.sum("v").alias("v")).checkpoint()
    if precondition is None:
        inverse = schur_inverse(matrix, second)
        precondition = lambda v: product(inverse, v)
    return bicgstab(matrix, full, tolerance, rounds, precondition)
