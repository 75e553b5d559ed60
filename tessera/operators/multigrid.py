"""Geometric multigrid over coarsened leaf tables; a whole cycle is three products with stored tables.

Let b_n be the right side that grid n gets in a V-cycle with one damped Jacobi step before and after each correction. It is
linear in the finest one, b_n = Q_n b, and for a symmetric matrix the cycle's result is the sum of Q_n^T W_n Q_n b over the
grids, where W_n is what both steps make (on the coarsest grid the inverse). So the Q_n of all grids are one table, the W_n
another, and a cycle is one plan for all grids instead of jobs for each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL

from .solve import cell_id, matrix_sum, product


@dataclass(frozen=True)
class Grids:
    """The finest matrix; `down` and `steps` (row, col, value), whose rows are (grid, id); points: (grid, id) of all grids."""

    matrix: DataFrame
    down: DataFrame
    steps: DataFrame
    points: DataFrame


def parents_of_finest(leaves: DataFrame, top: int) -> DataFrame:
    """Leaves with `up`, the cell of the next coarser grid: parents of those on level `top`, else the leaf itself."""
    fine = F.col("level") == top
    up = F.struct((F.col("level") - fine.cast("int")).alias("level"), *(F.when(fine, F.shiftright(a, 1)).otherwise(F.col(a)).alias(a) for a in AXES))
    return leaves.select(*CELL, up.alias("up"))


def diagonal(matrix: DataFrame) -> DataFrame:
    """(id, d) of the rows with a diagonal entry that is not zero."""
    return matrix.where("row = col and value <> 0").select(F.col("row").alias("id"), F.col("value").alias("d"))


def two_steps(matrix: DataFrame, weight: float = 0.8) -> DataFrame:
    """What two damped Jacobi steps from zero make of a right side, as a matrix: 2 w / D - w^2 / D A / D."""
    d = diagonal(matrix)
    side = lambda name: d.select(F.col("id").alias(name), F.col("d").alias(f"d_{name}"))
    both = matrix.join(side("row"), "row").join(side("col"), "col")
    value = F.when(F.col("row") == F.col("col"), 2 * weight / F.col("d_row")).otherwise(0.0) - weight**2 * F.col("value") / F.col("d_row") / F.col("d_col")
    return both.select("row", "col", value.alias("value"))


def hierarchy(leaves: DataFrame, operator: Callable[[DataFrame], DataFrame], coarsest: int = 0, direct: int = 256, weight: float = 0.8) -> Grids | None:
    """Grids from the leaves to their ancestors on level `coarsest`, the finest level of each merged for the next.

    operator: the symmetric matrix of a mesh, scaled by cell volumes (such as solve.diffusion_matrix); each cell needs an
    entry on the diagonal. A coarsest grid of at most `direct` cells is inverted, which is all that the driver ever holds; a
    larger one gets two steps. A graduated mesh stays graduated. None for a mesh without cells.
    """
    top = leaves.agg(F.max("level")).first()[0]
    if top is None:
        return None
    on = lambda n, c: F.struct(F.lit(n).alias("grid"), F.col(c).alias("id"))
    finest, below, down, steps, points = None, None, [], [], []
    for n in range(max(top - coarsest, 0) + 1):
        matrix = operator(leaves).checkpoint()
        finest = finest or matrix
        cells = parents_of_finest(leaves, top - n).select(cell_id().alias("id"), "up")
        reach = (cells.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value")) if below is None else below).checkpoint()
        down.append(reach.select(on(n, "row").alias("row"), "col", "value"))
        points.append(cells.select(on(n, "id").alias("id")))
        last = top - n <= coarsest
        made = (_inverse(matrix, cells, direct) if last else None) or two_steps(matrix, weight)
        steps.append(made.select(on(n, "row").alias("row"), on(n, "col").alias("col"), "value"))
        if not last:
            # one step from zero, its residual summed on the coarser cells
            above = cells.select(F.col("id").alias("row"), "up")
            scaled = matrix.join(diagonal(matrix).select(F.col("id").alias("col"), "d"), "col").select("row", "col", (-weight * F.col("value") / F.col("d")).alias("value"))
            once = cells.select(F.col("up").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))
            taken = matrix_sum(scaled.join(above, "row").select(F.col("up").alias("row"), "col", "value"), once)
            below = times(taken, reach)
            leaves = cells.select("up.*").distinct()
            if n % 2:
                leaves = leaves.checkpoint()
    union = lambda tables: reduce(DataFrame.unionByName, tables).checkpoint()
    return Grids(finest, union(down), union(steps), union(points))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices: a join on the inner index, a sum by both outer ones."""
    inner = b.select(F.col("row").alias("col"), F.col("col").alias("to"), F.col("value").alias("w"))
    return a.join(inner, "col").groupBy("row", F.col("to").alias("col")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def _inverse(matrix: DataFrame, cells: DataFrame, direct: int) -> DataFrame | None:
    """The inverse as a table, of at most `direct` cells."""
    ids = [r.id for r in cells.select("id").limit(direct + 1).collect()]
    if len(ids) > direct:
        return None
    at = {c: n for n, c in enumerate(ids)}
    dense = np.zeros((len(ids), len(ids)))
    for r in matrix.collect():
        dense[at[r.row], at[r.col]] = r.value
    inverse = np.linalg.inv(dense)
    rows = [(a, b, float(inverse[at[a], at[b]])) for a in ids for b in ids]
    return cells.sparkSession.createDataFrame(rows, matrix.schema)


def cycle(grids: Grids, rhs: DataFrame) -> DataFrame:
    """One V-cycle from zero: an approximate solution (id, v), linear and symmetric in rhs (id, v)."""
    return product(transposed(grids.down), product(grids.steps, product(grids.down, rhs)))


def cycles(grids: Grids | None, rhs: DataFrame, tolerance: float = 1e-8, rounds: int = 60) -> DataFrame:
    """The solution (id, v) by V-cycles alone; an error if the residual does not fall to `tolerance` of the right side.

    A right side without rows, or of zeros, is its own solution.
    """
    state = rhs.select("id", F.lit(0.0).alias("x"), F.col("v").alias("r")).checkpoint()
    start = size = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(rounds):
        if size <= tolerance**2 * start:
            break
        step = cycle(grids, state.select("id", F.col("r").alias("v"))).checkpoint()
        image = product(grids.matrix, step).withColumnRenamed("v", "q")
        state = state.join(step, "id").join(image, "id").select("id", (F.col("x") + F.col("v")).alias("x"), (F.col("r") - F.col("q")).alias("r")).checkpoint()
        size = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
    if size > tolerance**2 * start:
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    return state.select("id", F.col("x").alias("v"))
