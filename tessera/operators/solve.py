"""Sparse linear systems as tables of coordinates (row, col, value), and solvers whose products are joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import CELL, length

from .faces import faces
from .mesh import boundary_faces, interfaces


def cell_id():
    """What names a cell in a matrix or vector: its level and indices, of any size and sign."""
    return F.struct(*CELL)


def _id_of(side: str):
    return F.struct(*(F.col(f"{side}_{c}").alias(c) for c in CELL))


def diffusion_matrix(leaves: DataFrame, area: DataFrame, dim: int, k: float = 1.0, dirichlet: bool = True, shift: float = 0.0) -> DataFrame:
    """The matrix of shift * u - div(k grad u), scaled by cell volumes (so it is symmetric); borders hold 0 or let nothing pass."""
    h, faces = length(F.col("level")), interfaces(leaves, dim)
    c = F.lit(k) * F.pow(h, F.lit(dim - 2))
    l, r = _id_of("l"), _id_of("r")
    parts = [faces.select(a.alias("row"), b.alias("col"), (c * s).alias("value")) for a, b, s in ((l, l, 1), (r, r, 1), (l, r, -1), (r, l, -1))]
    if dirichlet:
        parts.append(boundary_faces(leaves, area, dim).select(cell_id().alias("row"), cell_id().alias("col"), (2 * c).alias("value")))
    if shift:
        parts.append(leaves.select(cell_id().alias("row"), cell_id().alias("col"), (shift * F.pow(h, F.lit(dim))).alias("value")))
    return matrix_sum(*parts)


def matrix_sum(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("row", "col").agg(F.sum("value").alias("value"))


def block_matrix(blocks: dict[tuple[int, int], DataFrame]) -> DataFrame:
    """A matrix of blocks: unknowns become (block, id)."""
    return reduce(DataFrame.unionByName, [m.select(F.lit(a).alias("row_block"), "row", F.lit(b).alias("col_block"), "col", "value") for (a, b), m in blocks.items()])


def product(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix times a vector (id, v): a join on columns, a sum by rows."""
    return matrix.join(x.select(F.col("id").alias("col"), "v"), "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("v")).alias("v"))


def conjugate_gradient(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-8, rounds: int = 500, keep: int = 8) -> DataFrame:
    """The solution (id, v) of a symmetric positive definite system; an error if it does not converge.

    Vectors are columns of one table; every `keep` rounds it is checkpointed. Only two sums a round come to the driver.
    """
    state = rhs.select("id", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p")).checkpoint()
    norm = start = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    matrix = matrix.checkpoint()
    for n in range(rounds):
        if norm <= tolerance**2 * start:
            return state.select("id", F.col("x").alias("v"))
        q = product(matrix, state.select("id", F.col("p").alias("v"))).withColumnRenamed("v", "q")
        state = state.join(q, "id").checkpoint()
        alpha = norm / state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        state = state.select("id", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = state.withColumn("p", F.col("r") + F.lit(new / norm) * F.col("p"))
        norm = new
    raise ArithmeticError(f"no convergence in {rounds} rounds")


def bicgstab(matrix: DataFrame, rhs: DataFrame, tolerance: float = 1e-8, rounds: int = 200, precondition: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The solution (id, v) of any regular system by stabilised bi-conjugate gradients (van der Vorst 1992); an error if it
    does not converge.

    All vectors are columns of one table, checkpointed twice a round; the sums of half a round come to the driver together.
    precondition: an approximate inverse, from (id, v) to (id, v), applied on the right; by default the diagonal's.
    """
    matrix = matrix.checkpoint()
    if precondition is None:
        diagonal = matrix.where("row = col").select(F.col("row").alias("id"), F.col("value").alias("d"))
        precondition = lambda v: v.join(diagonal, "id", "left").select("id", (F.col("v") / F.when(F.coalesce("d", F.lit(0.0)) == 0, 1.0).otherwise(F.col("d"))).alias("v"))

    def applied(state: DataFrame, vector: str, hat: str, image: str) -> DataFrame:
        made = precondition(state.select("id", F.col(vector).alias("v")))
        out = product(matrix, made).withColumnRenamed("v", image)
        return state.join(made.withColumnRenamed("v", hat), "id").join(out, "id", "left").fillna(0.0, [image]).checkpoint()

    dot = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}")
    state = rhs.select("id", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("r0"), F.col("v").alias("p")).checkpoint()
    start = rho = state.agg(dot("r", "r")).first()[0] or 0.0
    for _ in range(rounds):
        if not start:
            break
        state = applied(state, "p", "p1", "q")
        alpha = rho / state.agg(dot("r0", "q")).first()[0]
        state = state.withColumn("s", F.col("r") - alpha * F.col("q"))
        state = applied(state, "s", "s1", "t")
        n = state.agg(dot("t", "s"), dot("t", "t"), dot("s", "s"), dot("r0", "s"), dot("r0", "t")).first()
        omega = n.t_s / n.t_t if n.t_t else 0.0
        left = n.s_s - 2 * omega * n.t_s + omega * omega * n.t_t
        x = (F.col("x") + alpha * F.col("p1") + omega * F.col("s1")).alias("x")
        if left <= tolerance**2 * start:
            return state.select("id", x.alias("v"))
        new = n.r0_s - omega * n.r0_t
        if not omega or not new:
            raise ArithmeticError("the iteration breaks down")
        r, beta = F.col("s") - omega * F.col("t"), new / rho * alpha / omega
        state = state.select("id", x, r.alias("r"), "r0", (r + beta * (F.col("p") - omega * F.col("q"))).alias("p"))
        rho = new
    else:
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    return state.select("id", F.col("x").alias("v"))


def flux_jacobian(leaves: DataFrame, field: DataFrame, dim: int, flux: Callable, *names: str, by: str = "u", shift: float = 0.0, step: float = 1e-6, border: Callable | None = None) -> DataFrame:
    """The matrix of derivatives of shift * u + div flux (scaled by cell volumes) by the column `by`, at a field.

    flux, border: as in schemes.flux_scheme (border: derivatives of the faces with one cell). Both sides' derivatives are
    central differences of the flux itself, of a step relative to the value; each face gives four entries, a border one.
    """
    found = faces(field.select(*CELL, *names).join(leaves.select(*CELL), CELL, "left_semi"), dim, *names)
    h, area = length(F.col("level")), F.pow(length(F.col("level")), F.lit(dim - 1))
    of = lambda side: {n: F.col(f"{side}.{n}") for n in names}

    def change(f: Callable, moved: str, l: dict, r: dict) -> object:
        own = (l if moved == "l" else r)[by]
        d = F.lit(step) * F.greatest(F.abs(own), F.lit(1.0))
        at = lambda x: ({**l, by: x}, r) if moved == "l" else (l, {**r, by: x})
        by_axis = lambda x: reduce(lambda a, n: a.when(F.col("axis") == n, f(n, *at(x), h)), range(1, dim), F.when(F.col("axis") == 0, f(0, *at(x), h)))
        return (by_axis(own + d) - by_axis(own - d)) / (2 * d) * area

    cell = lambda side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in CELL))
    inner = found.where("l is not null and r is not null").select(cell("l").alias("l_id"), cell("r").alias("r_id"), change(flux, "l", of("l"), of("r")).alias("dl"), change(flux, "r", of("l"), of("r")).alias("dr"))
    entries = F.inline(F.array(*(F.struct(F.col(a).alias("row"), F.col(b).alias("col"), (F.col(v) * sign).alias("value")) for a, b, v, sign in (("l_id", "l_id", "dl", 1), ("l_id", "r_id", "dr", 1), ("r_id", "l_id", "dl", -1), ("r_id", "r_id", "dr", -1)))))
    parts = [inner.select(entries)]
    if border is not None:
        for side, sign in (("l", 1), ("r", -1)):
            one = found.where(f"{'r' if side == 'l' else 'l'} is null")
            both = lambda f: lambda n, l, r, h: f(n, l, l, h)
            parts.append(one.select(cell(side).alias("row"), cell(side).alias("col"), (change(both(border), "l", of(side), of(side)) * sign).alias("value")))
    if shift:
        parts.append(leaves.select(cell_id().alias("row"), cell_id().alias("col"), (F.lit(float(shift)) * F.pow(h, F.lit(dim))).alias("value")))
    return matrix_sum(*parts)


def newton(field: DataFrame, residual: Callable[[DataFrame], DataFrame], jacobian: Callable[[DataFrame], DataFrame], name: str = "u", tolerance: float = 1e-8, rounds: int = 20, inner: float = 1e-6, **linear) -> DataFrame:
    """The field at which `residual` (level, i, j, k, r) vanishes, all cells at once; an error if it does not converge.

    Each round solves with the Jacobian at the last field, to the tolerance `inner`. residual and jacobian are of one scale (both by volumes, or not).
    """
    field = field.checkpoint()
    first = None
    for _ in range(rounds + 1):
        r = residual(field).checkpoint()
        size = r.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        first = size if first is None else first
        if size <= tolerance**2 * max(first, 1e-300):
            return field
        change = bicgstab(jacobian(field), r.select(cell_id().alias("id"), (-F.col("r")).alias("v")), inner, **linear)
        moved = field.withColumn("id", cell_id()).join(change, "id").withColumn(name, F.col(name) + F.col("v"))
        field = moved.select(*field.columns).checkpoint()
    raise ArithmeticError("Newton's method does not converge")


def newton_by_cell(table: DataFrame, start: str, f: Callable, derivative: Callable, parameters: list[str], rounds: int = 50, tolerance: float = 1e-12) -> DataFrame:
    """Independent Newton iterations, one unknown a cell, vectorised over Arrow batches: f(x, parameters...) = 0 near `start`."""

    @F.pandas_udf("double")
    def run(x0: pd.Series, args: pd.DataFrame) -> pd.Series:
        x, p = x0.to_numpy(float).copy(), [args[c].to_numpy(float) for c in args]
        for _ in range(rounds):
            step = f(x, *p) / derivative(x, *p)
            x -= step
            if np.abs(step).max(initial=0) < tolerance:
                return pd.Series(x)
        raise ArithmeticError("Newton's method does not converge")

    return table.withColumn(start, run(F.col(start).cast("double"), F.struct(*parameters)))


def on_cells(vector: DataFrame, leaves: DataFrame, name: str = "u") -> DataFrame:
    return leaves.select(*CELL, cell_id().alias("id")).join(vector, "id").select(*CELL, F.col("v").alias(name))
