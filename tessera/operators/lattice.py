"""Lattice Boltzmann schemes: distributions move with their velocities, then relax towards equilibrium."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from itertools import product
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL
from tessera.functions.prediction import descendant


@dataclass(frozen=True)
class Scheme:
    """velocities: integer steps; moments: the matrix M; relax: a rate for each moment; equilibrium: moments -> equilibrium moments."""

    velocities: list[tuple[int, ...]]
    moments: list[list[float]]
    relax: list[float]
    equilibrium: Callable[[list[Column]], list[Column]]

    @property
    def names(self) -> list[str]:
        return [f"f{n}" for n in range(len(self.velocities))]


def _times(matrix, columns: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, [c * float(w) for w, c in zip(row, columns)]) for row in matrix]


def stream(field: DataFrame, scheme: Scheme, ghosts: DataFrame | None = None) -> DataFrame:
    """Each distribution of a cell comes from the cell that its velocity points from; a missing one is an error.

    All distributions move in one exchange: every row sends each of its values to one cell, and cells collect them.
    """
    source = field if ghosts is None else field.unionByName(ghosts)
    sent = F.array(*(F.struct(F.lit(n).alias("n"), *((F.col(a) + (v[d] if d < len(v) else 0)).alias(a) for d, a in enumerate(AXES)), F.col(f"f{n}").alias("f")) for n, v in enumerate(scheme.velocities)))
    got = source.select("level", F.inline(sent)).groupBy(*CELL).agg(*(F.max(F.when(F.col("n") == n, F.col("f"))).alias(name) for n, name in enumerate(scheme.names)))
    whole = field.select(*CELL).join(got, CELL, "left")
    return whole.select(*CELL, *(F.when(F.col(n).isNull(), F.raise_error(F.lit("a cell to stream from is missing"))).otherwise(F.col(n)).alias(n) for n in scheme.names))


def transport(order: int, delta: int, velocity: tuple[int, ...]) -> dict[tuple[int, ...], float]:
    """The linear form, in cells around one, of its mean after a step of `velocity` finest cells, `delta` levels below.

    The mean of the reconstructed values of its finest cells, each moved back by the velocity. Prediction is a product over the
    axes, and so is this: 2^delta terms an axis, not 2^(delta * dim).
    """
    lines = []
    for c in velocity:
        line: dict[int, Fraction] = {}
        for x in range(1 << delta):
            for (cell,), w in descendant(order, delta, (x - c,)).items():
                line[cell] = line.get(cell, Fraction(0)) + w / (1 << delta)
        lines.append({x: w for x, w in line.items() if w})
    return {tuple(x for x, _ in at): float(prod((w for _, w in at), start=Fraction(1))) for at in product(*(line.items() for line in lines))}


def stream_levels(field: DataFrame, values: DataFrame, scheme: Scheme, max_level: int, order: int = 1, place: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """Streaming on leaves of any level, in steps of the finest one; a missing value is an error.

    values: the distributions with all their ghosts (ghost_values, as wide as the fastest velocity plus the prediction's
    radius). One table of transport forms by level and velocity, one join with the values, one sum by cell.
    """
    dim = len(scheme.velocities[0])
    spark = field.sparkSession
    levels = [r.level for r in field.select("level").distinct().collect()]  # a few numbers
    rows = [(m, n, *(*cell, 0, 0)[:3], w) for m in levels for n, v in enumerate(scheme.velocities) for cell, w in transport(order, max_level - m, tuple(v[:dim])).items()]
    by_cell: dict[tuple, list[float]] = {}
    for m, n, i, j, k, w in rows:
        by_cell.setdefault((m, i, j, k), [0.0] * len(scheme.velocities))[n] += w
    forms = spark.createDataFrame([(*key, w) for key, w in by_cell.items()], "level int, oi int, oj int, ok int, w array<double>")
    at = field.select(*CELL).join(F.broadcast(forms), "level")
    at = at.withColumns({f"n{a}": F.col(a) + F.col(f"o{a}") if place is None else place(a, F.col(a) + F.col(f"o{a}")) for a in AXES})
    source = values.select("level", *(F.col(a).alias(f"n{a}") for a in AXES), *scheme.names)
    got = at.join(source, ["level", *(f"n{a}" for a in AXES)], "left")
    weight = lambda n: F.element_at("w", n + 1)
    part = lambda n: F.when(weight(n) == 0, 0.0).when(F.col(f"f{n}").isNull(), F.raise_error(F.lit("a value to stream from is missing")).cast("double")).otherwise(weight(n) * F.col(f"f{n}"))
    return got.groupBy(*CELL).agg(*(F.sum(part(n)).alias(name) for n, name in enumerate(scheme.names)))


def collide(field: DataFrame, scheme: Scheme) -> DataFrame:
    """m = M f; m += s (m_eq - m); f = M^-1 m, within each row."""
    m = _times(scheme.moments, [F.col(n) for n in scheme.names])
    new = [x + (e - x) * float(s) for x, e, s in zip(m, scheme.equilibrium(m), scheme.relax)]
    return field.select(*CELL, *(c.alias(n) for c, n in zip(_times(np.linalg.inv(np.array(scheme.moments)), new), scheme.names)))


def at_equilibrium(cells: DataFrame, scheme: Scheme, moments: list[Column]) -> DataFrame:
    """Distributions at equilibrium for given moments."""
    return cells.select(*CELL, *(c.alias(n) for c, n in zip(_times(np.linalg.inv(np.array(scheme.moments)), scheme.equilibrium(moments)), scheme.names)))


def step(field: DataFrame, scheme: Scheme, ghosts: DataFrame | None = None) -> DataFrame:
    return collide(stream(field, scheme, ghosts), scheme)
