"""Ghost values outside a domain from conditions on its border."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL, length
from tessera.functions.stencils import Offset

from .mesh import boundary


def lagrange(points: list[float], at: float) -> list[float]:
    """Weights that give a polynomial through `points` its value at a place."""
    out = []
    for n, p in enumerate(points):
        w = 1.0
        for m, q in enumerate(points):
            if m != n:
                w *= (at - q) / (p - q)
        out.append(w)
    return out


def _inner(field: DataFrame, edge: DataFrame, direction: Offset, depth: int, name: str) -> DataFrame:
    """edge with the values v_0 (the border cell), v_1, ... inwards; a missing one is an error."""
    out = edge.select(*CELL)
    for n in range(depth):
        source = field.select("level", *((F.col(a) + n * d).alias(a) for a, d in zip(AXES, direction)), F.col(name).alias(f"v_{n}"))
        out = out.join(source, CELL, "left").withColumn(f"v_{n}", F.when(F.col(f"v_{n}").isNull(), F.raise_error(F.lit("a cell inside the border is missing"))).otherwise(F.col(f"v_{n}")))
    return out


def _ghosts(df: DataFrame, direction: Offset, layers: list[Column], name: str) -> DataFrame:
    parts = [df.select("level", *((F.col(a) + (n + 1) * d).alias(a) for a, d in zip(AXES, direction)), v.alias(name)) for n, v in enumerate(layers)]
    return reduce(DataFrame.unionByName, parts)


def dirichlet(field: DataFrame, area: DataFrame, direction: Offset, value: Column | float, order: int = 1, name: str = "u", region: Column | None = None) -> DataFrame:
    """`order` ghost layers by the polynomial through `order` inner cells and the border value (order 1: twice the value less the cell)."""
    edge = boundary(field.select(*CELL), area, direction)
    edge = edge if region is None else edge.where(region)
    inner = _inner(field, edge, direction, order, name)
    v = value if isinstance(value, Column) else F.lit(float(value))
    points = [0.5, *(-float(n) for n in range(order))]
    layers = []
    for n in range(1, order + 1):
        w = lagrange(points, float(n))
        layers.append(reduce(lambda a, b: a + b, [v * w[0], *(F.col(f"v_{m}") * w[m + 1] for m in range(order))]))
    return _ghosts(inner, direction, layers, name)


def neumann(field: DataFrame, area: DataFrame, direction: Offset, slope: Column | float = 0.0, name: str = "u", region: Column | None = None) -> DataFrame:
    """One ghost layer: the border cell plus a cell's side times the outward slope."""
    edge = boundary(field.select(*CELL), area, direction)
    edge = edge if region is None else edge.where(region)
    g = slope if isinstance(slope, Column) else F.lit(float(slope))
    return _ghosts(_inner(field, edge, direction, 1, name), direction, [F.col("v_0") + length(F.col("level")) * g], name)


def extrapolate(field: DataFrame, edge: DataFrame, direction: Offset, cells: int = 1, layers: int = 1, name: str = "u") -> DataFrame:
    """Ghost layers by the polynomial through the `cells` last values inwards (also along diagonals, for corners).

    Layer by layer: each new one is part of what the next reads.
    """
    known, out = field.select(*CELL, name), None
    w = lagrange([-float(n) for n in range(cells)], 1.0)
    for _ in range(layers):
        new = _ghosts(_inner(known, edge, direction, cells, name), direction, [reduce(lambda a, b: a + b, [F.col(f"v_{m}") * w[m] for m in range(cells)])], name)
        out = new if out is None else out.unionByName(new)
        known = known.unionByName(new)
        edge = new.select(*CELL)
    return out


def _on_level(x: int, level: int) -> Column:
    """An index of one level on the level of each row, coarser or finer."""
    return F.floor(F.lit(x) * F.pow(F.lit(2.0), F.col("level") - level)).cast("int")


def periodic(field: DataFrame, extent: dict[str, tuple[int, int]], level: int, width: int, *names: str) -> DataFrame:
    """Ghosts beyond both ends of each axis in `extent` (low, high on `level`): copies from the opposite side."""
    whole = field.select(*CELL, *names)
    for axis, (low, high) in extent.items():
        first, end = _on_level(low, level), _on_level(high, level)
        after = whole.where(F.col(axis) < first + width).withColumn(axis, F.col(axis) + end - first)
        before = whole.where(F.col(axis) >= end - width).withColumn(axis, F.col(axis) + first - end)
        whole = whole.unionByName(after).unionByName(before)
    return whole.join(field.select(*CELL), CELL, "left_anti")


def periodic_tags(tags: DataFrame, extent: dict[str, tuple[int, int]], level: int) -> DataFrame:
    """Tags of cells, ghosts among them: cells that are images of one another on periodic axes get each other's flags.

    extent: low and high of each periodic axis on `level`. One aggregation by the image inside.
    """
    inside = []
    for a in AXES:
        if a not in extent:
            inside.append(F.col(a))
            continue
        low, high = (_on_level(x, level) for x in extent[a])
        inside.append(F.pmod(F.col(a) - low, high - low) + low)
    named = tags.select(*CELL, "tag", *(x.alias(f"in_{a}") for x, a in zip(inside, AXES)))
    key = ["level", *(f"in_{a}" for a in AXES)]
    flags = named.groupBy(*key).agg(F.bit_or("tag").alias("flags"))
    return named.join(flags, key).select(*CELL, F.col("flags").alias("tag"))


def bounce_back(field: DataFrame, area: DataFrame, direction: Offset, opposite: dict[str, str], sign: int = 1) -> DataFrame:
    """Wall ghosts: each distribution takes its opposite's value in the border cell (sign -1: anti bounce back)."""
    edge = field.join(boundary(field.select(*CELL), area, direction), CELL, "left_semi")
    return edge.select("level", *((F.col(a) + d).alias(a) for a, d in zip(AXES, direction)), *((F.col(o) * sign).alias(n) for n, o in opposite.items()))


Condition = Callable[[DataFrame, DataFrame, Offset], DataFrame]


def with_conditions(field: DataFrame, area: DataFrame, conditions: list[tuple[list[Offset], Condition]]) -> DataFrame:
    """The field and the ghosts of all conditions; each is a function of (field, area, direction), so users add their own."""
    return reduce(DataFrame.unionByName, [bc(field, area, d) for directions, bc in conditions for d in directions], field)
