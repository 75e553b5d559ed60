"""Finite-volume schemes: fluxes through faces, joined to values and summed on cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fluxes
from tessera.functions.levels import CELL, length
from tessera.functions.stencils import line

from . import faces
from .mesh import boundary_faces, moved, stencil_values

#: flux(axis, left, right, h): a Column of the values of both sides (by name) and the finer cell's side.
Flux = Callable[[int, dict[str, Column], dict[str, Column], Column], Column]


def face_values(leaves: DataFrame, field: DataFrame, dim: int, *names: str) -> DataFrame:
    """Faces between two leaves: axis, level, l and r cells (l_level, ...), l_<name> and r_<name>; the values come along."""
    cells = field.select(*CELL, *names) if leaves is field else field.select(*CELL, *names).join(leaves.select(*CELL), CELL, "left_semi")
    found = faces.faces(cells, dim, *names).where("l is not null and r is not null")
    return found.select("axis", "level", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in (*CELL, *names)))


def flux_scheme(leaves: DataFrame, field: DataFrame, dim: int, flux: Flux, *names: str, border: Flux | None = None, area: DataFrame | None = None) -> DataFrame:
    """Sum of outward fluxes times face areas over cell volumes, on each leaf: (level, i, j, k, r).

    A face one level apart counts once for each fine cell, with the fine area. `border` gives the flux through the faces
    on the border of `area` from the inner value (as both sides); without it nothing passes there.
    """
    of = lambda side: {n: F.col(f"{side}_{n}") for n in names}
    faces = face_values(leaves, field, dim, *names)
    value = reduce(lambda a, b: a.when(F.col("axis") == b, flux(b, of("l"), of("r"), length(F.col("level")))), range(1, dim), F.when(F.col("axis") == 0, flux(0, of("l"), of("r"), length(F.col("level")))))
    through = faces.withColumn("q", value * F.pow(length(F.col("level")), F.lit(dim - 1)))
    sides = [through.select(*(F.col(f"{s}_{c}").alias(c) for c in CELL), (F.col("q") * sign).alias("q")) for s, sign in (("l", 1), ("r", -1))]
    if border is not None and area is not None:
        edge = boundary_faces(leaves, area, dim).join(field, CELL)
        own = {n: F.col(n) for n in names}
        out = reduce(lambda a, b: a.when(F.col("axis") == b, border(b, own, own, length(F.col("level")))), range(1, dim), F.when(F.col("axis") == 0, border(0, own, own, length(F.col("level")))))
        sides.append(edge.select(*CELL, (out * F.col("side") * F.pow(length(F.col("level")), F.lit(dim - 1))).alias("q")))
    total = reduce(DataFrame.unionByName, sides).groupBy(*CELL).agg(F.sum("q").alias("q"))
    return leaves.select(*CELL).join(total, CELL, "left").select(*CELL, (F.coalesce("q", F.lit(0.0)) / F.pow(length(F.col("level")), F.lit(dim))).alias("r"))


def convection_upwind(leaves: DataFrame, field: DataFrame, velocity: list[float], name: str = "u", **border) -> DataFrame:
    """Divergence of velocity times u, upwind."""
    return flux_scheme(leaves, field, len(velocity), lambda d, l, r, h: fluxes.upwind(velocity[d], l[name], r[name]), name, **border)


def convection_upwind_field(leaves: DataFrame, field: DataFrame, velocity: list[str], name: str = "u", **border) -> DataFrame:
    """The same with velocity columns; a face takes the mean of both sides."""
    return flux_scheme(leaves, field, len(velocity), lambda d, l, r, h: fluxes.upwind((l[velocity[d]] + r[velocity[d]]) / 2, l[name], r[name]), name, *velocity, **border)


def burgers_upwind(leaves: DataFrame, field: DataFrame, dim: int, name: str = "u", **border) -> DataFrame:
    return flux_scheme(leaves, field, dim, lambda d, l, r, h: fluxes.upwind_burgers(l[name], r[name]), name, **border)


def convection_rusanov(leaves: DataFrame, field: DataFrame, velocity: list[str], name: str = "u", eps: float = 1e-6, **border) -> DataFrame:
    return flux_scheme(leaves, field, len(velocity), lambda d, l, r, h: fluxes.smooth_rusanov((l[velocity[d]] + r[velocity[d]]) / 2, l[name], r[name], eps), name, *velocity, **border)


def convection_nonlinear(leaves: DataFrame, field: DataFrame, dim: int, *names: str, kind: str = "upwind", **border) -> DataFrame:
    """Divergence of u times u: r for one name (a scalar, flux u * u on every axis), r_<name> for the components of a vector.

    kind: "upwind" (the side is chosen by the mean of the axis's component) or "rusanov" (smooth speed of that mean).
    """

    def flux(name):
        def through(d, l, r, h):
            a, b = l[names[d if len(names) > 1 else 0]], r[names[d if len(names) > 1 else 0]]
            mean = (a + b) / 2
            if kind == "upwind":
                return F.when(mean >= 0, a * l[name]).otherwise(b * r[name])
            return (a * l[name] + b * r[name] - fluxes.smooth_abs(mean) * (r[name] - l[name])) / 2

        return through

    parts = [flux_scheme(leaves, field, dim, flux(n), *names, **({**border, "border": flux(n)} if border else {})) for n in names]
    if len(names) == 1:
        return parts[0]
    return reduce(lambda a, b: a.join(b, CELL), [p.withColumnRenamed("r", f"r_{n}") for p, n in zip(parts, names)])


def diffusion(leaves: DataFrame, field: DataFrame, dim: int, k: float | list[float] | str = 1.0, name: str = "u", **border) -> DataFrame:
    """-div(k grad u) of second order; k: a number, one for each axis, or a column (harmonic means on faces)."""
    own = [k] if isinstance(k, str) else []

    def flux(d, l, r, h):
        c = 2 * l[k] * r[k] / (l[k] + r[k]) if own else F.lit(float(k[d] if isinstance(k, list) else k))
        return -c * (r[name] - l[name]) / h

    return flux_scheme(leaves, field, dim, flux, name, *own, **border)


def multi_diffusion(leaves: DataFrame, field: DataFrame, dim: int, k: dict[str, float], **border) -> DataFrame:
    """Diffusion of several fields, each with its own coefficient."""
    parts = [diffusion(leaves, field, dim, c, n, **border).withColumnRenamed("r", f"r_{n}") for n, c in k.items()]
    return reduce(lambda a, b: a.join(b, CELL), parts)


def laplacian(leaves: DataFrame, field: DataFrame, dim: int, name: str = "u", **border) -> DataFrame:
    return scaled(diffusion(leaves, field, dim, 1.0, name, **border), -1.0)


def gradient(leaves: DataFrame, field: DataFrame, dim: int, name: str = "u", **border) -> DataFrame:
    """Means on faces, summed outwards along each axis: r_0, r_1, ..."""
    only = lambda a: lambda d, l, r, h: (l[name] + r[name]) / 2 if d == a else F.lit(0.0)
    parts = [flux_scheme(leaves, field, dim, only(a), name, **({**border, "border": only(a)} if border else {})).withColumnRenamed("r", f"r_{a}") for a in range(dim)]
    return reduce(lambda a, b: a.join(b, CELL), parts)


def divergence(leaves: DataFrame, field: DataFrame, names: list[str], **border) -> DataFrame:
    return flux_scheme(leaves, field, len(names), lambda d, l, r, h: (l[names[d]] + r[names[d]]) / 2, *names, **border)


def on_all_levels(leaves: DataFrame, values: DataFrame, dim: int, size: int, names: list[str], fluxes: dict[str, faces.WideFlux], place: faces.Place | None = None, borders: bool = True, **finer) -> DataFrame:
    """Divergences of fluxes with `size` values of one level across each face: those of a coarser side are predicted.

    values: all ghosts too (ghost_values of radius size / 2; finer fluxes need one more for each order of prediction). finer,
    max_level, order: see faces.stencils. (level, i, j, k, results) on the leaves.
    """
    found = faces.faces(leaves.select(*CELL), dim, place=place)
    return faces.divergence_of(faces.stencils(found, values, size, *names, place=place, dim=dim, **finer), dim, size, names, fluxes, borders)


def upwind_flux(velocity: list[float], name: str = "u") -> faces.WideFlux:
    return faces.WideFlux(lambda d, s, h: [fluxes.upwind(velocity[d], s[name][0], s[name][1])])


def diffusion_flux(k: float, name: str = "u") -> faces.WideFlux:
    return faces.WideFlux(lambda d, s, h: [-k * (s[name][1] - s[name][0]) / h])


def _picked(mean: Column, values: list[Column]) -> list[Column]:
    """The five of six values that an upwind fifth-order flux reads, first those behind."""
    return [F.when(mean >= 0, values[n]).otherwise(values[5 - n]) for n in range(5)]


def weno5_flux(velocity: list[float], name: str = "u") -> faces.WideFlux:
    """Of size 6: the side is chosen by the sign of the axis's velocity."""
    return faces.WideFlux(lambda d, s, h: [*(s[name][:5] if velocity[d] >= 0 else s[name][:0:-1]), F.lit(float(velocity[d]))], lambda x: fluxes.weno5(*x[:5]) * x[5])


def weno5_field_flux(velocity: list[str], name: str = "u") -> faces.WideFlux:
    """With velocity columns: a face takes the mean of the two cells beside it."""

    def inputs(d, s, h):
        mean = (s[velocity[d]][2] + s[velocity[d]][3]) / 2
        return [*_picked(mean, s[name]), mean]

    return faces.WideFlux(inputs, lambda x: fluxes.weno5(*x[:5]) * x[5])


def weno5_nonlinear_flux(names: list[str], name: str) -> faces.WideFlux:
    """u times u: of the axis's component (or the only one) and `name`; upwind by that component's mean."""

    def inputs(d, s, h):
        own = s[names[d if len(names) > 1 else 0]]
        return _picked((own[2] + own[3]) / 2, [a * b for a, b in zip(own, s[name])])

    return faces.WideFlux(inputs, lambda x: fluxes.weno5(*x))


def convection_weno5(field: DataFrame, velocity: list[float], name: str = "u") -> DataFrame:
    """Divergence of velocity times u by fifth-order faces, on the cells of one uniform level that have three neighbours each way."""
    total, cells = None, field.select(*CELL)
    for d, v in enumerate(velocity):
        around = stencil_values(field, cells, line(3, d, *range(-3, 4)), name)
        u = [F.col(f"u_{n}") for n in range(7)]
        face = (lambda n: fluxes.weno5(*u[n - 2 : n + 3])) if v >= 0 else (lambda n: fluxes.weno5(*u[n - 1 : n + 4][::-1]))
        part = around.where(reduce(lambda a, b: a & b, [x.isNotNull() for x in u])).select(*CELL, ((face(3) - face(2)) * v / length(F.col("level"))).alias(f"r{d}"))
        total = part if total is None else total.join(part, CELL)
    return total.select(*CELL, reduce(lambda a, b: a + b, [F.col(f"r{d}") for d in range(len(velocity))]).alias("r"))


def _weno_divergence(field: DataFrame, dim: int, speed: list[str], values: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Differences of fifth-order fluxes; a face's side is chosen by the mean of the axis's speed in both cells.

    values(u, mean): the flux of one cell of the stencil. On the cells of one uniform level with three neighbours each way.
    """
    parts = []
    for d in range(dim):
        around = stencil_values(field, field, line(3, d, *range(-3, 4)), name)
        if speed[d] == name:
            v = [F.col(f"u_{n}") for n in (2, 3, 4)]
        else:
            fast = stencil_values(field, field, line(3, d, -1, 0, 1), speed[d])
            around = around.join(fast.select(*CELL, *(F.col(f"u_{n}").alias(f"v_{n}") for n in range(3))), CELL)
            v = [F.col(f"v_{n}") for n in range(3)]
        u = [F.col(f"u_{n}") for n in range(7)]
        mean = {n: (v[n - 2] + v[n - 1]) / 2 for n in (2, 3)}
        # The side is chosen first, in columns of their own: one face then is one short expression.
        picked = [F.when(mean[n] >= 0, values(u[n - 2 + k], mean[n])).otherwise(values(u[n + 3 - k], mean[n])).alias(f"f{n}{k}") for n in (2, 3) for k in range(5)]
        whole = around.where(reduce(lambda a, b: a & b, [x.isNotNull() for x in u])).select(*CELL, *picked)
        right, left = (fluxes.weno5(*(F.col(f"f{n}{k}") for k in range(5))) for n in (3, 2))
        parts.append(whole.select(*CELL, ((right - left) / length(F.col("level"))).alias(f"r{d}")))
    total = reduce(lambda a, b: a.join(b, CELL), parts)
    return total.select(*CELL, reduce(lambda a, b: a + b, [F.col(f"r{d}") for d in range(dim)]).alias("r"))


def convection_weno5_field(field: DataFrame, velocity: list[str], name: str = "u") -> DataFrame:
    """convection_weno5 with velocity columns; a face takes the mean of both sides."""
    return _weno_divergence(field, len(velocity), velocity, lambda u, mean: u * mean, name)


def convection_weno5_nonlinear(field: DataFrame, dim: int, name: str = "u") -> DataFrame:
    """Divergence of u * u by fifth-order faces."""
    return _weno_divergence(field, dim, [name] * dim, lambda u, mean: u * u, name)


def upwind_scalar_burgers(field: DataFrame, ghosts: DataFrame, speed: list[float], name: str = "u") -> DataFrame:
    """The difference of Burgers' fluxes on one level; ghosts give the values outside."""
    values, total = field.select(*CELL, name).unionByName(ghosts.select(*CELL, name)), F.lit(0.0)
    out = field.select(*CELL, F.col(name).alias("own"))
    for d, a in enumerate(speed):
        for side, by in (("b", 1), ("a", -1)):
            step = tuple(by * int(x == d) for x in range(3))
            out = out.join(moved(values, step).select(*CELL, F.col(name).alias(f"{side}{d}")), CELL)
        through = fluxes.godunov_burgers(a, F.col("own"), F.col(f"a{d}")) - fluxes.godunov_burgers(a, F.col(f"b{d}"), F.col("own"))
        total = total + through / length(F.col("level"))
    return out.select(*CELL, total.alias("r"))


def identity(field: DataFrame, name: str = "u") -> DataFrame:
    return field.select(*CELL, F.col(name).alias("r"))


def zero(field: DataFrame) -> DataFrame:
    return field.select(*CELL, F.lit(0.0).alias("r"))


def buoyancy(field: DataFrame, dim: int, name: str = "u") -> DataFrame:
    """A scalar as the last component of a vector."""
    return field.select(*CELL, *((F.col(name) if a == dim - 1 else F.lit(0.0)).alias(f"r_{a}") for a in range(dim)))


def cell_scheme(field: DataFrame, cells: DataFrame, stencil: list, value: Callable[[list[Column]], Column], name: str = "u") -> DataFrame:
    """A value for each cell from those around it (null where there is none)."""
    return stencil_values(field, cells, stencil, name).select(*CELL, value([F.col(f"u_{n}") for n in range(len(stencil))]).alias("r"))


def scaled(result: DataFrame, by: float) -> DataFrame:
    return result.select(*CELL, (F.col("r") * by).alias("r"))


def operator_sum(*results: DataFrame) -> DataFrame:
    """The sum of schemes' results."""
    return reduce(DataFrame.unionByName, results).groupBy(*CELL).agg(F.sum("r").alias("r"))


def explicit_step(field: DataFrame, result: DataFrame, dt: float, name: str = "u") -> DataFrame:
    """u - dt r."""
    return field.join(result, CELL).select(*CELL, (F.col(name) - dt * F.col("r")).alias(name))


def upwind_expression(field: DataFrame, ghosts: DataFrame, velocity: list[float], name: str = "u") -> DataFrame:
    """The upwind difference as an expression of shifted fields on one level; ghosts give the values outside."""
    values = field.select(*CELL, name).unionByName(ghosts.select(*CELL, name))
    out = field.select(*CELL, F.col(name).alias("own"))
    total = F.lit(0.0)
    for d, v in enumerate(velocity):
        step = tuple((1 if v >= 0 else -1) * int(a == d) for a in range(3))
        out = out.join(moved(values, step).select(*CELL, F.col(name).alias(f"n{d}")), CELL)
        total = total + F.lit(abs(v)) * (F.col("own") - F.col(f"n{d}")) / length(F.col("level"))
    return out.select(*CELL, total.alias("r"))
