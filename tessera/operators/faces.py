"""Faces of an adapted mesh as one table, and flux schemes whose stencils are all of one level.

Every cell names its faces on its own level, on the next finer one (its sub-faces) and, where it lies on one, on the next coarser
one. Cells that share a face name the same key, so one grouping finds all faces with both sides, jumps and borders among
them, without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL, length
from tessera.functions.prediction import descendant

KEY = ["axis", "level", *AXES]
Place = Callable[[str, Column], Column]


def faces(cells: DataFrame, dim: int, *names: str, place: Place | None = None) -> DataFrame:
    """axis, level, i, j, k of the face (its left cell on the finer side's level), and the cells `l` and `r` beside it.

    l, r: structs of level, i, j, k and the named columns; one of them is null at a border. Equal levels, or one apart (then
    one face for each fine cell). place(axis, index): periodic axes, see Border.inside.
    """
    own = F.struct(*CELL, *names)
    said = []
    for axis in range(dim):
        for side in (0, 1):  # the cell is left of the face, or right of it
            at = {a: F.col(a) - side * (n == axis) for n, a in enumerate(AXES)}
            said.append((axis, side, 0, F.col("level"), at))
            for sub in product((0, 1), repeat=dim - 1):
                rest = iter(sub)
                fine = {a: (F.col(a) * 2 + (1 if not side else -1)) if n == axis else F.col(a) * 2 + next(rest) if n < dim else F.col(a) for n, a in enumerate(AXES)}
                said.append((axis, side, 1, F.col("level") + 1, fine))
            coarse = {a: F.shiftright(F.col(a), 1) - side * (n == axis) if n < dim else F.col(a) for n, a in enumerate(AXES)}
            said.append((axis, side, -1, F.when(F.pmod(F.col(AXES[axis]), F.lit(2)) == 1 - side, F.col("level") - 1), coarse))
    rows = F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(side).alias("side"), F.lit(kind).alias("kind"), level.alias("flevel"), *(x.alias(f"f{a}") for a, x in at.items())) for axis, side, kind, level, at in said))
    each = cells.select(own.alias("own"), F.explode(rows).alias("f")).select("own", "f.*").where("flevel is not null").withColumnsRenamed({"flevel": "level", **{f"f{a}": a for a in AXES}})
    if place is not None:
        each = each.withColumns({a: place(a, F.col(a)) for a in AXES[:dim]})
    of = lambda side, *kinds: F.max(F.when((F.col("side") == side) & F.col("kind").isin(*kinds), F.col("own")))
    is_fine = lambda side: F.max(((F.col("side") == side) & (F.col("kind") == -1)).cast("int"))
    named = each.groupBy(*KEY).agg(of(0, 0, 1).alias("l"), of(1, 0, 1).alias("r"), is_fine(0).alias("fl"), is_fine(1).alias("fr"), F.max((F.col("kind") == 0).cast("int")).alias("own"))
    # Without a cell of the key's own level, or with finer cells on a side, the face is another key's.
    return named.where("own = 1 and fl = 0 and fr = 0").select(*KEY, "l", "r")


def stencils(found: DataFrame, values: DataFrame, size: int, *names: str, place: Place | None = None, dim: int = 2, order: int = 1, finer: int = 0, max_level: int | None = None) -> DataFrame:
    """found with s_<name>: arrays of the `size` values across each face, left to right, all of one level; and `h`, `share`.

    finer = 0: on the face's own level, so that a coarser side is its predicted cells. finer = n (or -1: up to max_level): as
    many levels finer, predicted from the cells around; then a face has a row for each sub-face, each with its `share`.
    values: from ghost_values of radius size / 2, and as many more as the prediction's order for finer = 1, twice as many for
    others; a missing one is an error. The forms are a table of fixed size: 2^(levels * (dim - 1)) rows.
    """
    half = size // 2
    if finer and max_level is None:
        raise ValueError("finer fluxes need max_level")
    delta = F.lit(0) if not finer else F.lit(max_level) - F.col("level") if finer < 0 else F.least(F.lit(finer), F.lit(max_level) - F.col("level"))
    # For each sub-face of a face `d` levels finer, the values across it as forms in cells around (along the axis, then others).
    forms = []
    for d in range(1 if not finer else (max_level if finer < 0 else finer) + 1):
        for sub in product(range(1 << d), repeat=dim - 1):
            forms.append((d, [descendant(order, d, (n - 1 + (1 << d), *sub)) for n in range(1 - half, half + 1)]))
    spots = sorted({cell for _, lines in forms for line in lines for cell in line})
    place_of = {s: n for n, s in enumerate(spots)}
    at = F.posexplode(F.array(*(F.struct(*(F.lit(x).alias(f"s{n}") for n, x in enumerate(s))) for s in spots))).alias("spot", "s")
    asked = found.select(*KEY, at).select(*KEY, "spot", "s.*")

    def moved(n: int, a: str) -> Column:
        others = lambda axis: [x for x in range(dim) if x != axis]
        by = F.lit(0)
        for axis in range(dim):
            by = F.when(F.col("axis") == axis, F.col("s0") if n == axis else F.col(f"s{1 + others(axis).index(n)}") if n < dim else F.lit(0)).otherwise(by)
        return F.col(a) + by if place is None else place(a, F.col(a) + by)

    asked = asked.withColumns({f"n{a}": moved(n, a) for n, a in enumerate(AXES)})
    source = values.select("level", *(F.col(a).alias(f"n{a}") for a in AXES), *(F.col(c).alias(f"v_{c}") for c in names))
    got = asked.join(source, ["level", *(f"n{a}" for a in AXES)], "left")
    arrays = got.groupBy(*KEY).agg(*(F.transform(F.sort_array(F.collect_list(F.struct("spot", F.col(f"v_{c}").alias("v")))), lambda x: x["v"]).alias(f"v_{c}") for c in names))
    out = found.join(arrays, KEY).withColumn("delta", delta)
    if not finer:
        checked = lambda c: F.when(F.exists(f"v_{c}", lambda x: x.isNull()), F.raise_error(F.lit("a value of a stencil is missing")).cast("array<double>")).otherwise(F.col(f"v_{c}"))
        return out.select(*found.columns, *(checked(c).alias(f"s_{c}") for c in names), length(F.col("level")).alias("h"), F.lit(1.0).alias("share"))
    rows = [(d, [[float(line.get(cell, 0)) for cell in spots] for line in lines]) for d, lines in forms]
    joined = out.join(F.broadcast(found.sparkSession.createDataFrame(rows, "delta int, w array<array<double>>")), "delta")

    def predicted(c: str) -> Column:
        # A value that has weight must be there; those without may be missing.
        value = lambda line: F.aggregate(F.zip_with(F.col(f"v_{c}"), line, lambda v, w: F.when(w != 0, F.when(v.isNull(), F.raise_error(F.lit("a value of a stencil is missing")).cast("double")).otherwise(v * w)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        return F.transform("w", value)

    return joined.select(*found.columns, *(predicted(c).alias(f"s_{c}") for c in names), (length(F.col("level")) / F.pow(F.lit(2.0), F.col("delta"))).alias("h"), F.pow(F.lit(0.5), F.lit(dim - 1) * F.col("delta")).alias("share"))


@dataclass(frozen=True)
class WideFlux:
    """A flux through a face: inputs(axis, values by name from left to right, h) gives Columns, value(inputs) the flux.

    Inputs become columns before the flux is made from them, so that a long formula holds each of them by name only.
    """

    inputs: Callable[[int, dict[str, list[Column]], Column], list[Column]]
    value: Callable[[list[Column]], Column] = lambda x: x[0]


def divergence_of(stencil: DataFrame, dim: int, size: int, names: list[str], fluxes: dict[str, WideFlux], borders: bool = True) -> DataFrame:
    """Sums of outward fluxes over cell volumes, for each result name: (level, i, j, k, results). Both sides of a face get the
    same flux. borders: whether faces with one cell count (their stencils then reach the ghosts outside)."""
    values = {c: [F.element_at(f"s_{c}", n + 1) for n in range(size)] for c in names}
    area = F.pow(length(F.col("level")), F.lit(dim - 1)) * F.col("share")
    given: dict[str, Column] = {}
    parts: dict[str, list[str]] = {}
    for result, flux in fluxes.items():
        for n, by_axis in enumerate(zip(*(flux.inputs(axis, values, F.col("h")) for axis in range(dim)))):
            picked = F.lit(None).cast("double")
            for axis, x in enumerate(by_axis):
                picked = F.when(F.col("axis") == axis, x).otherwise(picked)
            given[f"{result}_in{n}"] = picked
            parts.setdefault(result, []).append(f"{result}_in{n}")
    out = list(fluxes)
    stencil = stencil.withColumns(given)
    stencil = stencil.select(F.col("l").alias("left"), F.col("r").alias("right"), *((flux.value([F.col(c) for c in parts[r]]) * area).alias(r) for r, flux in fluxes.items()))
    rows = stencil if borders else stencil.where("left is not null and right is not null")
    sides = F.inline(F.array(*(F.struct(F.col(s).alias("cell"), *((F.col(r) * sign).alias(r) for r in out)) for s, sign in (("left", 1.0), ("right", -1.0)))))
    each = rows.select(sides).where("cell is not null").select(*(f"cell.{c}" for c in CELL), *out)
    total = each.groupBy(*CELL).agg(*(F.sum(r).alias(r) for r in out))
    return total.select(*CELL, *((F.col(r) / F.pow(length(F.col("level")), F.lit(dim))).alias(r) for r in out))
