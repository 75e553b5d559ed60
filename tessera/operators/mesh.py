"""Meshes: leaf cells (level, i, j, k) of different levels that tile a domain, and the tables derived from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL, centre, down, length
from tessera.functions.stencils import Offset, box, children, diagonals, directions, star

from .faces import faces
from .intervals import deal


@dataclass(frozen=True)
class Config:
    """Options of a mesh and of its adaptation."""

    dim: int = 2
    min_level: int = 0
    max_level: int = 6
    stencil_radius: int = 1
    prediction_order: int = 1
    graduation_width: int = 1
    epsilon: float = 1e-4
    regularity: float = 1.0
    periodic: tuple[bool, bool, bool] = (False, False, False)


def moved(df: DataFrame, by: Offset) -> DataFrame:
    return df.withColumns({a: F.col(a) + s for a, s in zip(AXES, by) if s})


def neighbourhood(cells: DataFrame, offsets: list[Offset]) -> DataFrame:
    """Each row once for each offset, with columns di, dj, dk and the neighbour's ni, nj, nk."""
    each = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{a}") for a, x in zip(AXES, o))) for o in offsets))).alias("o")
    return cells.select("*", each).select("*", "o.*").drop("o").withColumns({f"n{a}": F.col(a) + F.col(f"d{a}") for a in AXES})


def cells_of_boxes(spark: SparkSession, level: int, boxes: list[tuple[tuple[int, ...], tuple[int, ...]]]) -> DataFrame:
    """Cells that lie in any of the integer boxes (low, high)."""
    rows = [(level, *(*low, 0, 0)[:3], *(*high, 1, 1)[:3]) for low, high in boxes if all(a < b for a, b in zip(low, high))]
    df = spark.createDataFrame(rows, "level int, i0 int, j0 int, k0 int, i1 int, j1 int, k1 int")
    for a in AXES:
        df = df.withColumn(a, F.explode(F.sequence(f"{a}0", F.col(f"{a}1") - 1)))
    return df.select(*CELL).distinct()


def domain(spark: SparkSession, level: int, added: list, removed: list = ()) -> DataFrame:
    """Cells of the added boxes without those of the removed ones."""
    cells = cells_of_boxes(spark, level, list(added))
    return cells.join(cells_of_boxes(spark, level, list(removed)), CELL, "left_anti") if removed else cells


def largest_subdivision(lengths: list[int]) -> int:
    """The longest cell side that divides all these lengths."""
    return reduce(gcd, lengths)


def approximate_box(low: list[float], high: list[float], tolerance: float = 0.05, subdivision: float = 0.0) -> tuple[list[float], list[float], float]:
    """A box near (low, high) that whole cells fill, and the cells' side: the shortest edge, halved until each edge is within tolerance."""
    edges = [b - a for a, b in zip(low, high)]
    side = subdivision or min(edges)
    while not subdivision and any(abs(round(e / side) * side - e) > tolerance * e for e in edges):
        side /= 2
    return list(low), [a + max(1, round(e / side)) * side for a, e in zip(low, edges)], side


def ancestors(leaves: DataFrame, min_level: int = 0) -> DataFrame:
    """All proper ancestors of the leaves, down to min_level; no loop over levels."""
    at = leaves.where(F.col("level") > min_level).select(*CELL, F.explode(F.sequence(F.lit(min_level), F.col("level") - 1)).alias("up"))
    return at.select(F.col("up").alias("level"), *(down(a, F.col("level") - F.col("up")).alias(a) for a in AXES)).distinct()


def pyramid(cells: DataFrame, levels: range, dim: int, rows: int | None = None) -> DataFrame:
    """Cells of one level on every level: those touched on coarser ones, all descendants on finer ones. rows: about how many cells
    there are, where that is known; they are then dealt out before repeated ones are found, so no task gathers those of a long input."""
    own = cells.agg(F.max("level")).first()[0]
    if own is None:
        return cells
    up = cells.select(*CELL, F.explode(F.array(*(F.lit(x) for x in levels if x <= own))).alias("to")).select(F.col("to").alias("level"), *(down(a, F.col("level") - F.col("to")).alias(a) for a in AXES)) if min(levels) <= own else cells.limit(0)
    up = deal(up, rows and rows * sum(x <= own for x in levels), *AXES[:dim]).distinct()
    fine = [x for x in levels if x > own]
    return reduce(DataFrame.unionByName, [refine(cells, x - own, dim) for x in fine], up)


def refine(cells: DataFrame, steps: int, dim: int) -> DataFrame:
    """All descendants `steps` levels down."""
    out = cells.select((F.col("level") + steps).alias("level"), *AXES)
    for a in AXES[:dim]:
        out = out.withColumn(a, F.explode(F.sequence(F.shiftleft(a, steps), F.shiftleft(F.col(a) + 1, steps) - 1)))
    return out.select(*CELL)


def parents(cells: DataFrame) -> DataFrame:
    return cells.select((F.col("level") - 1).alias("level"), *(F.shiftright(a, 1).alias(a) for a in AXES)).distinct()


def boundary(cells: DataFrame, area: DataFrame, direction: Offset, width: int = 1) -> DataFrame:
    """Cells within `width` of the border of `area` (cells on the same levels) in a direction."""
    inner = [moved(area, tuple(-w * d for d in direction)).select(*CELL) for w in range(1, width + 1)]
    return reduce(DataFrame.unionByName, [cells.join(x, CELL, "left_anti") for x in inner]).distinct() if width > 1 else cells.join(inner[0], CELL, "left_anti")


def outer_layer(area: DataFrame, direction: Offset, width: int = 1) -> DataFrame:
    """The ring of cells outside `area` in a direction."""
    edge = boundary(area, area, direction)
    return reduce(DataFrame.unionByName, [moved(edge, tuple(w * d for d in direction)) for w in range(1, width + 1)]).select(*CELL).distinct()


def corners(area: DataFrame, dim: int) -> DataFrame:
    """Cells at a corner of `area`, with the diagonal direction di, dj, dk: no neighbour along any axis that it moves."""
    out = []
    for d in (x for x in diagonals(dim) if all(x[:dim])):
        left = area
        for a in range(dim):
            step = tuple(-x if b == a else 0 for b, x in enumerate(d))
            left = left.join(moved(area, step).select(*CELL), CELL, "left_anti")
        out.append(left.select(*CELL, *(F.lit(x).alias(f"d{a}") for a, x in zip(AXES, d))))
    return reduce(DataFrame.unionByName, out)


def with_ghosts(cells: DataFrame, dim: int, width: int) -> DataFrame:
    """Cells and all within `width` of them on the same level."""
    return neighbourhood(cells.select(*CELL), box(dim, width)).select("level", *(F.col(f"n{a}").alias(a) for a in AXES)).distinct()


def reference_tables(leaves: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The tables of a multiresolution mesh: cells, cells_and_ghosts, proj_cells (ancestors), reference (all with values)."""
    ghosts = with_ghosts(leaves, config.dim, config.stencil_radius)
    up = ancestors(leaves, config.min_level)
    sources = with_ghosts(parents(ghosts.where(F.col("level") > config.min_level)), config.dim, config.prediction_order)
    siblings = refine(parents(up.where(F.col("level") > config.min_level)), 1, config.dim)
    reference = ghosts.unionByName(up).unionByName(sources).unionByName(siblings).distinct()
    return {"cells": leaves.select(*CELL), "cells_and_ghosts": ghosts, "proj_cells": up, "reference": reference}


def overleaves(leaves: DataFrame, config: Config) -> DataFrame:
    """Children of the leaves, but for those on the finest level."""
    return refine(leaves.where(F.col("level") < config.max_level), 1, config.dim)


def exists(cells: DataFrame, table: DataFrame) -> DataFrame:
    """cells with a column `there`."""
    return cells.join(table.select(*CELL).distinct().withColumn("there", F.lit(True)), CELL, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def ghost_kinds(cells: DataFrame, leaves: DataFrame, area: DataFrame, config: Config) -> DataFrame:
    """cells with a column `kind`: cell (a leaf), projection (has leaves below), outside (not in `area`), else prediction.

    area: the domain's cells on every level of `cells`.
    """
    tables = {"leaf": leaves, "above": ancestors(leaves, config.min_level), "inside": area}
    out = cells.select(*CELL)
    for name, table in tables.items():
        out = out.join(table.select(*CELL).distinct().withColumn(name, F.lit(True)), CELL, "left")
    kind = F.when(F.col("leaf"), "cell").when(F.col("above"), "projection").when(F.col("inside"), "prediction").otherwise("outside")
    return out.select(*CELL, kind.alias("kind"))


def gravity_centre(leaves: DataFrame, dim: int) -> DataFrame:
    volume = F.pow(length(F.col("level")), F.lit(dim))
    return leaves.agg(*((F.sum(volume * centre(F.col("level"), F.col(a))) / F.sum(volume)).alias(f"c_{a}") for a in AXES[:dim]))


def find_cell(points: DataFrame, leaves: DataFrame, levels: range, at: int | Column) -> DataFrame:
    """The leaf that holds each point (i, j, k on level `at`); the coarsest one first. Points outside get nulls.

    Each point asks its cell on every level (a bounded number), an equi-join finds leaves among them, the least level wins.
    """
    level = F.lit(at) if isinstance(at, int) else at
    asked = points.withColumn("at", level).withColumn("leaf", F.explode(F.array(*map(F.lit, levels)))).where("leaf <= at")
    asked = asked.withColumns({f"leaf_{a}": down(a, F.col("at") - F.col("leaf")) for a in AXES})
    named = leaves.select(F.col("level").alias("leaf"), *(F.col(a).alias(f"leaf_{a}") for a in AXES))
    keys = ["leaf", *(f"leaf_{a}" for a in AXES)]
    hit = asked.join(named, keys, "left_semi")
    best = hit.groupBy(*points.columns).agg(F.min(F.struct(*keys)).alias("best"))
    return points.join(best, points.columns, "left").select(*points.columns, *(F.col(f"best.{k}").alias(k) for k in keys))


def stencil_values(field: DataFrame, cells: DataFrame, offsets: list[Offset], value: str = "u") -> DataFrame:
    """cells with one column for each offset, u_0, u_1, ..., of the values around them; null where there is no such cell."""
    near = neighbourhood(cells.select(*CELL), offsets).withColumn("n", F.element_at(F.create_map(*(F.lit(x) for n, o in enumerate(offsets) for x in ("%d,%d,%d" % o, n))), F.format_string("%d,%d,%d", "di", "dj", "dk")))
    source = field.select("level", *(F.col(a).alias(f"n{a}") for a in AXES), F.col(value).alias("v"))
    joined = near.join(source, ["level", "ni", "nj", "nk"], "left")
    return joined.groupBy(*CELL).agg(*(F.max(F.when(F.col("n") == n, F.col("v"))).alias(f"u_{n}") for n in range(len(offsets))))


FACE = ["axis", "level", "i", "j", "k", "l_level", "l_i", "l_j", "l_k", "r_level", "r_i", "r_j", "r_k"]


def interfaces(leaves: DataFrame, dim: int) -> DataFrame:
    """Every face that two leaves share, once: equal levels, or one level apart (then once for each fine cell).

    axis; level and i, j, k of the finer cell (the left one if equal); l_* and r_*: the cells left and right of the face.
    """
    found = faces(leaves.select(*CELL), dim).where("l is not null and r is not null")
    fine = F.when(F.col("l.level") >= F.col("r.level"), F.col("l")).otherwise(F.col("r"))
    return found.select("axis", fine.alias("fine"), "l", "r").select("axis", *(f"fine.{c}" for c in CELL), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in CELL))


def boundary_faces(leaves: DataFrame, area: DataFrame, dim: int) -> DataFrame:
    """Faces of leaves on the border of `area` (cells on every level of the leaves), with axis and side (-1 or 1)."""
    out = []
    for d in directions(dim):
        axis = next(a for a in range(3) if d[a])
        out.append(boundary(leaves.select(*CELL), area, d).select(F.lit(axis).alias("axis"), F.lit(d[axis]).alias("side"), *CELL))
    return reduce(DataFrame.unionByName, out)


def kept(periodic: dict[str, tuple[int, int]], level: int, axis: str, x: Column) -> Column:
    """An index on the level of its row, moved into a periodic axis's extent (low, high on `level`)."""
    if axis not in periodic:
        return x
    low, high = (F.floor(F.lit(e) * F.pow(F.lit(2.0), F.col("level") - level)).cast("int") for e in periodic[axis])
    return F.pmod(x - low, high - low) + low


def too_coarse(leaves: DataFrame, dim: int, width: int, offsets: list[Offset] | None = None, periodic: dict[str, tuple[int, int]] | None = None, level: int = 0) -> DataFrame:
    """Leaves with a leaf at least two levels finer within `width` cells of its level minus one: those must be refined.

    One plan for all levels: each leaf names the cells of all levels that its neighbourhood touches, at least two above it.
    periodic: the extent (low, high on `level`) of axes whose ends meet; images count as neighbours.
    """
    near = neighbourhood(leaves.select(*CELL), offsets or box(dim, 2 * width)).where("level >= 2").select("level", *(kept(periodic or {}, level, a, F.col(f"n{a}")).alias(f"n{a}") for a in AXES)).distinct()
    up = near.select("*", F.explode(F.sequence(F.lit(0), F.col("level") - 2)).alias("to"))
    touched = up.select(F.col("to").alias("level"), *(down(f"n{a}", F.col("level") - F.col("to")).alias(a) for a in AXES)).distinct()
    return leaves.join(touched, CELL, "left_semi")


def tree_of(cells: DataFrame, area: DataFrame, min_level: int, dim: int) -> DataFrame:
    """The leaves of the coarsest mesh over `area` (cells of min_level) that has `cells` among its leaves or their ancestors."""
    up = ancestors(cells, min_level)
    out = refine(up, 1, dim).unionByName(area.select(*CELL)).unionByName(cells.select(*CELL)).distinct()
    return out.join(up, CELL, "left_anti")


def border_leaves(leaves: DataFrame, min_level: int, direction: Offset) -> DataFrame:
    """Leaves with nothing of the domain beside them in a direction. The domain is what the leaves' ancestors on min_level cover.

    A leaf within its ancestor's faces has the domain beside it; only those at a face ask for the next ancestor.
    """
    steps = F.col("level") - min_level
    area = leaves.select(*(down(a, steps).alias(f"n{a}") for a in AXES)).distinct()
    beside = leaves.select(*CELL, *(down(F.col(a) + d, steps).alias(f"n{a}") for a, d in zip(AXES, direction)))
    moves = reduce(lambda a, b: a | b, [F.col(f"n{a}") != down(a, steps) for a, d in zip(AXES, direction) if d])
    return beside.where(moves).join(area, [f"n{a}" for a in AXES], "left_anti").select(*CELL)


def broken_borders(leaves: DataFrame, dim: int, radius: int, min_level: int, periodic: tuple[str, ...] = ()) -> DataFrame:
    """Leaves to refine so that a stencil of `radius` at a border stays on one level.

    Inwards from a border leaf, max(radius, 2 (radius - 2)) cells must be of its level: coarser leaves among them split (looked
    for at every second cell, as they are two cells wide); and for a radius over two, a border leaf with finer ones within
    radius - 1 cells splits itself.
    """
    count = max(radius, 2 * (radius - 2))
    if radius < 2:
        return leaves.select(*CELL).limit(0)
    out = []
    fine = leaves.select((F.col("level") - 1).alias("level"), *(F.shiftright(a, 1).alias(f"n{a}") for a in AXES)).distinct()
    for d in directions(dim):
        if any(x and a in periodic for a, x in zip(AXES, d)):
            continue
        edge = border_leaves(leaves, min_level, d)
        inward = lambda first, last, step: edge.select(*CELL, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("s")).withColumns({f"n{a}": F.col(a) - F.col("s") * x for a, x in zip(AXES, d)})  # noqa: E731, B023
        coarse = inward(2, count, 2).where(F.col("level") > min_level)
        out.append(coarse.select((F.col("level") - 1).alias("level"), *(F.shiftright(f"n{a}", 1).alias(a) for a in AXES)))
        if radius > 2:
            out.append(inward(1, radius - 1, 1).join(fine, ["level", *(f"n{a}" for a in AXES)], "left_semi").select(*CELL))
    return leaves.select(*CELL).join(reduce(DataFrame.unionByName, out).distinct(), CELL, "left_semi") if out else leaves.select(*CELL).limit(0)


def is_graduated(leaves: DataFrame, dim: int) -> bool:
    """Whether no leaf touches, along an axis, one at least two levels coarser."""
    return too_coarse(leaves, dim, 1, [o for o in star(dim) if any(o)]).isEmpty()


def graduate(leaves: DataFrame, dim: int, width: int = 1, radius: int = 1, min_level: int = 0, periodic: dict[str, tuple[int, int]] | None = None, level: int = 0) -> DataFrame:
    """Refine leaves until none is too coarse for its neighbours, nor borders broken for stencils of `radius`.

    min_level: of the mesh, for the border rule (radius over 1). periodic: see too_coarse; such axes have no border. Each pass
    is checkpointed; every pass refines, so there are at most as many as levels times the depth of a border.
    """
    leaves = leaves.select(*CELL).checkpoint()
    while True:
        split = too_coarse(leaves, dim, width, periodic=periodic, level=level).select(*CELL)
        if radius > 1:
            split = split.unionByName(broken_borders(leaves, dim, radius, min_level, tuple(periodic or {}))).distinct().checkpoint()
        if split.isEmpty():
            return leaves
        leaves = leaves.join(split, CELL, "left_anti").unionByName(refine(split, 1, dim)).checkpoint()


KEEP, COARSEN, REFINE, ENLARGE = 1, 2, 4, 8


def from_tags(tagged: DataFrame, config: Config) -> DataFrame:
    """New leaves from tags: refine gives the children, coarsen without keep the parent, all else the cell itself."""
    tag, level = F.col("tag"), F.col("level")
    fine = (tag.bitwiseAND(REFINE) != 0) & (level < config.max_level)
    up = ~fine & (tag.bitwiseAND(COARSEN) != 0) & (tag.bitwiseAND(KEEP) == 0) & (tag.bitwiseAND(REFINE) == 0) & (level > config.min_level)
    return refine(tagged.where(fine), 1, config.dim).unionByName(parents(tagged.where(up))).unionByName(tagged.where(~fine & ~up).select(*CELL)).distinct()


def from_tags_strict(tagged: DataFrame, config: Config) -> DataFrame:
    """The older rule: refine before keep before coarsen; a cell without a tag goes."""
    tag, level = F.col("tag"), F.col("level")
    fine = tag.bitwiseAND(REFINE) != 0
    keep = ~fine & (tag.bitwiseAND(KEEP) != 0)
    up = ~fine & ~keep & (tag.bitwiseAND(COARSEN) != 0)
    stay = keep | (fine & (level >= config.max_level)) | (up & (level <= config.min_level))
    return refine(tagged.where(fine & (level < config.max_level)), 1, config.dim).unionByName(parents(tagged.where(up & (level > config.min_level)))).unionByName(tagged.where(stay).select(*CELL)).distinct()


def child_offsets(dim: int) -> list[Offset]:
    return children(dim)
