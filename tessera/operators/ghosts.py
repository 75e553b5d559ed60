"""Values of all ghosts of an adapted mesh, inside and outside its domain, in one ordered plan.

A ghost outside belongs to the cell inside that is nearest along an axis (or, at a corner, along a diagonal), and that
cell's kind says where the value comes from: next to a leaf a border condition gives it, next to an ancestor the ghosts
one level finer do (their mean; at a corner the child nearest to it), under a coarser leaf the ghost one level coarser. Layers
that no condition reaches continue as polynomials through the last values inwards. So conditions on all levels are one plan;
then ancestors' ghosts follow from fine to coarse, then coarser leaves' ghosts and the predictions inside from coarse to fine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL, down, length
from tessera.functions.stencils import Offset, box, directions

from .boundary import lagrange
from .mesh import Config, kept, neighbourhood
from .multires import predict, project_all


@dataclass(frozen=True)
class Condition:
    """Ghost layers from the values inwards (the border cell first), on faces in some directions and in a region.

    layers(values) gives one Column for each layer; it may use x, y, z (the face's centre), h (the cell's side) and the cell.
    """

    layers: Callable[[list[Column]], list[Column]]
    depth: int = 1
    directions: tuple[Offset, ...] = tuple(directions(3))
    region: Column | None = None


def fixed(value: Column | float, order: int = 1, **where) -> Condition:
    """`order` layers of the polynomial through `order` cells and the border value."""
    v = value if isinstance(value, Column) else F.lit(float(value))
    weights = [lagrange([0.5, *(-float(n) for n in range(order))], float(n)) for n in range(1, order + 1)]
    return Condition(lambda u: [reduce(lambda a, b: a + b, [v * w[0], *(x * y for x, y in zip(u, w[1:]))]) for w in weights], order, **where)


def slope(value: Column | float = 0.0, **where) -> Condition:
    """One layer: the border cell plus its side times the outward slope."""
    g = value if isinstance(value, Column) else F.lit(float(value))
    return Condition(lambda u: [u[0] + F.col("h") * g], 1, **where)


@dataclass(frozen=True)
class Border:
    """The axes that are periodic, from index low to high on `level`, and the conditions of each field, the first that fits.

    A face without a condition continues the values inside.
    """

    conditions: dict[str, list[Condition]] = field(default_factory=dict)
    periodic: dict[str, tuple[int, int]] = field(default_factory=dict)
    level: int = 0

    def inside(self, axis: str, x: Column) -> Column:
        """An index on the level of its row, moved by whole periods."""
        return kept(self.periodic, self.level, axis, x)

    def wrap(self, cells: DataFrame) -> DataFrame:
        return cells.withColumns({a: self.inside(a, F.col(a)) for a in self.periodic}) if self.periodic else cells


def continued(known: list[Column], inner: int, layers: int) -> list[Column]:
    """Outer layers after `known` ones: layer k by the polynomial through the last 2k - 1 values, k of them inside.

    known: `inner` values inside, the border cell first, then the layers that are there. Inside values may be null: then as
    many as are there in a row are used.
    """
    inside, out = known[:inner], known[inner:]
    for k in range(len(out) + 1, layers + 1):
        tries = []
        for m in range(min(k, inner), 0, -1):
            values = [*inside[:m][::-1], *out]
            w = lagrange([float(n) for n in range(len(values))], float(len(values)))
            tries.append(reduce(lambda a, b: a + b, [x * y for x, y in zip(values, w)]))
        out = [*out, F.coalesce(*tries)]
    return out


def kinds(cells: DataFrame, known: DataFrame, min_level: int) -> DataFrame:
    """cells with `kind`: that of `known` (leaf or above: an ancestor of leaves), else below (under a coarser leaf) or out."""
    named = cells.join(known.select(*CELL, "kind"), CELL, "left")
    up = named.where(F.col("kind").isNull() & (F.col("level") > min_level)).select(*CELL, F.explode(F.sequence(F.lit(min_level), F.col("level") - 1)).alias("up"))
    up = up.withColumns({f"u{a}": down(a, F.col("level") - F.col("up")) for a in AXES})
    own = known.where("kind = 'leaf'").select(F.col("level").alias("up"), *(F.col(a).alias(f"u{a}") for a in AXES))
    below = up.join(own, ["up", *(f"u{a}" for a in AXES)], "left_semi").select(*CELL).distinct().withColumn("below", F.lit("below"))
    return named.join(below, CELL, "left").select(*CELL, F.coalesce("kind", "below", F.lit("out")).alias("kind"))


_STEP = [f"e{a}" for a in AXES]
_BASE = [f"b{a}" for a in AXES]


def anchors(found: DataFrame, border: Border, dim: int, width: int) -> DataFrame:
    """Each cell outside with its cell inside (bi, bj, bk), the step outwards (ei, ej, ek), the layer, and that cell's kind.

    Of several the one with fewest axes, then the nearest; layers of a corner count along its first axis.
    """
    offsets = sorted((o for o in box(dim, width) if any(o)), key=lambda o: (sum(map(bool, o)), sum(map(abs, o)), o))
    first = lambda o: next(abs(x) for x in o if x)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rank"), F.lit(first(o)).alias("layer"), *(F.lit(x).alias(f"o{a}") for a, x in zip(AXES, o))) for n, o in enumerate(offsets)))).alias("o")
    asked = found.where("kind = 'out'").select(*CELL, each).select(*CELL, "o.*").withColumns({f"b{a}": border.inside(a, F.col(a) - F.col(f"o{a}")) for a in AXES})
    inside = found.where("kind <> 'out'").select("level", *(F.col(a).alias(f"b{a}") for a in AXES), F.col("kind"))
    hit = asked.join(inside, ["level", *_BASE])
    best = hit.groupBy(*CELL).agg(F.min(F.struct("rank", "layer", *_BASE, *(F.signum(f"o{a}").cast("int").alias(f"e{a}") for a in AXES), "kind")).alias("best"))
    return best.select(*CELL, "best.layer", *(f"best.{c}" for c in (*_BASE, *_STEP)), "best.kind")


def _lines(found: DataFrame, values: DataFrame, border: Border, depth: int, names: tuple[str, ...]) -> DataFrame:
    """Border cells and steps of `found`, each once, with v<n>_<name>: values n cells inwards."""
    keys = ["level", *_BASE, *_STEP, "kind"]
    asked = found.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("n"))
    asked = asked.withColumns({a: border.inside(a, F.col(f"b{a}") - F.col("n") * F.col(f"e{a}")) for a in AXES})
    got = asked.join(values.select(*CELL, *names), CELL, "left")
    return got.groupBy(*keys).agg(*(F.max(F.when(F.col("n") == n, F.col(c))).alias(f"v{n}_{c}") for n in range(depth) for c in names))


def _with_layers(lines: DataFrame, border: Border, width: int, depth: int, names: tuple[str, ...], given: bool) -> DataFrame:
    """lines with `layers_<name>`: by conditions, or, if `given`, from first_<name> on."""
    h = length(F.col("level"))
    lines = lines.withColumn("h", h).withColumns({x: (F.col(f"b{a}") + F.lit(0.5) + F.col(f"e{a}") / 2) * F.col("h") for a, x in zip(AXES, "xyz")})
    lines = lines.withColumnsRenamed({f"b{a}": a for a in AXES})
    straight = sum((F.abs(e) for e in _STEP[1:]), F.abs(_STEP[0])) == 1
    out = {}
    for c in names:
        inner = [F.col(f"v{n}_{c}") for n in range(depth)]
        value = F.array(*continued([*inner, F.col(f"first_{c}")], depth, width)) if given else F.array(*continued(inner, depth, width))
        for bc in reversed([] if given else border.conditions.get(c, [])):
            fits = straight & F.concat_ws(",", *_STEP).isin([",".join(map(str, d)) for d in bc.directions]) & (F.lit(True) if bc.region is None else bc.region)
            there = reduce(lambda a, b: a & b, [x.isNotNull() for x in inner[: bc.depth]])
            missing = F.raise_error(F.lit("a border condition needs more cells inside; see graduate(..., border_cells)")).cast("array<double>")
            value = F.when(fits, F.when(there, F.array(*continued([*inner, *bc.layers(inner[: bc.depth])[:width]], depth, width))).otherwise(missing)).otherwise(value)
        out[f"layers_{c}"] = value
    return lines.select("level", *(F.col(a).alias(f"b{a}") for a in AXES), *_STEP, *(v.alias(n) for n, v in out.items()))


def _placed(outside: DataFrame, layers: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return outside.join(layers, ["level", *_BASE, *_STEP]).select(*CELL, *(F.element_at(f"layers_{c}", F.col("layer")).alias(c) for c in names))


def _first_from_children(lines: DataFrame, ghosts: DataFrame, dim: int, names: tuple[str, ...]) -> DataFrame:
    """lines with first_<name>, the first layer: the mean of its children that are ghosts, or, at a corner, its nearest child.

    Children are looked for one level down and, if there are none, two.
    """
    at = {a: F.col(f"b{a}") + F.col(f"e{a}") for a in AXES}
    own = lines.withColumns({f"f{a}": x for a, x in at.items()})
    straight = sum((F.abs(e) for e in _STEP[1:]), F.abs(_STEP[0])) == 1
    for n in (1, 2):
        up = ghosts.select((F.col("level") - n).alias("level"), *((F.shiftright(a, n) if k < dim else F.col(a)).alias(f"f{a}") for k, a in enumerate(AXES)), *(F.col(a).alias(f"c{a}") for a in AXES), *names)
        means = up.groupBy("level", *(f"f{a}" for a in AXES)).agg(*(F.avg(c).alias(f"mean{n}_{c}") for c in names))
        near = [F.shiftleft(F.col(f"f{a}"), n) + F.when(F.col(f"e{a}") < 0, (1 << n) - 1).otherwise(0) if k < dim else F.col(f"f{a}") for k, a in enumerate(AXES)]
        child = up.select("level", *(f"c{a}" for a in AXES), *(F.col(c).alias(f"child{n}_{c}") for c in names))
        own = own.withColumns({f"c{a}": x for a, x in zip(AXES, near)})
        own = own.join(means, ["level", *(f"f{a}" for a in AXES)], "left").join(child, ["level", *(f"c{a}" for a in AXES)], "left")
    return own.withColumns({f"first_{c}": F.when(straight, F.coalesce(f"mean1_{c}", f"mean2_{c}")).otherwise(F.coalesce(f"child1_{c}", f"child2_{c}")) for c in names})


def ghost_values(field: DataFrame, config: Config, border: Border, *names: str, images: bool = True) -> DataFrame:
    """Values on leaves, their ancestors, and all cells within reach of those: (level, i, j, k, names).

    Reach is the greater of the stencil's and the prediction's radius. The domain is what the leaves cover, with holes or
    without. images: whether cells beyond periodic ends are there too; operators that take border.inside need them not, but
    all cells inside. Each level is checkpointed: one coarser level of the ghosts of ancestors, one finer level of predictions.
    """
    width, top, low = max(config.stencil_radius, config.prediction_order), config.max_level, config.min_level
    depth = max([width, *(bc.depth for c in names for bc in border.conditions.get(c, []))])
    leaves, above = field.select(*CELL, *names, F.lit("leaf").alias("kind")), project_all(field, config.dim, low, *names).withColumn("kind", F.lit("above"))
    known = leaves.unionByName(above).checkpoint()
    inside = known.drop("kind")
    reach = neighbourhood(inside.select(*CELL), box(config.dim, width)).select("level", *(F.col(f"n{a}").alias(a) for a in AXES)).distinct().checkpoint()
    found = kinds(border.wrap(reach).distinct(), known, low).checkpoint()
    outside = anchors(found, border, config.dim, width).checkpoint()
    lines = _lines(outside.where("kind <> 'below'"), inside, border, depth, names).checkpoint()

    by_leaf = _with_layers(lines.where("kind = 'leaf'"), border, width, depth, names, False)
    ghosts = _placed(outside.where("kind = 'leaf'"), by_leaf, names).checkpoint()
    for level in range(top - 1, low - 1, -1):
        own = lines.where((F.col("kind") == "above") & (F.col("level") == level))
        near = ghosts.where(F.col("level").between(level + 1, level + 2))
        made = _with_layers(_first_from_children(own, near, config.dim, names), border, width, depth, names, True)
        ghosts = ghosts.unionByName(_placed(outside.where((F.col("kind") == "above") & (F.col("level") == level)), made, names)).checkpoint()

    values = inside.unionByName(ghosts)
    for level in range(low + 1, top + 1):
        under = outside.where((F.col("kind") == "below") & (F.col("level") == level)).select(*CELL, *(F.shiftright(a, 1).alias(f"p{a}") for a in AXES))
        coarse = values.where(F.col("level") == level - 1)
        copied = under.join(coarse.select(*(F.col(a).alias(f"p{a}") for a in AXES), *names), [f"p{a}" for a in AXES]).select(*CELL, *names)
        missing = found.where((F.col("kind") == "below") & (F.col("level") == level)).select(*CELL)
        parents = missing.select((F.col("level") - 1).alias("level"), *(F.shiftright(a, 1).alias(a) for a in AXES)).distinct()
        guess = predict(parents, coarse, config.dim, config.prediction_order, *names, place=border.inside).join(missing, CELL, "left_semi")
        values = values.unionByName(copied).unionByName(guess).checkpoint()
    if not border.periodic or not images:
        return values
    home = border.wrap(reach.withColumns({f"own_{a}": F.col(a) for a in AXES})).join(values, CELL)
    return home.select("level", *(F.col(f"own_{a}").alias(a) for a in AXES), *names)


@dataclass
class Ghosts:
    """A field whose ghosts are filled when they are asked for, once."""

    field: DataFrame
    config: Config
    border: Border
    names: tuple[str, ...]
    filled: DataFrame | None = None

    def values(self) -> DataFrame:
        if self.filled is None:
            self.filled = ghost_values(self.field, self.config, self.border, *self.names)
        return self.filled

    def replace(self, field: DataFrame) -> None:
        """Another field on the same or another mesh: its ghosts are not filled yet."""
        self.field, self.filled = field, None
