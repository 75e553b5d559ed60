"""Queries on a mesh of many levels, grown around points of a stored table, and the SQL that grows the same mesh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.levels import CELL, centre
from tessera.functions.prediction import child
from tessera.functions.stencils import directions
from tessera.operators import blocks, ghosts, lattice, mesh, multigrid, partition, schemes, solve

from . import lenses
from .queries import IJ, QUERIES, SQL, _weno_face


#: Levels of the mesh. Suppliers are its finest cells.
LOW, TOP = 4, 8
#: Rounds of graduation in SQL: more than are needed, the mesh then stays as it is.
ROUNDS = 12


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with recursive {sql}"
        return f

    return add


def pins(spark: SparkSession, sf: str) -> DataFrame:
    """A cell of the finest level for each supplier, some at the borders."""
    side = 1 << TOP
    i, j = F.pmod(F.col("s_suppkey") * 37, F.lit(side)), F.pmod(F.col("s_suppkey") * 101 + F.col("s_nationkey") * 17, F.lit(side))
    return lenses.table(spark, sf, "supplier").select(F.lit(TOP).alias("level"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(0).alias("k")).distinct()


def area(spark: SparkSession) -> DataFrame:
    return mesh.cells_of_boxes(spark, LOW, [((0, 0), (1 << LOW, 1 << LOW))])


def grown(spark: SparkSession, sf: str, radius: int = 1, periodic: bool = False) -> DataFrame:
    """The graduated mesh around the pins; periodic: along both axes."""
    leaves = mesh.tree_of(pins(spark, sf), area(spark), LOW, 2)
    both = {a: (0, 1 << LOW) for a in "ij"}
    return mesh.graduate(leaves, 2, 1, radius, LOW, both if periodic else None, LOW)


def valued(leaves: DataFrame) -> DataFrame:
    return leaves.select(*CELL, F.pmod(F.col("i") * 31 + F.col("j") * 17 + F.col("level") * 7, F.lit(23)).cast("double").alias("u"))


def _rounded(name: str, digits: int):
    """Rounded a little above, in SQL too: most values are halves of halves, and exact ties would hang on the order of sums."""
    return F.round(F.col(name) + 1e-8, digits).alias(name)


# The same in SQL


def _border_rule(radius: int) -> str:
    """Cells to refine for stencils of `radius` at borders; empty for 1."""
    count, parts = max(radius, 2 * (radius - 2)), []
    edges = (("i = 0", "1", "0"), ("i = (1 << level) - 1", "-1", "0"), ("j = 0", "0", "1"), ("j = (1 << level) - 1", "0", "-1"))
    if radius > 1:
        parts += [f"select level - 1, (i + {x} * s)::int >> 1, (j + {y} * s)::int >> 1 from grown, range(2, {count + 1}, 2) r(s) where {at} and level > {LOW}" for at, x, y in edges]
    if radius > 2:
        parts += [f"select b.level, b.i, b.j from grown b, range(1, {radius}) r(s) where {at.replace('i =', 'b.i =').replace('j =', 'b.j =').replace('level', 'b.level')} and (b.level + 1, b.i + {x} * s, b.j + {y} * s) in (select level, i >> 1, j >> 1 from grown)" for at, x, y in edges]
    return "".join(f" union all {p}" for p in parts)


def _grown_sql(radius: int = 1, periodic: bool = False) -> str:
    wrap = (lambda x: f"(({x}) & ((1 << g.level) - 1))") if periodic else (lambda x: f"({x})")
    touched = f"select y.l::int as level, {wrap('(g.i + x.e)::int')} >> (g.level - y.l)::int as i, {wrap('(g.j + z.d)::int')} >> (g.level - y.l)::int as j from grown g, range(-2, 3) x(e), range(-2, 3) z(d), range({LOW}, {TOP - 1}) y(l) where y.l <= g.level - 2"
    split = f"(select level, i, j from ({touched}{'' if periodic else _border_rule(radius)}))"
    return f"""pins as (select distinct (s_suppkey * 37 % {1 << TOP})::int as i, ((s_suppkey * 101 + s_nationkey * 17) % {1 << TOP})::int as j from supplier),
up as (select distinct x.l::int as level, i >> ({TOP} - x.l)::int as i, j >> ({TOP} - x.l)::int as j from pins, range({LOW}, {TOP}) x(l)),
tree as (select level, i, j from (select level + 1 as level, (i * 2 + x.e)::int as i, (j * 2 + y.d)::int as j from up, range(2) x(e), range(2) y(d) union select {LOW}, x.i::int, y.j::int from range({1 << LOW}) x(i), range({1 << LOW}) y(j) union select {TOP}, i, j from pins)
  where (level, i, j) not in (select level, i, j from up)),
grown as (select 0 as n, level, i, j from tree
  union all select n + 1, level, i, j from (select n, level, i, j from grown where n < {ROUNDS} and (level, i, j) not in {split}
    union all select n, level + 1, (i * 2 + x.e)::int, (j * 2 + y.d)::int from grown, range(2) x(e), range(2) y(d) where n < {ROUNDS} and (level, i, j) in {split})),
leaf as (select level, i, j, ((i * 31 + j * 17 + level * 7) % 23)::double as u from grown where n = {ROUNDS})"""


def _union(rows: list[str]) -> str:
    return " union all ".join(rows)


def _ghosts_sql(width: int, sides: str, periodic: bool = False, tail: str = " select level, i, j, round(u + 1e-8, 6) as u from whole") -> str:
    """All values: `sides` is an expression of the first layer (or, as a list, of all) next to a leaf on a straight border.

    It may use v0, v1 (values inwards), x, y (the face's centre), h and ex, ey. periodic: along i.
    """
    n = "(1 << level)"
    w = f"range(-{width}, {width + 1})"
    off = f"(j < 0 or j >= {n})" if periodic else f"(i < 0 or j < 0 or i >= {n} or j >= {n})"
    home = f"i & ({n} - 1)" if periodic else "i"
    second = "coalesce(v1 - 3 * v0 + 3 * g1, 2 * g1 - v0)"
    third = f"coalesce(v2 - 5 * v1 + 10 * v0 - 10 * g1 + 5 * {second}, -v1 + 4 * v0 - 6 * g1 + 4 * {second}, v0 - 3 * g1 + 3 * {second})"
    straight = "(ex = 0 or ey = 0)"
    lines = f"""
val as (select *, 'leaf' as kind from leaf union all select x.l::int, i >> (level - x.l)::int, j >> (level - x.l)::int, sum(u * pow(0.25, level - x.l)), 'above' from leaf, range({LOW}, {TOP}) x(l) where x.l < level group by 1, 2, 3),
near as (select distinct level, (i + x.e)::int as i, (j + y.d)::int as j from val, {w} x(e), {w} y(d)),
reach as (select distinct level, {home} as i, j from near),
outs as (select level, i, j, bi, bj, sign(i - bi)::int as ex, sign(j - bj)::int as ey, abs(case when i <> bi then i - bi else j - bj end) as layer
  from (select *, {'i' if periodic else f'greatest(0, least(i, {n} - 1))'} as bi, greatest(0, least(j, {n} - 1)) as bj from reach where {off})),
line as (select o.*, coalesce(a.kind, 'below') as kind, a.u as v0, b.u as v1, c.u as v2, pow(0.5, o.level) as h, (bi + 0.5 + ex / 2.0) * pow(0.5, o.level) as x, (bj + 0.5 + ey / 2.0) * pow(0.5, o.level) as y
  from outs o left join val a on a.level = o.level and a.i = bi and a.j = bj left join val b on b.level = o.level and b.i = bi - ex and b.j = bj - ey left join val c on c.level = o.level and c.i = bi - 2 * ex and c.j = bj - 2 * ey),
first{TOP} as (select *, case when {straight} then {sides} else v0 end as g1 from line where kind = 'leaf' and level = {TOP}),"""
    layer2 = f"case when layer = 1 then g1 when layer = 2 then {second} else {third} end"
    for level in range(TOP, LOW - 1, -1):
        if level < TOP:
            deeper = f"union all select level, i, j, u from ghost{level + 2}" if level + 2 <= TOP else ""
            lines += f"""
finer{level} as (select level, i, j, u from ghost{level + 1} {deeper}),
mean{level} as (select i >> (level - {level}) as i, j >> (level - {level}) as j, level - {level} as step, avg(u) as u from finer{level} group by 1, 2, 3),
first{level} as (select *, case when {straight} then {sides} else v0 end as g1 from line where kind = 'leaf' and level = {level} union all
  select l.*, case when {straight} then coalesce(m1.u, m2.u) else coalesce(c1.u, c2.u) end as g1 from line l
  left join mean{level} m1 on m1.step = 1 and m1.i = bi + ex and m1.j = bj + ey left join mean{level} m2 on m2.step = 2 and m2.i = bi + ex and m2.j = bj + ey
  left join finer{level} c1 on c1.level = {level + 1} and c1.i = (bi + ex) * 2 + (ex < 0)::int and c1.j = (bj + ey) * 2 + (ey < 0)::int
  left join finer{level} c2 on c2.level = {level + 2} and c2.i = (bi + ex) * 4 + 3 * (ex < 0)::int and c2.j = (bj + ey) * 4 + 3 * (ey < 0)::int
  where l.kind = 'above' and l.level = {level}),"""
        lines += f"\nghost{level} as (select level, i, j, {layer2} as u from first{level}),"
    weights = ", ".join(f"({p}, {o}, {float(x)!r})" for p in (0, 1) for o, x in child(1, p).items())
    lines += f"""
w as (select * from (values {weights}) t(p, o, w)),
all{LOW} as (select i, j, u from val where level = {LOW} union all select i, j, u from ghost{LOW}),"""
    for level in range(LOW + 1, TOP + 1):
        source = f"((m.i >> 1) + a.o)::int & ((1 << {level - 1}) - 1)" if periodic else "(m.i >> 1) + a.o"
        lines += f"""
miss{level} as (select i, j from reach where level = {level} and not {off} except select i, j from val where level = {level}),
all{level} as (select i, j, u from val where level = {level} union all select i, j, u from ghost{level}
  union all select l.i, l.j, p.u from line l join all{level - 1} p on p.i = l.i >> 1 and p.j = l.j >> 1 where l.level = {level} and l.kind = 'below'
  union all select m.i, m.j, sum(a.w * b.w * n.u)::double from miss{level} m join w a on a.p = m.i & 1 join w b on b.p = m.j & 1 join all{level - 1} n on n.i = {source} and n.j = (m.j >> 1) + b.o group by m.i, m.j),"""
    whole = _union([f"select {level} as level, i, j, u from all{level}" for level in range(LOW, TOP + 1)])
    if periodic:
        return lines.strip() + f" whole as ({whole}) select r.level, r.i, r.j, round(w.u + 1e-8, 6) as u from near r join whole w on w.level = r.level and w.i = r.i & ((1 << r.level) - 1) and w.j = r.j"
    return lines.strip() + f" whole as materialized ({whole})" + tail


# Queries


@query(_grown_sql() + " select level, i, j from leaf")
def grown_mesh(spark, sf):
    return grown(spark, sf).select("level", *IJ)


@query(_grown_sql(2) + " select level, i, j from leaf")
def graduated_borders(spark, sf):
    """Two cells of one level, at least, inwards from every border."""
    return grown(spark, sf, 2).select("level", *IJ)


@query(_grown_sql(3) + " select level, i, j from leaf")
def graduated_borders_wide(spark, sf):
    return grown(spark, sf, 3).select("level", *IJ)


@query(_grown_sql(1, True) + " select level, i, j from leaf")
def graduated_periodic(spark, sf):
    """Images across both axes are neighbours."""
    return grown(spark, sf, 1, True).select("level", *IJ)


X_SIDES, Y_SIDES = ((1, 0, 0), (-1, 0, 0)), ((0, 1, 0), (0, -1, 0))


def _config(radius: int) -> mesh.Config:
    return mesh.Config(dim=2, min_level=LOW, max_level=TOP, stencil_radius=radius)


def _filled(leaves: DataFrame, border: ghosts.Border, radius: int) -> DataFrame:
    return ghosts.ghost_values(valued(leaves), _config(radius), border, "u").select("level", *IJ, _rounded("u", 6))


@query(_grown_sql() + ", " + _ghosts_sql(1, "case when ex <> 0 then 2 * (y * 10) - v0 else v0 + h * 3 end"))
def ghosts_of_borders(spark, sf):
    """A value that changes along the left and right borders, a slope at the others, on all levels."""
    return _filled(grown(spark, sf), _border(), 1)


_ORDER2 = "case when ex <> 0 and y < 0.5 then case layer when 1 then 8.0 / 3 * 7 + v1 / 3 - 2 * v0 else 8.0 * 7 + 2 * v1 - 9 * v0 end when ex <> 0 then 2 * 4.0 - v0 else v0 + h * 3 end"


@query(_grown_sql(2) + ", " + _ghosts_sql(2, _ORDER2).replace("case when layer = 1 then g1 when", "case when layer = 1 or (kind = 'leaf' and ex <> 0 and ey = 0 and y < 0.5) then g1 when"))
def ghosts_of_borders_wide(spark, sf):
    """Two layers: of order two on one half of the left and right borders, of order one (then continued) on the other."""
    low = ghosts.fixed(7.0, 2, directions=X_SIDES, region=F.col("y") < 0.5)
    border = ghosts.Border({"u": [low, ghosts.fixed(4.0, directions=X_SIDES), ghosts.slope(3.0, directions=Y_SIDES)]})
    return _filled(grown(spark, sf, 2), border, 2)


@query(_grown_sql(1, True) + ", " + _ghosts_sql(1, "2 * (x * 10) - v0", True))
def ghosts_of_periodic(spark, sf):
    """Periodic along i, values at the borders of j."""
    border = ghosts.Border({"u": [ghosts.fixed(F.col("x") * 10)]}, {"i": (0, 1 << LOW)}, LOW)
    return _filled(grown(spark, sf, 1, True), border, 1)




# Fluxes across levels


FACES = """
neighbour as (select * from (values (0, 1, 0), (1, 0, 1)) t(axis, di, dj)),
face as (select axis, di, dj, a.level, a.i, a.j, a.level as ll, a.i as li, a.j as lj, b.level as rl, b.i as ri, b.j as rj from leaf a, neighbour join leaf b on b.level = a.level and b.i = a.i + di and b.j = a.j + dj
  union all select axis, di, dj, f.level, f.i, f.j, f.level, f.i, f.j, c.level, c.i, c.j from leaf f, neighbour join leaf c on c.level = f.level - 1 and c.i = (f.i + di) >> 1 and c.j = (f.j + dj) >> 1
  union all select axis, di, dj, f.level, f.i - di, f.j - dj, c.level, c.i, c.j, f.level, f.i, f.j from leaf f, neighbour join leaf c on c.level = f.level - 1 and c.i = (f.i - di) >> 1 and c.j = (f.j - dj) >> 1
  union all select axis, di, dj, level, i, j, level, i, j, null, null, null from leaf, neighbour where i * di + j * dj = (1 << level) - 1
  union all select axis, di, dj, level, i - di, j - dj, null, null, null, level, i, j from leaf, neighbour where i * di + j * dj = 0)"""


def _across(size: int) -> str:
    """Faces with the `size` values across them, s0, s1, ..., and h."""
    half = size // 2
    keys = "axis, level, i, j, ll, li, lj, rl, ri, rj"
    got = f"select {keys}, r.n, w.u from (select *, (i + (n - {half - 1}) * di)::int as wi, (j + (n - {half - 1}) * dj)::int as wj from face, range({size}) r(n)) r join whole w on w.level = r.level and w.i = r.wi and w.j = r.wj"
    got = got.replace(keys, ", ".join(f"r.{k}" for k in keys.split(", ")))
    return f"{FACES.strip()}, across as materialized (select {keys}, pow(0.5, level) as h, 1.0 as share, {', '.join(f'max(u) filter (where n = {n}) as s{n}' for n in range(size))} from ({got}) group by {keys})"


def _kids_across() -> str:
    """Two sub-faces a level finer (one on the finest level), their values predicted."""
    return f"""{FACES.strip()}, kid as (select m.level, m.i, m.j, a.p, b.p as q, sum(a.w * b.w * n.u) as u from whole m, w a, w b join whole n on n.level = m.level and n.i = m.i + a.o and n.j = m.j + b.o where m.level < {TOP} group by m.level, m.i, m.j, a.p, b.p),
across as (select f.*, pow(0.5, f.level) / 2 as h, 0.5 as share, l.u as s0, r.u as s1 from face f, range(2) t(t) join kid l on l.level = f.level and l.i = f.i and l.j = f.j and l.p = (case axis when 0 then 1 else t end) and l.q = (case axis when 0 then t else 1 end)
    join kid r on r.level = f.level and r.i = f.i + di and r.j = f.j + dj and r.p = (case axis when 0 then 0 else t end) and r.q = (case axis when 0 then t else 0 end)
  union all select f.*, pow(0.5, f.level) as h, 1.0 as share, l.u, r.u from face f join whole l on l.level = f.level and l.i = f.i and l.j = f.j join whole r on r.level = f.level and r.i = f.i + di and r.j = f.j + dj where f.level = {TOP})"""


def _divergence(across: str, **fluxes: str) -> str:
    q = ", ".join(f"({x}) * share * pow(0.5, level) as {n}" for n, x in fluxes.items())
    minus = ", ".join(f"-{n}" for n in fluxes)
    total = ", ".join(f"round(sum({n}) * pow(4.0, level) + 1e-8, 4) as {n}" for n in fluxes)
    return f", {across}, q as (select ll, li, lj, rl, ri, rj, {q} from across), part as (select ll as level, li as i, lj as j, {', '.join(fluxes)} from q where ll is not null union all select rl, ri, rj, {minus} from q where rl is not null) select level, i, j, {total} from part group by level, i, j"


_SIDES = "case when ex <> 0 then 2 * (y * 10) - v0 else v0 + h * 3 end"


def _border() -> ghosts.Border:
    return ghosts.Border({"u": [ghosts.fixed(F.col("y") * 10, directions=X_SIDES), ghosts.slope(3.0, directions=Y_SIDES)]})


def _flux(spark, sf, radius: int, size: int, fluxes: dict, border: ghosts.Border | None = None, fields=valued, **finer) -> DataFrame:
    """Divergences on the leaves; radius: of the mesh's borders and ghosts."""
    leaves = grown(spark, sf, radius)
    field = fields(leaves)
    names = [c for c in field.columns if c not in CELL]
    values = ghosts.ghost_values(field, _config(radius), border or _border(), *names)
    out = schemes.on_all_levels(leaves, values, 2, size, names, fluxes, **finer)
    return out.select("level", *IJ, *(_rounded(r, 4) for r in fluxes))


@query(_grown_sql() + ", " + _ghosts_sql(1, _SIDES, tail=_divergence(_across(2), convection="case when axis = 0 then s0 else -0.5 * s1 end", diffusion="-0.25 * (s1 - s0) / h")))
def flux_at_jumps(spark, sf):
    """At a jump the coarser side is its predicted cell; borders take part."""
    return _flux(spark, sf, 1, 2, {"convection": schemes.upwind_flux([1.0, -0.5]), "diffusion": schemes.diffusion_flux(0.25)})


@query(_grown_sql(2) + ", " + _ghosts_sql(2, _SIDES, tail=_divergence(_kids_across(), convection="case when axis = 0 then s0 else -0.5 * s1 end", diffusion="-0.25 * (s1 - s0) / h")))
def flux_finer(spark, sf):
    """Fluxes of all faces one level finer: two sub-faces with predicted sides."""
    return _flux(spark, sf, 2, 2, {"convection": schemes.upwind_flux([1.0, -0.5]), "diffusion": schemes.diffusion_flux(0.25)}, finer=1, max_level=TOP)


def _weno(values: list[str]) -> str:
    """The face value in SQL, from five values, those behind first."""
    return _weno_face(*values)


@query(_grown_sql(3) + ", " + _ghosts_sql(3, _SIDES, tail=_divergence(_across(6), r=f"case when axis = 0 then {_weno(['s0', 's1', 's2', 's3', 's4'])} else -0.5 * {_weno(['s5', 's4', 's3', 's2', 's1'])} end")))
def convection_weno5_levels(spark, sf):
    """Fifth-order faces on all levels."""
    return _flux(spark, sf, 3, 6, {"r": schemes.weno5_flux([1.0, -0.5])})


def _two(leaves: DataFrame) -> DataFrame:
    return valued(leaves).withColumn("v", F.col("u") * 2 - 20)


# u and v = 2 u - 20, so ghosts of v follow; the axis's own component, and products picked by its mean's sign.
_VECTOR = f"""two as (select *, {', '.join(f"s{n} as us{n}, 2 * s{n} - 20 as vs{n}, case when axis = 0 then s{n} else 2 * s{n} - 20 end as own{n}" for n in range(6))} from across),
picked as (select *, {', '.join(f"case when own2 + own3 >= 0 then own{n} * {c}s{n} else own{5 - n} * {c}s{5 - n} end as {c}p{n}" for c in "uv" for n in range(5))} from two)"""


@query(_grown_sql(3) + ", " + _ghosts_sql(3, _SIDES, tail=_divergence(f"{_across(6)}, {_VECTOR}", r_u=_weno([f"up{n}" for n in range(5)]), r_v=_weno([f"vp{n}" for n in range(5)])).replace("from across), part", "from picked), part")))
def convection_weno5_levels_vector(spark, sf):
    """u times u for a vector (u, v), on all levels."""
    v = [ghosts.fixed(F.col("y") * 20 - 20, directions=X_SIDES), ghosts.slope(6.0, directions=Y_SIDES)]
    border = ghosts.Border(_border().conditions | {"v": v})
    names = ["u", "v"]
    return _flux(spark, sf, 3, 6, {f"r_{n}": schemes.weno5_nonlinear_flux(names, n) for n in names}, border, _two)


# Streaming across levels


#: Four velocities of a plane; distributions are multiples of the field's value.
SCHEME = lattice.Scheme([(1, 0), (0, 1), (-1, 0), (0, -1)], [[1, 1, 1, 1], [1, 0, -1, 0], [0, 1, 0, -1], [1, -1, 1, -1]], [0.0, 1.0, 1.0, 1.0], lambda m: [m[0], m[0] * 0.25, m[0] * 0.125, m[0] * 0])


def _transport_rows() -> str:
    rows = [(m, n, i, j, w * (n + 1)) for m in range(LOW, TOP + 1) for n, v in enumerate(SCHEME.velocities) for (i, j), w in lattice.transport(1, TOP - m, v).items()]
    return ", ".join(f"({m}, {n}, {i}, {j}, {w!r})" for m, n, i, j, w in rows)


_STREAMED = f" , form as (select * from (values {_transport_rows()}) t(level, n, oi, oj, w)), got as (select l.level, l.i, l.j, f.n, sum(f.w * v.u) as s from leaf l join form f on f.level = l.level join whole v on v.level = l.level and v.i = l.i + f.oi and v.j = l.j + f.oj group by l.level, l.i, l.j, f.n) select level, i, j, {', '.join(f'round(max(s) filter (where n = {n}) + 1e-8, 6) as f{n}' for n in range(4))} from got group by level, i, j"


@query(_grown_sql(2) + ", " + _ghosts_sql(2, "v0", tail=_STREAMED))
def lattice_stream_levels(spark, sf):
    """A step of four velocities on all levels; nothing changes across the borders."""
    leaves = grown(spark, sf, 2)
    field = valued(leaves).select(*CELL, *((F.col("u") * (n + 1)).alias(f"f{n}") for n in range(4)))
    border = ghosts.Border({f"f{n}": [ghosts.slope(0.0)] for n in range(4)})
    values = ghosts.ghost_values(field, _config(2), border, *SCHEME.names)
    out = lattice.stream_levels(field, values, SCHEME, TOP)
    return out.select("level", *IJ, *(_rounded(n, 6) for n in SCHEME.names))


# Implicit steps


def _burgers(d: int, l: dict, r: dict, h):
    """u * u / 2 upwind with viscosity; smooth enough for Newton's method."""
    mean = (l["u"] + r["u"]) / 2
    return mean * mean / 2 - (F.lit(12.0) + 0.02 / h) * (r["u"] - l["u"])


RATE = 1e5


def _implicit_residual(leaves: DataFrame, old: DataFrame):
    """Volumes times RATE (u - old) + div flux(u)."""

    def residual(field: DataFrame) -> DataFrame:
        flow = schemes.flux_scheme(leaves, field, 2, _burgers, "u")
        both = field.select(*CELL, "u").join(old.select(*CELL, F.col("u").alias("old")), CELL).join(flow, CELL)
        return both.select(*CELL, ((RATE * (F.col("u") - F.col("old")) + F.col("r")) * F.pow(F.lit(0.25), F.col("level"))).alias("r"))

    return residual


@query(_grown_sql() + " select level, i, j, u from leaf")
def burgers_implicit(spark, sf):
    """One implicit step of a viscous Burgers equation by Newton's method over the whole mesh, and back: the step's own
    equation, applied to its result, gives the field it began with."""
    leaves = grown(spark, sf).checkpoint()
    old = valued(leaves).checkpoint()
    new = solve.newton(old, _implicit_residual(leaves, old), lambda f: solve.flux_jacobian(leaves, f, 2, _burgers, "u", shift=RATE), tolerance=1e-9, inner=1e-5)
    flow = schemes.flux_scheme(leaves, new, 2, _burgers, "u")
    return new.join(flow, CELL).select("level", *IJ, F.round(F.col("u") + F.col("r") / RATE, 4).alias("u"))


@query(_grown_sql() + " select level, i, j, u from leaf")
def heat_residual(spark, sf):
    """An implicit heat step on many levels by conjugate gradients, nothing passing the borders, and back."""
    leaves = grown(spark, sf).checkpoint()
    old = valued(leaves)
    a = solve.diffusion_matrix(leaves, leaves, 2, dirichlet=False, shift=RATE)
    rhs = old.select(solve.cell_id().alias("id"), (F.col("u") * RATE * F.pow(F.lit(0.25), F.col("level"))).alias("v"))
    new = solve.on_cells(solve.conjugate_gradient(a, rhs, 1e-9), leaves).checkpoint()
    return new.join(schemes.diffusion(leaves, new, 2), CELL).select("level", *IJ, F.round(F.col("u") + F.col("r") / RATE, 4).alias("u"))


# Multigrid and block systems


def _poisson(leaves: DataFrame) -> DataFrame:
    return solve.diffusion_matrix(leaves, leaves, 2, dirichlet=False, shift=1.0)


@query(_grown_sql() + " select level, i, j, u from leaf")
def poisson_preconditioned(spark, sf):
    """u - div grad u = the field, on all levels, by BiCGStab with V-cycles over coarsened meshes; returns what the equation gives
    for the result."""
    leaves = grown(spark, sf).checkpoint()
    rhs = valued(leaves).select(solve.cell_id().alias("id"), (F.col("u") * F.pow(F.lit(0.25), F.col("level"))).alias("v"))
    grids = multigrid.hierarchy(leaves, _poisson, LOW - 1)
    new = solve.on_cells(solve.bicgstab(grids.matrix, rhs, 1e-10, precondition=lambda v: multigrid.cycle(grids, v)), leaves).checkpoint()
    return new.join(schemes.diffusion(leaves, new, 2), CELL).select("level", *IJ, F.round(F.col("u") + F.col("r"), 3).alias("u"))


COUPLING = 3e4


@query(_grown_sql() + " select level, i, j, u, 20 - u as p from leaf")
def control_blocks(spark, sf):
    """State u and adjoint p of a controlled heat step, coupled both ways, with rows for the borders of both; and back.

    u has the value 10 y left and right and the slope 3 above and below, p is zero at all borders.
    """
    leaves = grown(spark, sf).checkpoint()
    kinds = {0: lambda axis, side: ("value", centre(F.col("level"), F.col("j")) * 10) if axis == 0 else ("slope", 3.0), 1: lambda axis, side: ("value", 0.0)}
    rows = [blocks.border_rows(leaves, 2, b, 2 + 4 * b, LOW, kinds[b]) for b in (0, 1)]
    parts = [blocks.diffusion(leaves, 2, b, shift=RATE) for b in (0, 1)] + [blocks.mass(leaves, 2, 0, 1, -COUPLING), blocks.mass(leaves, 2, 1, 0, COUPLING)] + [m for m, _ in rows]
    volume = F.pow(F.lit(0.25), F.col("level")) * RATE
    old = valued(leaves)
    right = [old.select(blocks.unknown(0).alias("id"), (F.col("u") * volume).alias("v")), old.select(blocks.unknown(1).alias("id"), ((20 - F.col("u")) * volume).alias("v"))]
    union = lambda x: reduce(DataFrame.unionByName, x)
    new = blocks.solve(union(parts), union(right + [r for _, r in rows]), [1, 6, 7, 8, 9], 1e-10).checkpoint()
    at = lambda b: new.where(F.col("id.block") == b).select("id.level", "id.i", "id.j", "id.k", F.col("v"))
    u, p = at(0).withColumnRenamed("v", "u"), at(1).withColumnRenamed("v", "p")
    inner = schemes.diffusion(leaves, u, 2).join(schemes.diffusion(leaves, p, 2, name="p").withColumnRenamed("r", "rp"), CELL)
    # through the borders, from their conditions and the cells inside only
    edges = union([mesh.border_leaves(leaves, LOW, d).withColumn("axis", F.lit(0 if d[0] else 1)) for d in directions(2)]).join(u, CELL).join(p, CELL)
    h2 = F.pow(F.lit(4.0), F.col("level"))
    out_u = F.when(F.col("axis") == 0, 2 * (F.col("u") - centre(F.col("level"), F.col("j")) * 10)).otherwise(-3 * F.pow(F.lit(0.5), F.col("level"))) * h2
    out = edges.groupBy(*CELL).agg(F.sum(out_u).alias("bu"), F.sum(2 * F.col("p") * h2).alias("bp"))
    both = u.join(p, CELL).join(inner, CELL).join(out, CELL, "left").fillna(0.0, ["bu", "bp"])
    back = lambda own, other, flow, border, sign: F.round(F.col(own) + (F.col(flow) + F.col(border) + sign * COUPLING * F.col(other)) / RATE, 4).alias(own)
    return both.select("level", *IJ, back("u", "p", "r", "bu", -1), back("p", "u", "rp", "bp", 1))


# Diffusive balance


ROUNDS_OF_FLOW = 6
_PARTS = f"""part as (select *, ((i >> (level - 2)) * 4 + (j >> (level - 2)))::int as part from leaf),
{FACES.strip()},
pair as (select distinct a.part as a, b.part as b, f.ll, f.li, f.lj, f.rl, f.ri, f.rj from face f join part a on a.level = f.ll and a.i = f.li and a.j = f.lj join part b on b.level = f.rl and b.i = f.ri and b.j = f.rj where a.part <> b.part),
beside as (select a as part, b as other, ll as level, li as i, lj as j from pair union select b, a, rl, ri, rj from pair),
near as (select distinct part as a, other as b from beside),
rated as (select a, b, 1 + greatest((select count(*) from near x where x.a = n.a), (select count(*) from near x where x.a = n.b)) as rate from near n),
run as (select 0 as n, a, b, rate, 0.0::double as flow, (select count(*) from part where part = a)::double as own, (select count(*) from part where part = b)::double as theirs from rated
  union all select n + 1, a, b, rate, flow + (theirs - own) / rate, own + (select sum((x.theirs - x.own) / x.rate) from run x where x.a = r.a), theirs + (select sum((x.theirs - x.own) / x.rate) from run x where x.a = r.b) from run r where n < {ROUNDS_OF_FLOW}),
flows as (select a, b, case when abs(flow) < 0.01 * (select count(*) / count(distinct part) from part) then 0 else flow end as flow from run where n = {ROUNDS_OF_FLOW})"""


def _in_blocks(spark, sf) -> DataFrame:
    """The mesh dealt to sixteen blocks of the plane, each cell of weight one: so of unequal load."""
    leaves = grown(spark, sf).checkpoint()
    block = lambda a: F.call_function("shiftright", F.col(a), F.col("level") - 2)
    return leaves.select(*CELL, (block("i") * 4 + block("j")).alias("part"), F.lit(1).alias("weight"))


@query(_grown_sql() + ", " + _PARTS + " select a, b, round(flow + 1e-8, 6) as flow from flows")
def balance_flows(spark, sf):
    """What neighbouring parts should hand to one another."""
    dealt = _in_blocks(spark, sf)
    flows = partition.diffusion_flows(partition.loads(dealt), partition.part_graph(dealt, 2), ROUNDS_OF_FLOW)
    return flows.select("a", "b", _rounded("flow", 6))


@query(_grown_sql() + ", " + _PARTS + f""", given as (select b as part, a as other, flow * least(1.0, 0.9 * (select count(*) from part p where p.part = f.b) / sum(flow) over (partition by b)) as flow from flows f where flow > 0),
picked as (select b.part, min(b.other) as other, b.level, b.i, b.j from beside b join given g on g.part = b.part and g.other = b.other group by b.part, b.level, b.i, b.j),
taken as (select p.*, count(*) over (partition by part, other order by i << ({TOP} - level), j << ({TOP} - level), level rows unbounded preceding) as n from picked p)
select p.level, p.i, p.j, coalesce(t.other, p.part) as part from part p left join (select t.* from taken t join given g on g.part = t.part and g.other = t.other where t.n <= g.flow) t on t.level = p.level and t.i = p.i and t.j = p.j""")
def balance_moved(spark, sf):
    """Cells at the borders of parts move along the flows."""
    dealt = _in_blocks(spark, sf)
    flows = partition.diffusion_flows(partition.loads(dealt), partition.part_graph(dealt, 2), ROUNDS_OF_FLOW)
    order = [F.call_function("shiftleft", F.col(a), F.lit(TOP) - F.col("level")) for a in "ij"]
    return partition.diffuse(dealt, flows, 2, order).select("level", *IJ, "part")
