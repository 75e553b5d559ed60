"""One query for each operator, on the lenses; SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import curves, stencils
from tessera.functions.levels import CELL, centre, length
from tessera.functions.prediction import descendant
from tessera.operators import boundary, boxes, fields, intervals, lattice, mesh, multires, partition, schemes, sets, solve
from tessera.sources import tables
from tessera.streaming import loops

from . import lenses
from .lenses import LEVEL, SIDE
from .session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

IJ = ["i", "j"]
CONFIG = mesh.Config(dim=2, min_level=4, max_level=LEVEL, epsilon=2.0, regularity=0.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with {lenses.SQL.strip()}{' ' if sql.startswith('select') else ', '}{sql}"
        return f

    return add


def _area(spark: SparkSession) -> DataFrame:
    return mesh.pyramid(mesh.cells_of_boxes(spark, LEVEL, [((0, 0), (SIDE, SIDE))]), range(CONFIG.min_level, LEVEL + 1), 2)


def _limits(spark: SparkSession) -> DataFrame:
    return multires.domain_limits(spark, CONFIG, (0, 0), (SIDE, SIDE), LEVEL)


def _cells(s: sets.CellSet) -> DataFrame:
    return s.cells().select("level", *IJ)


# Sets


@query("select 14 as level, * from (select i, j from a intersect select i, j from b)")
def set_intersection(spark, sf):
    return _cells(sets.intersection(lenses.sparse(spark, sf, "a"), lenses.sparse(spark, sf, "b")))


@query("select 14 as level, * from (select i, j from a union select i, j from b union select i, j from c)")
def set_union(spark, sf):
    return _cells(sets.union(*(lenses.sparse(spark, sf, w) for w in "abc")))


@query("select 14 as level, * from ((select i, j from a except select i, j from b) except select i, j from c)")
def set_difference(spark, sf):
    return _cells(sets.difference(*(lenses.sparse(spark, sf, w) for w in "abc")))


@query("select distinct 12 as level, i >> 2 as i, j >> 2 as j from c")
def set_coarsen(spark, sf):
    return _cells(lenses.sparse(spark, sf, "c").on(12))


@query("select distinct 12 as level, (i - 32) >> 2 as i, (j - 32) >> 2 as j from c")
def set_coarsen_negative(spark, sf):
    return _cells(lenses.sparse(spark, sf, "c").translate(-32, -32).on(12))


@query("select 16 as level, (j * 4 + y.d)::int as j, count(*)::bigint as cells, min(i * 4)::int as first, max(i * 4 + 3)::int as last from (select i, j from c), range(4) x(e), range(4) y(d) group by all")
def set_refine(spark, sf):
    return lenses.sparse(spark, sf, "c").on(16).cells().groupBy("level", "j").agg(F.count("*").alias("cells"), F.min("i").alias("first"), F.max("i").alias("last"))


@query("select distinct 13 as level, i, j from (select i >> 1 as i, j >> 1 as j from (select i, j from a intersect select i + 3 as i, j - 2 as j from b))")
def set_translate_on(spark, sf):
    return _cells(sets.intersection(lenses.sparse(spark, sf, "a"), lenses.sparse(spark, sf, "b").translate(3, -2)).on(13))


@query("select distinct 14 as level, (i + x.e)::int as i, (j + y.d)::int as j from c, range(-2, 3) x(e), range(-2, 3) y(d)")
def set_expand(spark, sf):
    return _cells(lenses.sparse(spark, sf, "c").expand(2))


@query("select distinct 14 as level, (i + x.e)::int as i, (j + y.d)::int as j from c, range(-1, 2) x(e), range(-3, 4) y(d)")
def set_expand_widths(spark, sf):
    return _cells(lenses.sparse(spark, sf, "c").expand((1, 3)))


@query("select distinct 14 as level, i, (j + y.d)::int as j from c, range(-2, 3) y(d)")
def set_expand_axis(spark, sf):
    return _cells(lenses.sparse(spark, sf, "c").expand(2, (False, True)))


@query("x as (select i, j from b intersect select i + 1, j from b intersect select i - 1, j from b) select 14 as level, * from (select i, j from x intersect select i, j + 1 from x intersect select i, j - 1 from x)")
def set_contract(spark, sf):
    return _cells(lenses.sparse(spark, sf, "b").contract(1))


@query("select 12 as level, y, (x_start + 1)::int as x_start, (x_end - 1)::int as x_end from runs1 where x_end - x_start > 2")
def set_shrink(spark, sf):
    return sets.of_table(lenses.orders_intervals(spark, sf), 12).shrink(1).table.select("level", "y", "x_start", "x_end")


@query("select 14 as level, i, j from a where i between 10 and 999 and j between 2 and 49")
def set_box(spark, sf):
    return _cells(sets.intersection(lenses.sparse(spark, sf, "a"), sets.of_box(spark, 14, (10, 2), (1000, 50))))


@query("select 15 as level, * from (select distinct (i * 2 + x.e)::int as i, (j * 2 + y.d)::int as j from c, range(2) x(e), range(2) y(d) except select (i * 8 + x.e)::int, (j * 8 + y.d)::int from (select distinct i >> 2 as i, j >> 2 as j from b), range(8) x(e), range(8) y(d))")
def set_levels_differ(spark, sf):
    low = lenses.sparse(spark, sf, "b").on(12)
    return _cells(sets.difference(lenses.sparse(spark, sf, "c").on(15), low))


# Intervals


@query("select 12 as level, y, x_start, x_end from runs1")
def interval_normalise(spark, sf):
    return intervals.normalise(lenses.orders_intervals(spark, sf)).select("level", "y", "x_start", "x_end")


@query("select xs >> 3 as x_start, ((xe - 1) >> 3) + 1 as x_end, count(*)::bigint as n from n1 group by all")
def interval_coarser(spark, sf):
    return intervals.coarser(lenses.orders_intervals(spark, sf), 3).groupBy("x_start", "x_end").agg(F.count("*").alias("n"))


@query("select floor(xs / 5.0)::int as x_start, (case when floor(xs / 5.0) = floor(xe / 5.0) then floor(xe / 5.0) + 1 else floor(xe / 5.0) end)::int as x_end, count(*)::bigint as n from n1 group by all")
def interval_divide(spark, sf):
    return intervals.divide(lenses.orders_intervals(spark, sf), 5).groupBy("x_start", "x_end").agg(F.count("*").alias("n"))


@query("select 12 as level, sum(x_end - x_start)::bigint as cells, count(*)::bigint as intervals, count(distinct y)::bigint as rows, min(x_end - x_start)::int as shortest, max(x_end - x_start)::int as longest from runs1")
def interval_statistics(spark, sf):
    return intervals.statistics(intervals.normalise(lenses.orders_intervals(spark, sf))).drop("json")


@query("select 12 as level, min(x_start) as x_min, max(x_end) as x_max, min(y) as y_min, max(y) + 1 as y_max, sum(x_end - x_start)::bigint as cells, sum(x_end - x_start) = (max(x_end) - min(x_start)) * (max(y) + 1 - min(y)) as is_box from runs1")
def interval_bounds(spark, sf):
    df = intervals.normalise(lenses.orders_intervals(spark, sf))
    return intervals.bounds(df).join(intervals.is_box(df), "level").drop("z_min", "z_max")


@query("select y, count(*)::bigint as odd from cells1 where x % 2 <> 0 group by y")
def interval_odd(spark, sf):
    return intervals.parity(intervals.to_cells(intervals.normalise(lenses.orders_intervals(spark, sf))), True).groupBy(F.col("j").alias("y")).agg(F.count("*").alias("odd"))


@query("p as (select distinct (event_id % 3000)::int i, (user_id % 16)::int j from events) select p.i, p.j, x_start, x_end from p left join runs1 on y = j and x_start <= i and i < x_end")
def interval_of_point(spark, sf):
    p = lenses.table(spark, sf, "events").select(F.lit(12).alias("level"), (F.col("event_id") % 3000).cast("int").alias("i"), (F.col("user_id") % 16).cast("int").alias("j"), F.lit(0).alias("k")).distinct()
    return intervals.interval_of(intervals.normalise(lenses.orders_intervals(spark, sf)), p).select("i", "j", "x_start", "x_end")


# Search, stencils, faces


@query("select p.i, p.j, coalesce(c.level, f.level) as leaf from points p left join mesh c on c.level = 5 and c.i = p.i >> 1 and c.j = p.j >> 1 left join mesh f on f.level = 6 and f.i = p.i and f.j = p.j")
def find_cell(spark, sf):
    return mesh.find_cell(lenses.points(spark, sf), lenses.mesh(spark, sf), range(4, 7), LEVEL).select(*IJ, "leaf")


@query("select g.i, g.j, (g.u + w.u + e.u + s.u + n.u) as total from grid g join grid w on w.i = g.i - 1 and w.j = g.j join grid e on e.i = g.i + 1 and e.j = g.j join grid s on s.i = g.i and s.j = g.j - 1 join grid n on n.i = g.i and n.j = g.j + 1")
def stencil_star(spark, sf):
    g = lenses.grid(spark, sf)
    return mesh.stencil_values(g, g, stencils.star(2)).select(*IJ, sum((F.col(f"u_{n}") for n in range(1, 5)), F.col("u_0")).alias("total")).where("total is not null")


FACES = """
same as (select 0 as axis, l.level as level, l.level as ll, l.i as li, l.j as lj, r.level as rl, r.i as ri, r.j as rj from mesh l join mesh r on r.level = l.level and r.i = l.i + 1 and r.j = l.j
 union all select 1, l.level, l.level, l.i, l.j, r.level, r.i, r.j from mesh l join mesh r on r.level = l.level and r.i = l.i and r.j = l.j + 1),
jump as (select x.axis, f.level, x.side, f.i, f.j, c.i as ci, c.j as cj from mesh f, (values (0, 1, 1, 0), (0, -1, -1, 0), (1, 1, 0, 1), (1, -1, 0, -1)) x(axis, side, di, dj) join mesh c on c.level = f.level - 1 and c.i = (f.i + x.di) >> 1 and c.j = (f.j + x.dj) >> 1),
faces as (select * from same union all select axis, level, case when side > 0 then level else level - 1 end, case when side > 0 then i else ci end, case when side > 0 then j else cj end, case when side > 0 then level - 1 else level end, case when side > 0 then ci else i end, case when side > 0 then cj else j end from jump),
vals as (select f.*, l.u as lu, r.u as ru, pow(2.0, -f.level) as h from faces f join mesh l on l.level = ll and l.i = li and l.j = lj join mesh r on r.level = rl and r.i = ri and r.j = rj)
"""


def _divergence(flux: str) -> str:
    return FACES.strip() + f", q as (select *, ({flux}) * h as q from vals), s as (select ll as level, li as i, lj as j, q from q union all select rl, ri, rj, -q from q) select m.level, m.i, m.j, round(coalesce(sum(s.q), 0) * pow(4.0, m.level), 6) as r from mesh m left join s on s.level = m.level and s.i = m.i and s.j = m.j group by m.level, m.i, m.j"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("level", *IJ, F.round("r", 6).alias("r"))


@query(FACES.strip() + " select axis, level, ll as l_level, li as l_i, lj as l_j, rl as r_level, ri as r_i, rj as r_j from faces")
def interfaces(spark, sf):
    return mesh.interfaces(lenses.mesh(spark, sf), 2).select("axis", "level", *(f"{s}_{c}" for s in "lr" for c in ("level", *IJ)))


@query("select * from (select 0 as axis, -1 as side, level, i, j from mesh where i = 0 union all select 0, 1, level, i, j from mesh where i = (1 << level) - 1 union all select 1, -1, level, i, j from mesh where j = 0 union all select 1, 1, level, i, j from mesh where j = (1 << level) - 1)")
def boundary_faces(spark, sf):
    return mesh.boundary_faces(lenses.mesh(spark, sf), _area(spark), 2).select("axis", "side", "level", *IJ)


@query("select level, i, j from mesh where level = 6 and i >= 61")
def boundary_layer(spark, sf):
    m = lenses.mesh(spark, sf).where("level = 6").select(*CELL)
    return mesh.boundary(m, _area(spark).where("level = 6"), (1, 0, 0), 3).select("level", *IJ)


@query("select 6 as level, * from (values (0, 0, -1, -1), (0, 63, -1, 1), (63, 0, 1, -1), (63, 63, 1, 1)) t(i, j, di, dj)")
def corner_cells(spark, sf):
    return mesh.corners(_area(spark).where("level = 6"), 2).select("level", *IJ, "di", "dj")


# Meshes


@query("select distinct x.l::int as level, i >> (level - x.l)::int as i, j >> (level - x.l)::int as j from mesh, range(0, 6) x(l) where x.l < level")
def mesh_ancestors(spark, sf):
    return mesh.ancestors(lenses.mesh(spark, sf)).select("level", *IJ)


@query("p as (select distinct 12 as level, i >> 2 as i, j >> 2 as j from c union select 13, i >> 1, j >> 1 from c union select 14, i, j from c union all select 15, (i * 2 + x.e)::int, (j * 2 + y.d)::int from c, range(2) x(e), range(2) y(d)) select level, i, j from p")
def mesh_pyramid(spark, sf):
    return mesh.pyramid(lenses.sparse_cells(spark, sf, "c"), range(12, 16), 2, lenses.lines(spark, sf)).select("level", *IJ)


@query("select distinct level, (i + x.e)::int as i, (j + y.d)::int as j from mesh, range(-1, 2) x(e), range(-1, 2) y(d)")
def mesh_ghosts(spark, sf):
    return mesh.reference_tables(lenses.mesh(spark, sf), CONFIG)["cells_and_ghosts"].select("level", *IJ)


@query("select 6 as level, (i * 2 + x.e)::int as i, (j * 2 + y.d)::int as j from mesh, range(2) x(e), range(2) y(d) where level = 5")
def mesh_overleaves(spark, sf):
    return mesh.overleaves(lenses.mesh(spark, sf), CONFIG).select("level", *IJ)


@query("select s.i, s.j, m.i is not null as there from square s left join mesh m on m.level = 6 and m.i = s.i and m.j = s.j")
def mesh_exists(spark, sf):
    return mesh.exists(_area(spark).where("level = 6"), lenses.mesh(spark, sf)).select(*IJ, "there")


@query("select round(sum(pow(0.25, level) * (i + 0.5) * pow(0.5, level)) / sum(pow(0.25, level)), 9) as c_i, round(sum(pow(0.25, level) * (j + 0.5) * pow(0.5, level)) / sum(pow(0.25, level)), 9) as c_j from mesh")
def gravity_centre(spark, sf):
    return mesh.gravity_centre(lenses.mesh(spark, sf), 2).select(F.round("c_i", 9).alias("c_i"), F.round("c_j", 9).alias("c_j"))


TAGS = "t as (select level, i, j, (case when i % 7 = 0 then 4 when (i >> 1) % 3 = 0 then 2 when j % 5 = 0 then 1 else 0 end) as tag from mesh)"


def _tags(spark, sf):
    tag = F.when(F.col("i") % 7 == 0, 4).when(F.shiftright("i", 1) % 3 == 0, 2).when(F.col("j") % 5 == 0, 1).otherwise(0)
    return lenses.mesh(spark, sf).select(*CELL, tag.alias("tag"))


@query(TAGS + " select distinct * from (select level + 1 as level, (i * 2 + x.e)::int as i, (j * 2 + y.d)::int as j from t, range(2) x(e), range(2) y(d) where tag = 4 and level < 6 union all select level - 1, i >> 1, j >> 1 from t where tag = 2 and level > 4 union all select level, i, j from t where (tag = 4 and level = 6) or tag in (0, 1))")
def leaves_from_tags(spark, sf):
    return mesh.from_tags(_tags(spark, sf), CONFIG).select("level", *IJ)


@query(TAGS + " select distinct * from (select level + 1 as level, (i * 2 + x.e)::int as i, (j * 2 + y.d)::int as j from t, range(2) x(e), range(2) y(d) where tag = 4 and level < 6 union all select level - 1, i >> 1, j >> 1 from t where tag = 2 and level > 4 union all select level, i, j from t where (tag = 4 and level = 6) or tag = 1)")
def leaves_from_tags_strict(spark, sf):
    return mesh.from_tags_strict(_tags(spark, sf), CONFIG).select("level", *IJ)


@query("select distinct 4 as level, s.i, s.j from (select distinct (c.i + x.e) >> 2 as i, (c.j + y.d) >> 2 as j from mark c, (values (-2), (-1), (0), (1), (2)) x(e), (values (-2), (-1), (0), (1), (2)) y(d)) s where s.i between 0 and 15 and s.j between 0 and 15")
def too_coarse_leaves(spark, sf):
    leaves = lenses.marked(spark, sf).unionByName(mesh.cells_of_boxes(spark, 4, [((0, 0), (16, 16))]))
    return mesh.too_coarse(leaves, 2, 1).select("level", *IJ)


@query()
def graduated_mesh(spark, sf):
    fine = lenses.marked(spark, sf)
    coarse = mesh.cells_of_boxes(spark, 3, [((0, 0), (8, 8))]).join(mesh.ancestors(fine, 3), CELL, "left_anti")
    rest = mesh.refine(mesh.ancestors(fine, 3), 1, 2)
    leaves = coarse.unionByName(rest.join(mesh.ancestors(fine, 3), CELL, "left_anti").where("level <= 6")).unionByName(fine)
    return mesh.graduate(leaves.distinct(), 2).select("level", *IJ)


# Fields


@query("select level, i, j, u * 2 + 1 - u / 4 as v from mesh")
def field_expression(spark, sf):
    return lenses.mesh(spark, sf).select("level", *IJ, (F.col("u") * 2 + 1 - F.col("u") / 4).alias("v"))


@query("select level, i, j, round(pow((i + 0.5) * pow(0.5, level), 2) + pow(0.25, level) / 12 + (j + 0.5) * pow(0.5, level), 9) as u from mesh")
def field_quadrature(spark, sf):
    q = fields.quadrature(2, 2, lambda x, y: x * x + y)
    return fields.make_field(lenses.mesh(spark, sf), F.round(q, 9)).select("level", *IJ, "u")


@query("select g.i, g.j, case when c.i is null then g.u else -g.u end as u from grid g left join mark c on c.i = g.i and c.j = g.j")
def field_copy(spark, sf):
    g = lenses.grid(spark, sf)
    return fields.copy(g, g.withColumn("u", -F.col("u")), lenses.marked(spark, sf), ["u"]).select(*IJ, "u")


@query("select g.i, g.j, g.u from grid g join mark c on c.i = g.i and c.j = g.j")
def field_extract(spark, sf):
    return fields.extract(lenses.grid(spark, sf), lenses.marked(spark, sf)).select(*IJ, "u")


@query("select round(sqrt(sum(pow(u - 3, 2) * pow(0.25, level))), 6) as error from mesh")
def field_error(spark, sf):
    e = fields.l2_error(lenses.mesh(spark, sf), lambda x, y: F.lit(3.0), 2)
    return spark.createDataFrame([(round(e, 6),)], "error double")


# Multiresolution


@query("select 5 as level, i >> 1 as i, j >> 1 as j, sum(u) / 4 as u, sum(u * u) / 4 as v from grid group by all")
def project(spark, sf):
    return multires.project(lenses.grid(spark, sf).withColumn("v", F.col("u") * F.col("u")), 2, "u", "v").select("level", *IJ, "u", "v")


@query("select x.l::int as level, i >> (level - x.l)::int as i, j >> (level - x.l)::int as j, sum(u * pow(0.25, level - x.l)) as u from mesh, range(0, 6) x(l) where x.l < level group by x.l, i >> (level - x.l)::int, j >> (level - x.l)::int")
def project_all_levels(spark, sf):
    return multires.project_all(lenses.mesh(spark, sf), 2, 0, "u").select("level", *IJ, "u")


PREDICT = """w as (select * from (values (0, -1, 0.125), (0, 0, 1.0), (0, 1, -0.125), (1, -1, -0.125), (1, 0, 1.0), (1, 1, 0.125)) t(p, o, w)),
guess as (select 7 as level, (g.i * 2 + a.p)::int as i, (g.j * 2 + b.p)::int as j, sum(a.w * b.w * n.u)::double as u from grid g, w a, w b join grid n on n.i = least(greatest(g.i + a.o, 0), 63) and n.j = least(greatest(g.j + b.o, 0), 63) group by g.i, g.j, a.p, b.p)"""


@query(PREDICT + " select * from guess")
def predict(spark, sf):
    g = lenses.grid(spark, sf)
    return multires.predict(g, g, 2, 1, "u", limits=_limits(spark)).select("level", *IJ, "u")


DETAIL = PREDICT.replace("grid g,", "five g,").replace("grid n", "five n").replace("63", "31").replace("7 as level", "6 as level").replace("w as (", "five as (select i >> 1 as i, j >> 1 as j, sum(u) / 4 as u from grid group by i >> 1, j >> 1), w as (", 1) + ", details as (select g.i, g.j, g.u - p.u as d from grid g join guess p on p.i = g.i and p.j = g.j)"


def _details(spark, sf):
    g = lenses.grid(spark, sf)
    return multires.detail(g, multires.project(g, 2, "u"), 2, 1, "u", limits=_limits(spark))


@query(DETAIL + " select 6 as level, i, j, d as d_u from details")
def detail(spark, sf):
    return _details(spark, sf).select("level", *IJ, "d_u")


@query(DETAIL + " select 6 as level, max(abs(d)) as max_u from details")
def max_detail(spark, sf):
    return multires.max_detail(_details(spark, sf), "u")


@query(DETAIL + " select 6 as level, i, j, round(d / (select max(abs(u)) from grid), 9) as d_u from details")
def relative_detail(spark, sf):
    return multires.relative(_details(spark, sf), lenses.grid(spark, sf), "u").select("level", *IJ, F.round("d_u", 9).alias("d_u"))


@query(DETAIL + ", f as (select *, max(abs(d)) over (partition by i >> 1, j >> 1) as m from details) select i, j, case when m <= 40.0 then 2 else 1 end as tag from f")
def criteria(spark, sf):
    return multires.criteria(_details(spark, sf), mesh.Config(dim=2, min_level=4, max_level=LEVEL, epsilon=40.0), "u").select(*IJ, "tag")


@query(TAGS + ", f as (select *, max(tag % 2) over (partition by level, i >> 1, j >> 1) as keep, min((tag >> 1) % 2) over (partition by level, i >> 1, j >> 1) as up, count(*) over (partition by level, i >> 1, j >> 1) as n from t) select level, i, j, (case when keep = 1 then tag | 1 else tag end) & (case when up = 1 and n = 4 and keep = 0 then 15 else 13 end) as tag from f")
def siblings_agree(spark, sf):
    return multires.siblings_agree(_tags(spark, sf), 2).select("level", *IJ, "tag")


@query(TAGS + " select level, i, j, tag | max(tag & 1) over (partition by level, i >> 1, j >> 1) as tag from t")
def keep_children_together(spark, sf):
    return multires.keep_children_together(_tags(spark, sf)).select("level", *IJ, "tag")


@query(TAGS + ", near as (select distinct level, (i + x.e)::int as i, (j + y.d)::int as j from t, range(-1, 2) x(e), range(-1, 2) y(d) where tag & 4 <> 0) select t.level, t.i, t.j, t.tag | (case when n.i is null then 0 else 1 end) as tag from t left join near n on n.level = t.level and n.i = t.i and n.j = t.j")
def keep_around_refine(spark, sf):
    return multires.keep_around_refine(_tags(spark, sf), 2).select("level", *IJ, "tag")


@query(TAGS + ", near as (select distinct level, (i + x.e)::int as i, (j + y.d)::int as j from t, range(-1, 2) x(e), range(-1, 2) y(d) where tag & 1 <> 0) select t.level, t.i, t.j, t.tag | (case when n.i is null then 0 else 8 end) as tag from t left join near n on n.level = t.level and n.i = t.i and n.j = t.j")
def enlarge(spark, sf):
    return multires.enlarge(_tags(spark, sf), 2).select("level", *IJ, "tag")


@query(TAGS + ", near as (select distinct level - 1 as level, (i + x.e) >> 1 as i, j >> 1 as j from t, (values (-1), (0), (1)) x(e) where tag & 4 <> 0) select t.level, t.i, t.j, t.tag | (case when n.i is null then 0 else 4 end) as tag from t left join near n on n.level = t.level and n.i = t.i and n.j = t.j")
def refine_above(spark, sf):
    return multires.refine_above(_tags(spark, sf), 4, 4, stencils.line(2, 0, -1, 0, 1)).select("level", *IJ, "tag")


@query("five as (select i >> 1 as i, j >> 1 as j, sum(u) / 4 as u from grid group by i >> 1, j >> 1), w as (select * from (values (0, -1, 0.125), (0, 0, 1.0), (0, 1, -0.125), (1, -1, -0.125), (1, 0, 1.0), (1, 1, 0.125)) t(p, o, w)) select m.level + 1 as level, (m.i * 2 + a.p)::int as i, (m.j * 2 + b.p)::int as j, sum(a.w * b.w * n.u)::double as u from mesh m, w a, w b join five n on n.i = least(greatest(m.i + a.o, 0), 31) and n.j = least(greatest(m.j + b.o, 0), 31) where m.level = 5 group by m.level, m.i, m.j, a.p, b.p union all select level, i, j, u from mesh where level = 6")
def reconstruct(spark, sf):
    return multires.reconstruct(lenses.mesh(spark, sf), mesh.Config(dim=2, min_level=5, max_level=LEVEL), multires.domain_limits(spark, mesh.Config(dim=2, min_level=5, max_level=LEVEL), (0, 0), (SIDE, SIDE), LEVEL), "u").select("level", *IJ, "u")


def _portion_sql() -> str:
    form = descendant(1, 2, (2, 1))
    rows = ", ".join(f"({a}, {b}, {float(w)!r})" for (a, b), w in form.items())
    return f"f as (select * from (values {rows}) t(a, b, w)) select g.i, g.j, round(sum(w * n.u)::double, 6) as value from grid g, f join grid n on n.i = g.i + f.a and n.j = g.j + f.b group by g.i, g.j having count(*) = {len(form)}"


@query(_portion_sql())
def portion(spark, sf):
    return multires.portion(lenses.grid(spark, sf), 2, (2, 1), 2, 1).select(*IJ, F.round("value", 6).alias("value"))


@query()
def adapted_field(spark, sf):
    """Means of a smooth bump, adapted."""
    x, y = fields.centres(2)
    bump = F.exp(-((x - 0.3) * (x - 0.3) + (y - 0.3) * (y - 0.3)) * 60)
    config = mesh.Config(dim=2, min_level=4, max_level=LEVEL, epsilon=1e-2, regularity=1.0)
    field = fields.make_field(_area(spark).where(f"level = {LEVEL}"), bump)
    return multires.adapt(field, config, multires.domain_limits(spark, config, (0, 0), (SIDE, SIDE), LEVEL), "u").select("level", *IJ, "u")


# Borders


@query("select 64 + n as i, j, case n when 0 then 8.0 / 3 * 5 + u0 / 3 - 2 * u1 else 8.0 * 5 + 2 * u0 - 9 * u1 end as u from (select a.j, b.u as u0, a.u as u1 from grid a join grid b on b.i = 62 and b.j = a.j where a.i = 63), (values (0), (1)) t(n)".replace("case n", "round(case n").replace("9 * u1 end", "9 * u1 end, 6)"))
def dirichlet(spark, sf):
    return boundary.dirichlet(lenses.grid(spark, sf), _area(spark).where("level = 6"), (1, 0, 0), 5.0, 2).select(*IJ, F.round("u", 6).alias("u"))


@query("select i, -1 as j, u + 2.0 / 64 as u from grid where j = 0")
def neumann(spark, sf):
    return boundary.neumann(lenses.grid(spark, sf), _area(spark).where("level = 6"), (0, -1, 0), 2.0).select(*IJ, "u")


@query("select -1 as i, a.j, 3 * a.u - 3 * b.u + c.u as u from grid a join grid b on b.i = 1 and b.j = a.j join grid c on c.i = 2 and c.j = a.j where a.i = 0")
def extrapolate(spark, sf):
    g, d = lenses.grid(spark, sf), (-1, 0, 0)
    return boundary.extrapolate(g, mesh.boundary(g.select(*CELL), g.select(*CELL), d), d, 3).select(*IJ, "u")


@query("select (i + 64 * x.e)::int as i, j, u from grid, (values (-1), (1)) x(e) where i + 64 * x.e between -2 and 65")
def periodic_ghosts(spark, sf):
    return boundary.periodic(lenses.grid(spark, sf), {"i": (0, SIDE)}, LEVEL, 2, "u").select(*IJ, "u")


# Schemes


@query(_divergence("case when axis = 0 then 1.0 * lu else -0.5 * ru end"))
def convection_upwind(spark, sf):
    m = lenses.mesh(spark, sf)
    return _rounded(schemes.convection_upwind(m, m, [1.0, -0.5]))


@query(_divergence("-0.5 * (ru - lu) / h"))
def diffusion(spark, sf):
    m = lenses.mesh(spark, sf)
    return _rounded(schemes.diffusion(m, m, 2, 0.5))


@query(_divergence("case when lu + ru >= 0 then lu * lu else ru * ru end / 2"))
def burgers_upwind(spark, sf):
    m = lenses.mesh(spark, sf)
    return _rounded(schemes.burgers_upwind(m, m, 2))


@query(_divergence("case when axis = 0 then (lu + ru) / 2 else 0 end"))
def gradient(spark, sf):
    m = lenses.mesh(spark, sf)
    return _rounded(schemes.gradient(m, m, 2).withColumnRenamed("r_0", "r"))


@query(_divergence("case when axis = 0 then (lu + ru) / 2 else (2 * lu + 2 * ru) / 2 end"))
def divergence(spark, sf):
    m = lenses.mesh(spark, sf).withColumn("v", F.col("u") * 2)
    return _rounded(schemes.divergence(m, m, ["u", "v"]))


@query("select g.i, g.j, round((g.u - w.u) * 64 + 0.5 * (g.u - s.u) * 64, 6) as r from grid g join grid w on w.i = (g.i + 63) % 64 and w.j = g.j join grid s on s.i = g.i and s.j = (g.j + 63) % 64")
def upwind_expression(spark, sf):
    g = lenses.grid(spark, sf)
    ghosts = boundary.periodic(g, {"i": (0, SIDE), "j": (0, SIDE)}, LEVEL, 1, "u")
    return _rounded(schemes.upwind_expression(g, ghosts, [1.0, 0.5])).drop("level")


def _weno_face(a: str, b: str, c: str, d: str, e: str) -> str:
    q = (f"({a}/3 - 7*{b}/6 + 11*{c}/6)", f"(-{b}/6 + 5*{c}/6 + {d}/3)", f"({c}/3 + 5*{d}/6 - {e}/6)")
    s = (f"(13*pow({a}-2*{b}+{c},2)/12 + pow({a}-4*{b}+3*{c},2)/4)", f"(13*pow({b}-2*{c}+{d},2)/12 + pow({b}-{d},2)/4)", f"(13*pow({c}-2*{d}+{e},2)/12 + pow(3*{c}-4*{d}+{e},2)/4)")
    w = [f"({k}/pow({x}+1e-6,2))" for k, x in zip((0.1, 0.6, 0.3), s)]
    return f"(({w[0]}*{q[0]} + {w[1]}*{q[1]} + {w[2]}*{q[2]})/({w[0]}+{w[1]}+{w[2]}))"


def _weno_sql() -> str:
    u = [f"u{n}" for n in range(7)]
    joins = " ".join(f"join grid g{n} on g{n}.i = g.i + {n - 3} and g{n}.j = g.j" for n in range(7))
    return f"x as (select g.i, g.j, {', '.join(f'g{n}.u as u{n}' for n in range(7))} from grid g {joins}) select i, j, round(({_weno_face(*u[1:6])} - {_weno_face(*u[0:5])}) * 64, 3) as r from x"


@query(_weno_sql())
def convection_weno5(spark, sf):
    return schemes.convection_weno5(lenses.grid(spark, sf), [1.0]).select(*IJ, F.round("r", 3).alias("r"))


@query("g as (select i, j, u as f0, u * 2 as f1, u / 2 as f2, u + 1 as f3 from grid), s as (select g.i, g.j, a.f0, b.f1, c.f2, d.f3 from g join g a on a.i = (g.i + 63) % 64 and a.j = g.j join g b on b.i = g.i and b.j = (g.j + 63) % 64 join g c on c.i = (g.i + 1) % 64 and c.j = g.j join g d on d.i = g.i and d.j = (g.j + 1) % 64), m as (select i, j, f0 + f1 + f2 + f3 as m0, f0 - f2 as m1, f1 - f3 as m2, f0 - f1 + f2 - f3 as m3 from s), e as (select i, j, m0, m1 + 1.5 * (0.25 * m0 - m1) as m1, m2 + 1.5 * (0.5 * m0 - m2) as m2, m3 + (0 - m3) as m3 from m) select i, j, round(m0 / 4 + m1 / 2 + m3 / 4, 6) as f0, round(m0 / 4 + m2 / 2 - m3 / 4, 6) as f1, round(m0 / 4 - m1 / 2 + m3 / 4, 6) as f2, round(m0 / 4 - m2 / 2 - m3 / 4, 6) as f3 from e")
def lattice_step(spark, sf):
    u = F.col("u")
    f = lenses.grid(spark, sf).select(*CELL, u.alias("f0"), (u * 2).alias("f1"), (u / 2).alias("f2"), (u + 1).alias("f3"))
    scheme = lattice.Scheme([(1, 0), (0, 1), (-1, 0), (0, -1)], [[1, 1, 1, 1], [1, 0, -1, 0], [0, 1, 0, -1], [1, -1, 1, -1]], [0.0, 1.5, 1.5, 1.0], lambda m: [m[0], m[0] * 0.25, m[0] * 0.5, F.lit(0.0)])
    ghosts = boundary.periodic(f, {"i": (0, SIDE), "j": (0, SIDE)}, LEVEL, 1, *scheme.names)
    return lattice.step(f, scheme, ghosts).select(*IJ, *(F.round(n, 6).alias(n) for n in scheme.names))


@query(_divergence("-1.0 * (ru - lu) / h").replace(" * pow(4.0, m.level)", ""))
def matrix_product(spark, sf):
    """The assembled diffusion matrix times a field is the scheme's result times the volumes."""
    m = lenses.mesh(spark, sf)
    a = solve.diffusion_matrix(m, _area(spark), 2, dirichlet=False)
    out = solve.product(a, m.select(solve.cell_id().alias("id"), F.col("u").alias("v")))
    return _rounded(solve.on_cells(out, m, "r"))


@query()
def heat_implicit(spark, sf):
    """One implicit step of the heat equation."""
    m, area = lenses.mesh(spark, sf), _area(spark)
    a = solve.diffusion_matrix(m, area, 2, shift=1e5)
    rhs = m.select(solve.cell_id().alias("id"), (F.col("u") * 1e5 * F.pow(F.lit(0.25), F.col("level"))).alias("v"))
    return solve.on_cells(solve.conjugate_gradient(a, rhs, 1e-6), m).select("level", *IJ, "u")


@query("select i, j, round(cbrt(u + 1), 6) as x from grid")
def newton_by_cell(spark, sf):
    g = lenses.grid(spark, sf).select(*CELL, (F.col("u") + 1).alias("u")).withColumn("x", F.col("u"))
    return solve.newton_by_cell(g, "x", lambda x, u: x**3 - u, lambda x, u: 3 * x**2, ["u"], 200).select(*IJ, F.round("x", 6).alias("x"))


# Parts

MORTON = "(" + " + ".join(f"((({c} >> {b}) & 1) << {2 * b + n})" for b in range(7) for n, c in enumerate("ij")) + ")"


@query(f"select i, j, {MORTON}::bigint as key from square")
def morton_key(spark, sf):
    return _area(spark).where("level = 6").select(*IJ, curves.morton(F.col("i"), F.col("j")).alias("key"))


@query()
def hilbert_key(spark, sf):
    return _area(spark).where("level = 6").select(*IJ, curves.hilbert(6, F.col("i"), F.col("j")).alias("key"))


_CUTS = f"k as (select level, i << (6 - level) as i, j << (6 - level) as j, i as oi, j as oj, u + 1 as w from mesh), o as (select *, {MORTON} as key from k), p as (select level, oi as i, oj as j, w, least(floor((sum(w) over (order by key) - w / 2) * 5 / (select sum(w) from k)), 4)::int as part from o)"


def _dealt(spark, sf):
    return partition.cuts(lenses.mesh(spark, sf), partition.curve_key(2, LEVEL), F.col("u") + 1, 5)


@query(_CUTS + " select level, i, j, part from p")
def curve_cuts(spark, sf):
    return _dealt(spark, sf).select("level", *IJ, "part")


@query(_CUTS + " select part, sum(w) as load, count(*)::bigint as cells from p group by part")
def part_loads(spark, sf):
    return _dealt(spark, sf).groupBy("part").agg(F.sum("weight").alias("load"), F.count("*").alias("cells"))


@query(FACES.strip() + ", e as (select ll, li, lj, rl, ri, rj, count(*) as n from faces group by all) select ll as l_level, li as l_i, lj as l_j, count(*)::bigint as edges, sum(n)::bigint as faces from e group by all")
def cell_graph(spark, sf):
    return partition.cell_graph(lenses.mesh(spark, sf), 2).groupBy("l_level", "l_i", "l_j").agg(F.count("*").alias("edges"), F.sum("faces").alias("faces"))


# Tables and streams


@query("e as (select distinct (i + x.e) << (6 - level) as x, (j + y.d) << (6 - level) as y from mesh, (values (0), (1)) x(e), (values (0), (1)) y(d)) select x / 64.0 as x, y / 64.0 as y from e".replace("(i + x.e)", "(i + x.e)::int").replace("(j + y.d)", "(j + y.d)::int").replace("x / 64.0", "(x / 64.0)::double").replace("y / 64.0", "(y / 64.0)::double"))
def corner_points(spark, sf):
    return tables.elements(lenses.mesh(spark, sf), 2, LEVEL)[0].select("x", "y")


@query("select i, j, u as a_u, -u as b_u from grid where u > 500")
def compare_fields(spark, sf):
    g = lenses.grid(spark, sf)
    return tables.compare(g, g.withColumn("u", F.when(F.col("u") > 500, -F.col("u")).otherwise(F.col("u"))), ["u"]).select(*IJ, "a_u", "b_u")


@query("select date_trunc('day', ts) as start, (user_id % 8)::int as i, count(*)::bigint as u from events group by all")
def windowed_cells(spark, sf):
    return loops.windowed_cells(lenses.table(spark, sf, "events"), "user_id", 8)


@query("select i, v0 + coalesce(lag(v0) over (order by i), 0) - v1 as v from vec")
def vector_field(spark, sf):
    v = lenses.vectors(spark, sf)
    left = mesh.moved(v, (1, 0, 0)).select(*CELL, F.col("v0").alias("left"))
    return v.join(left, CELL, "left").select("i", (F.col("v0") + F.coalesce("left", F.lit(0)) - F.col("v1")).alias("v"))


_UPWIND_STEP = "(select g.i, g.j, g.u - ((g.u - w.u) + (g.u - s.u)) / 2 as u from {0} g join {0} w on w.i = (g.i + 63) % 64 and w.j = g.j join {0} s on s.i = g.i and s.j = (g.j + 63) % 64)"


@query(f"once as {_UPWIND_STEP.format('grid')} select * from {_UPWIND_STEP.format('once')}")
def advection(spark, sf):
    """Two upwind steps on a periodic grid."""
    def step(field, dt):
        ghosts = boundary.periodic(field, {"i": (0, SIDE), "j": (0, SIDE)}, LEVEL, 1, "u")
        return schemes.explicit_step(field, schemes.upwind_expression(field, ghosts, [1.0, 1.0]), dt)

    return loops.march(lenses.grid(spark, sf), step, 1 / 128, 2 / 128).select(*IJ, "u")


# More on meshes


@query("select 6 as level, s.i, s.j from square s where i < 32 and j < 32 and not (i between 8 and 15 and j between 4 and 19)")
def domain_of_boxes(spark, sf):
    return mesh.domain(spark, 6, [((0, 0), (32, 32))], [((8, 4), (16, 20))]).select("level", *IJ)


@query("select 6 as level, 64 + n as i, j from range(64) x(j), (values (0), (1)) t(n)".replace("j from range", "j::int as j from range"))
def outer_layer(spark, sf):
    return mesh.outer_layer(_area(spark).where("level = 6"), (1, 0, 0), 2).select("level", *IJ)


GHOSTS = "g as (select distinct level, (i + x.e)::int as i, (j + y.d)::int as j from mesh, range(-1, 2) x(e), range(-1, 2) y(d)), up as (select distinct x.l::int as level, i >> (level - x.l)::int as i, j >> (level - x.l)::int as j from mesh, range(4, 6) x(l) where x.l < level)"


@query(GHOSTS + " select g.level, g.i, g.j, case when m.i is not null then 'cell' when up.i is not null then 'projection' when g.i < 0 or g.j < 0 or g.i >= 1 << g.level or g.j >= 1 << g.level then 'outside' else 'prediction' end as kind from g left join mesh m on m.level = g.level and m.i = g.i and m.j = g.j left join up on up.level = g.level and up.i = g.i and up.j = g.j")
def ghost_kinds(spark, sf):
    m = lenses.mesh(spark, sf)
    return mesh.ghost_kinds(mesh.with_ghosts(m, 2, 1), m, _area(spark), CONFIG).select("level", *IJ, "kind")


@query("select level, i, j, row_number() over (partition by level order by j, i) - 1 as number from mesh")
def cell_numbers(spark, sf):
    return tables.numbered(lenses.mesh(spark, sf)).select("level", *IJ, "number")


_BOXES = "bx as (select p_partkey as id, (p_partkey % 17)::int as x0, (p_partkey % 17 + 1 + p_size % 7)::int as x1, (p_size % 13)::int as y0, (p_size % 13 + 1 + p_partkey % 5)::int as y1 from part)"


def _boxes(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    low, high = F.array((key % 17).cast("int"), (size % 13).cast("int")), F.array((key % 17 + 1 + size % 7).cast("int"), (size % 13 + 1 + key % 5).cast("int"))
    return lenses.table(spark, sf, "part").select(key.alias("id"), low.alias("lo"), high.alias("hi"))


def _corners(df: DataFrame) -> DataFrame:
    return df.select("id", *(F.col(c)[n].alias(f"{a}{s}") for s, c in enumerate(("lo", "hi")) for n, a in enumerate("xy")))


@query(_BOXES + " select id, greatest(x0, 8) as x0, greatest(y0, 6) as y0, least(x1, 14) as x1, least(y1, 11) as y1 from bx where x0 < 14 and 8 < x1 and y0 < 11 and 6 < y1")
def box_intersection(spark, sf):
    return _corners(boxes.intersection(_boxes(spark, sf), (8, 6), (14, 11)))


@query(_BOXES + ", xs as (select id, greatest(x0, s.a) as x0, least(x1, s.b) as x1, s.m as mx from bx, (values (-1000, 8, 0), (8, 14, 1), (14, 1000, 0)) s(a, b, m) where greatest(x0, s.a) < least(x1, s.b)), ys as (select id, greatest(y0, s.a) as y0, least(y1, s.b) as y1, s.m as my from bx, (values (-1000, 6, 0), (6, 11, 1), (11, 1000, 0)) s(a, b, m) where greatest(y0, s.a) < least(y1, s.b)) select xs.id, x0, y0, x1, y1 from xs join ys on xs.id = ys.id where mx + my < 2")
def box_difference(spark, sf):
    return _corners(boxes.difference(_boxes(spark, sf), (8, 6), (14, 11)))


# More on tags and values


@query(TAGS + ", near as (select distinct level, (i + x.e)::int as i, (j + y.d)::int as j from t, range(-2, 3) x(e), range(-2, 3) y(d) where tag & 4 <> 0) select t.level, t.i, t.j, t.tag | (case when n.i is null then 0 else 1 end) as tag from t left join near n on n.level = t.level and n.i = t.i and n.j = t.j")
def tag_to_keep(spark, sf):
    return multires.tag_to_keep(_tags(spark, sf), 2, 2, mesh.REFINE).select("level", *IJ, "tag")


@query(TAGS + " select level, i, j, tag | (case when level = 6 and (i in (0, 63) or j in (0, 63)) then 1 else 0 end) as tag from t")
def keep_boundary_refined(spark, sf):
    return multires.keep_boundary_refined(_tags(spark, sf), _area(spark), CONFIG).select("level", *IJ, "tag")


@query("select 5 as level, i >> 1 as i, j >> 1 as j, sum(u) / 4 as u from mesh where level = 6 group by all union all select level, i, j, u from mesh where level = 5")
def transfer(spark, sf):
    return multires.transfer(lenses.mesh(spark, sf), _area(spark).where("level = 5"), CONFIG, _limits(spark), "u").select("level", *IJ, "u")


# More on borders


@query("select 64 + n as i, 64 + n as j, (n + 2) * a.u - (n + 1) * b.u as u from grid a, grid b, (values (0), (1)) t(n) where a.i = 63 and a.j = 63 and b.i = 62 and b.j = 62")
def corner_ghosts(spark, sf):
    """Two ghosts along a diagonal by the line through the last two cells."""
    g = lenses.grid(spark, sf)
    edge = mesh.corners(g.select(*CELL), 2).where("di = 1 and dj = 1").select(*CELL)
    return boundary.extrapolate(g, edge, (1, 1, 0), 2, 2).select(*IJ, "u")


@query("select 64 as i, j, u / 2 as f0, u + 1 as f1, u as f2, u * 2 as f3 from grid where i = 63")
def bounce_back(spark, sf):
    u = F.col("u")
    f = lenses.grid(spark, sf).select(*CELL, u.alias("f0"), (u * 2).alias("f1"), (u / 2).alias("f2"), (u + 1).alias("f3"))
    return boundary.bounce_back(f, _area(spark).where("level = 6"), (1, 0, 0), {"f0": "f2", "f1": "f3", "f2": "f0", "f3": "f1"}).select(*IJ, "f0", "f1", "f2", "f3")


# More schemes


def _coarsely(sql: str) -> str:
    return sql.replace(", 6) as r", ", 3) as r")


_V, _W = "((lu / 128 - 1) + (ru / 128 - 1)) / 2", "((1 - lu / 256) + (1 - ru / 256)) / 2"


def _with_velocity(spark, sf):
    return lenses.mesh(spark, sf).withColumn("v", F.col("u") / 128 - 1).withColumn("w", 1 - F.col("u") / 256)


@query(_divergence(f"case when axis = 0 then {_V} * (case when {_V} >= 0 then lu else ru end) else {_W} * (case when {_W} >= 0 then lu else ru end) end"))
def convection_upwind_field(spark, sf):
    m = _with_velocity(spark, sf)
    return _rounded(schemes.convection_upwind_field(m, m, ["v", "w"]))


def _rusanov(v: str) -> str:
    return f"({v}) * (lu + ru) / 2 - sqrt(({v}) * ({v}) + 1e-12) * (ru - lu) / 2"


@query(_coarsely(_divergence(f"case when axis = 0 then {_rusanov(_V)} else {_rusanov(_W)} end")))
def convection_rusanov(spark, sf):
    m = _with_velocity(spark, sf)
    return schemes.convection_rusanov(m, m, ["v", "w"]).select("level", *IJ, F.round("r", 3).alias("r"))


@query(_coarsely(_divergence("-2 * (lu + 1) * (ru + 1) / (lu + ru + 2) * (ru - lu) / h")))
def diffusion_field(spark, sf):
    m = lenses.mesh(spark, sf).withColumn("c", F.col("u") + 1)
    return schemes.diffusion(m, m, 2, "c").select("level", *IJ, F.round("r", 3).alias("r"))


@query(_divergence("-1.0 * (ru - lu) / h").replace("as r from mesh", "as r_u, round(coalesce(sum(s.q), 0) * pow(4.0, m.level), 6) as r_v from mesh"))
def multi_diffusion(spark, sf):
    m = lenses.mesh(spark, sf).withColumn("v", F.col("u") * 2)
    return schemes.multi_diffusion(m, m, 2, {"u": 1.0, "v": 0.5}).select("level", *IJ, F.round("r_u", 6).alias("r_u"), F.round("r_v", 6).alias("r_v"))


@query(_divergence("(case when axis = 0 then 1.0 * lu else -0.5 * ru end) - 0.5 * (ru - lu) / h"))
def operator_sum(spark, sf):
    m = lenses.mesh(spark, sf)
    return _rounded(schemes.operator_sum(schemes.convection_upwind(m, m, [1.0, -0.5]), schemes.diffusion(m, m, 2, 0.5)))


@query("select g.i, g.j, (4 * g.u - w.u - e.u - s.u - n.u) * 4096 as r from grid g join grid w on w.i = g.i - 1 and w.j = g.j join grid e on e.i = g.i + 1 and e.j = g.j join grid s on s.i = g.i and s.j = g.j - 1 join grid n on n.i = g.i and n.j = g.j + 1")
def diffusion_by_cell(spark, sf):
    g = lenses.grid(spark, sf)
    return schemes.cell_scheme(g, g, stencils.star(2), lambda u: (u[0] * 4 - u[1] - u[2] - u[3] - u[4]) * 4096).where("r is not null").select(*IJ, "r")


@query("select level, i, j, 0.0::double as r_0, u as r_1 from mesh")
def buoyancy(spark, sf):
    return schemes.buoyancy(lenses.mesh(spark, sf), 2).select("level", *IJ, "r_0", "r_1")


@query("select i, j, u * 0.375 as f0, u * 0.5 as f1, u * 0.125 as f2, u * 0.0 as f3 from grid".replace("u * 0.375", "round(u * 0.375, 6)").replace("u * 0.5", "round(u * 0.5, 6)").replace("u * 0.125", "round(u * 0.125, 6)"))
def lattice_equilibrium(spark, sf):
    scheme = lattice.Scheme([(1, 0), (0, 1), (-1, 0), (0, -1)], [[1, 1, 1, 1], [1, 0, -1, 0], [0, 1, 0, -1], [1, -1, 1, -1]], [0.0, 1.5, 1.5, 1.0], lambda m: [m[0], m[0] * 0.25, m[0] * 0.5, F.lit(0.0)])
    g = lenses.grid(spark, sf)
    out = lattice.at_equilibrium(g, scheme, [F.col("u"), F.lit(0.0), F.lit(0.0), F.lit(0.0)])
    return out.select(*IJ, *((F.round(n, 6) + F.lit(0.0)).alias(n) for n in scheme.names))


# More on parts and tables


@query(_CUTS + ", " + FACES.strip() + " select least(a.part, b.part) as a, greatest(a.part, b.part) as b, count(*)::bigint as faces from faces f join p a on a.level = ll and a.i = li and a.j = lj join p b on b.level = rl and b.i = ri and b.j = rj where a.part <> b.part group by all")
def part_graph(spark, sf):
    return partition.part_graph(_dealt(spark, sf), 2)


@query(_CUTS + ", l as (select part, sum(w) as load from p group by part) select round(max(load) / (sum(load) / 5) - 1, 9) as imbalance from l")
def imbalance(spark, sf):
    return spark.createDataFrame([(round(partition.imbalance(_dealt(spark, sf), 5), 9),)], "imbalance double")


@query("select level, i, j, u from mesh")
def dump_and_load(spark, sf):
    path = f"{checkpoint_dir(spark)}/dump-{uuid.uuid4().hex}"
    tables.dump(lenses.mesh(spark, sf), path, 2, ["u"], time=0.5)
    return tables.load(spark, path, 2, ["u"]).select("level", *IJ, "u")


# Schemes that are not linear


def _shifted(df: DataFrame) -> DataFrame:
    """Values of both signs."""
    return df.select(*CELL, (F.col("u") - 100).alias("u"))


def _shifted_sql(sql: str) -> str:
    return sql.replace("l.u as lu, r.u as ru", "l.u - 100 as lu, r.u - 100 as ru")


@query(_shifted_sql(_divergence("case when (lu + ru) / 2 >= 0 then lu * lu else ru * ru end")))
def convection_nonlinear(spark, sf):
    m = _shifted(lenses.mesh(spark, sf))
    return _rounded(schemes.convection_nonlinear(m, m, 2, "u"))


@query(_coarsely(_shifted_sql(_divergence("(lu * lu + ru * ru - sqrt((lu + ru) / 2 * ((lu + ru) / 2) + 1e-12) * (ru - lu)) / 2"))))
def convection_nonlinear_rusanov(spark, sf):
    m = _shifted(lenses.mesh(spark, sf))
    return schemes.convection_nonlinear(m, m, 2, "u", kind="rusanov").select("level", *IJ, F.round("r", 3).alias("r"))


@query(_divergence(f"case when axis = 0 then (case when {_V} >= 0 then (lu / 128 - 1) * (1 - lu / 256) else (ru / 128 - 1) * (1 - ru / 256) end) else (case when {_W} >= 0 then (1 - lu / 256) * (1 - lu / 256) else (1 - ru / 256) * (1 - ru / 256) end) end"))
def convection_nonlinear_vector(spark, sf):
    """The second component of a vector carried by itself."""
    m = _with_velocity(spark, sf)
    return _rounded(schemes.convection_nonlinear(m, m, 2, "v", "w").select(*CELL, F.col("r_w").alias("r")))


def _weno_plane(u: str, flux: str, speeds: tuple[str, str]) -> str:
    """flux in X (a value) and V (the mean of the speed on the face); speeds as expressions of a value G."""
    around, names, terms = [], [], []
    for a, (axis, speed) in enumerate(zip("ij", speeds)):
        over = f"over (partition by {'j' if axis == 'i' else 'i'} order by {axis})"
        for n in range(7):
            around.append(f"lag(u, {3 - n}) {over} as g{a}{n}" if n <= 3 else f"lead(u, {n - 3}) {over} as g{a}{n}")
            names += [f"{u.replace('G', f'g{a}{n}')} as u{a}{n}", f"{speed.replace('G', f'g{a}{n}')} as v{a}{n}"]
        for n in (3, 2):
            mean = f"((v{a}{n} + v{a}{n + 1}) / 2)"
            f = [flux.replace("X", f"u{a}{k}").replace("V", mean) for k in range(n - 2, n + 4)]
            names += [f"case when {mean} >= 0 then {f[k]} else {f[5 - k]} end as f{a}{n}{k}" for k in range(5)]
            terms.append(f"{'' if n == 3 else '-'}{_weno_face(*(f'f{a}{n}{k}' for k in range(5)))}")
    return f"w as (select i, j, {', '.join(around)} from grid), x as (select i, j, {', '.join(names)} from w where g00 + g06 + g10 + g16 is not null) select i, j, round(({' + '.join(terms)}) * 64, 2) as r from x"


@query(_weno_plane("G", "X * V", ("(G / 128 - 1)", "(1 - G / 256)")))
def convection_weno5_field(spark, sf):
    g = lenses.grid(spark, sf).withColumn("v", F.col("u") / 128 - 1).withColumn("w", 1 - F.col("u") / 256)
    return schemes.convection_weno5_field(g, ["v", "w"]).select(*IJ, F.round("r", 2).alias("r"))


@query(_weno_plane("((G - 100) / 64)", "X * X", ("((G - 100) / 64)",) * 2))
def convection_weno5_nonlinear(spark, sf):
    g = lenses.grid(spark, sf).select(*CELL, ((F.col("u") - 100) / 64).alias("u"))
    return schemes.convection_weno5_nonlinear(g, 2).select(*IJ, F.round("r", 2).alias("r"))


def _godunov(a: float, left: str, right: str) -> str:
    return f"(case when {a} * ({left}) < {a} * ({right}) then (case when ({left}) * ({right}) > 0 then least(abs({left}), abs({right})) ** 2 / 2 else 0 end) else greatest(abs({left}), abs({right})) ** 2 / 2 end)"


@query(f"s as (select i, j, u - 100 as u from grid) select g.i, g.j, ({_godunov(1, 'g.u', 'e.u')} - {_godunov(1, 'w.u', 'g.u')} + {_godunov(-1, 'g.u', 'n.u')} - {_godunov(-1, 's.u', 'g.u')}) * 64 as r from s g join s w on w.i = (g.i + 63) % 64 and w.j = g.j join s e on e.i = (g.i + 1) % 64 and e.j = g.j join s on s.i = g.i and s.j = (g.j + 63) % 64 join s n on n.i = g.i and n.j = (g.j + 1) % 64")
def upwind_scalar_burgers(spark, sf):
    g = _shifted(lenses.grid(spark, sf))
    ghosts = boundary.periodic(g, {"i": (0, SIDE), "j": (0, SIDE)}, LEVEL, 1, "u")
    return schemes.upwind_scalar_burgers(g, ghosts, [1.0, -1.0]).select(*IJ, "r")


@query(_divergence("-1.0 * (ru - lu) / h").replace("round(coalesce(sum(s.q), 0)", "round(-coalesce(sum(s.q), 0)"))
def laplacian(spark, sf):
    m = lenses.mesh(spark, sf)
    return _rounded(schemes.laplacian(m, m, 2))


@query("select level, i, j, u - 0.5 * u + 0 as r from mesh")
def identity_and_zero(spark, sf):
    m = lenses.mesh(spark, sf)
    return schemes.operator_sum(schemes.identity(m), schemes.scaled(schemes.identity(m), -0.5), schemes.zero(m)).select("level", *IJ, "r")


def _vector(df: DataFrame) -> DataFrame:
    return df.select(solve.cell_id().alias("id"), F.col("u").alias("v"))


@query(_divergence("-1.5 * (ru - lu) / h").replace("* pow(4.0, m.level)", "").replace("sum(s.q), 0)", "sum(s.q), 0) + 2 * max(m.u)"))
def matrix_of_sum(spark, sf):
    """The assembled sum of two diffusions and twice the identity, times a field."""
    m, area = lenses.mesh(spark, sf), _area(spark)
    two = m.select(solve.cell_id().alias("row"), solve.cell_id().alias("col"), F.lit(2.0).alias("value"))
    a = solve.matrix_sum(*(solve.diffusion_matrix(m, area, 2, k, dirichlet=False) for k in (1.0, 0.5)), two)
    return _rounded(solve.on_cells(solve.product(a, _vector(m)), m, "r"))


@query("select n::int as row_block, m::int as col_block, count(*)::bigint as entries, sum(u * (1 + n + m)) as total from mesh, range(2) x(n), range(2) y(m) where n >= m group by all")
def block_matrix(spark, sf):
    """Three blocks of a lower triangle, each a diagonal."""
    m = lenses.mesh(spark, sf)
    diagonal = lambda by: m.select(solve.cell_id().alias("row"), solve.cell_id().alias("col"), (F.col("u") * by).alias("value"))
    blocks = solve.block_matrix({(a, b): diagonal(1 + a + b) for a in range(2) for b in range(a + 1)})
    return blocks.groupBy("row_block", "col_block").agg(F.count("*").alias("entries"), F.sum("value").alias("total"))


# Tags, fields, sets, intervals and boxes that stood without a query


_RING = "r as (select level, i, j, tag from t union all select 6, i + 64, j, 8 from t where level = 6 and i < 2)"


@query(f"{TAGS}, {_RING}, f as (select level, i % (1 << level) as ii, bit_or(tag) as flags, j from r group by level, i % (1 << level), j) select r.level, r.i::int as i, r.j, f.flags as tag from r join f on f.level = r.level and f.ii = r.i % (1 << r.level) and f.j = r.j")
def periodic_tags(spark, sf):
    t = _tags(spark, sf)
    ghosts = t.where("level = 6 and i < 2").select("level", (F.col("i") + SIDE).alias("i"), "j", "k", F.lit(8).alias("tag"))
    return boundary.periodic_tags(t.unionByName(ghosts), {"i": (0, SIDE)}, LEVEL).select("level", *IJ, "tag")


@query("select level, i, j, case when i % 9 = 0 then true else false end as missing from mesh where i % 9 = 0 or j % 11 = 0")
def nan_cells(spark, sf):
    u = F.when(F.col("i") % 9 == 0, F.lit(None)).when(F.col("j") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("u"))
    return fields.nan_cells(lenses.mesh(spark, sf).withColumn("u", u), "u").select("level", *IJ, F.col("u").isNull().alias("missing"))


@query("select level, i, j, 2.5::double as u from mesh")
def field_fill(spark, sf):
    return fields.make_field(lenses.mesh(spark, sf), 2.5).select("level", *IJ, "u")


@query("select true as same, not exists (select 1 from mesh where u > 50) as changed")
def fields_equal(spark, sf):
    m = lenses.mesh(spark, sf)
    off = m.withColumn("u", F.when(F.col("u") > 50, F.col("u") + 1).otherwise(F.col("u")))
    return spark.createDataFrame([(fields.equal(m, m, ["u"]), fields.equal(m, off, ["u"]))], "same boolean, changed boolean")


@query("select not exists (select 1 from mesh f join mesh c on c.level <= f.level - 2 and exists (select 1 from (values (1, 0), (-1, 0), (0, 1), (0, -1)) x(a, b) where (f.i + x.a) >> (f.level - c.level)::int = c.i and (f.j + x.b) >> (f.level - c.level)::int = c.j)) as graduated")
def is_graduated(spark, sf):
    return spark.createDataFrame([(mesh.is_graduated(lenses.mesh(spark, sf), 2),)], "graduated boolean")


@query(_CUTS + ", l as (select part, sum(w) as load from p group by part) select max(load) / (sum(load) / 5) - 1 > 0.001 as strict, max(load) / (sum(load) / 5) - 1 > 0.9 as loose from l")
def needs_balance(spark, sf):
    dealt = _dealt(spark, sf)
    return spark.createDataFrame([(partition.needs_balance(dealt, 5, 0.001), partition.needs_balance(dealt, 5, 0.9))], "strict boolean, loose boolean")


@query("select distinct 14 as level, (i + x.e)::int as i, (j + y.d)::int as j from c, range(-2, 3) x(e), range(-2, 3) y(d)")
def set_nested_expand(spark, sf):
    return _cells(lenses.sparse(spark, sf, "c").nested_expand(2))


@query("select 14 as level, i, j from b")
def set_stored(spark, sf):
    checkpoint_dir(spark)
    return _cells(lenses.sparse(spark, sf, "b").stored())


@query("select not exists (select 1 from a) as a, not exists (select 1 from a join c on c.i - 10000 = a.i and c.j = a.j) as apart, true as nothing, false as may_exist")
def set_emptiness(spark, sf):
    a, none = lenses.sparse(spark, sf, "a"), sets.nothing(spark, 14)
    apart = sets.intersection(a, lenses.sparse(spark, sf, "c").translate(-10000, 0))
    return spark.createDataFrame([(a.empty(), apart.empty(), none.empty(), none.exist())], "a boolean, apart boolean, nothing boolean, may_exist boolean")


def _ends(df: DataFrame) -> DataFrame:
    return df.groupBy("x_start", "x_end").agg(F.count("*").alias("n"))


@query("select xs - 7 as x_start, xe - 7 as x_end, count(*)::bigint as n from n1 group by all")
def interval_shift(spark, sf):
    return _ends(intervals.shift(lenses.orders_intervals(spark, sf), -7))


@query("select xs * 3 as x_start, xe * 3 as x_end, count(*)::bigint as n from n1 group by all")
def interval_scale(spark, sf):
    return _ends(intervals.scale(lenses.orders_intervals(spark, sf), 3))


@query("select xs * 4 as x_start, xe * 4 as x_end, count(*)::bigint as n from n1 group by all")
def interval_finer(spark, sf):
    return _ends(intervals.finer(lenses.orders_intervals(spark, sf), 2))


@query("select xe - xs as size, count(*)::bigint as n from n1 group by all")
def interval_sizes(spark, sf):
    return lenses.orders_intervals(spark, sf).groupBy(intervals.size().alias("size")).agg(F.count("*").alias("n"))


@query(_BOXES + " select id, x0 < 14 and 8 < x1 and y0 < 11 and 6 < y1 as meets from bx")
def box_intersects(spark, sf):
    return _boxes(spark, sf).select("id", boxes.intersects((8, 6), (14, 11)).alias("meets"))


@query("select level, i, j, pow(2.0, -level) as side, (i + 0.5) * pow(2.0, -level) as x, (j + 0.5) * pow(2.0, -level) as y from mesh")
def cell_places(spark, sf):
    x, y = fields.centres(2)
    return lenses.mesh(spark, sf).select("level", *IJ, length(F.col("level")).alias("side"), x.alias("x"), y.alias("y"))
