"""Coarse and fine values: projection, prediction, details, tags and adaptation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL, down
from tessera.functions.prediction import descendant, table
from tessera.functions.stencils import Offset, box, directions

from .mesh import COARSEN, ENLARGE, KEEP, REFINE, Config, ancestors, boundary, from_tags, graduate, neighbourhood, refine


def parent_of() -> list[Column]:
    return [(F.col("level") - 1).alias("level"), *(F.shiftright(a, 1).alias(a) for a in AXES)]


def project(field: DataFrame, dim: int, *names: str) -> DataFrame:
    """Means of children on their parents, all fields in one aggregation."""
    return field.select(*parent_of(), *names).groupBy(*CELL).agg(*((F.sum(n) / F.lit(float(1 << dim))).alias(n) for n in names))


def project_all(field: DataFrame, dim: int, min_level: int, *names: str) -> DataFrame:
    """Volume-weighted means of the leaves on all their proper ancestors; one aggregation for all levels."""
    up = field.where(F.col("level") > min_level).select(*CELL, *names, F.explode(F.sequence(F.lit(min_level), F.col("level") - 1)).alias("to"))
    share = F.pow(F.lit(0.5), F.lit(dim) * (F.col("level") - F.col("to")))
    return up.select(F.col("to").alias("up"), *(down(a, F.col("level") - F.col("to")).alias(a) for a in AXES), *((F.col(n) * share).alias(n) for n in names)).groupBy(F.col("up").alias("level"), *AXES).agg(*(F.sum(n).alias(n) for n in names))


def predict(cells: DataFrame, coarse: DataFrame, dim: int, order: int, *names: str, limits: DataFrame | None = None, place: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """Values on the children of `cells` from coarse values around them.

    A coarse cell that is missing is an error, unless `limits` (level, i0, i1, ... one row for each level) says where the
    domain ends: beyond it the nearest cell inside stands in. place(axis, index): where a value is kept (periodic axes).
    """
    terms = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("pi", "pj", "pk", "oi", "oj", "ok", "w"), (*p, *o, w)))) for p, o, w in table(dim, order)))
    at = cells.select(*CELL, F.inline(terms))  # (2 * (2 * order + 1)) ^ dim terms
    if limits is not None:
        at = at.join(F.broadcast(limits), "level")

    def kept(a: str) -> Column:
        x = F.col(a) + F.col(f"o{a}")
        if limits is not None:
            return F.least(F.greatest(x, F.col(f"{a}0")), F.col(f"{a}1") - 1)
        return x if place is None else place(a, x)

    at = at.select(*CELL, "pi", "pj", "pk", "w", *(kept(a).alias(f"n{a}") for a in AXES))
    source = coarse.select("level", *(F.col(a).alias(f"n{a}") for a in AXES), *names)
    joined = at.join(source, ["level", "ni", "nj", "nk"], "left")
    value = lambda n: F.sum(F.col("w") * F.when(F.col(n).isNull(), F.raise_error(F.lit("a coarse value is missing"))).otherwise(F.col(n)))
    return joined.groupBy((F.col("level") + 1).alias("level"), *((F.col(a) * 2 + F.col(f"p{a}") if n < dim else F.col(a)).alias(a) for n, a in enumerate(AXES))).agg(*(value(n).alias(n) for n in names))


def detail(fine: DataFrame, coarse: DataFrame, dim: int, order: int, *names: str, limits: DataFrame | None = None) -> DataFrame:
    """What a prediction from `coarse` misses, on the cells of `fine` whose parents are all of its parents."""
    parents = fine.select(*parent_of()).distinct()
    guess = predict(parents, coarse, dim, order, *names, limits=limits).withColumnsRenamed({n: f"guess_{n}" for n in names})
    return fine.join(guess, CELL).select(*CELL, *((F.col(n) - F.col(f"guess_{n}")).alias(f"d_{n}") for n in names))


def relative(details: DataFrame, field: DataFrame, *names: str, least: float = 1e-15) -> DataFrame:
    """Details divided by the field's greatest absolute value (1 if that is tiny)."""
    top = field.agg(*(F.max(F.abs(n)).alias(n) for n in names)).first()
    return details.select(*CELL, *((F.col(f"d_{n}") / F.lit(float(top[n]) if top[n] and top[n] >= least else 1.0)).alias(f"d_{n}") for n in names))


def max_detail(details: DataFrame, *names: str) -> DataFrame:
    return details.groupBy("level").agg(*(F.max(F.abs(f"d_{n}")).alias(f"max_{n}") for n in names))


def criteria(details: DataFrame, config: Config, *names: str) -> DataFrame:
    """Tags from details: siblings coarsen if none of theirs, nor their parent's, is over its threshold; a cell refines if its own is.

    With e = epsilon / 2^(dim (max_level - level)): siblings against e, the parent against 2^regularity e, one cell against
    2^(regularity + dim) e; always strictly over.
    """
    size = F.greatest(*(F.abs(f"d_{n}") for n in names)) if len(names) > 1 else F.abs(f"d_{names[0]}")
    e = F.lit(config.epsilon) / F.pow(F.lit(2.0), F.lit(config.dim) * (F.lit(config.max_level) - F.col("level")))
    fine = F.pow(F.lit(2.0), F.lit(config.regularity + config.dim)) * e
    own = details.select(*CELL, size.alias("d"))
    above = own.select(F.col("level").alias("p_level"), *(F.col(a).alias(f"p_{a}") for a in AXES), F.col("d").alias("p_d"))
    keyed = own.withColumns({"p_level": F.col("level") - 1, **{f"p_{a}": F.shiftright(a, 1) for a in AXES}}).join(above, ["p_level", *(f"p_{a}" for a in AXES)], "left")
    family = F.max("d").over(Window.partitionBy("p_level", *(f"p_{a}" for a in AXES)))
    coarse = (family <= e) & (F.coalesce("p_d", F.lit(0.0)) <= fine / float(1 << config.dim)) & (F.col("level") > config.min_level)
    up = (F.col("d") > fine) & (F.col("level") < config.max_level)
    return keyed.select(*CELL, F.when(coarse, F.lit(COARSEN)).otherwise(F.lit(KEEP)).bitwiseOR(F.when(up, F.lit(REFINE)).otherwise(F.lit(0))).alias("tag"))


def siblings_agree(tags: DataFrame, dim: int) -> DataFrame:
    """Coarsen is for whole families: it goes where a sibling is missing, keeps or does not coarsen; a keep holds for all siblings."""
    family = Window.partitionBy(*[F.col("level"), *(F.shiftright(a, 1) for a in AXES)])
    keep = F.max((F.col("tag").bitwiseAND(KEEP) != 0).cast("int")).over(family) == 1
    all_up = (F.min((F.col("tag").bitwiseAND(COARSEN) != 0).cast("int")).over(family) == 1) & (F.count("*").over(family) == 1 << dim)
    tag = F.when(keep, F.col("tag").bitwiseOR(KEEP)).otherwise(F.col("tag"))
    return tags.select(*CELL, F.when(all_up & ~keep, tag).otherwise(tag.bitwiseAND(~COARSEN)).alias("tag"))


def keep_children_together(tags: DataFrame) -> DataFrame:
    """If one child keeps, all its siblings do."""
    family = Window.partitionBy(*[F.col("level"), *(F.shiftright(a, 1) for a in AXES)])
    keep = F.max(F.col("tag").bitwiseAND(KEEP)).over(family)
    return tags.select(*CELL, F.col("tag").bitwiseOR(keep).alias("tag"))


def spread(tags: DataFrame, offsets: list[Offset], when: int, give: int) -> DataFrame:
    """Cells around those with the flag `when` get the flag `give`; tags are joined by or."""
    source = tags.where(F.col("tag").bitwiseAND(when) != 0) if when else tags
    given = neighbourhood(source.select(*CELL), offsets).select("level", *(F.col(f"n{a}").alias(a) for a in AXES)).distinct().withColumn("give", F.lit(give))
    return tags.join(given, CELL, "left").select(*CELL, F.col("tag").bitwiseOR(F.coalesce("give", F.lit(0))).alias("tag"))


def tag_to_keep(tags: DataFrame, dim: int, width: int, flag: int = 0) -> DataFrame:
    return spread(tags, box(dim, width), flag, KEEP)


def enlarge(tags: DataFrame, dim: int) -> DataFrame:
    return spread(tags, box(dim, 1), KEEP, ENLARGE)


def keep_around_refine(tags: DataFrame, dim: int) -> DataFrame:
    return spread(tags, box(dim, 1), REFINE, KEEP)


def keep_boundary_refined(tags: DataFrame, area: DataFrame, config: Config) -> DataFrame:
    """Leaves of the finest level at the border of `area` keep."""
    fine, own = tags.where(F.col("level") == config.max_level).select(*CELL), area.where(F.col("level") == config.max_level)
    edge = reduce(DataFrame.unionByName, [boundary(fine, own, d) for d in directions(config.dim)]).distinct().withColumn("give", F.lit(KEEP))
    return tags.join(edge, CELL, "left").select(*CELL, F.col("tag").bitwiseOR(F.coalesce("give", F.lit(0))).alias("tag"))


def refine_above(tags: DataFrame, flag: int = KEEP, give: int = REFINE, offsets: list[Offset] = ((0, 0, 0),)) -> DataFrame:
    """A flag on a cell, moved by the offsets, gives a flag to the leaf one level coarser that is there."""
    near = neighbourhood(tags.where(F.col("tag").bitwiseAND(flag) != 0).select(*CELL), list(offsets))
    given = near.select((F.col("level") - 1).alias("level"), *(F.shiftright(f"n{a}", 1).alias(a) for a in AXES)).distinct().withColumn("give", F.lit(give))
    return tags.join(given, CELL, "left").select(*CELL, F.col("tag").bitwiseOR(F.coalesce("give", F.lit(0))).alias("tag"))


def domain_limits(spark, config: Config, low: tuple[int, ...], high: tuple[int, ...], level: int) -> DataFrame:
    """The index box of a domain, given on one level, on every level of a mesh."""
    lo, hi = (*low, 0, 0)[:3], (*high, 1, 1)[:3]
    at = lambda x, to, n: (x >> (level - to) if to <= level else x << (to - level)) if n < config.dim else x
    rows = [(m, *(v for n in range(3) for v in (at(lo[n], m, n), max(at(lo[n], m, n) + 1, at(hi[n], m, n))))) for m in range(min(config.min_level, level), config.max_level + 1)]
    return spark.createDataFrame(rows, "level int, i0 int, i1 int, j0 int, j1 int, k0 int, k1 int")


def all_values(field: DataFrame, config: Config, limits: DataFrame, *names: str) -> DataFrame:
    """Values on leaves, on all their ancestors, and by prediction on the cells around those that a stencil may read.

    Levels are filled from coarse to fine; each step reads the one above, so the table is checkpointed level by level.
    """
    values = field.select(*CELL, *names).unionByName(project_all(field, config.dim, config.min_level, *names)).checkpoint()
    reach = max(config.stencil_radius, config.prediction_order)
    need = neighbourhood(values.select(*CELL), box(config.dim, reach)).join(F.broadcast(limits), "level").where(reduce(lambda x, y: x & y, [(F.col(f"n{a}") >= F.col(f"{a}0")) & (F.col(f"n{a}") < F.col(f"{a}1")) for a in AXES]))
    need = need.select("level", *(F.col(f"n{a}").alias(a) for a in AXES)).distinct().join(values, CELL, "left_anti").checkpoint()
    for level in range(config.min_level + 1, config.max_level + 1):
        missing = need.where(F.col("level") == level)
        if missing.isEmpty():
            continue
        above = missing.select(*parent_of()).distinct()
        guess = predict(above, values, config.dim, config.prediction_order, *names, limits=limits)
        values = values.unionByName(guess.join(missing, CELL, "left_semi")).checkpoint()
    return values


def update_fields(field: DataFrame, leaves: DataFrame, config: Config, limits: DataFrame, *names: str) -> DataFrame:
    """The field on new leaves at most one level from the old: kept, projected or predicted, in one pass for all fields."""
    same = field.join(leaves.select(*CELL), CELL, "left_semi").select(*CELL, *names)
    rest = leaves.select(*CELL).join(same, CELL, "left_anti")
    up = project(field, config.dim, *names).join(rest, CELL, "left_semi")
    finer = rest.join(up, CELL, "left_anti")
    values = all_values(field, config, limits, *names)
    fine = predict(finer.select(*parent_of()).distinct(), values, config.dim, config.prediction_order, *names, limits=limits).join(finer, CELL, "left_semi")
    return same.unionByName(up).unionByName(fine)


def adapt(field: DataFrame, config: Config, limits: DataFrame, *names: str, relative_detail: bool = False) -> DataFrame:
    """The field on a mesh adapted to it: tag by details, make families agree, rebuild, graduate, carry the values over.

    At most max_level - min_level passes, fewer if a pass changes no leaf. Each pass is checkpointed.
    """
    field = field.select(*CELL, *names).checkpoint()
    for _ in range(config.max_level - config.min_level):
        values = all_values(field, config, limits, *names)
        found = detail(field.where(F.col("level") > config.min_level), values, config.dim, config.prediction_order, *names, limits=limits)
        up = ancestors(field, config.min_level).where(F.col("level") > config.min_level)
        inner = detail(values.join(up, CELL, "left_semi"), values, config.dim, config.prediction_order, *names, limits=limits)
        details = found.unionByName(inner).checkpoint()
        if relative_detail:
            details = relative(details, field, *names)
        tags = criteria(details, config, *names).join(field, CELL, "left_semi")
        tags = field.select(*CELL).join(tags, CELL, "left").select(*CELL, F.coalesce("tag", F.lit(KEEP)).alias("tag"))
        tags = siblings_agree(keep_around_refine(tags, config.dim), config.dim)
        new = graduate(from_tags(tags, config), config.dim, config.graduation_width)
        if new.exceptAll(field.select(*CELL)).isEmpty() and field.select(*CELL).exceptAll(new).isEmpty():
            return field
        field = transfer(field, new, config, limits, *names).checkpoint()
    return field


def transfer(field: DataFrame, leaves: DataFrame, config: Config, limits: DataFrame, *names: str) -> DataFrame:
    """The field on other leaves of the same domain, any number of levels away: equal, averaged or predicted."""
    known = all_values(field, config, limits, *names)
    own = known.join(leaves.select(*CELL), CELL, "left_semi").join(field.select(*CELL).unionByName(ancestors(field, config.min_level)), CELL, "left_semi")
    rest = leaves.select(*CELL).join(own, CELL, "left_anti")
    asked = rest.select(*CELL, F.explode(F.sequence(F.lit(config.min_level), F.col("level") - 1)).alias("up"))
    asked = asked.withColumns({f"u{a}": down(a, F.col("level") - F.col("up")) for a in AXES})
    held = field.select(F.col("level").alias("up"), *(F.col(a).alias(f"u{a}") for a in AXES))
    return own.unionByName(descend(asked.join(held, ["up", *(f"u{a}" for a in AXES)], "left_semi"), known, config, limits, *names))


def descend(asked: DataFrame, values: DataFrame, config: Config, limits: DataFrame, *names: str) -> DataFrame:
    """Values on cells (level, i, j, k) from those around their ancestor (up, ui, uj, uk), by the linear forms of prediction."""
    spark = asked.sparkSession
    forms = [(d, *(*at, 0, 0)[:3], *(*cell, 0, 0)[:3], float(w)) for d in range(1, config.max_level - config.min_level + 1) for at in _offsets(config.dim, d) for cell, w in descendant(config.prediction_order, d, at).items()]
    rows = spark.createDataFrame(forms, "delta int, ai int, aj int, ak int, oi int, oj int, ok int, w double")
    keyed = asked.withColumn("delta", F.col("level") - F.col("up")).withColumns({f"a{a}": F.col(a) - F.call_function("shiftleft", F.col(f"u{a}"), F.col("delta")) if n < config.dim else F.lit(0) for n, a in enumerate(AXES)})
    at = keyed.join(rows, ["delta", "ai", "aj", "ak"]).join(F.broadcast(limits.withColumnRenamed("level", "up")), "up")
    at = at.select(*CELL, "up", "w", *(F.least(F.greatest(F.col(f"u{a}") + F.col(f"o{a}"), F.col(f"{a}0")), F.col(f"{a}1") - 1).alias(f"n{a}") for a in AXES))
    source = values.select(F.col("level").alias("up"), *(F.col(a).alias(f"n{a}") for a in AXES), *names)
    joined = at.join(source, ["up", "ni", "nj", "nk"], "left")
    value = lambda n: F.sum(F.col("w") * F.when(F.col(n).isNull(), F.raise_error(F.lit("a value is missing"))).otherwise(F.col(n)))
    return joined.groupBy(*CELL).agg(*(value(n).alias(n) for n in names))


def _offsets(dim: int, delta: int) -> list[tuple[int, ...]]:
    from itertools import product

    return list(product(range(1 << delta), repeat=dim))


def reconstruct(field: DataFrame, config: Config, limits: DataFrame, *names: str) -> DataFrame:
    """The field on the uniform finest level."""
    fine = [refine(field.where(F.col("level") == m), config.max_level - m, config.dim) for m in range(config.min_level, config.max_level + 1)]
    return transfer(field, reduce(DataFrame.unionByName, fine), config, limits, *names)


def portion(field: DataFrame, delta: int, at: tuple[int, ...], dim: int, order: int, name: str = "u") -> DataFrame:
    """The value of one descendant (`delta` levels down, offset `at`) of each cell whose neighbours are all there."""
    form = descendant(order, delta, at)
    offsets = [(*c, 0, 0)[:3] for c in form]
    from .mesh import stencil_values

    around = stencil_values(field, field, offsets, name)
    value = reduce(lambda a, b: a + b, [F.col(f"u_{n}") * float(w) for n, w in enumerate(form.values())])
    return around.select(*CELL, value.alias("value")).where(F.col("value").isNotNull())
