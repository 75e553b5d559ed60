"""Dealing cells to parts: curve order, weights, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.curves import morton
from tessera.functions.levels import AXES, CELL

from .faces import faces
from .mesh import interfaces

#: Bits of the keys that share one block of the prefix sums; blocks are taken together in the same way, level by level.
BLOCK_BITS = 16


def curve_key(dim: int, level: int) -> Column:
    """The Morton key of a cell's first descendant on a level; cells of different levels get one order."""
    return morton(*(F.call_function("shiftleft", F.col(a), F.lit(level) - F.col("level")) for a in AXES[:dim]))


def _bases(blocks: DataFrame, top: int) -> DataFrame:
    """For each block (up to number `top`) the weight of all blocks before it."""
    groups = blocks.withColumn("group", F.shiftright("block", BLOCK_BITS))
    inside = F.coalesce(F.sum("w").over(Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = groups.select("block", "group", inside.alias("base"))
    if top >> BLOCK_BITS == 0:
        return base.drop("group")
    above = _bases(blocks.groupBy(F.shiftright("block", BLOCK_BITS).alias("block")).agg(F.sum("w").alias("w")), top >> BLOCK_BITS)
    return base.join(above.select(F.col("block").alias("group"), F.col("base").alias("above")), "group").select("block", (F.col("base") + F.col("above")).alias("base"))


def cuts(cells: DataFrame, key: Column, weight: Column, parts: int) -> DataFrame:
    """Cells with `part`: along the key, parts of equal weight; a cell belongs where its middle falls.

    Prefix sums within blocks of keys, and over the totals of blocks, of blocks of blocks and so on: no task sorts all cells
    or all blocks.
    """
    keyed = cells.select("*", key.alias("key"), weight.alias("weight")).withColumn("block", F.shiftright("key", BLOCK_BITS))
    total, top = keyed.agg(F.coalesce(F.sum("weight"), F.lit(1)), F.coalesce(F.max("block"), F.lit(0))).first()
    base = _bases(keyed.groupBy("block").agg(F.sum("weight").alias("w")), int(top))
    inside = F.sum("weight").over(Window.partitionBy("block").orderBy("key", "level"))
    middle = F.col("base") + inside - F.col("weight") / 2
    return keyed.join(base, "block").select(*cells.columns, "key", "weight", F.least(F.floor(middle * parts / F.lit(float(total))), F.lit(parts - 1)).cast("int").alias("part"))


def loads(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("part").agg(F.sum("weight").alias("load"))


def imbalance(dealt: DataFrame, parts: int) -> float:
    """Greatest load over the mean of all parts, empty ones too, less one."""
    row = loads(dealt).agg(F.max("load"), F.sum("load")).first()
    return float(row[0] / (row[1] / parts) - 1) if row[1] else 0.0


def needs_balance(dealt: DataFrame, parts: int, threshold: float = 0.05) -> bool:
    return imbalance(dealt, parts) > threshold


def level_weight(by_level: dict[int, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in by_level.items() for x in item)), F.col("level")), F.lit(1.0))


def cell_graph(leaves: DataFrame, dim: int) -> DataFrame:
    """Edges between leaves that share a face, with the number of such faces."""
    return interfaces(leaves, dim).groupBy(*(f"{s}_{c}" for s in "lr" for c in CELL)).agg(F.count("*").alias("faces"))


def part_graph(dealt: DataFrame, dim: int) -> DataFrame:
    """Pairs of different parts that share faces."""
    found = faces(dealt.select(*CELL, "part"), dim, "part").where("l.part <> r.part")
    return found.groupBy(F.least("l.part", "r.part").alias("a"), F.greatest("l.part", "r.part").alias("b")).agg(F.count("*").alias("faces"))


def diffusion_flows(loads: DataFrame, edges: DataFrame, rounds: int = 10, least: float = 0.01) -> DataFrame:
    """(a, b, flow): weight that part b should hand to its neighbour a, for both directions of each edge, so that loads even out.

    First-order diffusion in a fixed number of rounds over tables (part, load) and (a, b): each edge carries the difference of
    its loads over the greater of its parts' neighbours and one. Each round is a join and a sum by part, checkpointed. Flows
    under `least` of the mean load are none.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("degree"))
    near = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("degree").alias("other")), "b")
    near = near.select("a", "b", (F.greatest("degree", "other") + 1).alias("rate"), F.lit(0.0).alias("flow")).checkpoint()
    now = loads.select("part", F.col("load").cast("double").alias("load")).checkpoint()
    mean = now.agg(F.avg("load")).first()[0] or 0.0
    for _ in range(rounds):
        own, other = now.select(F.col("part").alias("a"), F.col("load").alias("own")), now.select(F.col("part").alias("b"), F.col("load").alias("other"))
        moves = near.join(own, "a").join(other, "b").withColumn("move", (F.col("other") - F.col("own")) / F.col("rate")).checkpoint()
        gained = moves.groupBy(F.col("a").alias("part")).agg(F.sum("move").alias("gain"))
        now = now.join(gained, "part", "left").select("part", (F.col("load") + F.coalesce("gain", F.lit(0.0))).alias("load")).checkpoint()
        near = moves.select("a", "b", "rate", (F.col("flow") + F.col("move")).alias("flow"))
    return near.select("a", "b", F.when(F.abs("flow") < least * mean, 0.0).otherwise(F.col("flow")).alias("flow"))


def diffuse(dealt: DataFrame, flows: DataFrame, dim: int, key: list[Column], keep: float = 0.1) -> DataFrame:
    """dealt (cells with part and weight) after cells at the borders of parts have moved along the flows.

    A part hands cells that share a face with the receiving part, in the order of `key`, as long as all of them together
    stay within the flow; of several receivers a cell has the least. If a part would give more than 1 - keep of its load, its
    flows shrink alike. Only cells at borders of parts are sorted, by pair of parts.
    """
    given = flows.where("flow > 0").select(F.col("b").alias("part"), F.col("a").alias("to"), "flow")
    asked = given.groupBy("part").agg(F.sum("flow").alias("all")).join(loads(dealt), "part")
    given = given.join(asked, "part").withColumn("flow", F.col("flow") * F.least(F.lit(1.0), (1 - keep) * F.col("load") / F.col("all"))).select("part", "to", "flow")
    found = faces(dealt.select(*CELL, "part"), dim, "part").where("l.part <> r.part")
    beside = found.select(F.inline(F.array(*(F.struct(*(F.col(f"{x}.{c}").alias(c) for c in (*CELL, "part")), F.col(f"{y}.part").alias("to")) for x, y in ("lr", "rl")))))
    picked = beside.join(given.select("part", "to"), ["part", "to"], "left_semi").groupBy(*CELL, "part").agg(F.min("to").alias("to"))
    order = Window.partitionBy("part", "to").orderBy(*key, "level").rowsBetween(Window.unboundedPreceding, 0)
    taken = picked.join(dealt.select(*CELL, "weight"), CELL).withColumn("sum", F.sum("weight").over(order)).join(given, ["part", "to"]).where("sum <= flow")
    moved = taken.select(*CELL, F.col("to").alias("new"))
    return dealt.join(moved, CELL, "left").withColumn("part", F.coalesce("new", "part")).select(*dealt.columns)
