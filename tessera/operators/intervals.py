"""Interval tables (level, z, y, x_start, x_end), half open, and their canonical form: sorted, disjoint, not touching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.levels import CELL

INTERVAL = ["level", "z", "y", "x_start", "x_end"]
SCHEMA = "level int, z int, y int, x_start int, x_end int"

#: A row of cells is worked on in blocks of 2^BLOCK cells, so that one long row is not one task's work.
BLOCK = 12


def frame(spark: SparkSession, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


#: Most rows that one task of a shuffle gets, where the number of a set's rows is known.
ROWS = 1 << 19


def deal(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """Shuffled by the keys (y and block, if none are given) into as many partitions as `rows` rows ask for; None: as it is, for the
    session's own settings. Constant columns are no keys: Spark drops them from a window's, and would shuffle again."""
    return df if rows is None else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *(keys or ("y", "block")))


def merge(df: DataFrame, row: list[str], order: list[str]) -> DataFrame:
    """Merge overlapping and touching intervals within a row (gaps and islands). Windows of one order alone, so that a task keeps
    nothing but its sort: no aggregate holds its islands."""
    along = Window.partitionBy(*row).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = df.select(*row, "x_start", "x_end", F.max("x_end").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"), F.max("x_end").over(upto).alias("upto"), F.lead("x_start").over(along).isNull().alias("last"))
    first = F.col("reach").isNull() | (F.col("x_start") > F.col("reach"))
    # What lies before the next island's first row, or up to the last row, ends an island.
    ends = seen.withColumn("first", first).where("first or last").withColumn("end", F.when(F.col("first"), F.col("reach")).otherwise(F.col("upto")))
    return ends.withColumn("end", F.when(F.col("last"), F.col("upto")).otherwise(F.lead("end").over(along))).where("first").select(*row, "x_start", F.col("end").alias("x_end"))


def split(df: DataFrame) -> DataFrame:
    """Cut intervals at block borders; adds column block."""
    blocks = F.sequence(F.shiftright("x_start", BLOCK), F.shiftright(F.col("x_end") - 1, BLOCK))
    cut = df.where("x_start < x_end").withColumn("block", F.explode(blocks))
    lo = F.shiftleft("block", BLOCK)
    return cut.withColumn("x_start", F.greatest("x_start", lo)).withColumn("x_end", F.least("x_end", lo + F.lit(1 << BLOCK)))


def normalise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The canonical form. Blocks are merged apart; then only the at most two islands of a block that touch its borders are
    merged along the row, so no task needs a whole row. rows: about how many there are, where that is known."""
    row = ["level", "z", "y", "block"]
    return stitch(merge(deal(split(df.select(*INTERVAL)), rows), row, ["x_start", "x_end"]), rows)


def stitch(local: DataFrame, rows: int | None = None) -> DataFrame:
    """Islands of blocks, merged apart, to canonical intervals."""
    row = ["level", "z", "y", "block"]
    lo = F.shiftleft("block", BLOCK)
    edge = (F.col("x_start") == lo) | (F.col("x_end") == lo + F.lit(1 << BLOCK))
    # Islands at borders have no block of their own any more, so they meet along the row; one branch, so chains plan linearly.
    met = local.select("level", "z", "y", "x_start", "x_end", F.when(~edge, F.col("block")).alias("block"))
    return merge(deal(met, rows), row, ["x_start", "x_end"]).select(*INTERVAL)


def to_cells(df: DataFrame) -> DataFrame:
    """One row (level, i, j, k) for each cell."""
    return df.where("x_start < x_end").select("level", F.explode(F.sequence("x_start", F.col("x_end") - 1)).alias("i"), F.col("y").alias("j"), F.col("z").alias("k"))


def to_intervals(cells: DataFrame, rows: int | None = None) -> DataFrame:
    """Canonical intervals of cells, repeated ones included once."""
    return normalise(cells.select("level", F.col("k").alias("z"), F.col("j").alias("y"), F.col("i").alias("x_start"), (F.col("i") + 1).alias("x_end")), rows)


def contains(x: Column) -> Column:
    return (F.col("x_start") <= x) & (x < F.col("x_end"))


def size() -> Column:
    return F.col("x_end") - F.col("x_start")


def shift(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("x_start", F.col("x_start") + by).withColumn("x_end", F.col("x_end") + by)


def scale(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("x_start", F.col("x_start") * by).withColumn("x_end", F.col("x_end") * by)


def divide(df: DataFrame, by: int) -> DataFrame:
    """Both ends floored, and one cell kept where nothing would be left."""
    a, b = (F.floor(F.col(c) / by).cast("int") for c in ("x_start", "x_end"))
    return df.select("level", "z", "y", a.alias("x_start"), F.when(a == b, b + 1).otherwise(b).alias("x_end"))


def coarser(df: DataFrame, steps: int) -> DataFrame:
    """x on a level coarser by `steps`: floor of the start, ceiling of the end."""
    return df.withColumn("x_start", F.shiftright("x_start", steps)).withColumn("x_end", F.shiftright(F.col("x_end") - 1, steps) + 1)


def finer(df: DataFrame, steps: int) -> DataFrame:
    return df.withColumn("x_start", F.shiftleft("x_start", steps)).withColumn("x_end", F.shiftleft("x_end", steps))


def parity(cells: DataFrame, odd: bool) -> DataFrame:
    """Cells whose i is odd, or even."""
    return cells.where(F.pmod("i", F.lit(2)) == int(odd))


def statistics(df: DataFrame) -> DataFrame:
    """Per level: cells, intervals, rows, and the shortest and longest interval, also as JSON."""
    out = df.groupBy("level").agg(F.sum(size()).alias("cells"), F.count("*").alias("intervals"), F.countDistinct("z", "y").alias("rows"), F.min(size()).alias("shortest"), F.max(size()).alias("longest"))
    return out.withColumn("json", F.to_json(F.struct("level", "cells", "intervals", "rows", "shortest", "longest")))


def bounds(df: DataFrame) -> DataFrame:
    """Per level the bounding box of cells: least and (exclusive) greatest indices."""
    return df.groupBy("level").agg(F.min("x_start").alias("x_min"), F.max("x_end").alias("x_max"), F.min("y").alias("y_min"), (F.max("y") + 1).alias("y_max"), F.min("z").alias("z_min"), (F.max("z") + 1).alias("z_max"), F.sum(size()).alias("cells"))


def is_box(df: DataFrame) -> DataFrame:
    """Per level whether the cells fill their bounding box."""
    volume = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")) * (F.col("z_max") - F.col("z_min"))
    return bounds(df).select("level", (F.col("cells") == volume).alias("is_box"))


def interval_of(df: DataFrame, points: DataFrame) -> DataFrame:
    """The interval of a canonical table that holds each point (level, i, j, k); points outside get nulls. Points keep their
    columns. Each block of a row is swept once: a point lies in the last interval that starts at or before it, or in none."""
    cut = split(df.select(*INTERVAL, F.struct("x_start", "x_end").alias("own")))
    starts = cut.select("level", F.col("x_start").alias("i"), F.col("y").alias("j"), F.col("z").alias("k"), "block", F.lit(0).alias("kind"), F.struct("own", F.col("x_end").alias("hi")).alias("last"))
    asked = points.select(*CELL).distinct().withColumn("block", F.shiftright("i", BLOCK)).withColumn("kind", F.lit(1)).withColumn("last", F.lit(None).cast(starts.schema["last"].dataType))
    before = Window.partitionBy("level", "k", "j", "block").orderBy("i", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.unionByName(asked).withColumn("last", F.last("last", ignorenulls=True).over(before))
    found = swept.where((F.col("kind") == 1) & (F.col("i") < F.col("last.hi"))).select(*CELL, "last.own.*")
    return points.join(found, CELL, "left")
