"""Meshes and fields as Parquet: checkpoints, and points with connectivity for viewers."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.levels import AXES, CELL, length
from tessera.functions.stencils import children


def dump(field: DataFrame, path: str, dim: int, names: list[str], **attributes) -> None:
    """Cells and values by level, and attributes (dim, fields and what is given, such as the time) beside them."""
    field.select(*CELL, *names).repartitionByRange("level", "k", "j", "i").sortWithinPartitions("level", "k", "j", "i").write.mode("overwrite").partitionBy("level").parquet(f"{path}/cells")
    text = json.dumps({"dim": dim, "fields": names, **attributes}, sort_keys=True)
    field.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attributes")


def attributes(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/attributes").first()[0])


def load(spark: SparkSession, path: str, dim: int, names: list[str]) -> DataFrame:
    """A dumped field; an error if its dimension or its fields are others."""
    found = attributes(spark, path)
    if found["dim"] != dim or not set(names) <= set(found["fields"]):
        raise ValueError(f"{path} has dimension {found['dim']} and fields {found['fields']}")
    kinds = {c: F.col(c).cast("int") for c in CELL}
    return spark.read.parquet(f"{path}/cells").withColumns(kinds).select(*CELL, *names)


def elements(leaves: DataFrame, dim: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Corner points (point, x, y, z) and, for each cell, the points of its corners in order.

    Corners are compared as integers on the finest level; a point is named by them, so no two places share a name.
    """
    scale = F.lit(level) - F.col("level")
    corner = lambda o: F.struct(*(F.call_function("shiftleft", F.col(a) + o[n], scale).alias(f"c{a}") if n < dim else F.lit(0).alias(f"c{a}") for n, a in enumerate(AXES)))
    each = leaves.select(*CELL, F.posexplode(F.array(*(corner(o) for o in children(dim)))).alias("corner", "c")).select(*CELL, "corner", "c.*")
    each = each.withColumn("point", F.struct("ci", "cj", "ck"))
    points = each.select("point", *((F.col(f"c{a}") * length(F.lit(level))).alias(x) for a, x in zip(AXES, "xyz"))).distinct()
    return points, each.groupBy(*CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "point"))), lambda x: x["point"]).alias("points"))


def save(field: DataFrame, path: str, dim: int, level: int, names: list[str]) -> None:
    """points, and cells with their points and values, for viewers."""
    points, cells = elements(field, dim, level)
    points.write.mode("overwrite").parquet(f"{path}/points")
    cells.join(field.select(*CELL, *names), CELL).write.mode("overwrite").parquet(f"{path}/elements")


def compare(a: DataFrame, b: DataFrame, names: list[str], tolerance: float = 1e-14, relative: float = 0.0) -> DataFrame:
    """Cells that only one has, or whose values differ by more than tolerance + relative * |value|."""
    both = a.select(*CELL, *(F.col(n).alias(f"a_{n}") for n in names), F.lit(1).alias("in_a")).join(b.select(*CELL, *(F.col(n).alias(f"b_{n}") for n in names), F.lit(1).alias("in_b")), CELL, "full")
    off = reduce(lambda x, y: x | y, [F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) > tolerance + relative * F.abs(F.col(f"b_{n}")) for n in names])
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | off)


def numbered(leaves: DataFrame) -> DataFrame:
    """Cells with a storage number, 0 upwards within each level, in canonical order (k, j, i).

    Cells are dealt by ranges of that order and numbered within a range; only the ranges' counts are summed in one place.
    """
    ranged = leaves.repartitionByRange("level", "k", "j", "i").withColumn("range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("level").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("level", "range").agg(F.count("*").alias("n")).select("level", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("level", "range").orderBy("k", "j", "i")) - 1
    return ranged.withColumn("inside", inside).join(base, ["level", "range"]).select(*leaves.columns, (F.col("base") + F.col("inside")).alias("number"))
