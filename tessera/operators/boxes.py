"""Boxes: rows with arrays lo and hi, half-open on every axis. Other columns stay as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersects(low: tuple[float, ...], high: tuple[float, ...]):
    """Whether a row's box and (low, high) share more than a border."""
    return reduce(lambda a, b: a & b, [(F.col("lo")[n] < h) & (F.col("hi")[n] > low[n]) for n, h in enumerate(high)])


def intersection(boxes: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """What of each box lies in (low, high); boxes with nothing there go."""
    inside = {"lo": F.array(*(F.greatest(F.col("lo")[n], F.lit(x)) for n, x in enumerate(low))), "hi": F.array(*(F.least(F.col("hi")[n], F.lit(x)) for n, x in enumerate(high)))}
    return boxes.where(intersects(low, high)).withColumns(inside)


def difference(boxes: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """What of each box lies outside (low, high), as at most 3^d - 1 boxes: each axis is cut into what is below, within and above."""
    out = boxes
    for n, (a, b) in enumerate(zip(low, high)):
        lo, hi = F.col("lo")[n], F.col("hi")[n]
        cut = lambda x, y, m: F.struct(x.alias("a"), y.alias("b"), F.lit(m).alias("mid"))
        parts = F.array(cut(lo, F.least(hi, F.lit(a)), 0), cut(F.greatest(lo, F.lit(a)), F.least(hi, F.lit(b)), 1), cut(F.greatest(lo, F.lit(b)), hi, 0))
        out = out.withColumn(f"cut{n}", F.explode(F.filter(parts, lambda x: x["a"] < x["b"])))
    axes = range(len(low))
    outside = out.where(sum((F.col(f"cut{n}.mid") for n in axes), F.lit(0)) < len(low))
    return outside.withColumns({"lo": F.array(*(F.col(f"cut{n}.a") for n in axes)), "hi": F.array(*(F.col(f"cut{n}.b") for n in axes))}).select(*boxes.columns)


def shortest_side(dim: int):
    sides = [F.col("hi")[n] - F.col("lo")[n] for n in range(dim)]
    return F.least(*sides) if dim > 1 else sides[0]


def is_valid(dim: int):
    """Whether every side is longer than nothing."""
    return shortest_side(dim) > 0
