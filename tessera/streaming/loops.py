"""Time loops: each step is one plan, cut by a checkpoint; and a stream of events counted on cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def march(field: DataFrame, step: Callable[[DataFrame, float], DataFrame], dt: float, end: float, start: float = 0.0, save: Callable[[DataFrame, int, float], None] | None = None) -> DataFrame:
    """field after steps of dt until `end` (the last one shorter); save(field, n, t) may write each. Restart by `start`."""
    t, n = start, 0
    while t < end - 1e-12:
        now = min(dt, end - t)
        field = step(field, now).checkpoint()
        t, n = t + now, n + 1
        if save:
            save(field, n, t)
    return field


def windowed_cells(events: DataFrame, key: str, cells: int, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of streamed (or stored) events on cells, by window of time; rows later than `late` are dropped by a stream."""
    at = F.pmod(F.col(key), F.lit(cells)).cast("int")
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), at.alias("i")).agg(F.count("*").alias("u")).select(F.col("w.start").alias("start"), "i", "u")
