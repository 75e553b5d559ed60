"""The algebra of cell sets. An expression lives on the finest level of its operands; `.on(level)` takes its result there."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .intervals import INTERVAL, deal, frame, merge, normalise, split, stitch, to_cells


#: Rows of cells, as a power of two, that are shuffled together where sets of two levels meet, or a set grows.
BAND = 6


@dataclass(frozen=True)
class CellSet:
    """Cells of one level as canonical intervals. `table` may be lazy; nothing runs before an action.

    rows: at most so many intervals, where that is known; shuffles then have partitions of a bounded size, whatever the session's.
    coarse: the set that this one refines; set operations work on it, and refine their result.
    """

    table: DataFrame
    level: int
    dim: int = 2
    known_empty: bool = False
    rows: int | None = None
    coarse: CellSet | None = None

    def on(self, level: int) -> CellSet:
        """Coarser: the cells that touch the set. Finer: all their descendants."""
        steps = self.level - level
        if not steps:
            return self
        if self.coarse:
            return self.coarse.on(level)
        if steps > 0:
            at = lambda c, used: F.shiftright(c, steps) if used else F.col(c)
            out = self.table.select(F.lit(level).alias("level"), at("z", self.dim > 2).alias("z"), at("y", self.dim > 1).alias("y"), F.shiftright("x_start", steps).alias("x_start"), (F.shiftright(F.col("x_end") - 1, steps) + 1).alias("x_end"))
            return self._new(normalise(out, self.rows), level)
        out = self.table.withColumn("level", F.lit(level)).withColumn("x_start", F.shiftleft("x_start", -steps)).withColumn("x_end", F.shiftleft("x_end", -steps))
        for c in ("y", "z")[: self.dim - 1]:
            out = out.withColumn(c, F.explode(F.sequence(F.shiftleft(c, -steps), F.shiftleft(F.col(c) + 1, -steps) - 1)))
        return replace(self._new(out.select(*INTERVAL), level, 1 << (-steps * (self.dim - 1))), coarse=self)

    def translate(self, *by: int) -> CellSet:
        """Moved by so many cells of its own level along x, y, z."""
        x, y, z = (*by, 0, 0)[:3]
        return self._new(self.table.select("level", (F.col("z") + z).alias("z"), (F.col("y") + y).alias("y"), (F.col("x_start") + x).alias("x_start"), (F.col("x_end") + x).alias("x_end")))

    def expand(self, width: int | tuple[int, ...], axes: tuple[bool, ...] | None = None) -> CellSet:
        """All cells at most `width` (one for each axis, or for all) away along each chosen axis."""
        widths = [w if (axes or (True,) * 3)[a] else 0 for a, w in enumerate((width,) * self.dim if isinstance(width, int) else width)] + [0, 0]
        out = self.table.withColumn("x_start", F.col("x_start") - widths[0]).withColumn("x_end", F.col("x_end") + widths[0])
        if widths[2]:
            out = out.withColumn("z", F.explode(F.sequence(F.col("z") - widths[2], F.col("z") + widths[2])))
        # An interval goes once to each band of rows that it reaches, and is dealt out to the rows there.
        y, w, rows = F.col("y"), widths[1], self._times(prod(2 * w + 1 for w in widths[1:]))
        banded = split(out).withColumn("band", F.explode(F.sequence(F.shiftright(y - w, BAND), F.shiftright(y + w, BAND))))
        low = F.shiftleft("band", BAND)
        each = deal(banded, rows, "band", "block").withColumn("y", F.explode(F.sequence(F.greatest(y - w, low), F.least(y + w, low + ((1 << BAND) - 1)))))
        local = merge(each, ["level", "z", "y", "band", "block"], ["x_start", "x_end"])
        return self._new(stitch(local, rows), more=prod(2 * w + 1 for w in widths[1:]))

    def contract(self, width: int, axes: tuple[bool, ...] | None = None) -> CellSet:
        """The set meets its own shifts by `width` both ways, along each chosen axis."""
        out = self
        for a, c in enumerate(("x", "y", "z")[: self.dim]):
            if width and (axes or (True,) * 3)[a]:
                # One read, dealt out thrice: where all three lie, the cover is three.
                shifted = out.table.withColumn("by", F.explode(F.array(*map(F.lit, (-width, 0, width)))))
                moved = shifted.withColumns({n: F.col(n) + F.col("by") for n in (("x_start", "x_end") if c == "x" else (c,))})
                out = _swept([moved], self.level, self.dim, out._times(3), lambda n: n[0] == 3)
        return out

    def shrink(self, width: int) -> CellSet:
        """Every interval shortened by `width` at both ends; those that would vanish go."""
        return self._new(self.table.where(F.col("x_end") - F.col("x_start") > 2 * width).withColumn("x_start", F.col("x_start") + width).withColumn("x_end", F.col("x_end") - width))

    def nested_expand(self, width: int) -> CellSet:
        """The union of all shifts by up to one cell, `width` times over: the same cells as expand."""
        return self.expand(width)

    def cells(self) -> DataFrame:
        return to_cells(self.table)

    def empty(self) -> bool:
        return self.known_empty or self.table.isEmpty()

    def exist(self) -> bool:
        """Whether it may have cells, without a job."""
        return not self.known_empty

    def stored(self) -> CellSet:
        """The same set with its lineage cut, by Spark's reliable checkpoint."""
        return self._new(self.table.checkpoint())

    def apply(self, *columns):
        """Cells with computed columns: what a visit of all cells would produce."""
        return self.cells().select("*", *columns)

    def _times(self, by: int) -> int | None:
        return None if self.rows is None else self.rows * by

    def _new(self, table: DataFrame, level: int | None = None, more: int = 1) -> CellSet:
        return CellSet(table, self.level if level is None else level, self.dim, self.known_empty, self._times(more))


def of_table(table: DataFrame, level: int, dim: int = 2, canonical: bool = False, rows: int | None = None) -> CellSet:
    """The intervals of one level; canonical: they are so already. rows: at most so many, where that is known."""
    own = table.where(F.col("level") == level)
    return CellSet(own if canonical else normalise(own, rows), level, dim, rows=rows)


def of_box(spark: SparkSession, level: int, low: tuple[int, ...], high: tuple[int, ...]) -> CellSet:
    """The cells low <= index < high."""
    (x0, y0, z0), (x1, y1, z1) = (*low, 0, 0)[:3], (*high, 1, 1)[:3]
    rows = spark.range(y0, max(y0, y1)).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(z0), F.lit(max(z0, z1 - 1)))).alias("z")).where(F.lit(z0 < z1))
    table = rows.select(F.lit(level).alias("level"), "z", "y", F.lit(x0).alias("x_start"), F.lit(x1).alias("x_end")).where(F.lit(x0 < x1))
    return CellSet(table, level, len(low), any(a >= b for a, b in zip(low, high)), max(0, y1 - y0) * max(0, z1 - z0))


def nothing(spark: SparkSession, level: int, dim: int = 2) -> CellSet:
    return CellSet(frame(spark, []), level, dim, True, 0)


def _rows(sets: list[CellSet]) -> int | None:
    return None if any(s.rows is None for s in sets) else sum(s.rows for s in sets)


def _sweep(sets: list[CellSet], keep) -> CellSet:
    """What `keep` says of whether each operand lies there."""
    level = max(s.level for s in sets)
    same = [s.on(level) for s in sets]
    return _swept([s.table for s in same], level, max(s.dim for s in sets), _rows(same), lambda n: keep([c > 0 for c in n]))


def _swept(tables: list[DataFrame], level: int, dim: int, rows: int | None, keep) -> CellSet:
    """Segments between the ends of all tables' intervals, where `keep(counts)` holds; counts has each table's cover."""
    end = lambda x, d: F.struct(F.col(x).alias("x_start"), F.lit(d).alias("d"))
    cut = [split(t.select(*INTERVAL)).select("z", "y", "block", F.explode(F.array(end("x_start", 1), end("x_end", -1))).alias("e"), F.lit(n).alias("of")) for n, t in enumerate(tables)]
    row = ["z", "y", "block"]
    ends = deal(reduce(DataFrame.unionByName, cut).select(*row, "e.*", "of"), rows and rows * 2)
    order = Window.partitionBy(*row).orderBy("x_start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = [F.sum(F.when(F.col("of") == n, F.col("d")).otherwise(0)).over(upto).alias(f"c{n}") for n in range(len(tables))]
    # Of ends at one place all but the last begin an empty segment.
    covered = ends.select(*row, "x_start", F.lead("x_start").over(order).alias("x_end"), *counts)
    kept = covered.where((F.col("x_start") < F.col("x_end")) & keep([F.col(f"c{n}") for n in range(len(tables))]))
    local = merge(kept.select(*row, "x_start", "x_end"), row, ["x_start"]).withColumn("level", F.lit(level))
    return CellSet(stitch(local, rows), level, dim, rows=rows)


def _cut(fine: CellSet, other: CellSet, inside: bool) -> CellSet:
    """What of `fine` lies inside, or outside, a set on a coarser level, whose rows are not refined: each block of a band of fine rows
    gets the coarse intervals there once (at most 2^BLOCK / 2^(steps + 1)), and cuts its own with them."""
    steps = fine.level - other.level
    band = min(steps, BAND)
    axes = [a for a in ("y", "z")[: max(fine.dim, other.dim) - 1]]
    holes = other.table.select(*INTERVAL).withColumns({x: F.shiftleft(x, steps) for x in ("x_start", "x_end")})
    for a in axes:
        holes = holes.withColumn(a, F.explode(F.sequence(F.shiftleft(a, steps - band), F.shiftleft(F.col(a) + 1, steps - band) - 1)))
    keys = [f"b{a}" for a in ("y", "z")]
    piece = F.struct("x_start", "x_end")
    mine = split(fine.table.select(*INTERVAL)).select(*((F.shiftright(a, band) if a in axes else F.col(a)).alias(k) for a, k in zip(("y", "z"), keys)), "block", "z", "y", piece.alias("own"))
    theirs = split(holes).select(F.col("y").alias("by"), F.col("z").alias("bz"), "block", piece.alias("hole"))
    both = deal(mine.unionByName(theirs, allowMissingColumns=True), _rows([fine, other]), "by", "block")
    group = Window.partitionBy(*keys, "block").orderBy("hole.x_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = both.withColumn("holes", F.collect_list("hole").over(group)).where("own is not null")
    start, end = F.col("own.x_start"), F.col("own.x_end")
    near = F.filter("holes", lambda h: (h["x_start"] < end) & (h["x_end"] > start))
    part = lambda a, b: F.struct(a.alias("x_start"), b.alias("x_end"))
    if inside:
        parts = F.transform(near, lambda h: part(F.greatest(h["x_start"], start), F.least(h["x_end"], end)))
    else:
        lows, highs = F.concat(F.array(start), F.transform(near, lambda h: h["x_end"])), F.concat(F.transform(near, lambda h: h["x_start"]), F.array(end))
        parts = F.filter(F.zip_with(lows, highs, part), lambda p: p["x_start"] < p["x_end"])
    left = met.select("z", "y", "block", F.explode(parts).alias("p")).select(F.lit(fine.level).alias("level"), "z", "y", "p.*", "block")
    rows = _rows([fine, other])
    return CellSet(stitch(left, rows), fine.level, max(fine.dim, other.dim), rows=rows)


def intersection(*sets: CellSet) -> CellSet:
    level, own = max(s.level for s in sets), [s.coarse or s for s in sets]
    finest = max(s.level for s in own)
    fine = [s for s in own if s.level == finest]
    out = fine[0] if len(fine) == 1 else _sweep(fine, lambda c: reduce(lambda a, b: a & b, c))
    return reduce(lambda a, b: _cut(a, b, True), [s for s in own if s.level < finest], out).on(level)


def difference(first: CellSet, *others: CellSet) -> CellSet:
    """Cells of the first set that are in none of the others."""
    level = max(s.level for s in (first, *others))
    out, *own = [s.coarse or s for s in (first, *others)]
    at = out.level
    out = reduce(lambda a, b: _cut(a, b, False), [s for s in own if s.level < at], out)
    rest = [s for s in own if s.level >= at]
    return (_sweep([out, *rest], lambda c: reduce(lambda a, b: a & ~b, c)) if rest else out).on(level)


def union(*sets: CellSet) -> CellSet:
    level = max(s.level for s in sets)
    same = [s.on(level) for s in sets]
    rows = _rows(same)
    return CellSet(normalise(reduce(DataFrame.unionByName, [s.table for s in same]), rows), level, max(s.dim for s in sets), all(s.known_empty for s in sets), rows)


def box_difference(low: tuple[int, ...], high: tuple[int, ...], hole_low: tuple[int, ...], hole_high: tuple[int, ...]) -> list[tuple]:
    """What is left of a box around a hole: at most 3^d - 1 boxes."""
    a, b = [max(x, y) for x, y in zip(low, hole_low)], [min(x, y) for x, y in zip(high, hole_high)]
    if any(x >= y for x, y in zip(a, b)):
        return [(tuple(low), tuple(high))]
    parts = [[(l, p), (p, q), (q, h)] for l, p, q, h in zip(low, a, b, high)]
    return [(tuple(x for x, _ in box), tuple(y for _, y in box)) for box in product(*parts) if all(x < y for x, y in box) and any((x, y) != (p, q) for (x, y), p, q in zip(box, a, b))]
