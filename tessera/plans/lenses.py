"""Stored tables seen as intervals, cells, fields, boxes and points; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.levels import CELL
from tessera.operators.mesh import cells_of_boxes
from tessera.operators.sets import CellSet, of_table
from tessera.operators.intervals import deal, to_intervals

SIDE, LEVEL = 64, 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Raw intervals, which overlap: days of orders in rows by customer."""
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return table(spark, sf, "orders").select(F.lit(12).alias("level"), F.lit(0).alias("z"), F.pmod("o_custkey", F.lit(16)).cast("int").alias("y"), day.alias("x_start"), (day + 1 + F.pmod("o_orderkey", F.lit(7))).cast("int").alias("x_end"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.lit(LEVEL).alias("level"), F.pmod("l_partkey", F.lit(SIDE)).cast("int").alias("i"), F.pmod("l_suppkey", F.lit(SIDE)).cast("int").alias("j"), F.lit(0).alias("k"), "l_orderkey", "l_returnflag", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))


#: Three sets of cells on a fine level, each from all line items: their whole keys, shifted by other columns.
FINE = 14
_SPARSE = {"a": ("l_partkey", "l_suppkey"), "b": ("l_partkey", "l_suppkey + l_linenumber - 1"), "c": ("l_partkey + l_quantity::bigint % 3", "l_suppkey")}


def sparse_cells(spark: SparkSession, sf: str, which: str) -> DataFrame:
    return deal(_line_cells(spark, sf, which), lines(spark, sf), "i", "j").distinct()


def lines(spark: SparkSession, sf: str) -> int:
    """Line items: a count that Parquet keeps."""
    return table(spark, sf, "lineitem").count()


def _line_cells(spark: SparkSession, sf: str, which: str) -> DataFrame:
    i, j = (F.expr(x).cast("int") for x in _SPARSE[which])
    return table(spark, sf, "lineitem").select(F.lit(FINE).alias("level"), i.alias("i"), j.alias("j"), F.lit(0).alias("k"))


def sparse(spark: SparkSession, sf: str, which: str) -> CellSet:
    """Repeated cells meet where intervals are merged. The table's row count says how far to deal them out."""
    rows = lines(spark, sf)
    return of_table(to_intervals(_line_cells(spark, sf, which), rows), FINE, canonical=True, rows=rows)


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the grid whose quantity is a multiple of 4."""
    return grid(spark, sf).where(F.col("u").cast("long") % 4 == 0).select(*CELL)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A value on every cell of a square of SIDE cells: quantities of line items, 0 where there are none."""
    u = _lines(spark, sf).groupBy(*CELL).agg(F.sum("q").cast("double").alias("u"))
    return cells_of_boxes(spark, LEVEL, [((0, 0), (SIDE, SIDE))]).join(u, CELL, "left").select(*CELL, F.coalesce("u", F.lit(0.0)).alias("u"))


def mesh(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with some families merged into their parents: leaves on two levels."""
    coarse = F.pmod(F.shiftright("i", 1) * 5 + F.shiftright("j", 1) * 3, F.lit(4)) == 0
    g = grid(spark, sf).withColumn("up", coarse)
    merged = g.where("up").groupBy((F.col("level") - 1).alias("level"), F.shiftright("i", 1).alias("i"), F.shiftright("j", 1).alias("j"), "k").agg((F.sum("u") / 4).alias("u"))
    return g.where(~F.col("up")).select(*CELL, "u").unionByName(merged)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.pmod(F.col("c_custkey") * 7, F.lit(SIDE)).cast("int").alias("i"), F.pmod(F.col("c_nationkey") * 5, F.lit(SIDE)).cast("int").alias("j"), F.lit(0).alias("k")).distinct()


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Small integer components on cells of one long row."""
    e = lambda n: F.round(F.col("embedding")[n].cast("double") * 1024).cast("int").alias(f"v{n}")
    return table(spark, sf, "embeddings").select(F.lit(0).alias("level"), F.col("vec_id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"), e(0), e(1))


SQL = f"""
n1 as (select (o_custkey % 16)::int y, date_diff('day', date '1995-01-01', o_orderdate::date)::int xs, (date_diff('day', date '1995-01-01', o_orderdate::date) + 1 + o_orderkey % 7)::int xe from orders),
lines as (select (l_partkey % {SIDE})::int i, (l_suppkey % {SIDE})::int j, l_orderkey o, l_returnflag f, l_linenumber n, l_quantity::bigint q from lineitem),
{''.join(f"{w} as (select distinct ({i})::int i, ({j})::int j from lineitem), " for w, (i, j) in _SPARSE.items())}
square as (select x.i::int i, y.j::int j from range({SIDE}) x(i), range({SIDE}) y(j)),
grid as (select s.i, s.j, coalesce(sum(q), 0)::double u from square s left join lines l on s.i = l.i and s.j = l.j group by all),
mark as (select i, j from grid where u::bigint % 4 = 0),
marked as (select *, ((i >> 1) * 5 + (j >> 1) * 3) % 4 = 0 up from grid),
mesh as (select 6 as level, i, j, u from marked where not up union all select 5, i >> 1, j >> 1, sum(u) / 4 from marked where up group by i >> 1, j >> 1),
points as (select distinct (c_custkey * 7 % {SIDE})::int i, (c_nationkey * 5 % {SIDE})::int j from customer),
cells1 as (select distinct y, unnest(range(xs, xe))::int x from n1),
runs1 as (select y, min(x)::int x_start, (max(x) + 1)::int x_end from (select y, x, x - row_number() over (partition by y order by x) g from cells1) group by y, g),
vec as (select vec_id::int i, round(embedding[1]::double * 1024)::int v0, round(embedding[2]::double * 1024)::int v1 from embeddings)
"""
