import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals, mesh, multires, partition, sets, solve
from tessera.operators.fields import equal
from tessera.plans import lenses, queries
from tessera.plans.session import checkpoint_dir
from tessera.sources import tables


def one(spark, level, *runs):
    return sets.of_table(intervals.frame(spark, [(level, 0, 0, a, b) for a, b in runs]), level, 1)


def runs(s):
    return sorted((r.x_start, r.x_end) for r in s.table.collect())


def test_levels_in_one_dimension(spark):
    ca1, ca4, ca5 = one(spark, 1, (0, 2)), one(spark, 4, (0, 2), (9, 12), (14, 20)), one(spark, 5, (9, 12), (14, 20))
    a, b, c = one(spark, 3, (0, 1)), one(spark, 3, (3, 5)), one(spark, 1, (1, 2))
    meet, join = sets.intersection, sets.union
    assert runs(ca4.on(0)) == [(0, 2)]
    assert runs(meet(ca4.on(0), ca5).on(1)) == [(0, 2)]
    assert runs(meet(ca5.on(1), ca1).on(3)) == [(0, 8)]
    assert runs(join(ca4, meet(ca5.on(1), ca1)).on(5)) == [(0, 40)]
    assert meet(meet(a.on(1), b.on(1)).on(2), c).empty()
    assert meet(a.translate(2), b).on(4).empty()
    assert runs(b.translate(-4).on(1).on(2)) == [(-2, 2)]
    assert runs(meet(a.on(1), b).on(2)) == [(1, 2)]
    assert runs(meet(join(a.on(2), b.on(2)), b).on(2)) == [(1, 3)]
    assert runs(sets.difference(one(spark, 0, (0, 10)), one(spark, 0, (2, 3)), one(spark, 0, (0, 5)))) == [(5, 10)]


def test_long_rows_are_stitched(spark):
    raw = [(0, 0, 0, a, a + n) for a, n in ((-5000, 3), (-4097, 1), (-4096, 4096), (0, 9000), (9000, 1), (9002, 5), (20000, 0))]
    df = intervals.normalise(intervals.frame(spark, raw))
    assert sorted((r.x_start, r.x_end) for r in df.collect()) == [(-5000, -4997), (-4097, 9001), (9002, 9007)]
    assert intervals.normalise(intervals.frame(spark, [])).isEmpty()
    points = spark.createDataFrame([(0, 8999, 0, 0), (0, 9001, 0, 0)], "level int, i int, j int, k int")
    assert {(r.i, r.x_start, r.x_end) for r in intervals.interval_of(df, points).collect()} == {(8999, -4097, 9001), (9001, None, None)}


@pytest.mark.parametrize("dim", [1, 2])
def test_laws(spark, dim):
    rng = random.Random(dim)
    make = lambda level: sets.of_table(intervals.to_intervals(spark.createDataFrame([(level, rng.randrange(-20, 20), rng.randrange(-6, 6) if dim > 1 else 0, 0) for _ in range(60)], "level int, i int, j int, k int")), level, dim)
    a, b, c = make(3), make(2), make(4)
    same = lambda x, y: x.table.exceptAll(y.table).isEmpty() and y.table.exceptAll(x.table).isEmpty()
    assert same(sets.intersection(a, sets.union(b, c)), sets.union(sets.intersection(a, b), sets.intersection(a, c)))
    assert same(sets.difference(c, sets.union(a, b)), sets.intersection(sets.difference(c, a), sets.difference(c, b)))


@pytest.fixture(scope="module")
def ready(spark):
    checkpoint_dir(spark)
    return spark


def test_graduation(ready):
    leaves = mesh.cells_of_boxes(ready, 0, [((1,), (2,))]).unionByName(mesh.cells_of_boxes(ready, 5, [((31,), (32,))]))
    done = mesh.graduate(leaves, 1)
    assert mesh.is_graduated(done, 1) and not mesh.is_graduated(leaves, 1)
    assert done.where("level < 5").agg(F.sum(F.pow(F.lit(0.5), "level"))).first()[0] == 1


def test_adaptation_and_checkpoint(ready, tmp_path):
    config = mesh.Config(dim=1, min_level=2, max_level=5, epsilon=1e-3)
    cells = mesh.cells_of_boxes(ready, 5, [((0,), (32,))])
    limits = multires.domain_limits(ready, config, (0,), (32,), 5)
    field = cells.select("*", F.when(F.col("i") < 11, 1.0).otherwise(0.0).alias("u"))
    small = multires.adapt(field, config, limits, "u").cache()
    volume = F.sum(F.pow(F.lit(0.5), "level") * F.col("u")), F.sum(F.pow(F.lit(0.5), "level"))
    assert small.agg(*volume).first() == field.agg(*volume).first()
    assert small.count() < 32 and small.where("level = 5").count() >= 2 and mesh.is_graduated(small, 1)
    assert equal(multires.reconstruct(small, config, limits, "u"), field, ["u"], 1e-9)
    tables.dump(small, f"{tmp_path}/m", 1, ["u"], time=0.5)
    assert equal(tables.load(ready, f"{tmp_path}/m", 1, ["u"]), small, ["u"], 0)
    assert tables.attributes(ready, f"{tmp_path}/m")["time"] == 0.5
    with pytest.raises(ValueError):
        tables.load(ready, f"{tmp_path}/m", 2, ["u"])


def test_solver(ready):
    area = mesh.cells_of_boxes(ready, 3, [((0,), (8,))])
    a = solve.diffusion_matrix(area, area, 1)
    want = area.select(solve.cell_id().alias("id"), F.sin(F.col("i") + 1.0).alias("v"))
    got = solve.conjugate_gradient(a, solve.product(a, want), 1e-10)
    assert got.withColumnRenamed("v", "g").join(want, "id").agg(F.max(F.abs(F.col("g") - F.col("v")))).first()[0] < 1e-6


def test_missing_neighbours_are_errors(ready):
    cells = mesh.cells_of_boxes(ready, 2, [((0,), (4,))]).withColumn("u", F.lit(1.0))
    with pytest.raises(Exception, match="missing"):
        multires.predict(cells, cells, 1, 1, "u").collect()


def test_balance(ready):
    cells = mesh.cells_of_boxes(ready, 4, [((0, 0), (16, 16))])
    dealt = partition.cuts(cells, partition.curve_key(2, 4), F.lit(1.0), 7)
    assert partition.imbalance(dealt, 7) < 0.05 and not partition.needs_balance(dealt, 7)
    assert partition.part_graph(dealt, 2).count() >= 6


def test_one_long_row_of_many_intervals(ready):
    df = ready.range(100_000).select(F.lit(20).alias("level"), F.lit(0).alias("z"), F.lit(0).alias("y"), (F.col("id") * 3).cast("int").alias("x_start"), (F.col("id") * 3 + 2).cast("int").alias("x_end"))
    points = ready.createDataFrame([(20, i, 0, 0) for i in (0, 1, 2, 150_000, 299_998, 299_999, 400_000)], "level int, i int, j int, k int")
    found = {r.i: (r.x_start, r.x_end) for r in intervals.interval_of(df, points).collect()}
    assert found == {0: (0, 2), 1: (0, 2), 2: (None, None), 150_000: (150_000, 150_002), 299_998: (299_997, 299_999), 299_999: (None, None), 400_000: (None, None)}


def test_names_of_fine_and_negative_cells_differ(ready):
    cells = ready.createDataFrame([(20, 524288, 0, 0), (20, 0, 1, 0), (20, -1, 0, 0), (20, -1, -1, 0)], "level int, i int, j int, k int")
    assert cells.select(solve.cell_id().alias("id")).distinct().count() == 4
    fine = ready.createDataFrame([(22, 2097152, 0, 0), (22, 0, 1, 0), (22, -1, 5, 0)], "level int, i int, j int, k int")
    points, corners = tables.elements(fine, 2, 22)
    assert points.count() == points.select("x", "y").distinct().count() == points.select("point").distinct().count() == 12
    assert corners.count() == 3


def test_numbers_run_through_a_level(ready):
    cells = ready.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (2, 5, 5, 1), (2, 6, 5, 0)], "level int, i int, j int, k int")
    assert sorted((r.level, r.k, r.j, r.i, r.number) for r in tables.numbered(cells).collect()) == [(1, 0, 0, 0, 0), (1, 0, 0, 1, 1), (1, 0, 1, 0, 2), (2, 0, 5, 6, 0), (2, 1, 5, 5, 1)]


def test_chains_plan_linearly(spark):
    """Every step adds the same to the plan."""
    one = sets.of_table(spark.createDataFrame([(5, 0, 0, 3, 9), (5, 0, 1, 4, 4099)], "level int, z int, y int, x_start int, x_end int"), 5)
    sizes, chain = [], one
    for _ in range(8):
        chain = sets.union(chain.expand(1), one).on(5)
        sizes.append(chain.table._jdf.queryExecution().optimizedPlan().toString().count("Window"))
    steps = [b - a for a, b in zip(sizes, sizes[1:])]
    assert len(set(steps)) == 1


def test_tasks_stay_small_as_rows_grow(ready):
    """Where the number of rows is known, partitions follow it, whatever the session's; no aggregate holds a task's islands."""
    raw = intervals.frame(ready, [(3, 0, n % 5, n * 2, n * 2 + 1 + n % 3) for n in range(50)])
    want = {(r.y, x) for r in raw.collect() for x in range(r.x_start, r.x_end)}
    s = sets.of_table(raw, 3, rows=intervals.ROWS * 7)
    both, either = sets.intersection(s, s.translate(1)), sets.union(s, s.translate(1))
    assert {(r.j, r.i) for r in s.cells().collect()} == want
    assert {(r.j, r.i) for r in both.cells().collect()} == {(y, x) for y, x in want if (y, x - 1) in want}
    assert [x.table.rdd.getNumPartitions() for x in (s, both, either)] == [7, 14, 14]
    for x in (s, both, either):
        assert "HashAggregate" not in x.table._jdf.queryExecution().executedPlan().toString()


def test_contraction_reads_its_set_once(ready):
    square = sets.of_table(intervals.frame(ready, [(3, 0, y, 4090, 4100) for y in range(6)]), 3)
    small = square.contract(2)
    assert sorted((r.y, r.x_start, r.x_end) for r in small.table.collect()) == [(2, 4092, 4098), (3, 4092, 4098)]
    assert small.table._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + small.table._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_coarser_sets_cut_without_refined_rows(spark):
    """Long and short runs against coarser sets, rows above and below zero, more rows than a band; as refined sets give it."""
    rng = random.Random(5)
    fine = [(9, 0, rng.randrange(-200, 200), x, x + rng.randrange(1, 6000)) for x in (rng.randrange(-9000, 9000) for _ in range(60))]
    rough = [(1, 0, rng.randrange(-1, 1), x, x + rng.randrange(1, 4)) for x in (rng.randrange(-40, 40) for _ in range(12))]
    a, b = sets.of_table(intervals.frame(spark, fine), 9), sets.of_table(intervals.frame(spark, rough), 1)
    plain = sets.CellSet(b.on(9).table, 9)
    assert b.on(9).coarse is not None and plain.coarse is None
    for f in (sets.intersection, sets.difference):
        got, want = (sorted(tuple(r) for r in f(a, x).table.collect()) for x in (b, plain))
        assert got == want != []
    assert sets.difference(a.on(11), b).coarse.level == 9


def test_growing_deals_rows_out_after_the_shuffle(spark):
    s = sets.of_table(intervals.frame(spark, [(7, 0, y, x, x + 2) for y, x in ((-1, 0), (63, 4093), (64, 4097), (200, 0))]), 7, rows=4)
    want = {(y + d, x + e) for y, x in ((-1, 0), (63, 4093), (64, 4097), (200, 0)) for d in range(-3, 4) for e in range(-1, 3)}
    grown = s.expand((1, 3))
    assert {(r.j, r.i) for r in grown.cells().collect()} == want
    plan = grown.table._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = [n for n, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert any("explode(sequence(greatest" in line for line in plan[dealt[0] : dealt[1]])


def test_pyramid_is_dealt_out_by_its_rows(spark):
    cells = spark.createDataFrame([(3, i, i % 4, 0) for i in range(8)], "level int, i int, j int, k int")
    known, plain = mesh.pyramid(cells, range(1, 5), 2, intervals.ROWS * 5), mesh.pyramid(cells, range(1, 5), 2)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, plain.collect()))
    assert known.where("level < 4").rdd.getNumPartitions() >= 15


@pytest.mark.parametrize("name", ["set_translate_on", "set_intersection", "set_difference", "set_expand_widths"])
def test_set_queries_follow_the_rows_of_their_table(ready, monkeypatch, name):
    """A task gets no more rows of a larger table, whatever the session's partitions (4 here)."""
    monkeypatch.setattr(intervals, "ROWS", 500, raising=False)
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](ready, sf)
    assert df.rdd.getNumPartitions() >= lenses.table(ready, sf, "lineitem").count() / 500 > 8
    assert "HashAggregate" not in df._jdf.queryExecution().executedPlan().toString()
