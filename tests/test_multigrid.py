"""Multigrid and block systems, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.levels import CELL
from tessera.functions.levels import CELL
from tessera.operators import blocks, mesh, multigrid, solve
from tessera.plans.session import checkpoint_dir


@pytest.fixture(scope="module")
def leaves(spark):
    checkpoint_dir(spark)
    area = mesh.cells_of_boxes(spark, 3, [((0, 0), (8, 8))])
    pins = spark.createDataFrame([(5, 9, 20, 0), (5, 0, 0, 0)], "level int, i int, j int, k int")
    return mesh.graduate(mesh.tree_of(pins, area, 3, 2), 2).checkpoint()


def dense(matrix, ids):
    out = np.zeros((len(ids), len(ids)))
    for r in matrix.collect():
        out[ids.index(tuple(r.row)), ids.index(tuple(r.col))] += r.value
    return out


def operator(leaves):
    return solve.diffusion_matrix(leaves, leaves, 2, dirichlet=False, shift=0.5)


def vector(leaves):
    return leaves.select(solve.cell_id().alias("id"), F.pmod(F.col("i") * 7 + F.col("j") * 3, F.lit(11)).cast("double").alias("v")).checkpoint()


@pytest.fixture(scope="module")
def grids(leaves):
    return multigrid.hierarchy(leaves, operator, 2)


def test_grids_tile_the_domain(leaves, grids):
    points = grids.points.select("id.grid", "id.id.*").checkpoint()
    sizes = [r["count"] for r in points.groupBy("grid").count().orderBy("grid").collect()]
    assert len(sizes) == 4 and sizes[0] == leaves.count() and sizes[-1] == 16 and sizes == sorted(sizes, reverse=True)
    assert {r.s for r in points.groupBy("grid").agg(F.sum(F.pow(F.lit(0.25), F.col("level"))).alias("s")).collect()} == {1.0}


def v_cycle(matrices, ups, b, weight=0.8):
    """A plain recursive V-cycle."""
    a = matrices[0]
    if len(matrices) == 1:
        return np.linalg.solve(a, b)
    d = np.diag(a)
    x = weight * b / d
    x = x + ups[0].T @ v_cycle(matrices[1:], ups[1:], ups[0] @ (b - a @ x), weight)
    return x + weight * (b - a @ x) / d


def test_cycle_is_a_v_cycle(spark, leaves, grids):
    """The three products against the recursion."""
    cells, matrices, ups, ids = leaves, [], [], [tuple(r) for r in leaves.select(*CELL).collect()]
    start = ids
    for top in (5, 4, 3, 2):
        matrices.append(dense(operator(cells), ids))
        if top > 2:
            up = {tuple(r)[:4]: tuple(r.up) for r in multigrid.parents_of_finest(cells, top).collect()}
            coarse = sorted(set(up.values()))
            ups.append(np.array([[float(up[c] == p) for c in ids] for p in coarse]))
            cells, ids = spark.createDataFrame(coarse, "level int, i int, j int, k int"), coarse
    rhs = vector(leaves)
    b = {tuple(r.id): r.v for r in rhs.collect()}
    want = v_cycle(matrices, ups, np.array([b[c] for c in start]))
    got = {tuple(r.id): r.v for r in multigrid.cycle(grids, rhs).collect()}
    assert [got[c] for c in start] == pytest.approx(list(want), rel=1e-9)


def test_solution(leaves, grids):
    rhs = vector(leaves)
    ids = [tuple(r.id) for r in rhs.collect()]
    want = np.linalg.solve(dense(grids.matrix, ids), [r.v for r in rhs.collect()])
    swept = multigrid.hierarchy(leaves, operator, 3, direct=1)
    for got in (multigrid.cycles(grids, rhs, 1e-8), solve.bicgstab(grids.matrix, rhs, 1e-9, 15, lambda v: multigrid.cycle(grids, v)), solve.bicgstab(swept.matrix, rhs, 1e-9, 60, lambda v: multigrid.cycle(swept, v))):
        found = {tuple(r.id): r.v for r in got.collect()}
        assert [found[c] for c in ids] == pytest.approx(list(want), rel=1e-5)
    with pytest.raises(ArithmeticError):
        multigrid.cycles(grids, rhs, 1e-12, 1)


def test_nothing_to_solve(leaves, grids):
    assert multigrid.hierarchy(leaves.limit(0), operator) is None
    assert {r.v for r in multigrid.cycles(grids, vector(leaves).withColumn("v", F.lit(0.0))).collect()} == {0.0}
    assert multigrid.cycles(None, vector(leaves).limit(0)).count() == 0


def test_border_rows(leaves):
    """With their unknowns eliminated, value rows are those of the matrix with zero at its borders; slopes only move the right side."""
    value, right = blocks.border_rows(leaves, 2, 0, 1, 3, lambda axis, side: ("value", 1.5))
    system = solve.matrix_sum(blocks.diffusion(leaves, 2, 0), value)
    ids = sorted({tuple(r.row) for r in system.collect()})
    a, b = dense(system, ids), np.zeros(len(ids))
    for r in right.collect():
        b[ids.index(tuple(r.id))] += r.v
    # zero diffusion between equal values: the constant solves it
    assert np.allclose(np.linalg.solve(a, b), 1.5)
    slope, right = blocks.border_rows(leaves, 2, 0, 1, 3, lambda axis, side: ("slope", 2.0 * side if axis == 0 else 0.0))
    system = solve.matrix_sum(blocks.diffusion(leaves, 2, 0), slope)
    a, b = dense(system, ids), np.zeros(len(ids))
    for r in right.collect():
        b[ids.index(tuple(r.id))] += r.v
    inner = [n for n, c in enumerate(ids) if c[0] == 0]
    assert np.allclose(a[inner].sum(axis=1), 0)
    # solvable: what flows in on one side leaves on the other
    assert np.allclose(a @ np.linalg.lstsq(a, b, rcond=None)[0], b, atol=1e-9)


def test_block_solution(spark, leaves):
    """A saddle-like system without a lower right block but for a small one, against numpy; repeated entries are summed."""
    border, right = blocks.border_rows(leaves, 2, 0, 2, 3, lambda axis, side: ("value", float(axis)))
    parts = [blocks.diffusion(leaves, 2, 0, shift=40.0), border, blocks.mass(leaves, 2, 0, 1, 30.0), blocks.mass(leaves, 2, 1, 0, -20.0), blocks.mass(leaves, 2, 1, 0, -10.0), blocks.mass(leaves, 2, 1, 1, 0.5)]
    system = parts[0]
    for p in parts[1:]:
        system = system.unionByName(p)
    rhs = right.unionByName(leaves.select(blocks.unknown(1).alias("id"), (F.pow(F.lit(0.25), F.col("level")) * F.col("i")).alias("v")))
    ids = sorted({tuple(r.row) for r in system.collect()})
    b = np.zeros(len(ids))
    for r in rhs.collect():
        b[ids.index(tuple(r.id))] += r.v
    want = np.linalg.solve(dense(system, ids), b)
    got = {tuple(r.id): r.v for r in blocks.solve(system, rhs, [1], 1e-10, 100).collect()}
    assert [got[c] for c in ids] == pytest.approx(list(want), abs=1e-5)


def test_product_of_matrices(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-2, 3, (5, 5)).astype(float) for _ in range(2))
    table = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(5) if m[i, j]], "row int, col int, value double")
    got = np.zeros((5, 5))
    for r in multigrid.times(table(a), table(b)).collect():
        got[r.row, r.col] = r.value
    assert (got == a @ b).all()
