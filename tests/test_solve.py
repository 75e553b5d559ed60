"""Solvers over whole systems, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.levels import CELL
from tessera.operators import mesh, schemes, solve
from tessera.plans.session import checkpoint_dir


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    checkpoint_dir(spark)


def test_unsymmetric_system(spark):
    rng = np.random.default_rng(3)
    n = 24
    a = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3) + np.diag(rng.uniform(4, 9, n))
    b = rng.normal(size=n)
    table = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "row int, col int, value double")
    got = {r.id: r.v for r in solve.bicgstab(table, spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "id int, v double"), 1e-10).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(list(np.linalg.solve(a, b)), abs=1e-7)
    nothing = solve.bicgstab(table, spark.createDataFrame([(i, 0.0) for i in range(n)], "id int, v double")).collect()
    assert {r.v for r in nothing} == {0.0}
    with pytest.raises(ArithmeticError):
        solve.bicgstab(table, spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "id int, v double"), 1e-14, rounds=1)


def test_jacobian_of_fluxes(spark):
    cells = mesh.tree_of(spark.createDataFrame([(3, 3, 4, 0)], "level int, i int, j int, k int"), mesh.cells_of_boxes(spark, 2, [((0, 0), (4, 4))]), 2, 2)
    field = cells.withColumn("u", F.pmod(F.col("i") * 3 + F.col("j"), F.lit(5)).cast("double") + 1).checkpoint()
    flux = lambda d, l, r, h: l["u"] * r["u"] * (d + 1) - (r["u"] - l["u"]) / h
    rows = solve.flux_jacobian(cells, field, 2, flux, "u", shift=2.0).collect()
    jacobian = {(tuple(r.row), tuple(r.col)): r.value for r in rows}
    ids = [tuple(r) for r in field.select(*CELL).collect()]
    direction = {c: float(n % 7 - 3) for n, c in enumerate(ids)}
    step = spark.createDataFrame([(*c, v) for c, v in direction.items()], "level int, i int, j int, k int, d double")

    def scaled(s):
        moved = field.join(step, CELL).select(*CELL, (F.col("u") + s * F.col("d")).alias("u"))
        flow = schemes.flux_scheme(cells, moved, 2, flux, "u")
        return {tuple(r[c] for c in CELL): r.x for r in moved.join(flow, CELL).select(*CELL, ((2 * F.col("u") + F.col("r")) * F.pow(F.lit(0.25), "level")).alias("x")).collect()}

    up, down = scaled(1e-4), scaled(-1e-4)
    for c in ids:
        want = (up[c] - down[c]) / 2e-4
        assert sum(v * direction[b] for (a, b), v in jacobian.items() if a == c) == pytest.approx(want, abs=1e-5)


def test_newton(spark):
    field = spark.createDataFrame([(0, i, 0, 0, 1.0 + i) for i in range(4)], "level int, i int, j int, k int, u double")
    residual = lambda f: f.select(*CELL, (F.pow("u", F.lit(3)) - (F.col("i") + 1)).alias("r"))
    jacobian = lambda f: f.select(solve.cell_id().alias("row"), solve.cell_id().alias("col"), (3 * F.pow("u", F.lit(2))).alias("value"))
    got = {r.i: r.u for r in solve.newton(field, residual, jacobian).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([(i + 1) ** (1 / 3) for i in range(4)], abs=1e-7)
