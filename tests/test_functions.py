from fractions import Fraction
from itertools import product

import numpy as np
import pytest

from tessera.functions import curves, prediction, stencils
from tessera.operators import boundary, mesh, partition, sets
from tessera.plans.session import checkpoint_dir


def test_half_cell_weights():
    assert prediction.half_cell(0) == (1,)
    assert prediction.half_cell(1) == (Fraction(-1, 8), 1, Fraction(1, 8))
    assert prediction.half_cell(2) == (Fraction(3, 128), Fraction(-22, 128), 1, Fraction(22, 128), Fraction(-3, 128))


@pytest.mark.parametrize("order", [0, 1, 2, 3, 5])
def test_prediction_keeps_means_and_polynomials(order):
    w = prediction.half_cell(order)
    both = [a + b for a, b in zip(w, w[::-1])]
    assert both == [2 * (n == order) for n in range(2 * order + 1)]
    mean = lambda a, b, m: (Fraction(b) ** (m + 1) - Fraction(a) ** (m + 1)) / (m + 1) / (Fraction(b) - Fraction(a))
    for m in range(2 * order + 1):
        assert sum(x * mean(Fraction(2 * c - 1, 2), Fraction(2 * c + 1, 2), m) for c, x in zip(range(-order, order + 1), w)) == mean(0, Fraction(1, 2), m)


@pytest.mark.parametrize("dim", [1, 2])
def test_descendants_average_to_their_ancestor(dim):
    forms = [prediction.descendant(1, 3, at) for at in product(range(8), repeat=dim)]
    assert prediction.combine(*((Fraction(1, 8**dim), f) for f in forms)) == {(0,) * dim: 1}
    assert all(sum(f.values()) == 1 for f in forms)


def test_stencils():
    assert len(stencils.star(3, 2)) == 13 and len(stencils.box(2)) == 9
    assert len(stencils.directions(3)) == 6 and len(stencils.diagonals(3)) == 20 and len(stencils.children(3)) == 8


@pytest.mark.parametrize("dim,bits", [(2, 4), (3, 3)])
def test_hilbert_visits_neighbours(dim, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dim)))
    key = curves.hilbert_keys(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_lagrange_ghosts():
    assert boundary.lagrange([0.5, 0.0], 1.0) == pytest.approx([2, -1])
    assert boundary.lagrange([0.0, -1.0, -2.0], 1.0) == pytest.approx([3, -3, 1])
    assert boundary.lagrange([0.5, 0.0, -1.0], 1.0) == pytest.approx([8 / 3, -2, 1 / 3])


def test_box_difference():
    parts = sets.box_difference((0, 0), (6, 6), (2, 2), (4, 4))
    cells = [c for lo, hi in parts for c in product(*(range(a, b) for a, b in zip(lo, hi)))]
    assert len(parts) == 8 and len(cells) == len(set(cells)) == 32
    assert sets.box_difference((0,), (2,), (5,), (6,)) == [((0,), (2,))]


def test_boxes():
    low, high, side = mesh.approximate_box([0.0, 0.0], [1.0, 2.5])
    assert all(abs((b - a) / side - round((b - a) / side)) < 1e-9 for a, b in zip(low, high))
    assert mesh.largest_subdivision([12, 18, 30]) == 6


def test_flows(spark):
    checkpoint_dir(spark)
    load = {0: 10.0, 1: 2.0, 2: 0.0}
    found = partition.diffusion_flows(spark.createDataFrame(list(load.items()), "part int, load double"), spark.createDataFrame([(0, 1), (1, 2)], "a int, b int"), 14).collect()
    flow = {(r.a, r.b): r.flow for r in found}
    assert all(flow[a, b] == pytest.approx(-flow[b, a]) for a, b in flow)
    assert load[0] - flow[1, 0] == pytest.approx(4, abs=0.1) and load[2] + flow[2, 1] == pytest.approx(4, abs=0.1)
