"""Coefficients that predict the mean of a half cell from cell means, exact for polynomials of degree twice the order."""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import product

from .stencils import Offset


@cache
def half_cell(order: int) -> tuple[Fraction, ...]:
    """Weights of cells -order..order for the right half of cell 0 (for the left half take them backwards).

    They follow from the conditions that means of x^m come out right for m up to 2 * order.
    """
    n = 2 * order + 1
    mean = lambda a, b, m: (Fraction(b) ** (m + 1) - Fraction(a) ** (m + 1)) / ((m + 1) * (Fraction(b) - Fraction(a)))
    rows = [[mean(Fraction(2 * c - 1, 2), Fraction(2 * c + 1, 2), m) for c in range(-order, order + 1)] + [mean(0, Fraction(1, 2), m)] for m in range(n)]
    for p in range(n):
        pivot = next(r for r in range(p, n) if rows[r][p])
        rows[p], rows[pivot] = rows[pivot], rows[p]
        rows[p] = [x / rows[p][p] for x in rows[p]]
        for r in range(n):
            if r != p and rows[r][p]:
                rows[r] = [x - rows[r][p] * y for x, y in zip(rows[r], rows[p])]
    return tuple(r[-1] for r in rows)


def child(order: int, parity: int) -> dict[int, Fraction]:
    """Weights by offset for the child of this parity along one axis."""
    w = half_cell(order)
    return {c - order: x for c, x in enumerate(w if parity else w[::-1]) if x}


@cache
def table(dim: int, order: int) -> tuple[tuple[Offset, Offset, float], ...]:
    """(child parity, offset of a coarse cell, weight) of the prediction along all axes."""
    out = []
    for parity in product((0, 1), repeat=dim):
        for cells in product(*(child(order, p).items() for p in parity)):
            weight = Fraction(1)
            for _, w in cells:
                weight *= w
            pad = (0,) * (3 - dim)
            out.append(((*parity, *pad), (*(c for c, _ in cells), *pad), float(weight)))
    return tuple(out)


@cache
def descendant(order: int, delta: int, at: tuple[int, ...]) -> dict[tuple[int, ...], Fraction]:
    """The linear form of a cell `delta` levels down (offset `at` within its ancestor) in cells around the ancestor."""
    if delta == 0:
        return {at: Fraction(1)}
    out: dict[tuple[int, ...], Fraction] = {}
    for cells in product(*(child(order, x & 1).items() for x in at)):
        weight = Fraction(1)
        for _, w in cells:
            weight *= w
        for cell, w in descendant(order, delta - 1, tuple((x >> 1) + c for x, (c, _) in zip(at, cells))).items():
            out[cell] = out.get(cell, Fraction(0)) + weight * w
    return {c: w for c, w in out.items() if w}


def combine(*forms: tuple[Fraction | int, dict]) -> dict:
    """Sum of scaled linear forms; entries that cancel are dropped."""
    out: dict = {}
    for scale, form in forms:
        for cell, w in form.items():
            out[cell] = out.get(cell, 0) + scale * w
    return {c: w for c, w in out.items() if w}
