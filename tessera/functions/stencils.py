"""Offsets of neighbours, as lists of integer triples."""

from __future__ import annotations

from itertools import product

Offset = tuple[int, int, int]


def _triple(v) -> Offset:
    return (*v, *[0] * (3 - len(v)))


def star(dim: int, width: int = 1) -> list[Offset]:
    """The centre and `width` cells each way along every axis."""
    return [(0, 0, 0), *(_triple([s * w if a == d else 0 for a in range(dim)]) for d in range(dim) for w in range(1, width + 1) for s in (-1, 1))]


def line(dim: int, axis: int, *at: int) -> list[Offset]:
    return [_triple([x if a == axis else 0 for a in range(dim)]) for x in at]


def box(dim: int, width: int = 1) -> list[Offset]:
    return [_triple(v) for v in product(range(-width, width + 1), repeat=dim)]


def centre_only() -> list[Offset]:
    return [(0, 0, 0)]


def directions(dim: int) -> list[Offset]:
    """Unit steps along the axes, both ways."""
    return [v for v in star(dim) if any(v)]


def diagonals(dim: int) -> list[Offset]:
    """Steps with at least two axes that move."""
    return [v for v in box(dim) if sum(map(bool, v)) >= 2]


def children(dim: int) -> list[Offset]:
    return [_triple(v) for v in product((0, 1), repeat=dim)]
