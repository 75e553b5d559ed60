"""Numerical fluxes as Column arithmetic on the values left and right of a face."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upwind(velocity: Column | float, left: Column, right: Column) -> Column:
    v = velocity if isinstance(velocity, Column) else F.lit(velocity)
    return v * F.when(v >= 0, left).otherwise(right)


def upwind_burgers(left: Column, right: Column) -> Column:
    """Half the square of the upwind value; the side is chosen by the mean."""
    return F.when(left + right >= 0, left * left).otherwise(right * right) / 2


def rusanov(velocity_left: Column, velocity_right: Column, left: Column, right: Column) -> Column:
    """Central flux with the greatest speed as dissipation."""
    speed = F.greatest(F.abs(velocity_left), F.abs(velocity_right))
    return (velocity_left * left + velocity_right * right) / 2 - speed * (right - left) / 2


def smooth_rusanov(velocity: Column, left: Column, right: Column, eps: float = 1e-6) -> Column:
    """Rusanov's flux with a speed that is smooth at 0."""
    return velocity * (left + right) / 2 - smooth_abs(velocity, eps) * (right - left) / 2


def smooth_abs(x: Column, eps: float = 1e-6) -> Column:
    return F.sqrt(x * x + F.lit(eps * eps))


def godunov_burgers(speed: float, left: Column, right: Column) -> Column:
    """Half a square: of the smaller value where speed * u rises over the face (0 if the signs differ), of the greater one elsewhere."""
    low, high = F.least(F.abs(left), F.abs(right)), F.greatest(F.abs(left), F.abs(right))
    return F.when(F.lit(speed) * left >= F.lit(speed) * right, high * high / 2).when(left * right > 0, low * low / 2).otherwise(F.lit(0.0))


def weno5(f0: Column, f1: Column, f2: Column, f3: Column, f4: Column) -> Column:
    """Value at the face right of f2: three parabolas weighted by smoothness (Jiang and Shu 1996)."""
    # The published constants of the scheme.
    q = (f0 / 3 - f1 * 7 / 6 + f2 * 11 / 6, -f1 / 6 + f2 * 5 / 6 + f3 / 3, f2 / 3 + f3 * 5 / 6 - f4 / 6)
    square = lambda x: x * x
    rough = (
        square(f0 - 2 * f1 + f2) * 13 / 12 + square(f0 - 4 * f1 + 3 * f2) / 4,
        square(f1 - 2 * f2 + f3) * 13 / 12 + square(f1 - f3) / 4,
        square(f2 - 2 * f3 + f4) * 13 / 12 + square(3 * f2 - 4 * f3 + f4) / 4,
    )
    weights = [F.lit(c) / square(r + 1e-6) for c, r in zip((0.1, 0.6, 0.3), rough)]
    return sum((w * x for w, x in zip(weights[1:], q[1:])), weights[0] * q[0]) / (weights[0] + weights[1] + weights[2])
