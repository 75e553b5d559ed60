"""Keys along space-filling curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread2(x: Column) -> Column:
    x = x.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _spread3(x: Column) -> Column:
    x = x.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(*axes: Column) -> Column:
    """Interleaved bits of non-negative coordinates: up to 31 bits each of two, 21 of three."""
    if len(axes) == 1:
        return axes[0].cast("long")
    spread = _spread2 if len(axes) == 2 else _spread3
    out = spread(axes[0])
    for n, x in enumerate(axes[1:], 1):
        out = out.bitwiseOR(F.shiftleft(spread(x), n))
    return out


def hilbert_keys(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert order of points (n, dim) with `bits` bits on each axis, by transposing Gray codes bit by bit."""
    x = coordinates.astype(np.int64).copy()
    n, dim = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        for d in range(dim):
            on = (x[:, d] & q) != 0
            x[on, 0] ^= q - 1
            t = np.where(on, 0, (x[:, 0] ^ x[:, d]) & (q - 1))
            x[:, 0] ^= t
            x[:, d] ^= t
        q >>= 1
    for d in range(1, dim):
        x[:, d] ^= x[:, d - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, dim - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dim):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def hilbert(bits: int, *axes: Column) -> Column:
    """Hilbert keys, in Arrow batches."""
    import pandas as pd

    def run(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_keys(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    by = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(axes)]
    return F.pandas_udf(by, "long", F.PandasUDFType.SCALAR)(*(a.cast("long") for a in axes))
