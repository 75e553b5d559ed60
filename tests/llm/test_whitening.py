import math

import numpy as np
import pytest

from tessera.llm import whitening
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"


def brute(rows, components=32):
    """numpy's decomposition of the exact integers."""
    size = max({len(v) for _, v in rows}, key=lambda k: (sum(len(v) == k for _, v in rows), k))
    rows = [(i, v) for i, v in rows if len(v) == size]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    centred = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > values[0] * 1e-12).sum())
    return n, ((n * x - s) ** 2).sum(1), centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(df, rows, tolerance=1e-8):
    n, deviation, white, share = brute(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows)
    sign = None
    for (i, _), dev, w in zip(rows, deviation, white):
        mine = [got[i][c + 1] for c in range(len(share))]
        assert len(got[i]) == len(share)
        assert all(r.n == n and r.deviation == dev and r.identity_error < 1e-9 for r in mine)
        assert [r.explained for r in mine] == pytest.approx(list(share), rel=1e-9)
        y = np.array([r.whitened for r in mine])
        if sign is None and (np.abs(w) > 1e-3).all():
            sign = np.sign(y * w)
            assert y * sign == pytest.approx(w, abs=tolerance)
        elif sign is not None:
            assert y * sign == pytest.approx(w, abs=tolerance)
    assert sign is not None


def test_stored_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    check(whitening.op13_whitening(spark, SF), rows, 1e-7)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 5)) * [9, 5, 3, 1, 0.5])]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)), rows)


def test_rank_one_updates():
    rng = np.random.default_rng(1)
    for trial in range(60):
        d = int(rng.integers(1, 9))
        values, vectors = np.zeros(d), np.eye(d)
        whole = np.zeros((d, d))
        for _ in range(int(rng.integers(1, 40))):
            v = rng.normal(size=d) * 10.0 ** rng.integers(-6, 6)
            if trial % 3 == 0:  # repeated directions and zeros are deflated
                v = np.round(rng.normal(size=d)) * (rng.random(d) < 0.5)
            whole += np.outer(v, v)
            values, vectors = whitening.rank_one(values, vectors, v)
        scale = max(1e-30, np.abs(whole).max())
        assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() < 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11
        assert values == pytest.approx(np.linalg.eigvalsh(whole), abs=1e-12 * scale)


def test_incremental_spectrum():
    x = np.random.default_rng(2).normal(size=(9000, 6)) * [5, 4, 3, 2, 1, 0.1] + 7
    whole, half = whitening.Spectrum.nothing(6), whitening.Spectrum.nothing(6)
    for k in range(0, 5000, 1000):
        whole.add_rows(x[k : k + 1000])
    for k in range(5000, 9000, 3):
        half.add_rows(x[k : k + 3])
    whole.add_spectrum(half)
    assert whole.n == 9000 and whole.mean == pytest.approx(x.mean(0))
    assert whole.values == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True) * 9000), rel=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, -1.0]), (3, [0.5, 0.25]), (4, [7.0, 3.0]), (5, [-3.0, 1.0])]
    bad = [(10, None), (11, [None, 1.0]), (12, [nan, 1.0]), (13, [inf, 1.0]), (14, [1.0]), (15, []), (16, [1.0, 2.0, 3.0]), (17, [1e300, 0.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(good + bad, schema).selectExpr("*", "1 as n", "'x' as y", "2 as part")
    check(whitening.whiten(df), good)
    again = whitening.whiten(spark.createDataFrame([*good, good[0], (None, [1.0, 1.0])], schema)).collect()
    assert len(again) == 14 and {r.n for r in again} == {7}
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame(good[:1] * 3, schema)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(flat, schema)).collect()} == {1}
    large = [(i, [2.0**44 * i, 2.0**40 * i * i]) for i in range(4)]
    assert {r.deviation for r in whitening.whiten(spark.createDataFrame(large, schema)).collect()} == {None}
