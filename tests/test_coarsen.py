"""Sketches, nested levels and growth of feature groups."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.matrix import MatrixError
from cellgrid.operators import coarsen


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"))


def vectors(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "row_id long, vec array<double>")


def test_sketch_equals_the_dense_product_and_keeps_cosines(spark):
    rng = np.random.default_rng(0)
    n, s = 30, 300
    rate = rng.gamma(0.5, 1.0, (n, s)) * np.r_[np.full(10, 0.05), np.full(19, 1.0), 40.0][:, None]
    y = rng.poisson(rate).astype(float)
    y[29, :40] = 0  # empty places beyond the clip
    size = np.r_[np.full(10, 300.0), np.full(s - 10, 1.0)]
    e = [(int(i), int(j), float(y[i, j])) for i, j in zip(*np.nonzero(y), strict=True)]
    sums = spark.createDataFrame(e, "row_id long, grp long, val double")
    sizes = spark.createDataFrame([(j, float(size[j])) for j in range(s)], "grp long, size double")
    mean = y.sum(axis=1, keepdims=True) * size / size.sum()
    assert (mean[29, :10] > s).any()
    z = np.clip((y - mean) / np.sqrt(np.maximum(mean, 1e-300)), -np.sqrt(s), np.sqrt(s))
    digits = ["".join(hashlib.md5(f"42:{i}:{j}".encode()).hexdigest() for i in range(2)) for j in range(s)]
    sign = np.array([[1.0 if c >= "8" else -1.0 for c in d] for d in digits])
    want = z @ sign / 8
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r.row_id: r.vec for r in coarsen.sketched_profiles(sums, sizes).collect()}
    assert len(got) == n and np.allclose([got[i] for i in range(n)], want, atol=1e-9)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert np.sqrt(np.mean((want @ want.T - z @ z.T) ** 2)) < 2 / 8  # about 1 / sqrt(64)


def blobs(rng, k, per, dims=6):
    c = rng.normal(size=(k, dims))
    v = np.repeat(c, per, axis=0) + rng.normal(0, 0.01, (k * per, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_levels_nest_with_the_background_last(spark):
    v = blobs(np.random.default_rng(1), 6, 8)
    out = coarsen.coarsened_levels(rows(spark, 55), vectors(spark, v), [1, 4, 7], 3)
    of = {(r.level, r.row_id): r.coarse for r in out.collect()}
    assert {of[0, i] for i in range(55)} == {0}
    for level, groups in ((1, 3), (2, 6)):
        assert {of[level, i] for i in range(48)} == set(range(groups)) and {of[level, i] for i in range(48, 55)} == {groups}
        assert of[level, 0] == 0  # numbered by first row
    assert len({(of[2, i], of[1, i]) for i in range(55)}) == 7
    assert all(len({of[2, i] for i in range(8 * b, 8 * b + 8)}) == 1 for b in range(6))
    none = coarsen.coarsened_levels(rows(spark, 5), vectors(spark, v).filter("row_id < 0"), [2])
    assert {r.coarse for r in none.collect()} == {0}
    whole = coarsen.coarsened_levels(rows(spark, 48), vectors(spark, v), [6])
    assert {r.coarse for r in whole.collect()} == set(range(6))
    with pytest.raises(MatrixError):
        coarsen.coarsened_levels(rows(spark, 5), vectors(spark, v), [4, 2])


def test_scattered_features_leave_their_slots(spark):
    v = np.vstack([blobs(np.random.default_rng(2), 2, 20), -np.eye(6)[:2]])
    out = {r.row_id: r.coarse for r in coarsen.partitioned(rows(spark, 42), vectors(spark, v), 4, 5).collect()}
    assert out[40] == out[41] == max(out.values())
    sizes = [list(out.values()).count(g) for g in range(max(out.values()))]
    assert min(sizes) >= 5 and sum(sizes) == 40 and len({out[i] for i in range(20)} & {out[i] for i in range(20, 40)}) == 0


def test_new_rows_join_the_group_they_resemble(spark):
    v = [[1, 0], [1, 0], [0, 1], [0.6, 0.8], [0.8, 0.6], [0, 0]]
    known = spark.createDataFrame([(0, 4), (1, 4), (2, 9), (77, 5)], "row_id long, coarse long")
    got = {r.row_id: r.coarse for r in coarsen.grown_groups(known, vectors(spark, v), 2).collect()}
    assert got == {0: 4, 1: 4, 2: 9, 3: 9, 4: 4, 5: 4}
    with pytest.raises(MatrixError):
        coarsen.grown_groups(known.filter("row_id = 77"), vectors(spark, v), 2)
