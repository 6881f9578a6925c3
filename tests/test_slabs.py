"""Slabs are written whole or refused, and resampled fits equal plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.matrix import MatrixError
from cellgrid.operators import collapse
from cellgrid.plans.storage import present
from cellgrid.sources import store

SCHEMA = "nnz_offset long, col_offset long, colptr array<long>, row_ids array<long>, vals array<double>"
GOOD = [(0, 0, [0, 2], [0, 3, 1], [5.0, -1.0, 2.0]), (3, 2, [0, 0, 1], [2, 0, 4], [7.0, 8.0, 9.0])]
ENTRIES = {(0, 0, 5.0), (3, 0, -1.0), (1, 1, 2.0), (2, 3, 7.0), (0, 4, 8.0), (4, 4, 9.0)}


def axes(spark):
    f = spark.range(5).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("row_name"))
    return f, f.withColumnsRenamed({"row_id": "col_id", "row_name": "col_name"})


def put(spark, slabs, path, nnz=6):
    store.write_slabs(spark.createDataFrame(slabs, SCHEMA), *axes(spark), nnz, path)


def test_slabs_equal_triplets_and_replace_an_earlier_matrix(spark, tmp_path):
    path = str(tmp_path / "m")
    put(spark, GOOD[::-1], path)
    assert {tuple(r) for r in store.read(spark, path).entries.collect()} == ENTRIES
    assert {tuple(r) for r in store.read(spark, path, "row").entries.collect()} == ENTRIES
    put(spark, [(0, 0, [0, 0, 0, 0, 0], [1], [3.0])], path, 1)
    assert [tuple(r) for r in store.read(spark, path).entries.collect()] == [(1, 4, 3.0)]
    with pytest.raises(MatrixError, match="exists"):
        store.write(store.read(spark, path), path)


def changed(i, **parts):
    names = ["nnz_offset", "col_offset", "colptr", "row_ids", "vals"]
    rows = [dict(zip(names, r, strict=True)) for r in GOOD]
    rows[i] |= parts
    return [tuple(r.values()) for r in rows]


@pytest.mark.parametrize(("slabs", "nnz", "why"), [
    (changed(1, nnz_offset=4), 6, "gap"),
    (changed(1, col_offset=3), 6, "gap"),
    (GOOD, 7, "declared"),
    (GOOD[:1], 3, "declared"),
    (changed(0, row_ids=[3, 0, 1]), 6, "rise"),
    (changed(0, row_ids=[3, 3, 1]), 6, "rise"),
    (changed(0, row_ids=[0, 5, 1]), 6, "range"),
    (changed(1, colptr=[0, 2, 1]), 6, "falling"),
    (changed(1, colptr=[0, 1, 9]), 6, "falling"),
    (changed(0, colptr=[1, 2]), 6, "start at 0"),
    (changed(0, row_ids=[0, 3]), 6, "number"),
    (changed(0, vals=[5.0, None, 2.0]), 6, "no value"),
])
def test_a_faulty_slab_leaves_nothing(spark, tmp_path, slabs, nnz, why):
    path = str(tmp_path / "m")
    with pytest.raises(MatrixError, match=why):
        put(spark, slabs, path, nnz)
    assert not present(spark, path) and list(tmp_path.iterdir()) == []


def test_resampled_rates_equal_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    obs, by_batch, n = rng.poisson(9, (7, 6)).astype(float), rng.poisson(30, (7, 2)).astype(float), rng.integers(3, 9, (2, 6)).astype(float)
    long = lambda a, key: spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], f"row_id long, {key} long, val double")
    sums, batches = long(obs, "grp"), long(by_batch, "batch")
    sizes = spark.createDataFrame([(b, g, float(n[b, g]), 0.0) for b in range(2) for g in range(6)], "batch long, grp long, n double, w double")
    features = spark.range(7).select(F.col("id").alias("row_id"))
    args = (sums, sums.limit(0), batches, sizes, features)
    got = {(r.row_id, r.grp): r for r in collapse.resampled(*args, draws=4, iterations=15, seed=7).collect()}
    rates = {}
    for draw in range(4):
        own = collapse.half(list(range(6)), 7, draw)
        assert len(own) == 3
        mu = collapse.batch_model(obs[:, own], np.zeros((7, 3)), by_batch, n[:, own], np.zeros((2, 3)), 15)["mu"]
        for j, g in enumerate(own):
            for i in range(7):
                rates.setdefault((i, int(g)), []).append(mu[i, j])
    assert set(got) == set(rates)
    for k, v in rates.items():
        assert got[k].n == len(v) and got[k].mu == pytest.approx(np.mean(v)) and got[k].spread == pytest.approx(np.std(v), abs=1e-12)
    again = {(r.row_id, r.grp): r.mu for r in collapse.resampled(*args, draws=4, iterations=15, seed=7).collect()}
    assert again == {k: r.mu for k, r in got.items()}
