"""The pseudobulk tree against dense singular value decompositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.matrix import MatrixError, SparseMatrix
from cellgrid.operators import genes, tree
from cellgrid.operators.tree import Growth


def counts(rng, per=16, rows=24):
    """Four kinds in two pairs, so that the first split parts the pairs."""
    base = np.full((4, rows), 3.0)
    base[:2, :8] = 30
    base[2:, 8:16] = 30
    base[0, 16:18] = base[2, 18:20] = 18
    kind = np.repeat(np.arange(4), per)
    return rng.poisson(base[kind]).astype(float).T, kind


def frames(spark, y):
    e = [(int(r), int(c), float(y[r, c])) for r, c in zip(*np.nonzero(y), strict=True)]
    f = spark.range(y.shape[0]).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("row_name"))
    c = spark.range(y.shape[1]).select(F.col("id").alias("col_id"), F.col("id").cast("string").alias("col_name"))
    return SparseMatrix(spark.createDataFrame(e, "row_id long, col_id long, val double"), f, c)


def dense_split(y, batch, how):
    """Sides and figures of one node from the whole residual matrix."""
    n = y.sum(axis=0)
    keep = y.sum(axis=1) >= how.floor
    rate = np.repeat((y.sum(axis=1) / n.sum())[:, None], y.shape[1], axis=1)
    for b in set(batch):
        own = batch == b
        if own.sum() >= how.least:
            rate[:, own] = (y[:, own].sum(axis=1) / n[own].sum())[:, None]
    mean, lim = (n * rate)[keep], np.sqrt(y.shape[1])
    r = np.where(y[keep] > 0, np.clip((y[keep] - mean) / np.sqrt(np.maximum(mean, 1e-300)), -lim, lim), -np.sqrt(mean))
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    lead = u[:, 0] * np.sign(u[np.abs(u[:, 0]).argmax(), 0])
    right = lead @ r > 0
    left_sum, right_sum = y[keep][:, ~right].sum(axis=1), y[keep][:, right].sum(axis=1)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / x.sum()), 0).sum()
    total = ((r - r.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    between = sum(k.sum() * (r[:, k].mean(axis=1) - r.mean(axis=1)) ** 2 for k in (right, ~right))
    sigma = np.sqrt(np.median((r**2).mean(axis=1)))
    return {"right": right, "s": s, "llr": f(left_sum) + f(right_sum) - f(left_sum + right_sum), "ve": (between / total).mean() * (y.shape[1] - 1), "edge": sigma * (np.sqrt(y.shape[1]) + np.sqrt(keep.sum())), "lead": lead, "keep": keep}


@pytest.mark.parametrize("uneven", [False, True])
def test_a_split_equals_the_dense_one(spark, uneven):
    y, _ = counts(np.random.default_rng(1))
    batch = np.where(np.arange(y.shape[1]) % (9 if uneven else 2) == 0, "a", "b")  # few of the first batch take pooled rates
    how = Growth(rounds=6)
    leaves = spark.createDataFrame([(0, c, str(batch[c])) for c in range(y.shape[1])], "leaf long, col_id long, batch string")
    (record,), sides, load = tree.proposals(frames(spark, y), leaves, how)
    want = dense_split(y, batch, how)
    got = {r.col_id: r.lab for r in sides.collect()}
    assert [got[c] for c in range(y.shape[1])] == want["right"].astype(int).tolist()
    assert record["s1"] == pytest.approx(want["s"][0], rel=1e-6) and record["s2"] == pytest.approx(want["s"][1], rel=1e-2)
    assert record["llr"] == pytest.approx(want["llr"]) and record["ve_ratio"] == pytest.approx(want["ve"]) and record["edge"] == pytest.approx(want["edge"])
    assert record["clear"]
    loads = {r.row_id: r.loading for r in load.collect()}
    assert np.allclose([loads[r] for r in np.flatnonzero(want["keep"])], want["lead"], atol=1e-5)


def test_levels_nest_and_equal_dense_splits(spark):
    y, kind = counts(np.random.default_rng(2))
    m = frames(spark, y)
    nodes = m.cells.select("col_id", F.lit("x").alias("batch"), F.lit(0).alias("leaf"))
    out = tree.grown(m, nodes, [1, 2, 4], Growth())
    of = {(r.level, r.col_id): r.leaf for r in out.labels.collect()}
    fine = [of[2, c] for c in range(len(kind))]
    one = np.full(len(kind), "x")
    first = dense_split(y, one, Growth())["right"]
    want = np.empty(len(kind), int)
    for side, k in ((~first, 0), (first, 2)):
        want[side] = k + dense_split(y[:, side], one[side], Growth())["right"]
    assert len(set(fine)) == 4 and len(set(zip(fine, want.tolist(), strict=True))) == 4
    assert len({of[1, c] for c in range(len(kind))}) == 2 and {of[0, c] for c in range(len(kind))} == {0}
    assert len({(of[2, c], of[1, c]) for c in range(len(kind))}) == 4
    codes = {r.col_id: r.code for r in out.codes.collect()}
    for level, bits in zip((2, 1, 0), out.widths, strict=True):
        masked = {(codes[c] & ((1 << bits) - 1), of[level, c]) for c in codes}
        assert len(masked) == len({a for a, _ in masked}) == len({b for _, b in masked})
    splits = {r.split: r for r in out.splits.collect()}
    assert len(splits) == 3 and splits[0].depth == 1 and splits[0].n_left + splits[0].n_right == len(kind) and all(r.root == 0 for r in splits.values())
    top = genes.contrast_features(out.loadings.select("split", "row_id", "loading"), out.loadings.select("split", "row_id", "of_left", "of_right"), 3)
    assert all((r.lfc > 0) == (r.side == "right") for r in top.filter("split = 0").collect())


def test_nodes_that_cannot_part_stay(spark):
    rng = np.random.default_rng(3)
    y = rng.poisson(20.0, (12, 30)).astype(float)
    y[:, 29] = 0
    m = frames(spark, y)
    nodes = m.cells.select("col_id", F.lit("x").alias("batch"), F.when(F.col("col_id") < 5, 0).otherwise(1).alias("leaf"))
    held = tree.grown(m, nodes, [2, 6], Growth(rounds=1, margin=1.0, stop=True))
    assert held.splits.count() == 0 and held.loadings.count() == 0
    assert {(r.level, r.leaf): r["count"] for r in held.labels.groupBy("level", "leaf").count().collect()} == {(0, 0): 5, (0, 1): 25, (1, 0): 5, (1, 1): 25}
    forced = tree.grown(m, nodes, [3], Growth(rounds=1, margin=1.0))
    assert not forced.splits.first().clear and forced.labels.count() == 30 and forced.labels.select("leaf").distinct().count() == 3
    with pytest.raises(MatrixError):
        tree.grown(m, nodes, [4, 2])
