"""Shared-row loading, mixed groups, exact neighbours and fixed-order sums against plain Python."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions import numeric
from cellgrid.matrix import MatrixError, SparseMatrix
from cellgrid.operators import collapse, genes, knn, project, sample, stats
from cellgrid.operators.qc import QcRules
from cellgrid.sources import loading


def matrix(spark, rows, cols, triplets):
    f = spark.createDataFrame(list(enumerate(rows)), "row_id long, row_name string")
    c = spark.createDataFrame(list(enumerate(cols)), "col_id long, col_name string")
    return SparseMatrix(spark.createDataFrame(triplets, "row_id long, col_id long, val double"), f, c)


def test_batches_of_columns_side_by_side(spark):
    a = matrix(spark, ["x", "y"], ["c1", "c2@d", "c3@e@f"], [(0, 0, 1.0), (1, 2, 2.0)])
    b = matrix(spark, ["y", "z"], ["c1"], [(0, 0, 5.0)])
    got = loading.shared_rows([a, b], ["p", "q"], keep_empty=True)
    assert {(r.col_name, r.batch) for r in got.matrix.cells.collect()} == {("c1@p", "p"), ("c2@d@p", "d"), ("c3@e@f@p", "f"), ("c1@q", "q")}
    assert got.emitted is None and got.matrix.features.count() == 3
    labels = [spark.createDataFrame([(0, "u"), (1, "v"), (2, "v")], "col_id long, batch string"), spark.createDataFrame([(0, "w")], "col_id long, batch string")]
    given = loading.shared_rows([a, b], ["p", "q"], keep_empty=True, batches=labels)
    assert {(r.col_name, r.batch) for r in given.matrix.cells.collect()} == {("c1@p", "u"), ("c2@d@p", "v"), ("c3@e@f@p", "v"), ("c1@q", "w")}
    for bad in (labels[:1], [labels[0].limit(2), labels[1]], [labels[0], labels[1].union(labels[1])], [labels[0], labels[1].union(spark.createDataFrame([(9, "w")], "col_id long, batch string"))]):
        with pytest.raises(MatrixError):
            loading.shared_rows([a, b], ["p", "q"], keep_empty=True, batches=bad)
    with pytest.raises(MatrixError):
        loading.shared_rows([a, b], ["p"], keep_empty=True)


def test_suffixes_keep_rows_and_samples_apart(spark):
    a = matrix(spark, ["x"], ["c1", "c2"], [(0, 0, 1.0), (0, 1, 2.0)])
    got = loading.shared_rows([a, a], ["p", "q"], columns="union", row_suffixes=["s", "u"], barcode_suffixes=["d1", None], keep_empty=True).matrix
    assert {(r.col_name, r.batch) for r in got.cells.collect()} == {("c1@d1", "d1"), ("c2@d1", "d1"), ("c1", "all"), ("c2", "all")}
    assert {r.row_name for r in got.features.collect()} == {"x/s", "x/u"}
    folded = loading.shared_rows([a, a], ["p", "q"], columns="union", keep_empty=True).matrix
    assert sorted(r.val for r in folded.entries.collect()) == [2.0, 4.0]


def test_empty_barcodes_go_unless_another_part_has_them(spark):
    rng = random.Random(3)
    rows = [f"g{i}" for i in range(300)]
    # 120 cells with about 200 rows each, 400 empty ones with 2 to 6
    n = [rng.randint(170, 230) for _ in range(120)] + [rng.randint(2, 6) for _ in range(400)]
    cols = [f"c{i}" for i in range(len(n))]
    a = matrix(spark, rows, cols, [(r, c, 1.0) for c, k in enumerate(n) for r in rng.sample(range(300), k)])
    alone = loading.shared_rows([a], ["p"])
    assert {r.col_name for r in alone.matrix.cells.collect()} == set(cols[:120])
    assert loading.shared_rows([a], ["p"], exempt=[True]).matrix.cells.count() == len(cols)
    b = matrix(spark, ["h"], cols[120:130], [(0, c, 1.0) for c in range(10)])
    both = loading.shared_rows([a, b], ["p", "q"], columns="union")
    assert {r.col_name for r in both.matrix.cells.collect()} == set(cols[:130])
    judged = loading.shared_rows([a], ["p"], rules=QcRules(min_counts=180, mads_on=(), feature_min_cells=1))
    left = {cols[i] for i in range(120) if n[i] >= 180}
    assert {r.col_name for r in judged.matrix.cells.collect()} == left and judged.emitted.count() == len(left)


def test_empty_parts(spark):
    none = matrix(spark, [], [], [])
    a = matrix(spark, ["x"], ["c"], [(0, 0, 1.0)])
    assert loading.shared_rows([none], ["p"]).matrix.cells.count() == 0
    assert loading.shared_rows([none, a], ["p", "q"], rules=QcRules(mads_on=())).matrix.cells.count() == 1


def test_neighbours_equal_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 4)) + 1000
    rows = [(i, f"b{i % 3}", base[rng.integers(12)].tolist()) for i in range(400)]  # many equal vectors
    df = spark.createDataFrame(rows, "id long, batch string, vec array<double>").repartition(7)
    for skip in (True, False):
        want = {}
        for i, b, v in rows[:20]:
            for other in ("b0", "b1", "b2"):
                if skip and other == b:
                    continue
                near = sorted((math.dist(v, w), j) for j, c, w in rows if c == other and j != i)[:5]
                want.update({(i, other, k + 1): j for k, (_, j) in enumerate(near)})
        got = {(r.source, r.batch, r["rank"]): r.match for r in knn.nearest(df.filter("id < 20"), df, 5, skip).collect()}
        assert got == want
    want = {(o, k + 1): j for o in ("b0", "b1", "b2") for k, (_, j) in enumerate(sorted((math.dist(base[0], w), j) for j, c, w in rows if c == o)[:9])}
    assert {(r.batch, r["rank"]): r.match for r in knn.nearest_to(base[0].tolist(), df, 9).collect()} == want
    assert knn.nearest(df.limit(0), df, 5).count() == 0 and knn.nearest(df.filter("id < 3"), df.limit(0), 5).count() == 0


def test_mixed_groups_equal_merged_codes(spark):
    rng = np.random.default_rng(6)
    vecs = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(200)], "col_id long, vec array<double>")
    of = spark.createDataFrame([(i, f"b{int(rng.integers(4))}") for i in range(200)], "col_id long, batch string")
    got = project.mixed_groups(vecs, 5, of, bits=4, min_batches=4, levels=2).collect()
    code = {r.col_id: r.code for r in project.sign_groups(vecs, 5, 4).collect()}
    counts = {}
    for r in got:
        assert r.code == code[r.col_id]
        counts[r.code, r.batch] = counts.get((r.code, r.batch), 0) + 1
    to = project.merged_codes([(c, b, n) for (c, b), n in counts.items()], 4, 4, 2)
    assert len(got) == 200 and all(r.grp == to[r.code] for r in got)
    with pytest.raises(MatrixError):
        project.mixed_groups(vecs, 5, of.filter("col_id < 199"), bits=4)


def test_adjustment_moves_batches_together(spark):
    rng = np.random.default_rng(7)
    y = rng.poisson(3, size=(40, 120))
    y[:10, 60:] += 6  # a shift of the second batch
    m = matrix(spark, [f"g{i}" for i in range(40)], [f"c{i}" for i in range(120)], [(int(r), int(c), float(y[r, c])) for r, c in zip(*np.nonzero(y), strict=True)])
    of = m.cells.select("col_id", F.when(F.col("col_id") < 60, "a").otherwise("b").alias("batch"))
    gap = lambda df: np.linalg.norm(np.subtract(*(np.mean([r.vec for r in df.collect() if (r.col_id < 60) == s], axis=0) for s in (True, False))))
    before, after = project.project(m, 6), project.adjusted(m, 6, of)
    assert gap(after) < 0.3 * gap(before)
    with pytest.warns(UserWarning):
        kept = project.adjusted(m, 6, of.filter("col_id < 50"))
    assert gap(kept) == pytest.approx(gap(before))


def test_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [("k", i, rng.uniform(-1, 1) * 10 ** rng.randint(-8, 8)) for i in range(-300, 5000)] + [("n", 1, None)]
    df = spark.createDataFrame(rows, "key string, place long, val double")
    sums = [{r.key: r.tot for r in stats.fixed_order_sums(df.repartition(p), "key", "place", block=16).collect()} for p in (1, 3, 11)]
    assert sums[0] == sums[1] == sums[2] and sums[0]["n"] == 0
    assert sums[0]["k"] == pytest.approx(math.fsum(v for _, _, v in rows if v), rel=1e-12)
    assert stats.fixed_order_sums(df.limit(0), "key", "place").count() == 0


def test_contrasts_take_weights_and_leave_out_zeros(spark):
    loadings = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 2.0), ("s", 3, -1.0), ("s", 4, -1.0), ("s", 5, 0.0), ("s", 6, float("nan")), ("s", 7, None)], "split string, row_id long, loading double")
    sums = spark.createDataFrame([("s", 1, 0.0, 9.0), ("s", 3, 4.0, 0.0)], "split string, row_id long, of_left double, of_right double")
    got = {(r.side, r["rank"]): r for r in genes.contrast_features(loadings, sums, 1, spark.createDataFrame([("s", 1, 0.5)], "split string, row_id long, weight double")).collect()}
    assert {k: r.row_id for k, r in got.items()} == {("right", 1): 1, ("left", 1): 4}
    assert got["right", 1].lfc == pytest.approx(math.log(9.5 / 9) - math.log(0.5 / 4)) and got["right", 1].weight == 0.5
    assert got["left", 1].lfc == pytest.approx(math.log(0.5 / 9) - math.log(0.5 / 4)) and got["left", 1].weight == 1


def test_draws_of_rows_and_columns_differ(spark):
    m = matrix(spark, [f"g{i}" for i in range(50)], [f"c{i}" for i in range(50)], [(i, i, 1.0) for i in range(50)])
    got = sample.both(m, 10, 10)
    rows, cols = ({r[0] for r in x.collect()} for x in (got.features.select("row_id"), got.cells.select("col_id")))
    assert len(rows) == len(cols) == 10 and rows != cols and got.entries.count() == len(rows & cols)


def test_special_functions_equal_the_library(spark):
    x = [0.5, 1.0, 2.0, 1e-9, 3.7, 171.5, 1e6, 1e200, -0.5, -3.25]
    assert np.allclose(numeric.log_gamma(np.array(x)), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-13)
    normal = NormalDist()
    p = [1e-12, 1e-4, 0.2, 0.5, 0.9, 1 - 1e-9]
    df = spark.createDataFrame([(normal.inv_cdf(q), q) for q in p] + [(None, None), (float("nan"), 1.0), (float("inf"), 0.0)], "x double, p double")
    got = df.select(numeric.normal_cdf("x").alias("c"), numeric.normal_ppf("p").alias("q"), "x", "p").collect()
    for r in got[: len(p)]:
        assert r.c == pytest.approx(r.p, rel=1e-9) and r.q == pytest.approx(r.x, rel=1e-9, abs=1e-12)
    assert [(r.c, r.q) for r in got[len(p) :]] == [(None, None), (None, None), (1.0, None)]


def test_collapsed_columns_equal_dense_sums(spark):
    rng = np.random.default_rng(9)
    y = rng.poisson(2, size=(6, 30)).astype(float)
    batch, grp = [f"b{i % 3}" for i in range(30)], [i % 4 for i in range(30)]
    m = matrix(spark, [f"g{i}" for i in range(6)], [f"c{i}" for i in range(30)], [(int(r), int(c), float(y[r, c])) for r, c in zip(*np.nonzero(y), strict=True)])
    cells = spark.createDataFrame([(i, batch[i], grp[i]) for i in range(30)], "col_id long, batch string, grp long")
    pairs = [(i, batch[j], j, float(rng.random())) for i in range(30) for j in rng.choice(30, 5, replace=False).tolist() if batch[j] != batch[i]]
    obs, imp = np.zeros((6, 4)), np.zeros((6, 4))
    by, n, w = np.zeros((6, 3)), np.zeros((3, 4)), np.zeros((3, 4))
    for i in range(30):
        obs[:, grp[i]] += y[:, i]
        by[:, i % 3] += y[:, i]
        n[i % 3, grp[i]] += 1
        own = [(j, math.exp(-d)) for s, _, j, d in pairs if s == i]
        for j, e in own:
            share = e / sum(x for _, x in own)
            imp[:, grp[i]] += share * y[:, j]
            w[j % 3, grp[i]] += share
    want = collapse.batch_model(obs, imp, by, n, w, 20)
    got = collapse.collapsed_columns(m, spark.createDataFrame(pairs, "source long, batch string, match long, dist double"), cells, 20).collect()
    assert len(got) == 24
    for r in got:
        for k in ("mu", "observed", "residual", "imputed"):
            assert r[k] == pytest.approx(want[k][r.row_id, r.grp], rel=1e-9)
