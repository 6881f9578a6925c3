"""Levels of a collapse: counts, nesting, strata, anchors, bulk, panels and stacks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.matrix import MatrixError, SparseMatrix
from cellgrid.operators import collapse, multilevel
from cellgrid.operators.multilevel import Levels
from cellgrid.operators.poisson import Refinement

QUICK = Refinement(gibbs=0, greedy=1, size_floor=0.5, size_cap=2.0)


def matrix(spark, y, batch, mult=None):
    c, g = np.nonzero(y)
    cells = [(i, f"c{i}", b, float(mult[i]) if mult is not None else 1.0) for i, b in enumerate(batch)]
    return SparseMatrix(
        spark.createDataFrame([(int(b), int(a), float(y[a, b])) for a, b in zip(c, g, strict=True)], "row_id long, col_id long, val double").repartition(4),
        spark.createDataFrame([(i, f"f{i}") for i in range(y.shape[1])], "row_id long, row_name string"),
        spark.createDataFrame(cells, "col_id long, col_name string, batch string, mult double"),
    )


def places(spark, y):
    z = np.log1p(y[:, :4])
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(z)], "col_id long, vec array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    kind = np.arange(80) % 4
    rate = rng.gamma(0.8, 3.0, (4, 12))
    y = rng.poisson(rate[kind]).astype(float)
    return y, kind, ["a" if i < 40 else "b" for i in range(80)]


def codes_of(spark, kind):
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(kind)], "col_id long, code long")


def sums_of(y, groups):
    out = {}
    for (c, level), g in groups.items():
        out.setdefault((level, g), np.zeros(y.shape[1]))
        out[level, g] += y[c]
    return out


@pytest.mark.parametrize("refine", [None, QUICK])
def test_every_level_and_layer_holds_its_counts_and_levels_nest(spark, data, refine):
    y, kind, batch = data
    layers = [matrix(spark, y, batch), matrix(spark, y[:, ::-1] * 2, batch)]
    out = multilevel.collapse_levels(layers, codes_of(spark, kind), places(spark, y), 4, Levels(bits=2, levels=2, coarsest=1, neighbours=2, iterations=20, refine=refine))
    groups = {(r.col_id, r.level): r.grp for r in out.groups.collect()}
    assert len(groups) == 160
    for a in range(80):
        for b in range(80):
            assert groups[a, 0] != groups[b, 0] or groups[a, 1] == groups[b, 1]
    for layer, z in enumerate((y, y[:, ::-1] * 2)):
        want = sums_of(z, groups)
        rows = [r for r in out.profiles.collect() if r.layer == layer]
        assert {(r.level, r.grp) for r in rows} == set(want)
        for r in rows:
            assert r.total == pytest.approx(want[r.level, r.grp][r.row_id]) and min(r.mu, r.observed, r.residual, r.imputed) > 0
            assert r.size == sum(1 for k, g in groups.items() if (k[1], g) == (r.level, r.grp))
    assert all(np.isfinite(r.delta) and r.delta > 0 for r in out.factors.collect())


def test_strata_share_no_group_and_no_match(spark, data):
    y, kind, batch = data
    strata = spark.createDataFrame([(i, (i // 4) % 3) for i in range(80)], "col_id long, stratum int")
    out = multilevel.collapse_levels([matrix(spark, y, batch)], codes_of(spark, kind), places(spark, y), 4, Levels(bits=2, levels=2, coarsest=1, neighbours=2, iterations=5, refine=QUICK), strata)
    mixed = out.groups.join(strata, "col_id").groupBy("level", "grp").agg(F.count_distinct("stratum").alias("n")).filter("n > 1")
    assert mixed.isEmpty() and out.groups.count() == 160
    middle = spark.createDataFrame([("p", "a", [0.0]), ("q", "b", [0.1]), ("r", "b", [5.0])], "pb string, batch string, vec array<double>")
    of = spark.createDataFrame([("p", 1), ("q", 0), ("r", 1)], "pb string, stratum int")
    assert {(r.source, r.match) for r in multilevel.sample_matches(middle, 1, (), (), of).collect()} == {("p", "r"), ("r", "p")}
    assert multilevel.stratum_bits(0, 1) == 0 and multilevel.stratum_bits(1, 2) == 1 and multilevel.stratum_bits(4, 3) == 3


def test_private_strata_do_not_pull_factors(spark):
    """A stratum of one batch alone has counts that would look like a factor."""
    y = np.full((40, 4), 10.0)
    y[30:, 0] = 200.0
    batch = ["a" if i < 15 or i >= 30 else "b" for i in range(40)]
    strata = spark.createDataFrame([(i, int(i >= 30)) for i in range(40)], "col_id long, stratum int")
    codes = codes_of(spark, np.zeros(40))
    how = Levels(bits=1, levels=1, coarsest=1, neighbours=2, iterations=30, refine=None)
    kept = {(r.row_id, r.batch): r.delta for r in multilevel.collapse_levels([matrix(spark, y, batch)], codes, places(spark, y), 4, how, strata).factors.collect()}
    assert kept[0, "a"] == pytest.approx(1, abs=0.1) and kept[0, "b"] == pytest.approx(1, abs=0.1)


def test_anchors_keep_their_frame_and_bulk_is_corrected_towards_it(spark):
    platform = np.array([2.0, 2.0, 0.5, 0.5])
    y = np.vstack([np.tile([10.0, 13, 10, 13], (30, 1)), np.tile(np.array([10.0, 13, 10, 13]) * platform, (30, 1))])
    batch = ["old"] * 30 + ["new"] * 30
    args = [matrix(spark, y, batch)], codes_of(spark, np.zeros(60)), places(spark, y), 4
    how = dict(bits=1, levels=1, coarsest=1, neighbours=2, iterations=50, refine=None)
    factor = lambda **k: {(r.row_id, r.batch): r.delta for r in multilevel.collapse_levels(*args, Levels(**how, **k)).factors.collect()}
    pooled, anchored, bulk = factor(), factor(anchors=("old",)), factor(bulk=("new",))
    for got in (anchored, bulk):
        assert all(got[g, "old"] == pytest.approx(1, abs=0.05) for g in range(4))
        assert all(got[g, "new"] == pytest.approx(platform[g], rel=0.15) for g in range(4))
    assert any(abs(np.log(pooled[g, "old"])) > 0.1 for g in range(4))


def test_roles_are_refused():
    assert multilevel.roles(["a", "b", "c"], (), ("b",)) == (("a", "c"), ("b",))
    with pytest.raises(MatrixError, match="not among"):
        multilevel.roles(["a"], ("x",), ())
    with pytest.raises(MatrixError, match="anchor and bulk"):
        multilevel.roles(["a", "b"], ("a",), ("a",))


def test_bulk_columns_are_samples_of_their_own_and_nothing_is_matched_with_them(spark, data):
    y, kind, batch = data
    m = matrix(spark, y, batch)
    samples = multilevel.samples_of(codes_of(spark, kind), m.cells, ("b",))
    assert samples.select("pb").distinct().count() == 4 + 40
    middle = spark.createDataFrame([("p", "a", [0.0]), ("q", "b", [0.1]), ("r", "c", [5.0])], "pb string, batch string, vec array<double>")
    assert {(r.source, r.match) for r in multilevel.sample_matches(middle, 1, (), ("b",)).collect()} == {("p", "r"), ("q", "p"), ("q", "r"), ("r", "p")}
    assert {(r.source, r.match) for r in multilevel.sample_matches(middle, 1, ("a",), ("b",)).collect()} == {("p", "p"), ("q", "p"), ("r", "p")}


def test_unmeasured_features_are_not_zeros(spark):
    y = np.full((60, 3), 8.0)
    y[30:, 2] = 0.0  # batch b does not measure feature 2
    batch = ["a"] * 30 + ["b"] * 30
    args = [matrix(spark, y, batch)], codes_of(spark, np.zeros(60)), places(spark, y), 3
    how = dict(bits=1, levels=1, coarsest=1, neighbours=2, iterations=50, refine=None)
    rows = {k: {r.row_id: r for r in multilevel.collapse_levels(*args, Levels(**how, panels=k)).profiles.collect()} for k in (False, True)}
    assert rows[False][2].observed == pytest.approx(4, rel=0.1) and rows[True][2].observed == pytest.approx(8, rel=0.1)
    assert rows[True][2].mu == pytest.approx(8, rel=0.1)
    delta = {(r.row_id, r.batch): r.delta for r in multilevel.collapse_levels(*args, Levels(**how, panels=True)).factors.collect()}
    assert delta[2, "b"] == 1.0


def test_another_runs_partition_is_made_to_nest(spark, data):
    y, _, batch = data
    fine = [(j * 7) % 6 for j in range(80)]
    coarse = [int(j >= 40) if f < 3 else f % 2 for j, f in enumerate(fine)]
    part = spark.createDataFrame([(j, 0, f) for j, f in enumerate(fine)] + [(j, 1, c) for j, c in enumerate(coarse)], "col_id long, level int, grp long")
    out = multilevel.collapse_partition([matrix(spark, y, batch)], part, places(spark, y), 4, Levels(neighbours=2, iterations=5))
    groups = {(r.col_id, r.level): r.grp for r in out.groups.collect()}
    assert [groups[j, 0] for j in range(80)] == fine
    up = {}
    for j in range(80):
        assert up.setdefault(groups[j, 0], groups[j, 1]) == groups[j, 1]
    want = sums_of(y, groups)
    assert all(r.total == pytest.approx(want[r.level, r.grp][r.row_id]) for r in out.profiles.collect())


def test_imputed_sums_equal_dense_ones(spark, data):
    y, kind, batch = data
    m = matrix(spark, y, batch, mult=np.where(np.arange(80) % 5 == 0, 3.0, 1.0))
    samples = multilevel.samples_of(codes_of(spark, kind), m.cells)
    groups = samples.select("pb", F.col("code").alias("grp")).distinct()
    matches = spark.createDataFrame([("a/0", "b", "b/1", 0.5), ("a/0", "b", "b/2", 1.5), ("b/3", "a", "a/3", 0.1)], "source string, batch string, match string, dist double")
    stat, mass = multilevel.finest_stats(m, samples, groups, matches)
    w = np.where(np.arange(80) % 5 == 0, 3.0, 1.0)
    pb = [f"{b}/{k}" for b, k in zip(batch, kind, strict=True)]
    total = lambda p: sum(w[i] * y[i] for i in range(80) if pb[i] == p)
    size = lambda p: sum(w[i] for i in range(80) if pb[i] == p)
    e = np.exp(-np.array([0.5, 1.5])) / np.exp(-np.array([0.5, 1.5])).sum()
    want = {("b", 0): size("a/0") * (e[0] * total("b/1") / size("b/1") + e[1] * total("b/2") / size("b/2")), ("a", 3): size("b/3") * total("a/3") / size("a/3")}
    got = [r for r in stat.collect() if r.what == "imputed"]
    assert {(r.batch, r.grp) for r in got} == set(want)
    assert all(r.val == pytest.approx(want[r.batch, r.grp][r.row_id]) for r in got)
    assert {(r.batch, r.grp): pytest.approx(r.val) for r in mass.collect() if r.what == "imputed"} == {("b", 0): size("a/0"), ("a", 3): size("b/3")}
