import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.matrix import MatrixError, SparseMatrix, common_meta, from_dense, from_triplets, info
from cellgrid.operators import align, qc, sample, select, stats

ROWS, COLS, NO_ROW, NO_COL = 6, 7, 2, 5


def drawn():
    """Counts of a seeded draw with an empty row and an empty column; the other rows and columns have some."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 60, (ROWS, COLS)) * (rng.random((ROWS, COLS)) < 0.45)
    a[NO_ROW], a[:, NO_COL] = 0, 0
    return [(int(r), int(c), float(a[r, c])) for r, c in np.argwhere(a)]


SMALL = drawn()


def matrix(spark, entries=None, rows=ROWS, cols=COLS):
    e = spark.createDataFrame(SMALL if entries is None else entries, "row_id long, col_id long, val double")
    f = spark.createDataFrame([(i, f"feat{i}") for i in range(rows)], "row_id long, row_name string")
    c = spark.createDataFrame([(i, f"cell{i}") for i in range(cols)], "col_id long, col_name string")
    return from_triplets(e, f, c)


def dense(entries=None, rows=ROWS, cols=COLS):
    a = np.zeros((rows, cols))
    for r, c, v in SMALL if entries is None else entries:
        a[r, c] = v
    return a


def places(a):
    return {(int(r), int(c), float(a[r, c])) for r, c in np.argwhere(a)}


def test_the_drawn_matrix_has_one_empty_row_and_column():
    a = dense() > 0
    assert [i for i in range(ROWS) if not a[i].any()] == [NO_ROW] and [j for j in range(COLS) if not a[:, j].any()] == [NO_COL]


def test_faulty_entries_are_refused(spark):
    with pytest.raises(MatrixError, match="given twice"):
        matrix(spark, [(0, 0, 1.0), (0, 0, 2.0)])
    with pytest.raises(MatrixError, match="row out of range"):
        matrix(spark, [(9, 0, 1.0)])
    with pytest.raises(MatrixError, match="column out of range"):
        matrix(spark, [(0, 9, 1.0)])


def test_statistics_count_zeros(spark):
    m, a = matrix(spark), dense()
    for r in stats.row_stats(m).collect():
        x = a[r.row_id]
        assert (r.nnz, r.tot) == ((x > 0).sum(), x.sum())
        assert r.mu == pytest.approx(x.mean()) and r.sig == pytest.approx(x.std())
    for r in stats.column_stats(m).collect():
        assert r.mu == pytest.approx(a[:, r.col_id].mean()) and r.sig == pytest.approx(a[:, r.col_id].std())
    some = m.features.filter("row_id in (1, 2)")
    for r in stats.column_stats(m, some).collect():
        assert r.mu == pytest.approx(a[1:3, r.col_id].mean())
    both = {(r.axis, r.id): r.tot for r in stats.both_stats(m).collect()}
    assert both["row", 4] == a[4].sum() and both["column", 4] == a[:, 4].sum() and ("row", NO_ROW) not in both


def test_grouped_statistics_cover_empty_pairs(spark):
    m = matrix(spark)
    g = spark.createDataFrame([(i, "a") for i in range(3)] + [(3, "b")], "col_id long, grp string")
    out = {(r.grp, r.row_id): r for r in stats.row_stats_by_group(m, g).collect()}
    a = dense()
    assert len(out) == 3 * ROWS
    for name, own in (("a", [0, 1, 2]), ("b", [3]), ("", [4, 5, 6])):
        for i in range(ROWS):
            x = a[i, own]
            assert (out[name, i].tot, out[name, i].nnz) == (x.sum(), (x > 0).sum()) and out[name, i].mu == pytest.approx(x.mean())


def test_selection(spark):
    m = matrix(spark)
    assert select.parse_indices("0,2-3,9", 5) == [0, 2, 3]
    with pytest.raises(MatrixError):
        select.parse_indices("7", 5)
    a = dense()
    picked = select.selection(spark, [4, 0, 4], "col_id")
    assert {tuple(r) for r in select.read_columns(m, picked).collect()} == places(a[:, [4, 0, 4]])
    with pytest.raises(MatrixError, match="repeats"):
        select.subset_columns(m, picked)
    with pytest.raises(MatrixError, match="out of range"):
        select.subset_columns(m, select.selection(spark, [0, 77], "col_id"))
    sub = select.subset_rows(m, select.selection(spark, [4, 0], "row_id"))
    assert {tuple(r) for r in sub.entries.collect()} == places(a[[4, 0]])
    assert [r.row_name for r in sub.features.orderBy("row_id").collect()] == ["feat4", "feat0"]
    d = select.dense_columns(m, select.selection(spark, [NO_COL], "col_id")).collect()
    assert len(d) == ROWS and all(r.val == 0 for r in d)


def test_reorder_keeps_missing_rows_empty(spark):
    order = spark.createDataFrame([(0, "feat4"), (1, "nope"), (2, "feat0")], "pos long, row_name string")
    out = select.reorder_rows(matrix(spark), order)
    want = np.zeros((3, COLS))
    want[[0, 2]] = dense()[[4, 0]]
    assert {tuple(r) for r in out.entries.collect()} == places(want) and out.features.count() == 3
    with pytest.raises(MatrixError):
        select.reorder_rows(matrix(spark), spark.createDataFrame([(0, "feat4"), (1, "feat4")], "pos long, row_name string"))


def test_unique_names_skip_taken(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x-1"), (3, "y")], "i long, n string")
    got = [r.n for r in select.unique_names(df, "n", "i").orderBy("i").collect()]
    assert len(set(got)) == 4 and got[0] == "x" and got[2] == "x-1" and got[3] == "y"


def test_dense_and_info(spark):
    m = from_dense(spark, spark.createDataFrame([(0, "a", [0.0, 2.0]), (1, "b", [3.0, 0.0])], "row_id long, row_name string, values array<double>"))
    assert {tuple(r) for r in m.entries.collect()} == {(0, 1, 2.0), (1, 0, 3.0)}
    assert {r.key: r.value for r in info(m).collect()} == {"nrow": "2", "ncol": "2", "nnz": "2"}
    assert common_meta([{"a": "1", "b": "2"}, {"a": "1", "b": "3"}]) == {"a": "1"}


def test_squeeze_counts_once_and_keeps_an_axis(spark):
    m = matrix(spark)
    out = qc.squeeze(m, 1, 1)
    assert out.features.count() == ROWS - 1 and out.cells.count() == COLS - 1
    assert qc.squeeze(m, 99, 1).features.count() == ROWS


def test_upper_median_and_band(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert qc.upper_median(df, "v") == 3
    assert qc.band_edges(spark.createDataFrame([(5.0,)] * 4, "v double"), "v") is None


def test_verdicts_and_guard(spark):
    rows = [(i, 10 + i % 3, 100.0 + i, 0.0, 0.0) for i in range(20)] + [(20, 1, 1.0, 0.0, 0.0), (21, 12, 10.0, 0.9, 0.0)]
    cells = spark.createDataFrame(rows, "col_id long, n_genes long, total_counts double, mito_frac double, ribo_frac double")
    got = {r.col_id: r for r in qc.verdicts(cells, qc.QcRules(mito_cap=0.5)).collect()}
    assert got[20].near_empty and not got[20].outlier and not got[20].emitted and got[20].train_keep
    assert got[21].outlier and not got[21].train_keep and got[0].emitted
    assert all(r.train_keep for r in qc.verdicts(cells, qc.QcRules(min_counts=1e9, min_nnz=0)).collect())


def test_trough_between_two_modes():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.poisson(8, 3000), rng.poisson(900, 2000)])
    cut = qc.trough([(int(a), int(b)) for a, b in zip(*np.unique(v, return_counts=True), strict=True)])
    assert 15 < cut < 800
    assert qc.trough([(int(a), int(b)) for a, b in zip(*np.unique(rng.poisson(50, 3000), return_counts=True), strict=True)]) is None


def test_depth_scales_use_an_averaged_median(spark):
    got = {r.col_id: r.scale for r in qc.depth_scales(matrix(spark)).collect()}
    depth = dense().sum(axis=0)
    mid = np.median(depth[depth > 0])
    assert got[NO_COL] == 1 and got[0] == pytest.approx(depth[0] / mid)


def test_broad_rows_need_every_group(spark):
    m = matrix(spark)
    g = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(COLS)], "col_id long, grp string")
    a = dense() > 0
    want = {i for i in range(ROWS) if a[i, :3].mean() > 0.3 and a[i, 3:].mean() > 0.3}
    assert want and {r.row_id for r in qc.broad_rows(m, g, 0.3).collect()} == want


def test_row_alignment_and_stack(spark):
    a = matrix(spark, [(0, 0, 1.0), (1, 1, 2.0)], 2, 2)
    b = a.with_(features=spark.createDataFrame([(0, "feat1"), (1, "feat9")], "row_id long, row_name string"))
    assert [r.name for r in align.aligned_rows([a, b]).orderBy("pos").collect()] == ["feat0", "feat1", "feat9"]
    assert [r.name for r in align.aligned_rows([a, b], "intersect").collect()] == ["feat1"]
    side = align.stack([a, b], ["x", "y"])
    assert {r.col_name for r in side.cells.collect()} == {"cell0@x", "cell1@x", "cell0@y", "cell1@y"}
    one = align.stack([a, b], ["x", "y"], columns="union")
    assert one.cells.count() == 2 and {(r.row_id, r.col_id): r.val for r in one.entries.collect()} == {(0, 0): 1.0, (1, 1): 2.0, (1, 0): 1.0, (2, 1): 2.0}
    with pytest.raises(MatrixError):
        align.merge([a, b], ["x", "y"])
    assert {(r.row_name) for r in align.merge([a, b], ["x", "y"], True).features.collect()} == {"feat1"}


def test_islands_keep_touching_apart(spark):
    loci = spark.createDataFrame([("1", 0, 10), ("1", 10, 20), ("1", 15, 30), ("1", 5, 5), ("2", 0, 4)], "chrom string, start long, stop long")
    assert {(r.chrom, r.lo, r.hi) for r in align.islands(loci).collect()} == {("1", 0, 10), ("1", 10, 30), ("2", 0, 4)}


def test_overlaps_meet_once(spark):
    a = spark.createDataFrame([("1", 0, 100), ("1", 250, 260)], "chrom string, start long, stop long")
    b = spark.createDataFrame([("1", 50, 300), ("1", 100, 200)], "chrom string, start long, stop long")
    got = sorted((r.l_start, r.r_start) for r in align.overlaps(a, b, 20).collect())
    assert got == [(0, 50), (250, 50)]


def test_sampling_is_seeded_and_bounded(spark):
    axis = spark.range(50).withColumnRenamed("id", "col_id")
    one = [r.col_id for r in sample.uniform(axis, "col_id", n=10).collect()]
    assert one == [r.col_id for r in sample.uniform(axis.repartition(3), "col_id", n=10).collect()] and len(set(one)) == 10
    groups = axis.withColumn("grp", F.when(F.col("col_id") < 5, "s").otherwise("l"))
    assert {r.grp: r.n for r in sample.by_group(groups, n=8).groupBy("grp").agg(F.count("*").alias("n")).collect()} == {"s": 5, "l": 8}
    assert sample.even_shares({0: 1, 1: 10, 2: 10}, 9) == {0: 1, 1: 4, 2: 4}
    split = sample.folds(groups, test_fraction=0.5).collect()
    assert sorted(r.test for r in split) == [False, True]
    sample.check_split(axis, [axis.filter("col_id < 9"), axis.filter("col_id >= 9")])
    with pytest.raises(MatrixError):
        sample.check_split(axis, [axis, axis])


def test_batch_names_differ():
    assert align.batch_names(["a/x", "b/x", "c/y"]) == ["a_x", "b_x", "y"]


def test_transposed(spark):
    t = matrix(spark).transposed()
    assert isinstance(t, SparseMatrix) and t.features.count() == COLS
