import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrid.functions import names, numeric
from cellgrid.operators import annotate, collapse, genes, knn, project
from cellgrid.sources import fragments, mtx, store, tables
from tests.test_matrix import COLS, NO_ROW, SMALL, dense, matrix


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_names(spark):
    lit = F.lit
    assert value(spark, names.id_name(lit("a"), lit("b"))) == "a_b" and value(spark, names.id_name(lit("a"), lit("a"))) == "a"
    assert tuple(value(spark, names.split_id_name(lit("a_b_c")))) == ("a", "b_c")
    assert value(spark, names.batch_of(lit("x@y@z"))) == "z" and value(spark, names.batch_of(lit("x"))) == "all"
    assert tuple(value(spark, names.locus(lit("chr2:5-9")))) == ("2", 5, 9)
    assert value(spark, names.spelled_locus(lit("chr1-10-20"))) == "chr1:10-20"
    assert value(spark, names.renamed(lit("March3"))) == "MARCHF3"
    assert tuple(value(spark, names.feature_row(lit("a/b/m6a/7/up")))) == ("a/b", "m6a", "7", "up")
    assert value(spark, names.flexible_match(lit("x_Abc_y"), "abc")) and not value(spark, names.flexible_match(lit("xabc"), "abc"))


def test_reconciled_takes_the_best_tier(spark):
    f = spark.createDataFrame([(0, "ENSG00000123456_TP53"), (1, "tp53"), (2, "chr1:5-9"), (3, "x_SEPTIN2")], "row_id long, row_name string")
    q = spark.createDataFrame([("TP53",), ("ENSG00000123456.7",), ("1:5-9",), ("sept2",), ("none",)], "query string")
    got = {r.query: (r.row_id, r.tier) for r in names.reconciled(q, f).collect()}
    assert got["TP53"] == (1, 1) and got["ENSG00000123456.7"] == (0, 3) and got["1:5-9"] == (2, 0) and got["sept2"] == (3, 4) and "none" not in got


def test_numeric(spark):
    df = spark.createDataFrame([(0.5,), (5.0,), (-1.0,)], "x double")
    got = [r.v for r in df.select(numeric.lgamma("x").alias("v")).collect()]
    assert got[0] == pytest.approx(math.lgamma(0.5)) and got[1] == pytest.approx(math.lgamma(5)) and got[2] is None
    assert value(spark, numeric.sign_code(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0)))) == 5
    w = numeric.exp_weights(np.array([1.0, 2.0, 3.0]), 1.5)
    assert w.sum() == pytest.approx(1.5, abs=1e-6)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, str(i % 3), v[i].tolist()) for i in range(60)], "id long, batch string, vec array<double>")
    got = {(r.source, r.batch, r["rank"]): r.match for r in knn.nearest(df.filter("id < 7"), df, 4).collect()}
    for i in range(7):
        for b in range(3):
            if b == i % 3:
                assert (i, str(b), 1) not in got
                continue
            own = [j for j in range(60) if j % 3 == b]
            best = sorted(own, key=lambda j: (np.linalg.norm(v[i] - v[j]), j))[:4]
            assert [got[i, str(b), k + 1] for k in range(4)] == best


def test_imputation_weights_sum_to_one(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0)], "source long, match long, dist double")
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "row_id long, col_id long, val double")
    assert knn.impute(m, e, 1.0).first().val == pytest.approx(1.0)


def test_pseudobulk_posterior(spark):
    m = matrix(spark)
    members = spark.createDataFrame([(0, "i", "k", 1.0), (1, "i", "k", 0.5)], "col_id long, individual string, kind string, w double")
    got = {r.row_id: r for r in collapse.pseudobulk(m, members).collect()}
    a = dense()
    assert got[4].a == 1 + a[4, 0] + 0.5 * a[4, 1] and got[4].b == 2.5 and got[NO_ROW].mean == pytest.approx(1 / 2.5)


def test_batch_model_pins_and_separates():
    rng = np.random.default_rng(0)
    true, delta = rng.gamma(5, 2, (40, 3)), np.array([0.5, 2.0])
    n = np.array([[30.0, 30, 30], [30, 30, 30]])
    per = true[:, None, :] * delta[None, :, None] * n[None]
    out = collapse.batch_model(per.sum(axis=1), np.zeros((40, 3)), per.sum(axis=2), n, np.zeros((2, 3)))
    assert np.allclose(np.log(out["delta"]).mean(axis=1), 0, atol=0.02)
    assert np.corrcoef(out["mu"].ravel(), true.ravel())[0, 1] > 0.99


def test_levels_nest_and_conserve(spark):
    assert collapse.level_bits(10, 2) == [10, 7] and collapse.level_bits(3, 3) == [3]
    m = matrix(spark).with_(cells=matrix(spark).cells.withColumn("batch", F.when(F.col("col_id") < 3, "a").otherwise("b")))
    groups, post = collapse.multilevel(m, project.project(m, 4), 4, 3, coarsest=1)
    wide = groups.groupBy("col_id").pivot("level", [0, 1]).agg(F.first("grp")).toPandas()
    assert (wide.groupby("0")["1"].nunique() == 1).all()
    total = {r.level: r.t for r in post.groupBy("level").agg(F.sum(F.col("a") - 1).alias("t")).collect()}
    assert total[0] == pytest.approx(dense().sum()) and total[1] == pytest.approx(dense().sum())


def test_refined_moves_a_misplaced_entity(spark):
    rows = []
    for e, g, p in [(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 0, 1)]:
        rows += [(0, e, g, r, 50.0 if (r < 3) == (p == 0) else 1.0) for r in range(6)]
    out = {r.entity: r.grp for r in collapse.refined(spark.createDataFrame(rows, "parent long, entity long, grp long, row_id long, val double")).collect()}
    assert out == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


def test_hierarchical_joins_like_profiles_first():
    a = pd.DataFrame([[90, 10, 0], [88, 12, 0], [0, 10, 90]])
    merges, labels = genes.hierarchical(a)
    assert merges[0][:2] == (0, 1) and labels[0] == labels[1] != labels[2]


def test_dispersion_of_constant_features(spark):
    s = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 2.0, 2.0, 3.0)], "row_id long, tot double, mu double, sig double")
    assert genes.dispersion_trend(s).first().intercept is None
    assert genes.variable_features(s, 1).first().row_id == 1


def test_ontology_and_sets(spark):
    text = "format: 1\n\n[Term]\nid: A\nname: a\n\n[Term]\nid: B\nis_a: A ! a\n\n[Term]\nid: C\nis_a: B\nrelationship: part_of A\n\n[Term]\nid: D\nis_obsolete: true\n"
    terms, edges = annotate.parse_obo(text)
    assert [t[0] for t in terms] == ["A", "B", "C"]
    up = annotate.closure(spark.createDataFrame(edges, "child string, parent string, rel string"))
    assert {tuple(r) for r in up.collect()} == {("A", "A"), ("B", "B"), ("B", "A"), ("C", "C"), ("C", "B"), ("C", "A")}
    gaf = spark.createDataFrame([("\t".join(["db", "P1", "abc", "NOT|x", "GO:1", "r", "IEA", "", "", "", "s1|s2", "protein", "", "", ""]),), ("\t".join(["db", "P1", "abc", "", "GO:1", "r", "IDA", "", "", "", "s1|s2", "protein", "", "", ""]),), ("!c",)], "value string")
    assert {r.alias for r in annotate.parse_gaf(gaf).collect()} == {"ABC", "P1", "S1", "S2"}


def test_fragments(spark):
    lines = spark.createDataFrame([("chr1\t0\t10\tA\t2",), ("1\t5\t25\tB\r",), ("#x",), ("chr1\t9\t9\tC",), ("bad",)], "value string")
    f = fragments.parse_lines(lines)
    assert {tuple(r) for r in f.collect()} == {("1", 0, 10, "A", 2), ("1", 5, 25, "B", 1)}
    assert {(r.tile, r.barcode): r.val for r in fragments.tile_counts(f, 10).collect()} == {(0, "A"): 1, (0, "B"): 1, (1, "B"): 1, (2, "B"): 1}
    peaks = spark.createDataFrame([("1", 8, 12)], "chrom string, start long, stop long")
    assert {r.barcode: r.val for r in fragments.peak_counts(f, peaks, True).collect()} == {"A": 2, "B": 1}
    m = fragments.tile_matrix(f, 10, spark.createDataFrame([(0, "Z"), (1, "B")], "pos long, barcode string"))
    assert m.cells.count() == 2 and m.entries.filter("col_id = 0").isEmpty()


def test_store_and_matrix_market_round_trips(spark, tmp_path):
    m = matrix(spark)
    store.write(m, str(tmp_path / "s"))
    back = store.open_any(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.entries.collect())) == sorted(SMALL) and back.cells.count() == COLS
    with pytest.raises(Exception):
        store.write(m, "x", ("x",))
    mtx.write_mex(m, str(tmp_path / "mex"), compress=False)
    lines = sorted((tmp_path / "mex" / "matrix.mtx").glob("part-*"))
    (tmp_path / "m.mtx").write_text("".join(p.read_text() for p in lines))
    (tmp_path / "f.tsv").write_text("g0\tn0\tGene\ng1\tn1\tGene\ng1\tn1\tGene\ng3\tg3\tTag\ng4\tn4\tTag\ng5\tn5\tTag\n")
    got = mtx.read_mtx(spark, str(tmp_path / "m.mtx"), str(tmp_path / "f.tsv"))
    assert sorted(map(tuple, got.entries.collect())) == sorted(SMALL)
    assert [r.row_name for r in got.features.orderBy("row_id").collect()] == ["g0_n0", "g1_n1", "g1_n1-1", "g3", "g4_n4", "g5_n5"]
    tagged, side = mtx.demultiplexed(got, F.col("feature_type") == "Tag")
    tags = dense()[3:]
    assert {r.barcode: r["count"] for r in side.collect()} == {str(j): tags[:, j].max() for j in range(COLS) if tags[:, j].any()} and tagged.features.count() == 3


def test_side_tables(spark):
    t = spark.createDataFrame([("a", "1.5", "2"), ("b", "x", "1"), ("c", "NaN", "1")], "n string, x string, y string")
    assert [r.col_name for r in tables.coordinates(t).collect()] == ["a"]
    assert tables.delimiter_of("a\tb") == "\t" and tables.delimiter_of("a b") == " "
