import pytest
from pyspark.sql import functions as F

from cellgrid import commands
from cellgrid.matrix import MatrixError
from cellgrid.operators import sim
from cellgrid.sources import store
from tests.test_matrix import COLS, ROWS, SMALL, dense, matrix, places


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("m") / "small")
    store.write(matrix(spark), p)
    return p


def test_reading_commands(spark, path):
    a = dense()
    assert {r.key: r.value for r in commands.info_of(spark, path).collect()} == {"nrow": str(ROWS), "ncol": str(COLS), "nnz": str(len(SMALL))}
    assert [r.row_name for r in commands.row_names(spark, path).collect()] == [f"feat{i}" for i in range(ROWS)]
    rows = commands.take_columns(spark, path, "4,0").collect()
    assert [(r.row_name, r.cell4, r.cell0) for r in rows] == [(f"feat{i}", a[i, 4], a[i, 0]) for i in range(ROWS)]
    rows = commands.take_rows(spark, path, "2-3").collect()
    assert [(r.column_name, r.feat2, r.feat3) for r in rows] == [(f"cell{j}", a[2, j], a[3, j]) for j in range(COLS)]
    got = {r.name: r.tot for r in commands.statistics(spark, path, "row").collect()}
    assert got == {f"feat{i}": a[i].sum() for i in range(ROWS)}
    assert sum(r.n for r in commands.histogram(spark, path).collect()) == COLS
    assert commands.list_contents(spark, path).filter("part = 'features'").count() == 2


def test_writing_commands(spark, path, tmp_path):
    commands.subset(spark, path, str(tmp_path / "s"), columns="1-3", row_pattern="FEAT[04]$")
    m = store.read(spark, str(tmp_path / "s"))
    assert set(map(tuple, m.entries.collect())) == places(dense()[[0, 4], 1:4])
    with pytest.raises(MatrixError):
        commands.subset(spark, path, str(tmp_path / "x"), column_pattern="nothing")
    with pytest.raises(MatrixError, match="input"):
        commands.convert(spark, path, path)
    commands.subsample(spark, path, str(tmp_path / "d"), n=3)
    assert store.read(spark, str(tmp_path / "d")).cells.count() == 3
    (tmp_path / "g.tsv").write_text("".join(f"cell{i}\t{'xy'[i % 2]}\n" for i in range(COLS)))
    commands.split(spark, path, str(tmp_path / "k"), str(tmp_path / "g.tsv"), folds=2)
    sizes = [store.read(spark, str(tmp_path / "k" / f"fold={f}" / p)).cells.count() for f in (0, 1) for p in ("train", "test")]
    assert sorted(sizes) == [3, 3, 4, 4] and sizes[0] + sizes[1] == COLS
    commands.merge(spark, [path, path], str(tmp_path / "m"))
    assert store.read(spark, str(tmp_path / "m")).cells.count() == 2 * COLS
    out = {r.key: r.value for r in commands.quality_control(spark, [path], str(tmp_path / "q")).collect()}
    few = int(((dense() > 0).sum(axis=0) < 2).sum())
    assert out["cells"] == COLS and out["near_empty"] == few and store.read(spark, str(tmp_path / "q")).cells.count() == out["emitted"]


def test_sets_of_folders_are_merged(spark, tmp_path):
    def put(folder, prefix, rows, cols, entries, tail=""):
        folder.mkdir(parents=True)
        (folder / f"{prefix}matrix.mtx").write_text("%%MatrixMarket matrix coordinate real general\n" + f"{len(rows)} {len(cols)} {len(entries)}\n" + "".join(f"{r} {c} {v}\n" for r, c, v in entries))
        (folder / f"{prefix}features.tsv").write_text("\n".join(rows) + "\n" + tail)
        (folder / f"{prefix}barcodes.tsv").write_text("\n".join(cols) + "\n")

    files = ("matrix.mtx", "features.tsv", "barcodes.tsv")
    put(tmp_path / "in" / "one", "", ["g2", "g1", "g2", "g9"], ["x", "y"], [(1, 1, 5), (2, 2, 7), (3, 1, 100), (4, 1, 1)])
    put(tmp_path / "in" / "two", "GSM1_", ["g1", "g2"], ["x"], [(1, 1, 3), (2, 1, 4)], tail="\n\n")
    (tmp_path / "in" / "none").mkdir()
    (tmp_path / "in" / "a file").write_text("")
    commands.merge_mtx(spark, [str(tmp_path / "in")], str(tmp_path / "out"), files)
    m = store.read(spark, str(tmp_path / "out"))
    assert [r.row_name for r in m.features.orderBy("row_id").collect()] == ["g1", "g2"]
    names = {r.col_id: r.col_name for r in m.cells.collect()}
    assert {(r.row_id, names[r.col_id], r.val) for r in m.entries.collect()} == {(1, "x@one", 5.0), (0, "y@one", 7.0), (0, "x@two", 3.0), (1, "x@two", 4.0)}
    put(tmp_path / "other", "", ["h"], ["x"], [(1, 1, 1)])
    for folders in (["none"], ["in", "other"]):
        with pytest.raises(MatrixError):
            commands.merge_mtx(spark, [str(tmp_path / f) if f != "none" else str(tmp_path / "in" / f) for f in folders], str(tmp_path / "no"), files)
    (tmp_path / "in" / "two" / "GSM2_matrix.mtx").write_text("")
    with pytest.raises(MatrixError, match="both end"):
        commands.merge_mtx(spark, [str(tmp_path / "in")], str(tmp_path / "no"), files)
    put(tmp_path / "long", "", ["g1", "g2"], ["x"], [(1, 1, 3)], tail="\ng3\n")
    with pytest.raises(MatrixError, match="lines for"):
        commands.merge_mtx(spark, [str(tmp_path / "long")], str(tmp_path / "no"), files)


def test_molecules_name_files_and_alignment(spark, path, tmp_path):
    mol = [(1, "AC", 1, 3, 1, True), (1, "AC", 1, 2, 1, True), (0, "AA", 2, 1, 1, True), (0, "AA", 2, 1, 0, True), (1, "GG", 1, 9, 1, True)]
    spark.createDataFrame(mol, "feature long, barcode string, gem int, reads long, umi_type int, pass_filter boolean").write.parquet(str(tmp_path / "mol"))
    spark.createDataFrame([("AC", 1), ("AA", 2), ("AA", 1)], "barcode string, gem int").write.parquet(str(tmp_path / "called"))
    spark.createDataFrame([(1, "g1"), (0, "g0"), (2, "g2")], "feature long, row_name string").write.parquet(str(tmp_path / "feat"))
    for reads, n in ((False, 2.0), (True, 5.0)):
        commands.from_molecules(spark, str(tmp_path / "mol"), str(tmp_path / "called"), str(tmp_path / "feat"), str(tmp_path / f"m{reads}"), reads)
        m = store.read(spark, str(tmp_path / f"m{reads}"))
        assert [r.col_name for r in m.cells.orderBy("col_id").collect()] == ["AA-1", "AA-2", "AC-1"] and m.features.count() == 3
        assert set(map(tuple, m.entries.collect())) == {(1, 2, n), (0, 1, 1.0)}
    (tmp_path / "cells.txt").write_text("cell4\ncell1\nunknown\n")
    commands.subset(spark, path, str(tmp_path / "s"), column_file=str(tmp_path / "cells.txt"))
    m = store.read(spark, str(tmp_path / "s"))
    assert [r.col_name for r in m.cells.orderBy("col_id").collect()] == ["cell1", "cell4"]
    assert set(map(tuple, m.entries.collect())) == places(dense()[:, [1, 4]])
    (tmp_path / "nobody.txt").write_text("unknown\n")
    with pytest.raises(MatrixError, match="nothing"):
        commands.subset(spark, path, str(tmp_path / "n"), column_file=str(tmp_path / "nobody.txt"))
    out = commands.align_data(spark, [[path], [str(tmp_path / "s")]], str(tmp_path / "grid"))
    parts = [store.read(spark, p) for p in out]
    assert [p.cells.count() for p in parts] == [2, 2] and all(set(map(tuple, p.entries.collect())) == places(dense()[:, [1, 4]]) for p in parts)


def test_simulated_counts_do_not_depend_on_partitions(spark):
    m = sim.topics(spark, 30, 20, batches=2)
    one = sorted(map(tuple, m.entries.collect()))
    assert one == sorted(map(tuple, sim.topics(spark, 30, 20, batches=2).entries.coalesce(1).collect())) and m.features.count() == 30
    assert sim.trajectory(spark, 20, 10).entries.agg(F.countDistinct("col_id")).first()[0] == 10
    shares = sim.bulk(m, 3).groupBy("sample").agg(F.sum("val").alias("t")).collect()
    assert len(shares) == 3
    parts = sim.multimodal(spark, [20, 10], 8)
    assert [p.features.count() for p in parts] == [20, 10]
    atac, rna, links = sim.linked(spark, 15, 6, 8)
    assert links.count() == 18 and rna.features.count() == 6 and atac.entries.count() > 0
    like = sim.from_reference(m, 40)
    report = {r.measure: r for r in sim.fidelity(m, like).collect()}
    assert report["mean correlation"].b > 0.8 and report["depth"].gap < 0.3 * report["depth"].a
