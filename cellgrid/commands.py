"""One function a command: read a store, apply an operator, write a store or return a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import MatrixError, SparseMatrix, info
from .operators import align, qc, sample, select, stats
from .sources import fragments, mtx, store, tables, zarr_store


def from_mtx(spark: SparkSession, path: str, out: str, features: str | None = None, barcodes: str | None = None, select_type: str = "", remove_type: str = "", min_row: int = 1, min_col: int = 1) -> None:
    store.write(qc.squeeze(mtx.read_mtx(spark, path, features, barcodes, select_type, remove_type), min_row, min_col), out, (path,))


def from_fragments(spark: SparkSession, path: str, out: str, tile: int = 500, weighted: bool = False) -> None:
    store.write(fragments.tile_matrix(fragments.read_fragments(spark, path), tile, weighted=weighted), out, (path,))


def from_zarr(spark: SparkSession, path: str, out: str) -> None:
    store.write(zarr_store.read_zarr(spark, path), out, (path,))


def from_molecules(spark: SparkSession, molecules: str, called: str, features: str, out: str, reads: bool = False) -> None:
    """Molecules, called cells and ``features(feature, row_name)`` as Parquet; columns in order of barcode and group, all features in order of number."""
    counts = tables.molecule_counts(spark.read.parquet(molecules), spark.read.parquet(called), reads=reads)
    cells = select.running(tables.molecule_cells(spark.read.parquet(called)), [], ["barcode", "gem"]).withColumn("col_id", F.col("_n") - 1)
    rows = select.running(spark.read.parquet(features).select("feature", "row_name"), [], ["feature"]).withColumn("row_id", F.col("_n") - 1)
    e = counts.join(cells, ["barcode", "gem"]).join(rows, "feature").select("row_id", "col_id", "val")
    store.write(SparseMatrix(e, rows.select("row_id", "row_name"), cells.select("col_id", "col_name"), {"producer": "molecules"}), out, (molecules, called, features))


def to_mtx(spark: SparkSession, path: str, out: str, compress: bool = True) -> None:
    mtx.write_mex(store.open_any(spark, path), out, compress)


def convert(spark: SparkSession, path: str, out: str) -> None:
    store.write(store.open_any(spark, path), out, (path,))


def info_of(spark: SparkSession, path: str) -> DataFrame:
    return info(store.open_any(spark, path))


def list_contents(spark: SparkSession, path: str) -> DataFrame:
    return store.contents(spark, path)


def row_names(spark: SparkSession, path: str) -> DataFrame:
    return store.open_any(spark, path).features.select("row_id", "row_name").orderBy("row_id")


def column_names(spark: SparkSession, path: str) -> DataFrame:
    return store.open_any(spark, path).cells.select("col_id", "col_name").orderBy("col_id")


def take_columns(spark: SparkSession, path: str, spec: str) -> DataFrame:
    """``(row_name, <column>...)`` of a stated list of columns."""
    m = store.read(spark, path)
    ids = select.parse_indices(spec, m.cells.count())
    names = {r.col_id: r.col_name for r in m.cells.filter(F.col("col_id").isin(ids)).collect()}
    wide = select.pivoted(select.dense_columns(m, select.selection(spark, ids, "col_id")), "row_id", [names[i] for i in ids])
    return m.features.select("row_id", "row_name").join(wide, "row_id").orderBy("row_id").drop("row_id")


def take_rows(spark: SparkSession, path: str, spec: str) -> DataFrame:
    """``(column_name, <row>...)`` of a stated list of rows, from the copy in row order."""
    m = store.read(spark, path, "row")
    ids = select.parse_indices(spec, m.features.count())
    names = {r.row_id: r.row_name for r in m.features.filter(F.col("row_id").isin(ids)).collect()}
    wide = select.pivoted(select.dense_rows(m, select.selection(spark, ids, "row_id")), "col_id", [names[i] for i in ids])
    return m.cells.select("col_id", F.col("col_name").alias("column_name")).join(wide, "col_id").orderBy("col_id").drop("col_id")


def subset(spark: SparkSession, path: str, out: str, columns: str | None = None, rows: str | None = None, column_pattern: str | None = None, row_pattern: str | None = None, column_file: str | None = None, row_file: str | None = None) -> None:
    """Columns and rows by index list, by pattern or by a file with a name a line; what both name is kept.

    Names and patterns keep the order of the matrix; names that it lacks are passed over.
    """
    m = store.open_any(spark, path)
    for spec, pattern, file, axis, key, name, cut in ((columns, column_pattern, column_file, m.cells, "col_id", "col_name", select.subset_columns), (rows, row_pattern, row_file, m.features, "row_id", "row_name", select.subset_rows)):
        if spec:
            m = cut(m, select.selection(spark, select.parse_indices(spec, axis.count()), key))
        elif pattern or file:
            hit = axis.filter(select.name_matches(F.col(name), pattern)) if pattern else axis
            if file:
                hit = hit.join(spark.read.text(file).select(F.trim("value").alias(name)), name, "left_semi")
            if hit.isEmpty():
                raise MatrixError(f"{pattern or file!r} matches nothing")
            m = cut(m, hit.select(key).join(select.dense_ids(hit, key), key), check=False)
    store.write(m, out, (path,))


def reorder_rows(spark: SparkSession, path: str, out: str, names: list[str]) -> None:
    store.write(select.reorder_rows(store.open_any(spark, path), spark.createDataFrame(list(enumerate(names)), "pos long, row_name string")), out, (path,))


def subsample(spark: SparkSession, path: str, out: str, n: int | None = None, fraction: float | None = None, groups: str | None = None, seed: int = 42) -> None:
    """Columns drawn uniformly, or from each group of a table."""
    m = store.open_any(spark, path)
    if groups:
        kept = sample.by_group(align.joined_groups(m, tables.read_group_table(spark, groups)), n=n, fraction=fraction, seed=seed)
    else:
        kept = sample.uniform(m.cells, "col_id", n, fraction, seed)
    ids = kept.select("col_id")
    store.write(select.subset_columns(m, select.dense_ids(ids, "col_id"), check=False), out, (path,))


def split(spark: SparkSession, path: str, out: str, groups: str, folds: int | None = None, test_fraction: float | None = 0.2, seed: int = 42) -> None:
    """``out/fold=<f>/{train,test}``: whole groups of columns on either side."""
    m = store.open_any(spark, path)
    of = align.joined_groups(m, tables.read_group_table(spark, groups))
    dealt = of.join(F.broadcast(sample.folds(of, folds, None if folds else test_fraction, seed)), "grp")
    for f in range(folds or 1):
        test = dealt.filter(F.col("fold") == f) if folds else dealt.filter("test")
        rest = of.join(test.select("col_id"), "col_id", "left_anti")
        sample.check_split(of, [test, rest])
        for name, part in (("test", test), ("train", rest)):
            store.write(select.subset_columns(m, select.dense_ids(part.select("col_id"), "col_id"), check=False), f"{out}/fold={f}/{name}", (path,))


def merge(spark: SparkSession, paths: list[str], out: str, common_rows: bool = False) -> None:
    store.write(align.merge([store.open_any(spark, p) for p in paths], align.batch_names(paths), common_rows), out, tuple(paths))


def merge_mtx(spark: SparkSession, folders: list[str], out: str, files: tuple[str, str, str] = ("matrix.mtx.gz", "features.tsv.gz", "barcodes.tsv.gz"), squeeze: bool = False) -> None:
    """The MatrixMarket sets of the folders and their subfolders on their common rows, in order of name; of a name that a set repeats the first row counts."""
    sets = mtx.found_sets(spark, folders, files)
    if not sets:
        raise MatrixError("no folder holds a matrix with its features and barcodes")
    m = align.merge_sorted([mtx.read_mtx(spark, *s[1:], repeated="first") for s in sets], align.batch_names([s[0] for s in sets]))
    if m.features.isEmpty():
        raise MatrixError("the sets share no row")
    store.write(qc.squeeze(m) if squeeze else m, out, tuple(folders))


def align_data(spark: SparkSession, grid: list[list[str | None]], out: str) -> list[str]:
    """Stores by type (outer list) and group: common rows of a type, common cells of a group; ``out/type=<t>/group=<g>`` of what is left."""
    paths = []
    for t, row in enumerate(align.align([[p and store.open_any(spark, p) for p in row] for row in grid])):
        for g, m in enumerate(row):
            if m:
                paths.append(f"{out}/type={t}/group={g}")
                store.write(m, paths[-1], tuple(p for r in grid for p in r if p))
    return paths


def statistics(spark: SparkSession, path: str, axis: str = "column", rows: str | None = None, groups: str | None = None) -> DataFrame:
    """``(name, nnz, tot, mu, sig)``, with ``grp`` first where groups of columns are given."""
    m: SparseMatrix = store.read(spark, path, axis)
    if groups:
        s = stats.row_stats_by_group(m, m.cells.join(tables.read_group_table(spark, groups), "col_name").select("col_id", "grp"))
        return s.join(m.features, "row_id").select("grp", F.col("row_name").alias("name"), "nnz", "tot", "mu", "sig")
    if axis == "row":
        return stats.row_stats(m).join(m.features, "row_id").select(F.col("row_name").alias("name"), "nnz", "tot", "mu", "sig")
    some = m.features.filter(select.name_matches(F.col("row_name"), rows)) if rows else None
    return stats.column_stats(m, some).join(m.cells, "col_id").select(F.col("col_name").alias("name"), "nnz", "tot", "mu", "sig")


def histogram(spark: SparkSession, path: str, axis: str = "column", of: str = "nnz") -> DataFrame:
    m = store.read(spark, path, axis)
    return stats.histogram(stats.column_stats(m) if axis == "column" else stats.row_stats(m), of)


def quality_control(spark: SparkSession, paths: list[str], out: str | None = None, rules: qc.QcRules = qc.QcRules(), mito: str = "(?i)(^|_)mt-") -> DataFrame:
    """Pool, measure, judge: ``(key, value)``; with ``out`` the emitted cells and kept features are written."""
    parts = [store.open_any(spark, p) for p in paths]
    m = align.merge(parts, align.batch_names(paths), True) if len(parts) > 1 else parts[0]
    judged = qc.verdicts(qc.metrics(m, F.col("row_name").rlike(mito)), rules)
    if out:
        kept = qc.feature_verdicts(qc.cells_per_feature(m), rules.feature_min_cells).filter("keep")
        clean = select.keep_rows(select.keep_columns(m, judged.filter("emitted")), kept)
        store.write(clean, out, tuple(paths))
    return qc.summary(judged)
