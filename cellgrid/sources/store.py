"""The native store: a folder of Parquet tables, entries once in column order and once in row order."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import MatrixError, SparseMatrix
from ..plans.storage import present, published, removed

SUFFIXES = {".zarr.zip": "zarr", ".zarr": "zarr", ".h5": "hdf5", ".h5ad": "h5ad", ".mtx": "mtx", ".mtx.gz": "mtx", ".parquet": "parquet"}


def resolve(path: str) -> tuple[str, str]:
    """``(kind, stem)`` of a path by its suffix; without one it is a native store."""
    for suffix, kind in sorted(SUFFIXES.items(), key=lambda x: -len(x[0])):
        if path.endswith(suffix):
            return kind, path[: -len(suffix)]
    return "parquet", path.rstrip("/")


def write(m: SparseMatrix, path: str, inputs: tuple[str, ...] = (), replace: bool = False) -> None:
    """Write a matrix; an existing output (unless it is to be replaced), or one that is an input, is refused.

    All parts are written beside the output and moved there when they are whole, so a failure leaves nothing that reads as a matrix.
    """
    spark, path = m.entries.sparkSession, path.rstrip("/")
    if path in {i.rstrip("/") for i in inputs}:
        raise MatrixError(f"{path} is an input")
    if not replace and present(spark, path):
        raise MatrixError(f"{path} exists")
    staged = f"{path}.part-{uuid.uuid4().hex}"
    try:
        m.features.write.parquet(f"{staged}/features")
        m.cells.write.parquet(f"{staged}/cells")
        for name, key, then in (("by_column", "col_id", "row_id"), ("by_row", "row_id", "col_id")):
            m.entries.repartitionByRange(key, then).sortWithinPartitions(key, then).write.option("compression", "zstd").parquet(f"{staged}/{name}")
        spark.createDataFrame([(json.dumps(m.meta),)], "meta string").coalesce(1).write.parquet(f"{staged}/meta")
    except Exception:
        removed(spark, staged)
        raise
    if replace:
        removed(spark, path)
    published(spark, staged, path)


def slab_faults(slabs: DataFrame, n_rows: int, n_columns: int, nnz: int) -> DataFrame:
    """``(nnz_offset, fault)`` of ``slabs(nnz_offset, col_offset, colptr, row_ids, vals)``, bands of columns in compressed form.

    ``colptr`` are the starts of a band's columns. Each slab is checked on its own: lengths, starts, row ids in range
    and rising within a column, no nulls. Their borders are then compared in order, over a row of four numbers
    a slab: entries and columns follow one another without gap or overlap up to the declared counts.
    """
    n, k = F.size("vals"), F.size("colptr")
    end = lambda c: F.coalesce(F.get("colptr", c + 1), n.cast("long"))
    column = lambda c: F.slice("row_ids", (F.get("colptr", c) + 1).cast("int"), F.greatest(end(c) - F.get("colptr", c), F.lit(0)).cast("int"))
    each = lambda f: (k > 0) & F.exists(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), f)
    null = lambda c: F.col(c).isNull() | F.exists(c, lambda x: x.isNull())
    own = (
        F.when(F.coalesce(F.col("nnz_offset").isNull() | F.col("col_offset").isNull() | null("colptr") | null("row_ids") | null("vals"), F.lit(True)), "no value")
        .when(F.size("row_ids") != n, "row ids and values differ in number")
        .when((k > 0) & (F.get("colptr", F.lit(0)) != 0), "the first column does not start at 0")
        .when(each(lambda c: F.get("colptr", c) > end(c)), "columns start in falling order or beyond the slab")
        .when(F.exists("row_ids", lambda r: (r < 0) | (r >= n_rows)), "row out of range")
        .when(each(lambda c: column(c) != F.array_sort(F.array_distinct(column(c)))), "rows of a column do not rise")
    )
    border = slabs.select("nnz_offset", "col_offset", n.alias("_n"), k.alias("_k"))
    order = Window.orderBy("nnz_offset", "col_offset", "_n")
    ends = border.select("nnz_offset", "col_offset", F.lag(F.col("nnz_offset") + F.col("_n"), 1, 0).over(order).alias("_at"), F.lag(F.col("col_offset") + F.col("_k"), 1, 0).over(order).alias("_col"))
    gap = ends.filter((F.col("_at") != F.col("nnz_offset")) | (F.col("_col") != F.col("col_offset"))).select("nnz_offset", F.lit("gap or overlap before the slab").alias("fault"))
    total = border.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_k"), F.lit(0)).alias("k"))
    short = total.filter((F.col("n") != nnz) | (F.col("k") != n_columns)).select(F.lit(None).cast("long").alias("nnz_offset"), F.lit("other counts than declared").alias("fault"))
    return slabs.select("nnz_offset", own.alias("fault")).filter("fault IS NOT NULL").unionByName(gap).unionByName(short)


def slab_entries(slabs: DataFrame) -> DataFrame:
    """``(row_id, col_id, val)`` of slabs without faults; zeros are dropped."""
    size = F.size("vals").cast("long")
    column = slabs.select("col_offset", "row_ids", "vals", F.posexplode("colptr").alias("c", "start"), F.col("colptr"), size.alias("n"))
    length = (F.coalesce(F.get("colptr", F.col("c") + 1), F.col("n")) - F.col("start")).cast("int")
    at = (F.col("start") + 1).cast("int")
    cut = column.select((F.col("col_offset") + F.col("c")).alias("col_id"), F.arrays_zip(F.slice("row_ids", at, length).alias("row_id"), F.slice("vals", at, length).alias("val")).alias("e"))
    return cut.select("col_id", F.inline("e")).select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.col("val").cast("double").alias("val")).filter("val <> 0")


def write_slabs(slabs: DataFrame, features: DataFrame, cells: DataFrame, nnz: int, path: str, meta: dict[str, str] | None = None) -> None:
    """Write a matrix that comes as slabs of columns, or refuse it with its first fault and leave nothing behind; an earlier matrix of that path is replaced only by a whole one."""
    if found := slab_faults(slabs, features.count(), cells.count(), nnz).orderBy("nnz_offset", "fault").first():
        raise MatrixError(f"slab at {found.nnz_offset}: {found.fault}")
    write(SparseMatrix(slab_entries(slabs), features, cells, dict(meta or {})), path, replace=True)


def read(spark: SparkSession, path: str, by: str = "column") -> SparseMatrix:
    """Read a matrix; ``by`` chooses the copy in column or in row order, whose file statistics prune selections of that axis."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    return SparseMatrix(spark.read.parquet(f"{path}/by_{by}"), spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/cells"), meta)


def open_any(spark: SparkSession, path: str, cache: str | None = None) -> SparseMatrix:
    """Open a native store; a MatrixMarket file or a zarr store is converted first, into ``cache`` where one is given."""
    kind, _ = resolve(path)
    if kind == "parquet":
        return read(spark, path)
    if kind == "mtx":
        from .mtx import read_mtx

        m = read_mtx(spark, path)
    elif kind == "zarr":
        from .zarr_store import read_zarr

        m = read_zarr(spark, path)
    else:
        from .hdf5_store import read_hdf5

        m = read_hdf5(spark, path)
    if cache:
        write(m, cache, (path,))
        return read(spark, cache)
    return m


def contents(spark: SparkSession, path: str) -> DataFrame:
    """``(part, column, kind)`` of a store."""
    rows = [(p, f.name, f.dataType.simpleString()) for p in ("by_column", "by_row", "features", "cells", "meta") for f in spark.read.parquet(f"{path}/{p}").schema]
    return spark.createDataFrame(rows, "part string, column string, kind string")


def select_columns(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Entries of some columns, from the copy in column order: the filter reaches the file statistics."""
    return read(spark, path).entries.filter(F.col("col_id").isin(ids))


def select_rows(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    return read(spark, path, "row").entries.filter(F.col("row_id").isin(ids))
