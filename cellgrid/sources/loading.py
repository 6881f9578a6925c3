"""Several matrices on shared rows in one step: aligned, with batches, without empty barcodes, and under quality control."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import MatrixError, SparseMatrix
from ..operators import qc
from ..operators.align import stack, stacked_columns
from ..operators.select import keep_columns, keep_rows
from .store import open_any


@dataclass(frozen=True)
class Loaded:
    """A matrix whose cells have a ``batch``, and ``emitted(col_id)``: the cells to give out, None where no QC ran."""

    matrix: SparseMatrix
    emitted: DataFrame | None = None


def preloaded(m: SparseMatrix) -> SparseMatrix:
    """The matrix with its entries kept by the executors, on disk where memory is short; ``m.entries.unpersist()`` lets them go."""
    return m.with_(entries=m.entries.persist(StorageLevel.MEMORY_AND_DISK))


def open_shared(spark: SparkSession, paths: list[str], names: list[str], preload: bool = False, **settings) -> Loaded:
    """``shared_rows`` of stores of any kind."""
    parts = [open_any(spark, p) for p in paths]
    return shared_rows([preloaded(m) for m in parts] if preload else parts, names, **settings)


def shared_rows(
    parts: list[SparseMatrix],
    names: list[str],
    rows: str = "union",
    columns: str = "disjoint",
    canon=lambda c: c,
    batches: list[DataFrame] | None = None,
    row_suffixes: list[str] | None = None,
    barcode_suffixes: list[str | None] | None = None,
    keep_empty: bool = False,
    exempt: list[bool] | None = None,
    rules: qc.QcRules | None = None,
) -> Loaded:
    """Several parts as one matrix with a batch for each cell.

    ``row_suffixes`` keep equal names of different kinds of features apart as
    ``name/suffix``; ``barcode_suffixes`` tag the barcodes of columns that
    would otherwise fold (``columns="union"`` only). The batch of a cell comes
    from ``batches`` - ``(col_id, batch)`` of each part, or one of the folded
    columns - else from the text behind the last ``@`` of its barcode, else it
    is the part's name (``"all"`` for folded columns). A column goes as an
    empty barcode where every part that has it counts fewer rows than that
    part's own trough; parts marked ``exempt`` are neither gated nor judged.
    ``rules`` drop outliers and, with ``feature_min_cells``, rare rows.
    """
    for what, given in (("names", names), ("row suffixes", row_suffixes), ("barcode suffixes", barcode_suffixes), ("exemptions", exempt)):
        if given is not None and len(given) != len(parts):
            raise MatrixError(f"{len(given)} {what} for {len(parts)} parts")
    named = [m.with_(features=m.features.withColumn("row_name", canon(F.col("row_name")))) for m in parts]
    if row_suffixes is not None:
        named = [m.with_(features=m.features.withColumn("row_name", F.concat_ws("/", "row_name", F.lit(s)))) for m, s in zip(named, row_suffixes, strict=True)]
    if columns == "union" and barcode_suffixes is not None:
        named = [m.with_(cells=m.cells.withColumn("col_name", F.concat_ws("@", "col_name", F.lit(s)))) if s else m for m, s in zip(named, barcode_suffixes, strict=True)]
    placed = stacked_columns(named, names, columns)
    m = stack(named, names, rows, columns, placed=placed)
    m = m.with_(cells=m.cells.drop("batch").join(_batches(placed, columns, batches, len(parts)), "col_id"))
    spared = [b for b, e in enumerate(exempt or []) if e]
    if not keep_empty:
        gate = qc.empty_barcode_gate(_counted(named, placed), placed.filter(~F.col("backend").isin(spared)) if spared else placed)
        m = keep_columns(m, gate.filter("keep"))
    if rules is None:
        return Loaded(m)
    free = placed.filter(F.col("backend").isin(spared)).select(F.col("to_col").alias("col_id")).distinct().withColumn("_free", F.lit(True))
    judged = qc.verdicts(qc.metrics(m).join(free, "col_id", "left").fillna(False, ["_free"]), rules, F.col("_free"))
    m = keep_columns(m, judged.filter("train_keep"))
    if rules.feature_min_cells > 0:
        m = keep_rows(m, qc.feature_verdicts(qc.cells_per_feature(m), rules.feature_min_cells).filter("keep"))
    return Loaded(m, judged.filter("emitted").select("col_id"))


def _counted(parts: list[SparseMatrix], placed: DataFrame) -> DataFrame:
    """``(backend, col_id, n_genes)`` of each part's columns under their common ids."""
    every = None
    for b, m in enumerate(parts):
        n = m.entries.groupBy("col_id").agg(F.count("*").alias("n_genes")).withColumn("backend", F.lit(b))
        every = n if every is None else every.unionByName(n)
    return placed.join(every, ["backend", "col_id"], "left").select("backend", F.col("to_col").alias("col_id"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


def _batches(placed: DataFrame, columns: str, given: list[DataFrame] | None, n_parts: int) -> DataFrame:
    """``(col_id, batch)`` under the common ids; given labels must name every column once."""
    ids = placed.select(F.col("to_col").alias("col_id")).distinct()
    if given is None:
        tag = F.when(F.col("barcode").contains("@"), F.substring_index("barcode", "@", -1))
        out = placed.withColumn("batch", F.coalesce(tag, F.lit("all") if columns == "union" else F.col("tag")))
        return out.groupBy(F.col("to_col").alias("col_id")).agg(F.min("batch").alias("batch"))
    if len(given) != (1 if columns == "union" else n_parts):
        raise MatrixError(f"{len(given)} tables of batches for {n_parts} parts")
    if columns == "union":
        out = given[0].select("col_id", "batch")
    else:
        every = None
        for b, labels in enumerate(given):
            one = labels.select(F.lit(b).alias("backend"), "col_id", "batch")
            every = one if every is None else every.unionByName(one)
        out = every.join(placed.select("backend", "col_id", "to_col"), ["backend", "col_id"], "left").select(F.col("to_col").alias("col_id"), "batch")
    if ids.join(out, "col_id", "left_anti").first() or out.join(ids, "col_id", "left_anti").first() or out.groupBy("col_id").count().filter("count > 1").first():
        raise MatrixError("the batches must name every column once")
    return out
