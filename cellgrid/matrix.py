"""The sparse matrix: entries with two dimension tables.

``entries(row_id, col_id, val)`` holds the non-zero values as doubles, unique
for each place; ``features(row_id, row_name, ...)`` and ``cells(col_id,
col_name, ...)`` hold every row and column, empty ones too, so the shape never
depends on the entries. Operators return new frames and change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MatrixError(ValueError):
    """A matrix or a selection breaks its contract."""


@dataclass(frozen=True)
class SparseMatrix:
    entries: DataFrame
    features: DataFrame
    cells: DataFrame
    meta: dict[str, str] = field(default_factory=dict)

    def with_(self, **parts) -> SparseMatrix:
        return replace(self, **parts)

    def transposed(self) -> SparseMatrix:
        """Rows and columns change places."""
        return SparseMatrix(
            self.entries.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "val"),
            self.cells.withColumnsRenamed({"col_id": "row_id", "col_name": "row_name"}),
            self.features.withColumnsRenamed({"row_id": "col_id", "row_name": "col_name"}),
            self.meta,
        )


def from_triplets(entries: DataFrame, features: DataFrame, cells: DataFrame, meta: dict[str, str] | None = None, check: bool = True) -> SparseMatrix:
    """A matrix from ``(row_id, col_id, val)``; zeros are dropped, ``check`` refuses places out of range or given twice."""
    e = entries.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.col("val").cast("double").alias("val"))
    m = SparseMatrix(e.filter("val <> 0"), features, cells, dict(meta or {}))
    if check:
        validate(m.with_(entries=e))
    return m


def faults(m: SparseMatrix) -> DataFrame:
    """``(fault, row_id, col_id)``: entries out of range, given twice, or null."""
    out = m.entries.join(m.features.select("row_id"), "row_id", "left_anti").select(F.lit("row out of range").alias("fault"), "row_id", "col_id")
    col = m.entries.join(m.cells.select("col_id"), "col_id", "left_anti").select(F.lit("column out of range").alias("fault"), "row_id", "col_id")
    twice = m.entries.groupBy("row_id", "col_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("given twice").alias("fault"), "row_id", "col_id")
    null = m.entries.filter("val is null").select(F.lit("no value").alias("fault"), "row_id", "col_id")
    return out.union(col).union(twice).union(null)


def validate(m: SparseMatrix) -> None:
    """Refuse a matrix with a faulty entry, naming the first."""
    if found := faults(m).orderBy("fault", "row_id", "col_id").first():
        raise MatrixError(f"entry ({found.row_id}, {found.col_id}): {found.fault}")


def from_dense(spark: SparkSession, rows: DataFrame, values: str = "values") -> SparseMatrix:
    """A matrix from ``(row_id, row_name, values array<double>)``; columns are numbered and named ``c0, c1, ...``."""
    e = rows.select("row_id", F.posexplode(values).alias("col_id", "val")).filter("val <> 0")
    n = rows.select(F.max(F.size(values))).first()[0] or 0
    cells = spark.range(n).select(F.col("id").alias("col_id"), F.concat(F.lit("c"), F.col("id")).alias("col_name"))
    return from_triplets(e, rows.select("row_id", "row_name"), cells, check=False)


def info(m: SparseMatrix) -> DataFrame:
    """``(key, value)``: shape, non-zeros and metadata."""
    one = lambda df, k: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(k).alias("key"), "value")
    out = one(m.features, "nrow").union(one(m.cells, "ncol")).union(one(m.entries, "nnz"))
    for k, v in sorted(m.meta.items()):
        out = out.union(m.features.sparkSession.createDataFrame([(f"meta.{k}", v)], "key string, value string"))
    return out


def common_meta(metas: list[dict[str, str]]) -> dict[str, str]:
    """Keys kept where every part has the same value."""
    first, *rest = metas or [{}]
    return {k: v for k, v in first.items() if all(m.get(k) == v for m in rest)}
