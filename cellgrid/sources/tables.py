"""Side tables, molecule records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import MatrixError, SparseMatrix


def delimiter_of(first_line: str) -> str:
    """Tab, comma, semicolon or blank: the first that occurs."""
    return next((d for d in ("\t", ",", ";") if d in first_line), " ")


def read_group_table(spark: SparkSession, path: str) -> DataFrame:
    """``(col_name, grp)`` of a two-column text or Parquet table; a list of names alone is refused."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(F.col(df.columns[0]).alias("col_name"), F.col(df.columns[1]).cast("string").alias("grp"))
    lines = spark.read.text(path)
    first = lines.first()
    p = lines.select(F.split("value", delimiter_of(first[0]) if first else "\t").alias("p"))
    if p.filter(F.size("p") < 2).first():
        raise MatrixError(f"{path} has no groups")
    return p.select(F.trim(F.get("p", F.lit(0))).alias("col_name"), F.trim(F.get("p", F.lit(1))).alias("grp"))


def coordinates(table: DataFrame) -> DataFrame:
    """``(col_name, x, y)``; what is no finite number is missing and goes, a header with it."""
    a, b, c = table.columns[:3]
    out = table.select(F.col(a).cast("string").alias("col_name"), F.expr(f"try_cast(`{b}` as double)").alias("x"), F.expr(f"try_cast(`{c}` as double)").alias("y"))
    return out.filter("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")


def molecule_counts(molecules: DataFrame, called: DataFrame, library: Column | None = None, reads: bool = False) -> DataFrame:
    """``(feature, barcode, gem, val)``: molecules, or the reads of them, of called cells.

    ``molecules(feature, barcode, gem, reads, umi_type, pass_filter)``; other
    libraries and molecules that fail go.
    """
    ok = (F.col("umi_type") == 1) & F.col("pass_filter")
    if library is not None:
        ok = ok & library
    m = molecules.filter(ok).join(called.select("barcode", "gem").distinct(), ["barcode", "gem"], "left_semi")
    return m.groupBy("feature", "barcode", "gem").agg((F.sum("reads") if reads else F.count("*")).cast("double").alias("val"))


def molecule_cells(called: DataFrame) -> DataFrame:
    """``(barcode, gem, col_name)``: every called cell, ``SEQ-GEM``."""
    return called.select("barcode", "gem").distinct().withColumn("col_name", F.concat_ws("-", "barcode", "gem"))


def write_statistics(stats: DataFrame, path: str) -> None:
    """A statistics table as Parquet or tab-separated text, by the suffix."""
    if path.endswith(".parquet"):
        stats.write.parquet(path)
    else:
        stats.write.option("sep", "\t").option("header", True).csv(path)


def qc_report(cells: DataFrame, judged: DataFrame) -> DataFrame:
    """``(cell, n_genes, total_counts, mito, ribo, near_empty, train_keep)``."""
    return cells.join(judged, "col_id").select(F.col("col_name").alias("cell"), "n_genes", "total_counts", F.col("mito_frac").alias("mito"), F.col("ribo_frac").alias("ribo"), "near_empty", "train_keep")


def batch_labels(m: SparseMatrix) -> DataFrame:
    """``(col_id, batch)`` in column order."""
    return m.cells.select("col_id", "batch").orderBy("col_id")


def pair_table(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``(left_cell, right_cell, <extra...>, weight)`` with names for ids."""
    extra = [c for c in edges.columns if c not in ("left", "right", "weight")]
    a, b = (cells.select(F.col("col_id").alias(k), F.col("col_name").alias(f"{k}_cell")) for k in ("left", "right"))
    return edges.join(a, "left").join(b, "right").select("left_cell", "right_cell", *extra, "weight")


def write_weights(features: DataFrame, weights: DataFrame, path: str, coarse: DataFrame | None = None) -> None:
    """``(row_name, weight)`` of every feature, 1 where none is given, and the weights ``(grp, weight)`` of coarser features beside them."""
    features.select("row_id", "row_name").join(weights, "row_id", "left").select("row_name", F.coalesce("weight", F.lit(1.0)).alias("weight")).write.parquet(f"{path}/fine")
    if coarse is not None:
        coarse.select("grp", "weight").write.parquet(f"{path}/coarse")


def read_weights(features: DataFrame, path: str, part: str = "fine") -> DataFrame:
    """``(row_id, weight)`` of ``features`` by name; unknown names get 1. ``part="coarse"`` gives ``(grp, weight)``."""
    found = features.sparkSession.read.parquet(f"{path}/{part}")
    if part == "coarse":
        return found
    return features.select("row_id", "row_name").join(found, "row_name", "left").select("row_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def write_types(features: DataFrame, path: str) -> None:
    """``(row_name, feature_type)``."""
    features.select("row_name", "feature_type").write.parquet(path)


def read_types(features: DataFrame, path: str) -> DataFrame:
    """``features`` with the ``feature_type`` of their name, null where unknown."""
    return features.drop("feature_type").join(features.sparkSession.read.parquet(path), "row_name", "left")


def exported_axis(axis: DataFrame, frame: DataFrame, name: str) -> DataFrame:
    """``axis`` with the columns of ``frame(key, donor?, ...)`` by name, else by ``name@donor``; ambiguous keys give nulls."""
    once = frame.groupBy("key").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in frame.columns if c != "key"]).filter("_n = 1").drop("_n")
    out = axis.join(once.withColumnRenamed("key", name), name, "left")
    if "donor" in frame.columns:
        rest = [c for c in frame.columns if c != "key"]
        by = frame.withColumn("key", F.concat_ws("@", "key", "donor")).groupBy("key").agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_{c}") for c in rest]).filter("_n = 1").drop("_n")
        out = out.join(by.withColumnRenamed("key", name), name, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in rest}).drop(*[f"_{c}" for c in rest])
    return out
