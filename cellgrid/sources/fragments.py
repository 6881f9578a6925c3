"""ATAC fragments: lines to intervals, counted over tiles or peaks, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..operators.align import overlaps
from ..operators.select import dense_ids

MAX_LENGTH = 1 << 30


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(chrom, start, stop, barcode, count)`` of valid lines; comments, blanks and malformed lines go. A missing count is 1."""
    p = lines.withColumn("value", F.regexp_replace("value", "\r$", "")).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    c = lambda i: F.get("p", F.lit(i))
    whole = lambda x: F.when(x.rlike(r"^\s*[0-9]{1,18}\s*$"), x.cast("long"))
    out = p.select(F.regexp_replace(c(0), "^chr", "").alias("chrom"), whole(c(1)).alias("start"), whole(c(2)).alias("stop"), c(3).alias("barcode"), F.coalesce(whole(c(4)), F.lit(1)).alias("count"))
    return out.filter("chrom <> '' and barcode <> '' and stop > start").filter(F.col("stop") - F.col("start") <= MAX_LENGTH)


def malformed(lines: DataFrame) -> DataFrame:
    """One row ``(lines, valid)``."""
    n = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).agg(F.count("*").alias("lines"))
    return n.crossJoin(parse_lines(lines).agg(F.count("*").alias("valid")))


def parse_bed(lines: DataFrame) -> DataFrame:
    """``(chrom, start, stop)`` of a peak file."""
    p = lines.filter(~F.col("value").rlike("^(#|track|browser)")).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 3)
    c = lambda i: F.get("p", F.lit(i))
    return p.select(F.regexp_replace(c(0), "^chr", "").alias("chrom"), F.expr("try_cast(p[1] as long)").alias("start"), F.expr("try_cast(p[2] as long)").alias("stop")).filter("stop > start")


def tile_counts(fragments: DataFrame, width: int, weighted: bool = False) -> DataFrame:
    """``(chrom, tile, barcode, val)``: fragments that touch each tile, or their counts."""
    tiles = F.sequence((F.col("start") / width).cast("long"), ((F.col("stop") - 1) / width).cast("long"))
    e = fragments.select("chrom", F.explode(tiles).alias("tile"), "barcode", (F.col("count") if weighted else F.lit(1)).alias("v"))
    return e.groupBy("chrom", "tile", "barcode").agg(F.sum("v").cast("double").alias("val"))


def peak_counts(fragments: DataFrame, peaks: DataFrame, weighted: bool = False, bin_width: int = 10_000) -> DataFrame:
    """``(chrom, start, stop, barcode, val)`` of the peaks that fragments overlap, by an equi-join on bins."""
    met = overlaps(peaks.select("chrom", "start", "stop"), fragments.select("chrom", "start", "stop", "barcode", "count"), bin_width)
    return met.groupBy(F.col("l_chrom").alias("chrom"), F.col("l_start").alias("start"), F.col("l_stop").alias("stop"), F.col("r_barcode").alias("barcode")).agg(F.sum(F.col("r_count") if weighted else F.lit(1)).cast("double").alias("val"))


def tile_matrix(fragments: DataFrame, width: int, whitelist: DataFrame | None = None, weighted: bool = False) -> SparseMatrix:
    """A matrix of tiles and barcodes; a whitelist ``(pos, barcode)`` fixes the columns and their order, empty ones too."""
    if whitelist is not None:
        fragments = fragments.join(whitelist.select("barcode"), "barcode", "left_semi")
        cells = whitelist.select(F.col("pos").alias("col_id"), F.col("barcode").alias("col_name"))
    else:
        names = fragments.select("barcode").distinct()
        cells = names.join(dense_ids(names, "barcode"), "barcode").select(F.col("pos").alias("col_id"), F.col("barcode").alias("col_name"))
    counts = tile_counts(fragments, width, weighted)
    keyed = counts.select(F.struct("chrom", "tile").alias("key")).distinct()
    rows = keyed.join(dense_ids(keyed, "key"), "key").select("key", F.col("pos").alias("row_id"))
    start = F.col("key.tile") * width
    features = rows.select("row_id", F.concat(F.lit("chr"), F.col("key.chrom"), F.lit(":"), start, F.lit("-"), start + width).alias("row_name"))
    e = counts.withColumn("key", F.struct("chrom", "tile")).join(rows, "key").join(cells.withColumnRenamed("col_name", "barcode"), "barcode").select("row_id", "col_id", "val")
    return SparseMatrix(e, features, cells, {"producer": "fragments"})


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))
