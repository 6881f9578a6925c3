"""The driver's tables as matrices, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders_matrix(spark: SparkSession, d: str, lines: str | None = None) -> SparseMatrix:
    """Parts by customers, summed quantities; ``lines`` filters line items while the axes stay whole."""
    li = table(spark, d, "lineitem")
    li = li.filter(lines) if lines else li
    e = li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("row_id"), F.col("o_custkey").alias("col_id")).agg(F.sum("l_quantity").alias("val"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.concat_ws("_", "p_partkey", "p_brand", "p_name").alias("row_name"), "p_brand", "p_name", F.col("p_type").alias("feature_type"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return SparseMatrix(e, p, c.select(F.col("c_custkey").alias("col_id"), F.col("c_name").alias("col_name"), F.col("r_name").alias("batch"), F.col("c_mktsegment").alias("grp")), {"producer": "orders", "content": "quantity"})


def order_sums(spark: SparkSession, d: str, groups: DataFrame) -> DataFrame:
    """``(row_id, grp, val)``: the sums of the order matrix over ``groups(col_id, grp)``, straight from the lines.

    Orders learn their group first, so lines move twice: to their order, and as sums to their part and group.
    """
    of = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("col_id")).join(groups, "col_id").select("o_orderkey", "grp")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return li.join(of, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("row_id"), "grp").agg(F.sum("l_quantity").alias("val"))


def supply_matrix(spark: SparkSession, d: str) -> SparseMatrix:
    """Parts with an id not divisible by 3 by suppliers."""
    e = table(spark, d, "lineitem").filter("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("row_id"), F.col("l_suppkey").alias("col_id")).agg(F.sum("l_quantity").alias("val"))
    p = table(spark, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("row_id"), F.concat_ws("_", "p_partkey", "p_brand", "p_name").alias("row_name"), F.col("p_type").alias("feature_type"))
    return SparseMatrix(e, p, table(spark, d, "supplier").select(F.col("s_suppkey").alias("col_id"), F.col("s_name").alias("col_name")), {"producer": "supply", "content": "quantity"})


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("batch"), F.col("embedding").alias("vec"))


def event_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals ``[second, second + ceil(value) + 1)`` of their user."""
    s = F.unix_timestamp("ts")
    return table(spark, d, "events").select(F.lit("1").alias("chrom"), s.alias("start"), (s + F.ceil("value") + 1).alias("stop"), F.col("user_id").cast("string").alias("barcode"), F.lit(1).alias("count"), "event_id")


FEATURES = "features AS (SELECT p_partkey AS row_id, p_partkey || '_' || p_brand || '_' || p_name AS row_name, p_brand, p_name, p_type AS feature_type FROM part)"
CELLS = "cells AS (SELECT c_custkey AS col_id, c_name AS col_name, r_name AS batch, c_mktsegment AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def entries_sql(where: str = "true", name: str = "entries") -> str:
    return f"{name} AS (SELECT l_partkey AS row_id, o_custkey AS col_id, sum(l_quantity) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {where} GROUP BY 1, 2)"


def orders_sql(where: str = "true") -> str:
    return f"WITH {entries_sql(where)}, {FEATURES}, {CELLS}"
