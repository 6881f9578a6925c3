"""Sampling and splitting of columns: uniform, by group, by sketch, in folds, and over space.

Draws are ranks of a seeded hash of the id, so they depend neither on order nor
on partitions. Large axes are drawn by the hash itself; ranks are only taken
within groups or over counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import MatrixError, SparseMatrix
from .select import keep_columns, keep_rows


def draw(key: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def uniform(axis: DataFrame, key: str, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """``(key)``: ``n`` ids, or a rounded fraction of at least one, none more than there are."""
    if n is None:
        n = max(1, round(fraction * axis.count()))
    return axis.select(key).orderBy(draw(key, seed), key).limit(n)


def both(m: SparseMatrix, cells: int, rows: int, seed: int = 42) -> SparseMatrix:
    """The matrix of so many columns and rows, drawn on their own, with their ids."""
    return keep_rows(keep_columns(m, uniform(m.cells, "col_id", cells, seed=seed)), uniform(m.features, "row_id", rows, seed=seed + 1))


def by_group(groups: DataFrame, key: str = "col_id", n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """``(key, grp)``: up to ``n`` ids of each group, or a rounded fraction of at least one; short groups are taken whole."""
    w = Window.partitionBy("grp")
    ranked = groups.withColumn("_r", F.row_number().over(w.orderBy(draw(key, seed), key)))
    quota = F.lit(n) if n is not None else F.greatest(F.lit(1), F.round(F.count("*").over(w) * fraction))
    return ranked.withColumn("_q", quota).filter("_r <= _q").select(key, "grp")


def even_shares(sizes: dict[int, int], n: int) -> dict[int, int]:
    """``n`` dealt evenly over bins, none above its size; what is left over goes one each to bins by their code."""
    left, share, open_ = n, {}, sorted(sizes.items(), key=lambda x: (x[1], x[0]))
    while open_:
        level = left // len(open_)
        if open_[0][1] > level:
            for i, (b, _) in enumerate(open_):
                share[b] = level + (i < left - level * len(open_))
            break
        b, size = open_.pop(0)
        share[b] = size
        left -= size
    return share


def sketch(codes: DataFrame, n: int, key: str = "col_id", seed: int = 42) -> DataFrame:
    """``(key, code)``: ``n`` ids spread evenly over ``codes(key, code)``; there are at most as many codes as the bits allow."""
    sizes = {r["code"]: r["n"] for r in codes.groupBy("code").agg(F.count("*").alias("n")).collect()}
    shares = codes.sparkSession.createDataFrame(list(even_shares(sizes, min(n, sum(sizes.values()))).items()) or [(0, 0)], "code long, share int")
    ranked = codes.withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(draw(key, seed), key)))
    return ranked.join(F.broadcast(shares), "code").filter("_r <= share").select(key, "code")


def folds(groups: DataFrame, k: int | None = None, test_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """``(grp, fold, test)``: whole groups dealt to ``k`` folds, or to a test part of at least one group and not all."""
    names = groups.select("grp").distinct()
    count = names.count()
    if count < 2:
        raise MatrixError("a split needs two groups")
    rank = F.row_number().over(Window.orderBy(draw("grp", seed), "grp")) - 1
    ranked = names.withColumn("_r", rank)
    if k is not None:
        return ranked.select("grp", (F.col("_r") % k).cast("int").alias("fold"), F.lit(None).cast("boolean").alias("test"))
    n = min(max(round(test_fraction * count), 1), count - 1)
    return ranked.select("grp", F.lit(0).alias("fold"), (F.col("_r") < n).alias("test"))


def tiles(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """``points(x, y, ...)`` with ``grp``, the tile of a grid over their bounding box; points that are not finite are left out."""
    finite = points
    for c in ("x", "y"):
        finite = finite.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))))
    box = finite.agg(*[f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c, n: F.least(F.greatest(F.floor((F.col(c) - F.col(f"_lo{c}")) / F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), F.col(f"_hi{c}") - F.col(f"_lo{c}")).otherwise(F.lit(1.0)) * n), F.lit(0)), F.lit(n - 1))
    out = finite.crossJoin(F.broadcast(box)).withColumn("grp", (cell("x", nx) * ny + cell("y", ny)).cast("long"))
    return out.select(*points.columns, "grp")


def check_split(whole: DataFrame, parts: list[DataFrame], key: str = "col_id") -> None:
    """Parts must be disjoint and cover the whole."""
    every = parts[0].select(key)
    for p in parts[1:]:
        every = every.union(p.select(key))
    n, d, total = every.count(), every.distinct().count(), whole.select(key).distinct().count()
    if n != d or d != total:
        raise MatrixError(f"{n} ids of which {d} differ, for {total}")
