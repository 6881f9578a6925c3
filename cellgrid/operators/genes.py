"""Feature models: dispersion trend, highly variable features, Fisher weights, informative features, residuals and coarsening."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from .stats import row_stats

#: Least mean of features in the trend, and bounds of a dispersion.
MIN_MEAN, MAX_DISPERSION = 1e-4, 100.0


def dispersion(mu: Column, var: Column) -> Column:
    return (var - mu) / (mu * mu)


def dispersion_trend(stats: DataFrame) -> DataFrame:
    """One row ``(intercept, slope, n)`` of ln dispersion on ln mean, weighted by the mean.

    With fewer than two features nulls (no dispersion); with one mean the slope is 0.
    """
    mu, var = F.col("mu"), F.col("sig") * F.col("sig")
    phi = dispersion(mu, var)
    use = stats.filter((mu >= MIN_MEAN) & (phi > 0)).select(mu.alias("w"), F.log(mu).alias("x"), F.log(phi).alias("y"))
    s = use.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"))
    mean = s.select("n", (F.col("x") / F.col("w")).alias("mx"), (F.col("y") / F.col("w")).alias("my"))
    dev = use.crossJoin(F.broadcast(mean)).agg(F.first("n").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(F.col("w") * (F.col("x") - F.col("mx")) ** 2).alias("xx"), F.sum(F.col("w") * (F.col("x") - F.col("mx")) * (F.col("y") - F.col("my"))).alias("xy"))
    slope = F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).otherwise(F.lit(0.0))
    fits = F.col("n") >= 2
    return dev.select(F.when(fits, F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(fits, slope).alias("slope"), F.coalesce("n", F.lit(0)).alias("n"))


def fitted(mu: Column) -> Column:
    """Dispersion of the trend at a mean, from the columns ``intercept`` and ``slope``."""
    value = F.least(F.greatest(F.exp(F.col("intercept") + F.col("slope") * F.log(mu)), F.lit(0.0)), F.lit(MAX_DISPERSION))
    return F.when(F.col("intercept").isNull() | (mu <= 0), F.lit(0.0)).otherwise(value)


def variable_features(stats: DataFrame, n: int | None = None) -> DataFrame:
    """``(row_id, mu, excess)``: dispersion above the trend, the ``n`` largest where asked; ties go to the lower id."""
    mu, var = F.col("mu"), F.col("sig") * F.col("sig")
    out = stats.crossJoin(F.broadcast(dispersion_trend(stats).drop("n"))).select("row_id", "mu", F.when(mu > 0, dispersion(mu, var) - fitted(mu)).otherwise(F.lit(-math.inf)).alias("excess"))
    return out if n is None else out.orderBy(F.desc("excess"), "row_id").limit(n)


def selected_features(stats: DataFrame, n: int, must: DataFrame | None = None) -> DataFrame:
    """``(row_id)``: the most variable features with those that must be among them."""
    out = variable_features(stats, n).select("row_id")
    return out if must is None else out.union(must.select("row_id")).distinct()


def fisher_weights(stats: DataFrame, n_columns: int | None = None, sums: str = "tot") -> DataFrame:
    """``(row_id, weight)``: ``1 / (1 + share * mean depth * dispersion)``."""
    total = stats.agg(F.sum(sums).alias("_total"))
    trend = dispersion_trend(stats).drop("n")
    c = stats.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(trend))
    depth = F.col("_total") / F.lit(n_columns) if n_columns else F.col("_total") * F.col("mu") / F.col(sums)
    share = F.when(F.col("_total") > 0, F.col(sums) / F.col("_total")).otherwise(F.lit(0.0))
    scaled = F.when(F.col(sums) > 0, share * depth * fitted(F.col("mu"))).otherwise(F.lit(0.0))
    return c.select("row_id", (1 / (1 + scaled)).alias("weight"))


def contrast_features(loadings: DataFrame, sums: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
    """``(split, side, rank, row_id, loading, lfc, weight)``: the ``k`` strongest rows on either side of each split.

    ``loadings(split, row_id, loading)``; rows above zero stand on the right,
    those below on the left. ``sums(split, row_id, of_left, of_right)`` are the
    counts of both sides, ``lfc`` the logarithm of their shares' ratio, right
    over left, with half a count added. ``weights(split, row_id, weight)``: 1 where there is none. Ties
    go to the lower row on the right and to the higher one on the left.
    """
    total = sums.groupBy("split").agg(F.greatest(F.sum("of_left"), F.lit(1.0)).alias("_l"), F.greatest(F.sum("of_right"), F.lit(1.0)).alias("_r"))
    right = F.col("loading") > 0
    signed = F.when(right, F.col("row_id")).otherwise(-F.col("row_id"))
    order = Window.partitionBy("split", "side").orderBy(F.desc(F.abs("loading")), signed)
    sided = loadings.filter("loading <> 0 and not isnan(loading)").withColumn("side", F.when(right, "right").otherwise("left"))
    top = sided.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = top.join(sums, ["split", "row_id"], "left").fillna(0.0, ["of_left", "of_right"]).join(total, "split", "left")
    lfc = F.log((F.col("of_right") + 0.5) / F.coalesce("_r", F.lit(1.0))) - F.log((F.col("of_left") + 0.5) / F.coalesce("_l", F.lit(1.0)))
    out = out.withColumn("lfc", lfc)
    out = out.join(weights, ["split", "row_id"], "left").fillna(1.0, ["weight"]) if weights is not None else out.withColumn("weight", F.lit(1.0))
    return out.select("split", "side", "rank", "row_id", "loading", "lfc", "weight")


def informative_features(m: SparseMatrix, z: float = 5.0) -> DataFrame:
    """``(row_id, deviance, z, informative)``: Poisson deviance against the columns' depths; a zero place adds twice its expectation."""
    depth = m.entries.groupBy("col_id").agg(F.sum("val").alias("depth"))
    total = m.entries.agg(F.sum("val").alias("total"))
    rows = m.entries.groupBy("row_id").agg(F.sum("val").alias("tot"))
    e = m.entries.join(depth, "col_id").join(rows, "row_id").crossJoin(F.broadcast(total))
    mean = F.col("tot") * F.col("depth") / F.col("total")
    # Over all places the parts (val - mean) cancel out.
    dev = e.groupBy("row_id").agg(F.sum(2 * F.col("val") * F.log(F.col("val") / mean)).alias("deviance"))
    n = m.cells.agg(F.count("*").alias("n"))
    score = (F.col("deviance") - F.col("n")) / F.sqrt(2.0 * F.col("n"))
    out = m.features.select("row_id").join(dev, "row_id", "left").fillna(0.0, ["deviance"]).crossJoin(F.broadcast(n))
    return out.select("row_id", "deviance", score.alias("z"), (score > z).alias("informative"))


def residual_profiles(sums: DataFrame) -> DataFrame:
    """``(row_id, grp, r)``: Pearson residuals of ``sums(row_id, grp, val)`` clipped at the root of the number of groups, rows of unit length."""
    rows = sums.groupBy("row_id").agg(F.sum("val").alias("_r"))
    cols = sums.groupBy("grp").agg(F.sum("val").alias("_c"))
    one = sums.agg(F.sum("val").alias("_t"), F.countDistinct("grp").alias("_n"))
    frame = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(one)).join(sums, ["row_id", "grp"], "left").fillna(0.0, ["val"])
    mean = F.col("_r") * F.col("_c") / F.col("_t")
    raw = F.when(mean > 0, (F.col("val") - mean) / F.sqrt(mean)).otherwise(F.lit(0.0))
    lim = F.sqrt(F.col("_n").cast("double"))
    r = frame.select("row_id", "grp", F.least(F.greatest(raw, -lim), lim).alias("r"))
    norm = r.groupBy("row_id").agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("_l"))
    return r.join(norm, "row_id").select("row_id", "grp", F.when(F.col("_l") > 0, F.col("r") / F.col("_l")).otherwise(F.lit(0.0)).alias("r"))


def coarsened(profiles: DataFrame, k: int, min_size: int = 1, seed: int = 42) -> DataFrame:
    """``(row_id, coarse)`` by k-means of ``profiles(row_id, vec)``; groups that are too small join the last, the background."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = profiles.select("row_id", array_to_vector("vec").alias("features"))
    out = KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("row_id", F.col("prediction").alias("coarse"))
    sizes = out.groupBy("coarse").agg(F.count("*").alias("n"))  # k rows
    return out.join(F.broadcast(sizes), "coarse").select("row_id", F.when(F.col("n") >= min_size, F.col("coarse")).otherwise(F.lit(k)).cast("long").alias("coarse"))


def coarse_sums(m: SparseMatrix, mapping: DataFrame) -> DataFrame:
    """``(row_id, col_id, val)`` summed within coarse features; features without one go."""
    return m.entries.join(mapping, "row_id").groupBy(F.col("coarse").alias("row_id"), "col_id").agg(F.sum("val").alias("val"))


def expanded(coarse: DataFrame, mapping: DataFrame, log_split: bool = False) -> DataFrame:
    """``(row_id, val)`` of fine features from coarse values: copied, or less the log of the group's size."""
    sizes = mapping.groupBy("coarse").agg(F.count("*").alias("n"))
    out = mapping.join(sizes, "coarse").join(coarse.select(F.col("row_id").alias("coarse"), "val"), "coarse")
    return out.select("row_id", (F.col("val") - F.log(F.col("n").cast("double")) if log_split else F.col("val")).alias("val"))


def hierarchical(profiles: pd.DataFrame, gamma: float = 1.0, effective_size: float | None = None, cut: float = 0.0) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Bayesian merging of a few clusters (rows: clusters, columns: features): merges ``(a, b, log factor)`` and labels at ``cut``.

    The score of a merge is how much likelier the joined Dirichlet-multinomial
    is than both apart; the largest goes first, ties to the smallest ids.
    """
    t = profiles.to_numpy(dtype=float)
    if effective_size:
        t = t * (effective_size / np.maximum(t.sum(axis=1), 1e-300))[:, None]
    background = t.sum(axis=0) / max(t.sum(), 1e-300)
    on = background > 0
    t, alpha = t[:, on], gamma * background[on]
    lg = np.frompyfunc(math.lgamma, 1, 1)
    base = lg(alpha).astype(float).sum()
    score = lambda x: math.lgamma(gamma) - math.lgamma(gamma + x.sum()) + lg(alpha + x).astype(float).sum() - base
    live = {i: x for i, x in enumerate(t)}
    own = {i: score(x) for i, x in live.items()}
    label, merges, gone = {i: [i] for i in live}, [], len(t)
    factor = {(a, b): score(live[a] + live[b]) - own[a] - own[b] for a in live for b in live if a < b}
    parts = None
    while factor:
        (a, b), f = max(factor.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        if f < cut and parts is None:
            parts = [list(v) for v in label.values()]
        merges.append((a, b, f))
        x = live.pop(a) + live.pop(b)
        factor = {k: v for k, v in factor.items() if not {a, b} & set(k)}
        own[gone] = score(x)
        factor.update({(i, gone): score(live[i] + x) - own[i] - own[gone] for i in live})
        label[gone] = label.pop(a) + label.pop(b)
        live[gone] = x
        gone += 1
    out = np.zeros(len(t), int)
    for k, members in enumerate(sorted(parts if parts is not None else label.values(), key=min)):
        out[members] = k
    return merges, out


def stats_for(m: SparseMatrix) -> DataFrame:
    return row_stats(m)
