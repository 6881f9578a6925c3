"""Simulated counts: topics, trajectories, bulk mixtures, modalities, and a report of how alike two matrices are.

Every cell draws from a generator seeded by ``(seed, cell)``, so the counts
depend on neither order nor partitions. Dictionaries of features by topics are
bounded by their stated sizes and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from .select import dense_ids
from .stats import column_stats, row_stats


def topic_dictionary(n_rows: int, topics: int, seed: int, spread: float = 1.0) -> np.ndarray:
    """Log-normal topics x features that sum up to one."""
    beta = np.exp(np.random.default_rng(seed).normal(0, spread, (topics, n_rows)))
    return beta / beta.sum(axis=1, keepdims=True)


def batch_effects(n_rows: int, batches: int, seed: int, size: float = 0.3) -> np.ndarray:
    """Log-normal batches x features."""
    return np.exp(np.random.default_rng(seed + 1).normal(0, size, (batches, n_rows)))


def _matrix(spark: SparkSession, n_rows: int, n_cells: int, rates, batches: int, meta: dict[str, str]) -> SparseMatrix:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for j in part["col_id"]:
                y = rates(int(j))
                on = np.flatnonzero(y)
                rows.append(pd.DataFrame({"row_id": on, "col_id": np.full(len(on), j), "val": y[on].astype(float)}))
            yield pd.concat(rows) if rows else pd.DataFrame({"row_id": [], "col_id": [], "val": []})

    entries = spark.range(n_cells).select(F.col("id").alias("col_id")).mapInPandas(run, "row_id long, col_id long, val double")
    features = spark.range(n_rows).select(F.col("id").alias("row_id"), F.concat(F.lit("g"), F.col("id")).alias("row_name"))
    cells = spark.range(n_cells).select(F.col("id").alias("col_id"), F.concat(F.lit("c"), F.col("id")).alias("col_name"), F.concat(F.lit("b"), F.col("id") % batches).alias("batch"))
    return SparseMatrix(entries, features, cells, meta)


def topics(spark: SparkSession, n_rows: int, n_cells: int, k: int = 5, batches: int = 1, depth: float = 1000.0, seed: int = 42, concentration: float = 0.3) -> SparseMatrix:
    """Poisson counts of ``depth * batch effect * (topic shares x dictionary)``."""
    beta, delta = topic_dictionary(n_rows, k, seed), batch_effects(n_rows, batches, seed)

    def rates(j: int) -> np.ndarray:
        rng = np.random.default_rng((seed, j))
        return rng.poisson(depth * rng.dirichlet(np.full(k, concentration)) @ beta * (delta[j % batches] if batches > 1 else 1))

    return _matrix(spark, n_rows, n_cells, rates, batches, {"producer": "topics"})


def trajectory(spark: SparkSession, n_rows: int, n_cells: int, branches: int = 2, waves: int = 4, depth: float = 1000.0, seed: int = 42) -> SparseMatrix:
    """Counts along a trunk and its branches: log rates are sums of sine waves over pseudotime, branches leave the trunk at its end."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1, (branches + 1, waves, n_rows)) / np.arange(1, waves + 1)[None, :, None]
    wave = lambda t: np.sqrt(2) * np.sin((np.arange(waves) + 0.5) * np.pi * t)

    def rates(j: int) -> np.ndarray:
        rng = np.random.default_rng((seed, j))
        branch, t = int(rng.integers(0, branches + 1)), rng.random()
        log = wave(t) @ weights[0] if branch == 0 else wave(1.0) @ weights[0] + wave(t) @ weights[branch]
        p = np.exp(log - log.max())
        return rng.poisson(depth * p / p.sum())

    return _matrix(spark, n_rows, n_cells, rates, 1, {"producer": "trajectory"})


def bulk(m: SparseMatrix, samples: int, concentration: float = 1.0, seed: int = 42) -> DataFrame:
    """``(row_id, sample, val)``: weighted sums of cells, with Gamma weights from seeded hashes that sum up to one in each sample."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "col_id", "sample"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    w = m.cells.select("col_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).withColumn("w", F.pow(-F.log(u), F.lit(1.0 / concentration)))
    total = w.groupBy("sample").agg(F.sum("w").alias("total"))
    share = w.join(F.broadcast(total), "sample").select("col_id", "sample", (F.col("w") / F.col("total")).alias("w"))
    return m.entries.join(share, "col_id").groupBy("row_id", "sample").agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def multimodal(spark: SparkSession, sizes: list[int], n_cells: int, k: int = 5, depth: float = 1000.0, changed: float = 0.1, seed: int = 42) -> list[SparseMatrix]:
    """Modalities over the same cells: one topic mixture, a shared dictionary with sparse changes for each modality."""
    base = topic_dictionary(max(sizes), k, seed)
    out = []
    for i, n in enumerate(sizes):
        rng = np.random.default_rng((seed, 100 + i))
        beta = base[:, :n] * np.exp(rng.normal(0, 1, (k, n)) * (rng.random((k, n)) < changed) * (i > 0))
        beta = beta / beta.sum(axis=1, keepdims=True)

        def rates(j: int, beta: np.ndarray = beta, i: int = i) -> np.ndarray:
            theta = np.random.default_rng((seed, j)).dirichlet(np.full(k, 0.3))
            return np.random.default_rng((seed, j, i)).poisson(depth * theta @ beta)

        out.append(_matrix(spark, n, n_cells, rates, 1, {"producer": f"modality-{i}"}))
    return out


def linked(spark: SparkSession, peaks: int, genes: int, n_cells: int, per_gene: int = 3, k: int = 5, depth: float = 1000.0, seed: int = 42) -> tuple[SparseMatrix, SparseMatrix, DataFrame]:
    """Peak counts from topics, gene counts from the peaks linked to them, and ``(peak, gene, weight)``."""
    beta = topic_dictionary(peaks, k, seed)
    rng = np.random.default_rng((seed, 7))
    links = [(int(p), g, float(w)) for g in range(genes) for p, w in zip(rng.choice(peaks, min(per_gene, peaks), replace=False), rng.gamma(2, 1, per_gene), strict=False)]
    weight = np.zeros((peaks, genes))
    for p, g, w in links:
        weight[p, g] = w
    gene = beta @ weight
    gene = gene / np.maximum(gene.sum(axis=1, keepdims=True), 1e-300)
    share = lambda j: np.random.default_rng((seed, j)).dirichlet(np.full(k, 0.3))
    atac = _matrix(spark, peaks, n_cells, lambda j: np.random.default_rng((seed, j, 1)).poisson(depth * share(j) @ beta), 1, {"producer": "peaks"})
    rna = _matrix(spark, genes, n_cells, lambda j: np.random.default_rng((seed, j, 2)).poisson(depth * share(j) @ gene), 1, {"producer": "genes"})
    return atac, rna, spark.createDataFrame(links, "peak long, gene long, weight double")


def from_reference(m: SparseMatrix, n_cells: int, seed: int = 42) -> SparseMatrix:
    """Cells like those of ``m``: a reference cell drawn by hash gives the depth and shares of a Poisson draw, smoothed by the means."""
    spark = m.entries.sparkSession
    n = m.cells.count()
    ids = dense_ids(m.cells, "col_id").select("col_id", F.col("pos").alias("_i"))
    drawn = spark.range(n_cells).select(F.col("id").alias("to"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("_i")).join(ids, "_i").select("to", "col_id")
    picked = m.entries.join(drawn, "col_id").select("row_id", F.col("to").alias("col_id"), "val")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            y = [np.random.default_rng((seed, int(r), int(c))).poisson(v) for r, c, v in zip(part["row_id"], part["col_id"], part["val"], strict=True)]
            part = part.assign(val=np.array(y, float))
            yield part[part["val"] > 0]

    entries = picked.mapInPandas(run, "row_id long, col_id long, val double")
    cells = spark.range(n_cells).select(F.col("id").alias("col_id"), F.concat(F.lit("s"), F.col("id")).alias("col_name"))
    return SparseMatrix(entries, m.features, cells, {"producer": "reference"})


def fidelity(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """``(measure, a, b, gap)``: depth, detection, and correlation of the features' means, variances and shares of zeros."""
    depth = lambda m: column_stats(m).agg(F.avg("tot").alias("depth"), F.avg("nnz").alias("detected"))
    pair = depth(a).select(F.col("depth").alias("a1"), F.col("detected").alias("a2")).crossJoin(depth(b).select(F.col("depth").alias("b1"), F.col("detected").alias("b2")))
    rows = row_stats(a).select("row_id", F.col("mu").alias("m1"), F.col("sig").alias("s1"), "nnz").join(row_stats(b).select("row_id", F.col("mu").alias("m2"), F.col("sig").alias("s2"), F.col("nnz").alias("n2")), "row_id")
    alike = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # noqa: E731  null where one is constant
    r = rows.agg(alike("m1", "m2").alias("mean"), alike("s1", "s2").alias("deviation"), alike("nnz", "n2").alias("detection"))
    one = pair.crossJoin(r)
    line = lambda k, x, y: F.struct(F.lit(k).alias("measure"), x.cast("double").alias("a"), y.cast("double").alias("b"), F.abs(x - y).cast("double").alias("gap"))
    same = F.lit(1.0)
    return one.select(F.inline(F.array(line("depth", F.col("a1"), F.col("b1")), line("detected", F.col("a2"), F.col("b2")), line("mean correlation", same, F.col("mean")), line("deviation correlation", same, F.col("deviation")), line("detection correlation", same, F.col("detection")))))
