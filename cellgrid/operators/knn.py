"""Nearest neighbours across batches, and what is read or imputed over them.

Exact search is a block matrix product in numpy: the queries are a stated set
that goes in bounded blocks over all reference vectors, each task keeps its own
k best and the best of all tasks are merged. No pair of vectors becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import width

#: Query vectors in one pass.
BLOCK_QUERIES = 20_000


def nearest(queries: DataFrame, reference: DataFrame, k: int, skip_same_batch: bool = True) -> DataFrame:
    """``(source, batch, match, dist, rank)``: the ``k`` nearest of each batch for each query.

    ``queries(id, batch, vec)``, ``reference(id, batch, vec)``; a query is no
    match of itself. Ties go to the smaller id.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    out = None
    for b in range(blocks):
        some = queries.select("id", "batch", "vec").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        ids, batches = some["id"].to_numpy(), some["batch"].to_numpy()
        q = np.stack(some["vec"].to_numpy()).astype(np.float64) if len(some) else np.zeros((0, 1))

        def run(parts: Iterator[pd.DataFrame], ids=ids, batches=batches, q=q) -> Iterator[pd.DataFrame]:
            best: dict = {}  # of each batch the k best so far, arrays of queries by k
            for part in parts:
                for batch, own in part.sort_values("id", kind="stable").groupby("batch"):
                    asked = np.flatnonzero(batches != batch) if skip_same_batch else np.arange(len(q))
                    if batch not in best:
                        best[batch] = np.full((len(q), k), np.inf), np.full((len(q), k), own["id"].iloc[0], own["id"].to_numpy().dtype)
                    dist, match = best[batch]
                    r, r_ids = np.stack(own["vec"].to_numpy()).astype(np.float64), own["id"].to_numpy()
                    for i in range(0, len(asked), 512):
                        at = asked[i : i + 512]
                        for j in range(0, len(r), 4096):
                            found = _nearest_rows(q[at], ids[at], r[j : j + 4096], r_ids[j : j + 4096], k)
                            dist[at], match[at] = _smallest(np.hstack([dist[at], found[0]]), np.hstack([match[at], found[1]]), k)
            rows = [(ids, batch, match, dist) for batch, (dist, match) in best.items()]
            for of, batch, match, dist in rows:
                at, place = np.nonzero(np.isfinite(dist))
                yield pd.DataFrame({"source": of[at], "batch": batch, "match": match[at, place], "dist": dist[at, place]})

        kinds = {f.name: f.dataType.simpleString() for f in reference.schema}
        found = reference.select("id", "batch", "vec").mapInPandas(run, f"source {kinds['id']}, batch {kinds['batch']}, match {kinds['id']}, dist double")
        out = found if out is None else out.union(found)
    w = Window.partitionBy("source", "batch").orderBy("dist", "match")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest_rows(q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the ``k`` nearest rows of ``r`` (ids ascending) for each query; infinite where there are fewer."""
    size = (q**2).sum(1)[:, None] + (r**2).sum(1)[None, :]
    about = size - 2 * q @ r.T  # candidates only, since it cancels
    about[q_ids[:, None] == r_ids[None, :]] = np.inf
    wide = min(k, len(r))
    limit = np.partition(about, wide - 1, axis=1)[:, wide - 1] + 1e-11 * size.max(axis=1, initial=0)
    inside = (about <= limit[:, None]) & np.isfinite(about)
    dist, match = np.full((len(q), k), np.inf), np.full((len(q), k), r_ids[0], r_ids.dtype)
    for row in range(len(q)):
        c = np.flatnonzero(inside[row])
        exact = np.sqrt(((r[c] - q[row]) ** 2).sum(axis=1))
        order = np.argsort(exact, kind="stable")[:k]  # ids ascend, so ties go to the smaller one
        dist[row, : len(order)], match[row, : len(order)] = exact[order], r_ids[c[order]]
    return dist, match


def _smallest(dist: np.ndarray, match: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest distances of each row with their ids; ties go to the smaller id."""
    by_id = np.argsort(match, axis=1, kind="stable")
    dist, match = np.take_along_axis(dist, by_id, 1), np.take_along_axis(match, by_id, 1)
    near = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(dist, near, 1), np.take_along_axis(match, near, 1)


def nearest_to(vec: list[float], reference: DataFrame, k: int) -> DataFrame:
    """``(batch, match, dist, rank)``: the ``k`` nearest of each batch to one given vector; ties go to the smaller id.

    Every batch is sorted in parts first, so none is gathered in one task.
    """
    from ..functions.numeric import squared_distance

    at = F.array(*[F.lit(float(x)) for x in vec])
    near = reference.select("batch", F.col("id").alias("match"), F.sqrt(squared_distance(F.col("vec"), at)).alias("dist"))
    some = near.withColumn("_part", F.pmod(F.xxhash64("match"), F.lit(width(reference.sparkSession))))
    part = Window.partitionBy("batch", "_part").orderBy("dist", "match")
    kept = some.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_part", "_r")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy("dist", "match"))).filter(F.col("rank") <= k)


def matched_columns(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """``(source, match, dist, row_id, val)``: the values of each match."""
    return matches.join(entries.withColumnRenamed("col_id", "match"), "match").select("source", "match", "dist", "row_id", "val")


def impute(matches: DataFrame, entries: DataFrame, tau: float) -> DataFrame:
    """``(source, row_id, val)``: values of the matches under weights ``exp(-d^2 / (2 tau^2))`` that sum up to one."""
    t = max(tau, 1e-6)
    low = matches.withColumn("_m", F.min("dist").over(Window.partitionBy("source")))
    raw = low.withColumn("_w", F.exp(-(F.col("dist") * F.col("dist") - F.col("_m") * F.col("_m")) / (2 * t * t)))
    w = raw.withColumn("w", F.col("_w") / F.sum("_w").over(Window.partitionBy("source"))).select("source", "match", "w")
    return w.join(entries.withColumnRenamed("col_id", "match"), "match").groupBy("source", "row_id").agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def softmax_weights(matches: DataFrame) -> DataFrame:
    """``matches`` with ``w``: ``exp(-d)`` that sum up to one for each source."""
    s = Window.partitionBy("source")
    raw = matches.withColumn("_e", F.exp(F.min("dist").over(s) - F.col("dist")))
    return raw.withColumn("w", F.col("_e") / F.sum("_e").over(s)).drop("_e")


def near_batches(vectors: DataFrame, k: int) -> DataFrame:
    """``(batch, near, dist, rank)``: for each batch the ``k`` with the nearest means."""
    from ..functions.numeric import squared_distance

    long = vectors.select("batch", F.posexplode("vec").alias("k", "v")).groupBy("batch", "k").agg(F.avg("v").alias("v"))
    mean = long.groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("vec"))
    other = mean.select(F.col("batch").alias("near"), F.col("vec").alias("to"))
    # A row a batch on either side.
    both = mean.join(other, F.col("batch") != F.col("near")).withColumn("dist", F.sqrt(squared_distance(F.col("vec"), F.col("to"))))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy("dist", "near"))).filter(F.col("rank") <= k).select("batch", "near", "dist", "rank")


def pair_values(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``(left, right, row_id, of_left, of_right)``: values of both ends of each edge, a zero where one has none."""
    a = edges.join(entries.withColumnsRenamed({"col_id": "left", "val": "of_left"}), "left")
    b = edges.join(entries.withColumnsRenamed({"col_id": "right", "val": "of_right"}), "right")
    keys = ["left", "right", "row_id"]
    return a.select(*keys, "of_left").join(b.select(*keys, "of_right"), keys, "full").fillna(0.0, ["of_left", "of_right"])


def collapsed_pairs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(a, b, n, coarse)`` of unordered label pairs, numbered as they first appear; loops stay, weights go.

    ``edges(pos, left, right)``, ``labels(id, label)``.
    """
    named = edges.join(labels.withColumnsRenamed({"id": "left", "label": "_l"}), "left").join(labels.withColumnsRenamed({"id": "right", "label": "_r"}), "right")
    pairs = named.groupBy(F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b")).agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    return pairs.select("a", "b", "n", (F.row_number().over(Window.orderBy("_first", "a", "b")) - 1).alias("coarse"))
