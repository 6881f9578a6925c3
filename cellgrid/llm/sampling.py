"""Bounded training samples of labelled documents, and thresholds from all the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled documents of each class at most, and the length of one; the bounds of what is fitted on.
PER_CLASS, MAX_CHARS = 2500, 8000
#: Bins of a score where a threshold may lie.
BINS = 2000


def calibrates(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels set thresholds and are not fitted on."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(5)) == 0


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label)`` of the documents that may be learnt from; of several labels the largest counts, null ones never."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[pa.Array, list[int], list[int]]:
    """``(texts, labels, ids)``: the first by hash of the labelled rows of each class, none held out or kept for thresholds.

    Null labels and rows without ``doc_id`` are passed over; of rows with one
    ``doc_id`` the smallest text counts. Only about twice the sample's ids, below
    a hash drawn from the classes' counts, come to the driver.
    """
    spark = docs.sparkSession
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length(F.coalesce("text", F.lit(""))) <= max_chars)
    known = known_labels(labels, label)
    both = known.filter(~calibrates(F.col("doc_id"))).join(here.select("doc_id"), "doc_id", "left_semi")
    rank, below = F.xxhash64("doc_id", F.lit("fit")), F.lit(False)
    for k, n in both.groupBy("label").count().collect():
        share = min(1.0, 2 * per_class / n)
        below = below | ((F.col("label") == k) & (rank <= int((share - 0.5) * float((1 << 64) - 4096))))
    drawn = sorted(both.filter(below).select("label", rank.alias("rank"), "doc_id").collect())
    ids = [(r[2], r[0]) for k in (0, 1) for r in [d for d in drawn if d[0] == k][:per_class]]
    if not ids:
        return pa.array([], pa.string()), [], []
    # At most 2 * per_class ids.
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))
    rows = sorted((r[0], r[1], r[2] or "") for r in here.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text")).collect())
    return pa.array([r[2] for r in rows], pa.string()), [r[1] for r in rows], [r[0] for r in rows]


def calibration(docs: DataFrame, labels: DataFrame, label: str, score: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each group, counts of the labels 0 and 1 by bin of the score, from every labelled row kept for thresholds.

    ``score``: uncalibrated scores and groups of a text column. Texts of any
    length count; they are scored where they are read, and only scores are
    joined with the labels.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, group = score(part.column("text"))
            place = np.clip((raw * BINS).astype(np.int32), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(place, pa.int32()), pa.array(group, pa.int32())], ["doc_id", "bin", "part"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & calibrates(F.col("doc_id")) & ~held_out(F.col("doc_id")))
    scores = some.mapInArrow(run, "doc_id long, bin int, part int")
    out: dict[int, np.ndarray] = {}
    # At most a row for each group, bin and label.
    for r in scores.join(known_labels(labels, label), "doc_id").groupBy("part", "bin", "label").count().collect():
        out.setdefault(r[0], np.zeros((2, BINS)))[r[2], r[1]] = r[3]
    return out


def threshold(counts: np.ndarray, default: float, few: int = 10) -> float:
    """The cut of the best balanced accuracy, near the upper end of its gap since the other class is the larger; 0.3 to 0.9.

    ``default`` where a class has fewer than ``few`` rows.
    """
    neg, pos = counts
    if min(pos.sum(), neg.sum()) < few:
        return default
    right = np.append(0, np.cumsum(neg)) / neg.sum() - np.append(0, np.cumsum(pos)) / pos.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    high = best[-1]
    low = high - np.argmin(np.append(np.diff(best)[::-1] == 1, False))
    return float(np.clip((low + 0.8 * (high - low)) / BINS, 0.3, 0.9))
