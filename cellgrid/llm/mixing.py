"""Mixing sources to target weights: whole passes of a source, then documents that fill the rest by their lengths.

What a source may give is its target of words. It is taken as whole passes over
the source and a rest. The rest is a bounded subset-sum problem over the
counts of documents by exact length: first an equal share of every length, so
that a mix resembles its source, then the longest lengths that fit, and the last
``REACH`` words at most by dynamic programming over sums. Only counts by length reach
that step (a source with ``d`` different lengths has at least ``d * (d - 1) / 2``
words, so they are few); which documents of a length are taken is drawn by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, looked_up, stored, table

WEIGHTS, PASSES, SEED = (1, 2, 3), 3, 42
#: Words that the dynamic program may have to fill.
REACH = 1 << 16
#: A draw counts by parts of this many bits of a hash; the part it ends in is looked at again.
BUCKET_BITS = 12


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 without a text."""
    parts = F.array(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+", -1))
    empty = lambda x: F.when(x == "", 1).otherwise(0)  # noqa: E731  before the first word, after the last
    return F.get(F.transform(parts, lambda x: F.size(x) - empty(F.get(x, F.lit(0))) - F.when(F.size(x) > 1, empty(F.element_at(x, -1))).otherwise(0)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: shares of all words by weight, none above ``passes`` times its source.

    Sources weigh as ``weights`` says, repeated, in order of code points, null
    last. What a full source leaves goes to the others by weight until none is
    above, that is, each gets ``min(passes * size, level * weight)`` for one level. Sources
    fill up in order of size by weight, so the level follows from running sums. One narrow row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    full = F.col("source_size") * F.lit(passes)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))
    level = w.withColumn("_level", rest / F.sum("weight").over(after)).withColumn("_open", F.col("_level") * F.col("weight") < full)
    level = level.withColumn("_level", F.min(F.when(F.col("_open"), F.struct(F.col("source_size") / F.col("weight"), "_level"))).over(everything)["_level"])
    return level.select("source", "source_size", F.when(F.col("_level").isNull(), full.cast("double")).otherwise(F.least(full.cast("double"), F.col("_level") * F.col("weight"))).alias("target"))


def subset(length: np.ndarray, count: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many of each length (ascending, positive) to take so that their sum comes as near to ``budget`` as found.

    What fits below the budget is compared with a choice that goes over it by one document, the rest filled anew.
    """
    best = filled(length, count, budget, reach)
    rest = budget - int((length * best).sum())
    over = np.flatnonzero((best < count) & (length > rest))
    if rest > 0 and len(over):
        one = np.zeros(len(length), np.int64)
        one[over[0]] = 1
        other = one + filled(length, count - one, budget - int(length[over[0]]), reach)
        if abs(budget - int((length * other).sum())) < rest:
            return other
    return best


def filled(length: np.ndarray, count: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """A choice of at most ``budget``: an equal share of each length, then the longest that fit, then the last ``reach`` exactly."""
    take = np.zeros(len(length), np.int64)
    total = int((length * count).sum())
    if budget <= 0 or not len(length):
        return take
    if budget >= total:
        return count.copy()
    # Counts and budget may be large, so in whole numbers without bound.
    take += np.array([int(c) * budget // total for c in count.tolist()], np.int64)
    rest = budget - int((length * take).sum())
    for i in np.argsort(-length, kind="stable"):
        if rest <= reach:
            break
        more = min(int(count[i] - take[i]), (rest - reach + int(length[i]) - 1) // int(length[i]), rest // int(length[i]))
        take[i] += more
        rest -= more * int(length[i])
    return take + bounded_knapsack(length, count - take, rest) if rest <= reach else take


def bounded_knapsack(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """The largest sum up to ``budget``; each sum remembers the last bundle that first reached it."""
    take = np.zeros(len(length), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int64)
    bundles: list[tuple[int, int]] = []
    for i in np.flatnonzero((length <= budget) & (count > 0)):
        left, part = min(int(count[i]), budget // int(length[i])), 1
        while left:
            part = min(part, left)
            size = part * int(length[i])
            new = ~reached[size:] & reached[: budget + 1 - size]
            by[size:][new] = len(bundles)
            reached[size:] |= new
            bundles.append((int(i), part))
            left, part = left - part, part * 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, part = bundles[by[at]]
        take[i] += part
        at -= part * int(length[i])
    return take


def quotas(counts: DataFrame, passes: int = PASSES, reach: int = REACH) -> DataFrame:
    """``(source, size, whole, extra)``: whole passes and documents taken once more, of ``counts(source, size, n, source_size, target)``; a task a source gets a row a length."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        size, n = part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        own, aim = int(part["source_size"].iloc[0]), int(np.floor(part["target"].iloc[0] + 0.5))
        whole = min(aim // own, passes)
        extra = subset(size, n, aim - whole * own, reach) if whole < passes else np.zeros(len(size), np.int64)
        return pd.DataFrame({"source": part["source"], "size": size, "whole": whole, "extra": extra})

    return counts.filter("size > 0").groupBy("source").applyInPandas(run, "source string, size long, whole long, extra long")


def _needed(rows: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """``rows(need)`` with the ``n`` of their own group of ``order`` and with ``need`` as what their ``key`` still needs of that group."""
    groups = rows.groupBy(key, *order).agg(F.count("*").alias("n"), F.first("need").alias("need"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = groups.withColumn("need", F.greatest(F.lit(0), F.least("n", F.col("need") - before)))
    named = lambda df: df.withColumn(at, F.concat_ws("\n", *order, key))
    return looked_up(named(rows.drop("need")), at, "p", named(still).select(at, "n", "need"))


def drawn(rows: DataFrame) -> DataFrame:
    """``rows(key, h, p, need)`` with ``more``: 1 for the ``need`` of each key with the smallest ``(h, p)``, else 0.

    Counts by parts of ``h`` say in which part the draw ends; the rows of that part
    alone are looked at again by ``h`` and parts of ``p``, and only those of the last such
    part are ranked. So a key that a third of the rows have is never ranked in one task.
    """
    first = stored(_needed(rows.withColumn("b", F.shiftright("h", 64 - BUCKET_BITS)), "key", ["b"], "in_key"), "drawn")
    open_ = (F.col("need") > 0) & (F.col("need") < F.col("n"))
    taken = F.when(F.col("need") > 0, 1).otherwise(0).alias("more")
    second = stored(_needed(first.filter(open_).withColumn("c", F.shiftright("p", 64 - BUCKET_BITS)).drop("n"), "in_key", ["h", "c"], "in_part"), "drawn")
    rank = F.row_number().over(Window.partitionBy("in_part").orderBy("p"))
    last = second.filter(open_).select("*", F.when(rank <= F.col("need"), 1).otherwise(0).alias("more"))
    keep = [*rows.drop("need").columns, "more"]
    return first.filter(~open_).select("*", taken).select(keep).unionByName(second.filter(~open_).select("*", taken).select(keep)).unionByName(last.select(keep))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES, seed: int = SEED, reach: int = REACH) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: for each row the words that the mix takes of it, repeats counted.

    ``docs(doc_id, text, source, ...)``; other columns are ignored. Null and empty texts have size 0
    and give nothing; null is a source of its own, the last. Documents without
    ``doc_id`` are drawn by their text, repeated rows apart from each other; of equal rows it does not
    matter which is taken. Documents are taken whole, so a source misses its target by what no
    choice found of them fills: nothing where there are short ones enough, up to half a document where one is longer than what is left. Without rows the result is empty.
    """
    kind = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")))
    narrow = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("source"), words(F.col("text")).alias("size"), h.alias("h")), "sizes")
    narrow = narrow.withColumn("p", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    counts = narrow.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    key = F.concat_ws("\n", "size", "source")
    aims = stored(targets(sizes, weights, passes), "targets")
    plan = stored(quotas(counts.join(aims, "source"), passes, reach), "quotas").join(aims, "source")
    wanted = aims.select(F.lit(0).cast("long").alias("size"), "source", F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("extra"), "source_size", "target").unionByName(plan)
    rows = looked_up(narrow.withColumn("key", key), "key", "p", wanted.select(key.alias("key"), "whole", F.col("extra").alias("need"), "source_size", "target"))
    return drawn(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix with weights 1, 2, 3, repeated, takes of every document."""
    return mixed(table(spark, sf_dir, "documents"))
