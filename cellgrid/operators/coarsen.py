"""Feature groups: sketched residual profiles, nested levels of k-means, growth onto new features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import MatrixError
from ..plans.storage import stored

#: Groups above which profiles are sketched, and places of a sketch.
PROFILE_GROUPS, SKETCH = 1024, 64
#: Most numbers of group centres that go to the tasks.
CENTRE_NUMBERS = 1 << 24


def signs(key: Column, dims: int, seed: int) -> Column:
    """``dims`` signs from the hex digits of hashes of seed and key, the same in any engine with MD5."""
    digits = F.concat(*[F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), key.cast("string"))) for i in range(-(-dims // 32))])
    return F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: F.when(F.substring(digits, k, F.lit(1)) >= "8", F.lit(1.0)).otherwise(F.lit(-1.0)))


def unit(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def sketched_profiles(sums: DataFrame, sizes: DataFrame, dims: int = SKETCH, seed: int = 42) -> DataFrame:
    """``(row_id, vec)``: residuals of ``sums(row_id, grp, val)`` against ``sizes(grp, size)`` times random signs, unit length.

    Residuals ``(n - mean) / sqrt(mean)`` are clipped at the root of the number of groups. A place without counts
    has ``-sqrt(mean)``, an outer product that is summed once; only counts, and empty places beyond the clip, become
    rows. Of the latter a row has at most twice its total over the number of groups, found by the power of two of a
    group's share. Rows without counts have no profile.
    """
    one = sizes.agg(F.sum("size").alias("_all"), F.count("*").cast("double").alias("_n"))
    groups = stored(sizes.crossJoin(F.broadcast(one)).filter("size > 0").select("grp", (F.col("size") / F.col("_all")).alias("share"), "_n", signs(F.col("grp"), dims, seed).alias("sign")), "groups")
    totals = sums.groupBy("row_id").agg(F.sum("val").alias("tot")).filter("tot > 0")
    low = lambda x: F.floor(F.log2(x)).cast("int")
    top = groups.agg(F.max("share").alias("_top"), F.max("_n").alias("_n"))
    heavy = totals.crossJoin(F.broadcast(top)).filter(F.col("tot") * F.col("_top") > F.col("_n"))
    bins = heavy.select("row_id", "tot", F.explode(F.sequence(low(F.col("_n") / F.col("tot")), low("_top"))).alias("bin"))
    clipped = bins.join(groups.select("grp", "share", "_n", low("share").alias("bin")), "bin").filter(F.col("tot") * F.col("share") > F.col("_n"))
    places = sums.select("row_id", "grp", "val").unionByName(clipped.select("row_id", "grp", F.lit(0.0).alias("val"))).groupBy("row_id", "grp").agg(F.sum("val").alias("val"))
    mean, lim = F.col("tot") * F.col("share"), F.sqrt("_n")
    r = F.least(F.greatest((F.col("val") - mean) / F.sqrt(mean), -lim), lim)
    part = places.join(totals, "row_id").join(groups, "grp").select("row_id", "tot", (r + F.sqrt(mean)).alias("s"), "sign")
    sums_k = part.groupBy("row_id").agg(F.first("tot").alias("tot"), *[F.sum(F.col("s") * F.get("sign", F.lit(k))).alias(f"_{k}") for k in range(dims)])
    zero = groups.agg(F.array(*[F.sum(F.sqrt("share") * F.get("sign", F.lit(k))) for k in range(dims)]).alias("zero"))
    vec = F.array(*[(F.col(f"_{k}") - F.sqrt("tot") * F.get("zero", F.lit(k))) / float(np.sqrt(dims)) for k in range(dims)])
    return sums_k.crossJoin(F.broadcast(zero)).select("row_id", vec.alias("vec")).select("row_id", unit(F.col("vec")).alias("vec"))


def _fit(data: DataFrame, k: int, seed: int):
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, maxIter=20).fit(data)


def _points(profiles: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return profiles.select("row_id", array_to_vector("vec").alias("features"))


def numbered(labels: DataFrame, features: DataFrame) -> DataFrame:
    """``(row_id, coarse)`` of all ``features``: labels numbered by their first row, all others in the last group, the background."""
    first = labels.groupBy("label").agg(F.min("row_id").alias("first"))  # a row a group
    ids = first.withColumn("coarse", (F.row_number().over(Window.orderBy("first")) - 1).cast("long"))
    of = labels.join(F.broadcast(ids), "label").select("row_id", "coarse")
    last = ids.agg(F.count("*").alias("_last"))
    return features.select("row_id").join(of, "row_id", "left").crossJoin(F.broadcast(last)).select("row_id", F.coalesce("coarse", "_last").alias("coarse"))


def coarsened_levels(features: DataFrame, profiles: DataFrame, targets: list[int], seed: int = 42) -> DataFrame:
    """``(row_id, level, coarse)``: nested groups of all ``features``, at most ``targets`` of each level, coarse to fine.

    ``profiles(row_id, vec)`` are those of the informative features; all others are the background, the last group of
    each level, which counts as one. The finest level is a k-means of the profiles, the
    others one of its centres, so each group of a level is a union of groups of the next. A target of 1 with a background is
    the background alone.
    """
    from pyspark.ml.linalg import Vectors

    if not targets or list(targets) != sorted(targets):
        raise MatrixError("levels run from coarse to fine")
    spark = features.sparkSession
    data = stored(_points(profiles.join(features.select("row_id"), "row_id", "left_semi")), "profiles")
    n = data.count()
    behind = n < features.count()
    slots = [max(t, 1) - int(behind) for t in targets]
    fine = min(slots[-1], n)
    out = None
    if fine > 0:
        model = _fit(data, fine, seed)
        label = stored(model.transform(data).select("row_id", F.col("prediction").cast("int").alias("fine")), "labels")
        centres = np.array(model.clusterCenters())
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        rows = spark.createDataFrame([(i, Vectors.dense(c)) for i, c in enumerate(centres)], ["fine", "features"])
    for level, k in enumerate(slots):
        if fine == 0 or k == 0:
            part = features.select("row_id", F.lit(0).cast("long").alias("coarse"))
        elif level + 1 == len(slots) or k >= len(centres):
            part = numbered(label.select("row_id", F.col("fine").alias("label")), features)
        else:
            up = _fit(rows, k, seed + 1 + level).transform(rows).select(F.col("fine").cast("int").alias("fine"), F.col("prediction").alias("label"))
            part = numbered(label.join(F.broadcast(up), "fine").select("row_id", "label"), features)
        part = part.select("row_id", F.lit(level).alias("level"), "coarse")
        out = part if out is None else out.unionByName(part)
    return out


def partitioned(features: DataFrame, profiles: DataFrame, n_groups: int, min_size: int = 1, seed: int = 42) -> DataFrame:
    """``(row_id, coarse)``: one level whose groups have ``min_size`` features; smaller ones are background.

    The slots they held go to splits of the largest groups in two, kept only where both halves are large enough.
    """
    data = stored(_points(profiles.join(features.select("row_id"), "row_id", "left_semi")), "profiles")
    n = data.count()
    behind = n < features.count()
    k = min(max(n_groups, 1) - int(behind), n)
    if k <= 0:
        return features.select("row_id", F.lit(0).cast("long").alias("coarse"))
    label = stored(_fit(data, k, seed).transform(data).select("row_id", "features", F.col("prediction").cast("int").alias("label")), "labels")
    if min_size > 1:
        sizes = {r["label"]: r["count"] for r in label.groupBy("label").count().collect()}  # k rows
        open_ = {g: c for g, c in sizes.items() if c >= min_size}
        behind = behind or len(open_) < len(sizes)
        label = label.filter(F.col("label").isin(list(open_)))
        free, next_id, kept = n_groups - len(open_) - int(behind), k, set(open_)
        while free > 0 and open_:
            g = max(open_, key=lambda x: (open_[x], x))
            if open_.pop(g) < 2 * min_size:
                break
            own = label.filter(F.col("label") == g)
            halves = _fit(own, 2, seed + g).transform(own).select("row_id", "prediction")
            n_half = {r["prediction"]: r["count"] for r in halves.groupBy("prediction").count().collect()}
            if len(n_half) < 2 or min(n_half.values()) < min_size:
                continue
            moved = halves.filter("prediction = 1").select("row_id", F.lit(next_id).alias("to"))
            label = stored(label.join(moved, "row_id", "left").select("row_id", "features", F.coalesce("to", "label").alias("label")), "labels")
            open_[g], open_[next_id] = n_half[0], n_half[1]
            kept.add(next_id)
            free, next_id = free - 1, next_id + 1
    return numbered(label.select("row_id", "label"), features)


def grown_groups(known: DataFrame, profiles: DataFrame, dims: int) -> DataFrame:
    """``(row_id, coarse)`` of all ``profiles(row_id, vec)``: known rows keep their group, others join the one they resemble most.

    ``known(row_id, coarse)``; likeness is the cosine with the sum of a group's unit profiles, ties go to the higher group. A zero profile joins
    the group of most known rows; a group without known rows gets none. Group centres go to the tasks, refused above ``CENTRE_NUMBERS``.
    """
    both = profiles.join(known.select("row_id", "coarse"), "row_id", "left")
    sums = both.filter("coarse IS NOT NULL").groupBy("coarse").agg(F.count("*").alias("n"), *[F.sum(F.get("vec", F.lit(k))).alias(f"_{k}") for k in range(dims)])
    if sums.count() * dims > CENTRE_NUMBERS:
        raise MatrixError("too many groups to grow")
    table = sums.orderBy("coarse").toPandas()  # a row a group, counted above
    if table.empty:
        raise MatrixError("no row of the new axis is known")
    ids, centres = table["coarse"].to_numpy(), table[[f"_{k}" for k in range(dims)]].to_numpy()
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.divide(centres, norm, out=np.zeros_like(centres), where=norm > 0)
    most = int(ids[len(ids) - 1 - table["n"].to_numpy()[::-1].argmax()])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            score = np.vstack(part["vec"]) @ centres.T if len(part) else np.zeros((0, len(ids)))
            best = ids[len(ids) - 1 - score[:, ::-1].argmax(axis=1)]
            yield pd.DataFrame({"row_id": part["row_id"], "coarse": np.where((score == 0).all(axis=1), most, best)})

    new = both.filter("coarse IS NULL").select("row_id", "vec").mapInPandas(run, "row_id long, coarse long")
    return both.filter("coarse IS NOT NULL").select("row_id", F.col("coarse").cast("long").alias("coarse")).unionByName(new)
