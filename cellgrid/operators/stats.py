"""Statistics of rows and columns: ``nnz, tot, mu, sig`` over whole axes, zeros included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..plans.storage import stored

def _sums() -> list[Column]:
    return [F.sum((F.col("val") > 0).cast("long")).alias("nnz"), F.sum("val").alias("tot"), F.sum(F.col("val") * F.col("val")).alias("sumsq")]


def _finish(sums: DataFrame, size: Column) -> DataFrame:
    """Mean and population deviation over ``size`` places of which most are zero."""
    tot, sumsq = F.coalesce("tot", F.lit(0.0)), F.coalesce("sumsq", F.lit(0.0))
    mu = tot / size
    return sums.withColumns({"nnz": F.coalesce("nnz", F.lit(0)), "mu": mu, "sig": F.sqrt(F.greatest(sumsq / size - mu * mu, F.lit(0.0))), "tot": tot}).drop("sumsq")


def column_stats(m: SparseMatrix, rows: DataFrame | None = None) -> DataFrame:
    """``(col_id, nnz, tot, mu, sig)`` of each column, over all rows or those of ``rows(row_id)``."""
    of = m.features.select("row_id") if rows is None else rows.select("row_id").distinct()
    e = m.entries if rows is None else m.entries.join(of, "row_id", "left_semi")
    size = of.agg(F.count("*").alias("axis"))
    sums = m.cells.select("col_id").join(e.groupBy("col_id").agg(*_sums()), "col_id", "left").crossJoin(F.broadcast(size))
    return _finish(sums, F.col("axis")).select("col_id", "nnz", "tot", "mu", "sig")


def row_stats(m: SparseMatrix) -> DataFrame:
    """``(row_id, nnz, tot, mu, sig)`` of each row over all columns."""
    size = m.cells.agg(F.count("*").alias("axis"))
    sums = m.features.select("row_id").join(m.entries.groupBy("row_id").agg(*_sums()), "row_id", "left").crossJoin(F.broadcast(size))
    return _finish(sums, F.col("axis")).select("row_id", "nnz", "tot", "mu", "sig")


def fixed_order_sums(values: DataFrame, key: str, order: str, value: str = "val", block: int = 4096) -> DataFrame:
    """``(key, tot)``: sums whose additions have one order, so every run and partitioning gives the same last bit.

    Values of a key are dealt to blocks by the whole number ``order``, each
    added up in that order; the blocks' sums are dealt again until one is
    left. Nulls count as zero. No task gathers more than twice a block's
    values of a key, as long as a place is taken once.
    """
    cur = values.select(key, F.col(order).cast("long").alias("_o"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    far = cur.agg(F.max(F.abs("_o"))).first()[0] or 0
    while True:
        add = F.aggregate(F.sort_array(F.collect_list(F.struct("_o", "_v"))), F.lit(0.0), lambda s, x: s + x["_v"])
        cur = cur.groupBy(key, F.expr(f"_o div {block}").alias("_o")).agg(add.alias("_v"))
        far //= block
        if far == 0:
            return cur.select(key, F.col("_v").alias("tot"))


def both_stats(m: SparseMatrix) -> DataFrame:
    """``(axis, id, nnz, tot)`` of rows and columns with entries from one scan."""
    e = m.entries.groupingSets([[F.col("row_id")], [F.col("col_id")]], "row_id", "col_id").agg(F.grouping("row_id").alias("g"), *_sums())
    return e.select(F.when(F.col("g") == 0, "row").otherwise("column").alias("axis"), F.coalesce("row_id", "col_id").alias("id"), "nnz", "tot")


def row_stats_by_group(m: SparseMatrix, groups: DataFrame) -> DataFrame:
    """``(grp, row_id, nnz, tot, mu, sig)`` within each group of ``groups(col_id, grp)``; columns without one form ``''``.

    Every group meets every row, so empty pairs appear with zeros.
    """
    of = m.cells.select("col_id").join(groups.select("col_id", "grp"), "col_id", "left").select("col_id", F.coalesce("grp", F.lit("")).alias("grp"))
    sizes = of.groupBy("grp").agg(F.count("*").alias("axis"))
    sums = m.entries.join(of, "col_id").groupBy("grp", "row_id").agg(*_sums())
    frame = sizes.crossJoin(m.features.select("row_id"))
    return _finish(frame.join(sums, ["grp", "row_id"], "left"), F.col("axis")).select("grp", "row_id", "nnz", "tot", "mu", "sig")


def axis_range(values: DataFrame, column: str) -> DataFrame:
    """One row ``(lo, hi, shift)`` of a logarithmic histogram axis over the finite values."""
    v = F.col(column)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    seen = values.filter(finite).agg(F.greatest(F.min(v), F.lit(0.0)).alias("lo"), F.max(v).alias("hi"), F.min(F.when(v > 0, v)).alias("pos"))
    lo = F.coalesce("lo", F.lit(0.0))
    hi = F.when(F.col("hi").isNull(), F.lit(1.0)).when(F.col("hi") <= F.col("lo"), F.col("lo") + F.greatest("lo", F.lit(1.0))).otherwise(F.col("hi"))
    wide = seen.select(lo.alias("lo"), hi.alias("hi"), "pos")
    shift = F.when(F.col("hi") >= 20, 1.0).otherwise(F.least(F.greatest(F.coalesce("pos", F.lit(0.0)) / 2, F.col("hi") * 1e-4), F.lit(1.0)))
    return wide.select("lo", "hi", shift.alias("shift"))


def histogram(values: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """``(bin, n, least, most)`` of the non-empty bins of a logarithmic axis."""
    t = lambda x: F.log(F.greatest(x, F.lit(0.0)) + F.col("shift"))
    v = F.col(column)
    placed = values.filter(v.isNotNull() & ~F.isnan(v)).crossJoin(F.broadcast(axis_range(values, column)))
    share = (t(v) - t(F.col("lo"))) / (t(F.col("hi")) - t(F.col("lo")))
    k = F.least(F.greatest(F.floor(share * bins + F.lit(1e-9)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return placed.withColumn("bin", k).groupBy("bin").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def upto(counts: DataFrame, key: str) -> DataFrame:
    """``counts(key, n)`` with ``upto``, the sum of ``n`` up to each key, added up over ranges of keys."""
    ranged = stored(counts.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "counts")
    parts = ranged.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.sum("n").over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").select(key, "n", (F.col("_own") + F.col("_before")).alias("upto"))


def quantiles(values: DataFrame, column: str, points: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """``(p, value)`` by nearest rank on the sorted finite values, without gathering them: counts of equal values are summed up."""
    v = F.col(column)
    counts = values.filter(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    held = upto(counts, "value")
    total = counts.agg(F.sum("n").alias("total"))
    asked = values.sparkSession.createDataFrame([(p,) for p in points], "p double").crossJoin(F.broadcast(total)).withColumn("rank", F.round((F.col("total") - 1) * F.col("p")))
    return F.broadcast(asked).join(held, F.col("upto") > F.col("rank")).groupBy("p").agg(F.min("value").alias("value"))


def top(stats: DataFrame, by: str = "tot", n: int = 20, key: str = "row_id") -> DataFrame:
    """The ``n`` rows with the largest ``by``, those that are no numbers last."""
    return stats.orderBy(F.nanvl(F.col(by), F.lit(None).cast("double")).desc_nulls_last(), key).limit(n)


#: Values that are collected, as distinct ones with their counts, to find a rank among them.
EXACT_VALUES = 50_000


def middles(values: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float] | None]:
    """The elements ``(n - 1) div 2`` and ``n div 2`` of the sorted finite values of each column; None without values.

    Exact, in a few scans for all columns together: approximate ranks bracket the middle, then
    rows below and inside the bracket are counted, and a bracket with few values is read. ``values`` is read
    several times and should be a stored table.
    """
    if not columns:
        return {}
    finite = {k: F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v) for k, v in ((k, v.cast("double")) for k, v in columns.items())}
    one = values.agg(*[x for k, v in finite.items() for x in (F.count(v).alias(f"n_{k}"), F.min(v).alias(f"lo_{k}"), F.max(v).alias(f"hi_{k}"), F.percentile_approx(v, [0.498, 0.502], 10_000).alias(f"p_{k}"))]).first()
    out: dict[str, tuple[float, float] | None] = {k: None for k in columns if not one[f"n_{k}"]}
    held = {k: ((one[f"lo_{k}"], one[f"hi_{k}"]) if one[f"n_{k}"] <= EXACT_VALUES else tuple(one[f"p_{k}"])) for k in columns if k not in out}
    below = {k: 0 for k in held}
    wanted = {k: ((one[f"n_{k}"] - 1) // 2, one[f"n_{k}"] // 2) for k in held}
    sized = {k: one[f"n_{k}"] for k in held if one[f"n_{k}"] <= EXACT_VALUES}
    while open_ := {k: b for k, b in held.items() if k not in sized and k not in out}:
        # A quarter of the bracket on either side of the rank, should it still hold too many.
        inside = {k: F.when(finite[k].between(*b), finite[k]) for k, b in open_.items()}
        got = values.agg(*[x for k, (lo, _) in open_.items() for x in (F.count_if(finite[k] < lo).alias(f"b_{k}"), F.count(inside[k]).alias(f"n_{k}"), F.percentile_approx(inside[k], [i / 64 for i in range(65)], 10_000).alias(f"p_{k}"))]).first()
        for k, (lo, hi) in open_.items():
            b, n, cuts = got[f"b_{k}"], got[f"n_{k}"], got[f"p_{k}"]
            if not b <= wanted[k][0] <= wanted[k][1] < b + n:  # the approximation missed: from the whole range again
                held[k] = (one[f"lo_{k}"], one[f"hi_{k}"])
                continue
            below[k] = b
            if lo == hi:
                out[k] = (lo, hi)
            elif n <= EXACT_VALUES:
                sized[k] = n
            else:
                at = (wanted[k][0] - b) * 64 // n
                near = cuts[max(at - 1, 0)], cuts[min(at + 2, 64)]
                if near == (lo, hi):  # few distinct values, each of many rows
                    sized[k] = n
                held[k] = near
    if some := {k: held[k] for k in sized}:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(finite[k].between(*b), finite[k]).alias("v")) for k, b in some.items()]))
        counts = values.select(each.alias("x")).select("x.*").filter("v is not null").groupBy("k", "v").agg(F.count("*").alias("n")).orderBy("k", "v").collect()
        for k in some:
            upto, found = below[k], []
            for r in (r for r in counts if r.k == k):
                found += [r.v for rank in wanted[k] if upto <= rank < upto + r.n]
                upto += r.n
            out[k] = found[0], found[-1]
    return out
