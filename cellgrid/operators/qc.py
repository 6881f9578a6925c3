"""Quality control of cells and features: metrics, robust bands, verdicts, cutoffs and depth scales."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..plans.storage import stored
from .select import keep_columns, keep_rows
from .stats import middles

MAD_SCALE = 1.4826


@dataclass(frozen=True)
class QcRules:
    """Settings of the verdicts; a cap of None is off."""

    n_mads: float = 5.0
    min_nnz: int = 2
    min_counts: float = 0.0
    mito_cap: float | None = None
    ribo_cap: float | None = None
    min_genes: int | None = None
    feature_min_cells: int = 0
    mads_on: tuple[str, ...] = ("n_genes", "total_counts")


def metrics(m: SparseMatrix, mito: Column | None = None, ribo: Column | None = None) -> DataFrame:
    """``(col_id, n_genes, total_counts, mito_frac, ribo_frac)`` from one scan; ``mito``, ``ribo``: conditions on features."""
    none = F.lit(False)
    marked = m.features.select("row_id", (mito if mito is not None else none).alias("is_mito"), (ribo if ribo is not None else none).alias("is_ribo"))
    sums = m.entries.join(marked, "row_id").groupBy("col_id").agg(
        F.sum((F.col("val") > 0).cast("long")).alias("n_genes"),
        F.sum("val").alias("total_counts"),
        F.sum(F.when(F.col("is_mito"), F.col("val"))).alias("mito"),
        F.sum(F.when(F.col("is_ribo"), F.col("val"))).alias("ribo"),
    )
    share = lambda c: F.when(F.col("total_counts") > 0, F.coalesce(c, F.lit(0.0)) / F.col("total_counts")).otherwise(F.lit(0.0))
    out = m.cells.select("col_id").join(sums, "col_id", "left").fillna(0, ["n_genes", "total_counts"])
    return out.select("col_id", "n_genes", "total_counts", share("mito").alias("mito_frac"), share("ribo").alias("ribo_frac"))


def cells_per_feature(m: SparseMatrix) -> DataFrame:
    """``(row_id, n_cells)``."""
    seen = m.entries.filter("val > 0").groupBy("row_id").agg(F.count("*").alias("n_cells"))
    return m.features.select("row_id").join(seen, "row_id", "left").fillna(0, ["n_cells"])


def stacked_metrics(parts: list[DataFrame]) -> DataFrame:
    """Metrics of one set of cells summed over modalities; the fractions are off."""
    every = parts[0].select("col_id", "n_genes", "total_counts")
    for p in parts[1:]:
        every = every.unionByName(p.select("col_id", "n_genes", "total_counts"))
    sums = every.groupBy("col_id").agg(F.sum("n_genes").alias("n_genes"), F.sum("total_counts").alias("total_counts"))
    return sums.withColumns({"mito_frac": F.lit(0.0), "ribo_frac": F.lit(0.0)})


def upper_median(values: DataFrame, column: str) -> float | None:
    """The element ``n div 2`` of the sorted values; None without values."""
    two = middles(values, {column: F.col(column)})[column]
    return two[1] if two else None


def bands(values: DataFrame, columns: list[str], n_mads: float = 5.0, log1p: bool = True) -> dict[str, tuple[float, float] | None]:
    """``median +- n_mads * MAD * 1.4826`` of each column on the transformed scale; None where the MAD is not positive or nothing is finite.

    Medians are the elements ``n div 2``. All columns are read together.
    """
    t = {c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if log1p else F.col(c).cast("double") for c in columns}
    # What is not a number or infinite before the transformation counts for nothing.
    t = {c: F.when(F.abs(F.nanvl(F.col(c).cast("double"), F.lit(float("inf")))) < F.lit(float("inf")), x) for c, x in t.items()}
    mid = {c: m[1] for c, m in middles(values, t).items() if m}
    mad = {c: m[1] for c, m in middles(values, {c: F.abs(t[c] - x) for c, x in mid.items()}).items()} if mid else {}
    return {c: (mid[c] - n_mads * MAD_SCALE * mad[c], mid[c] + n_mads * MAD_SCALE * mad[c]) if mad.get(c, 0) > 0 else None for c in columns}


def band_edges(values: DataFrame, column: str, n_mads: float = 5.0, log1p: bool = True) -> tuple[float, float] | None:
    """The band of one column."""
    return bands(values, [column], n_mads, log1p)[column]


def band(values: DataFrame, column: str, n_mads: float = 5.0, log1p: bool = True) -> DataFrame:
    """One row ``(lo, hi)`` of the band; nulls where there is none."""
    return values.sparkSession.createDataFrame([band_edges(stored(values.select(column), "values"), column, n_mads, log1p) or (None, None)], "lo double, hi double")


def within(value: Column, lo: Column, hi: Column, tail: str = "both", log1p: bool = True) -> Column:
    """Whether a value lies in its band; no band keeps all, what is not finite is dropped."""
    t = F.log1p(F.greatest(value.cast("double"), F.lit(0.0))) if log1p else value.cast("double")
    ok = {"lower": t >= lo, "upper": t <= hi, "both": (t >= lo) & (t <= hi)}[tail]
    return F.when(lo.isNull(), F.lit(True)).when(F.isnan(t) | (F.abs(t) == F.lit(float("inf"))), F.lit(False)).otherwise(ok)


def verdicts(cells: DataFrame, rules: QcRules = QcRules(), exempt: Column | None = None) -> DataFrame:
    """``cells`` (metrics) with ``near_empty``, ``outlier``, ``train_keep`` and ``emitted``.

    Near-empty cells shape no band and are no outliers; exempt cells get no
    verdict. If every cell would go, all stay.
    """
    free = exempt if exempt is not None else F.lit(False)
    cells = stored(cells, "metrics")  # bands, verdicts and the guard all read them
    c = cells.withColumns({"exempt": free, "near_empty": ~free & (F.col("n_genes") < rules.min_nnz)})
    bad = F.col("total_counts") < rules.min_counts
    if rules.mito_cap is not None:
        bad = bad | (F.col("mito_frac") > rules.mito_cap)
    if rules.ribo_cap is not None:
        bad = bad | (F.col("ribo_frac") > rules.ribo_cap)
    if rules.min_genes is not None:
        bad = bad | (F.col("n_genes") < rules.min_genes)
    for x, edges in bands(c.filter(~F.col("near_empty") & ~F.col("exempt")), list(rules.mads_on), rules.n_mads).items():
        if edges:
            bad = bad | ~within(F.col(x), F.lit(edges[0]), F.lit(edges[1]))
    out = ~F.col("exempt") & ~F.col("near_empty") & bad
    if c.filter(~out).isEmpty():
        out = F.lit(False)
    c = c.withColumns({"outlier": out, "train_keep": ~out, "emitted": ~out & ~F.col("near_empty")})
    return c.select(*cells.columns, "near_empty", "outlier", "train_keep", "emitted")


def feature_verdicts(features: DataFrame, min_cells: int) -> DataFrame:
    """``features`` with ``keep``: enough cells, unless that would drop all."""
    k = features.withColumn("_k", F.col("n_cells") >= min_cells)
    some = k.agg(F.coalesce(F.max("_k"), F.lit(False)).alias("_some"))
    return k.crossJoin(F.broadcast(some)).withColumn("keep", F.col("_k") | ~F.col("_some")).drop("_k", "_some")


def summary(judged: DataFrame) -> DataFrame:
    """``(key, value)`` counts of a QC run."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = judged.agg(F.count("*").alias("cells"), n(F.col("near_empty")).alias("near_empty"), n(F.col("outlier")).alias("outliers"), n(F.col("emitted")).alias("emitted"))
    return one.unpivot([], ["cells", "near_empty", "outliers", "emitted"], "key", "value")


def rule_overlap(cells: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(failed, n_rules, n)``: cells by the set of rules that they fail, and how many there are of each set."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return cells.select(names.alias("_f")).groupBy(F.array_join("_f", "+").alias("failed"), F.size("_f").alias("n_rules")).agg(F.count("*").alias("n"))


def rule_effects(cells: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, removes, only_it_removes)``."""
    failed = sum((c.cast("int") for c in rules.values()), F.lit(0))
    sums = [F.sum(c.cast("long")).alias(f"r_{k}") for k, c in rules.items()] + [F.sum((c & (failed == 1)).cast("long")).alias(f"o_{k}") for k, c in rules.items()]
    one = cells.agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r_{k}").alias("removes"), F.col(f"o_{k}").alias("only_it_removes")) for k in rules])
    return one.select(F.inline(rows))


def squeeze(m: SparseMatrix, min_row: int = 1, min_col: int = 1) -> SparseMatrix:
    """Rows and columns with enough non-zeros, both counted on the matrix as given; an axis that would vanish stays whole."""
    if min_row <= 0 and min_col <= 0:
        return m
    rows = m.entries.groupBy("row_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_row)
    cols = m.entries.groupBy("col_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_col)
    out = m
    if min_row > 0 and not rows.isEmpty():
        out = keep_rows(out, rows)
    if min_col > 0 and not cols.isEmpty():
        out = keep_columns(out, cols)
    return out


#: Trough search: bin width and smoothing on ln(1 + v), distance of the peaks, least side, accepted depth.
BIN, SIGMA, DECADE, LEAST_SIDE, DEPTH = 0.05, 3.0, np.log(10.0), 20, 0.25


def trough(counts: list[tuple[int, int]]) -> int | None:
    """The cutoff between two modes of ``(value, cells)``, or None.

    Works on the histogram of distinct values alone.
    """
    counts = [(v, n) for v, n in counts if v >= 0 and n > 0]
    if not counts:
        return None
    total = sum(n for _, n in counts)
    top = int(np.ceil(np.log1p(max(v for v, _ in counts) + 0.5) / BIN)) + 1
    density = np.zeros(top + 1)
    for v, n in counts:  # spread over [v - 1/2, v + 1/2)
        a, b = np.log1p(max(v - 0.5, 0.0)) / BIN, np.log1p(v + 0.5) / BIN
        edges = np.arange(int(a), int(np.ceil(b)) + 1)
        inside = np.clip(np.minimum(edges[1:], b) - np.maximum(edges[:-1], a), 0, None)
        density[edges[:-1]] += n * inside / inside.sum()
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(density, kernel / kernel.sum(), mode="same")
    centre = (np.arange(len(smooth)) + 0.5) * BIN
    left = np.maximum.accumulate(smooth)
    right = np.maximum.accumulate(smooth[::-1])[::-1]
    left_at = np.array([int(np.argmax(smooth[: i + 1])) for i in range(len(smooth))])
    right_at = np.array([i + int(np.argmax(smooth[i:])) for i in range(len(smooth))])
    below = np.cumsum(density)
    side = max(LEAST_SIDE, total / 1000)
    depth = np.full(len(smooth), np.inf)
    for i in range(len(smooth)):
        if centre[right_at[i]] - centre[left_at[i]] >= DECADE and below[i] >= side and total - below[i] >= side and min(left[i], right[i]) > 0:
            depth[i] = smooth[i] / min(left[i], right[i])
    best = depth.min()
    if not np.isfinite(best) or best > DEPTH:
        return None
    run = np.flatnonzero(depth == best)
    end = run[0]
    while end + 1 in run:
        end += 1
    return int(np.ceil(np.expm1(centre[(run[0] + end) // 2])))


def auto_cutoff(cells: DataFrame, column: str = "n_genes") -> int | None:
    """The trough of a metric."""
    return auto_cutoffs(cells.select(F.lit(0).alias("backend"), column), column).get(0)


def auto_cutoffs(cells: DataFrame, column: str = "n_genes") -> dict:
    """The trough of a metric for each ``backend``, from one grouped histogram: counts by value, by bins above 1,000."""
    v = F.col(column).cast("double")
    coarse = F.when(v < 1000, F.floor(v)).otherwise(F.floor(F.expm1(F.floor(F.log1p(v) / (BIN / 4)) * (BIN / 4))))
    counts: dict = {}
    for r in cells.groupBy("backend", coarse.alias("v")).agg(F.count("*").alias("n")).collect():  # some 3,000 rows a backend
        counts.setdefault(r["backend"], []).append((int(r["v"]), r["n"]))
    return {b: trough(c) for b, c in counts.items()}


def empty_barcode_gate(cells: DataFrame, seen_in: DataFrame | None = None) -> DataFrame:
    """``(col_id, keep)`` from ``cells(backend, col_id, n_genes)`` with a cutoff for each backend: a cell passes if one backend lets it.

    ``seen_in(backend)``: only cutoffs of these backends.
    """
    cuts = auto_cutoffs(cells if seen_in is None else cells.join(seen_in.select("backend").distinct(), "backend", "left_semi"))
    table = cells.sparkSession.createDataFrame([(b, c) for b, c in cuts.items() if c is not None], f"backend {dict(cells.dtypes)['backend']}, cut long")
    passed = cells.join(F.broadcast(table), "backend", "left").withColumn("_p", F.col("cut").isNull() | (F.col("n_genes") >= F.col("cut")))
    gate = passed.groupBy("col_id").agg(F.max("_p").alias("keep"))
    some = gate.agg(F.coalesce(F.max("keep"), F.lit(False)).alias("_some"))
    return gate.crossJoin(F.broadcast(some)).select("col_id", (F.col("keep") | ~F.col("_some")).alias("keep"))


def depth_scales(m: SparseMatrix, ignored: DataFrame | None = None) -> DataFrame:
    """``(col_id, depth, scale)``: depth over the rows not ignored, divided by the median of the positive depths; 1 where there is none."""
    e = m.entries if ignored is None else m.entries.join(ignored.select("row_id"), "row_id", "left_anti")
    depth = m.cells.select("col_id").join(e.groupBy("col_id").agg(F.sum("val").alias("depth")), "col_id", "left").fillna(0.0, ["depth"])
    depth = stored(depth, "depths")
    two = middles(depth.filter("depth > 0"), {"depth": F.col("depth")})["depth"]
    mid = F.lit(sum(two) / 2 if two else None).cast("double")
    return depth.select("col_id", "depth", F.when(F.col("depth") > 0, F.col("depth") / mid).otherwise(F.lit(1.0)).alias("scale"))


def broad_rows(m: SparseMatrix, groups: DataFrame, share: float) -> DataFrame:
    """``(row_id)`` of rows positive in more than ``share`` of the columns of every group."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    n = sizes.agg(F.count("*").alias("groups"))
    hits = m.entries.filter("val > 0").join(groups, "col_id").groupBy("grp", "row_id").agg(F.count("*").alias("k"))
    over = hits.join(sizes, "grp").filter(F.col("k") > F.lit(share) * F.col("size")).groupBy("row_id").agg(F.count("*").alias("c"))
    return over.crossJoin(F.broadcast(n)).filter("c = groups").select("row_id")
