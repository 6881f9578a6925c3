"""Pseudobulk tree: nodes are bisected along the leading residual component until each level has its number of leaves.

All open leaves of a round are split in one plan. A leaf's residuals are never
laid out densely: a zero place has the residual ``-sqrt(depth) * sqrt(rate)``,
so the matrix is the entries' part less one outer product for each batch, and
its leading component comes from a few rounds of block power iteration that
join entries with a few numbers for each row and column. Only records of
splits and Gram matrices of ``how.vectors`` places a leaf come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import MatrixError, SparseMatrix
from ..plans.storage import stored, width


@dataclass(frozen=True)
class Growth:
    """``least``: columns below which a leaf stays, and a batch takes the node's pooled rates; half of it is the least side.

    ``floor``: count over a node's columns from which a row enters; ``rows``: the most variable rows that enter, all
    where it is None. A split is clear when its singular value exceeds the noise edge by ``margin``;
    ``stop`` leaves nodes whose split is not clear as leaves.
    """

    least: int = 8
    floor: float = 5.0
    rows: int | None = None
    margin: float = 0.1
    stop: bool = False
    vectors: int = 8
    rounds: int = 4
    explained_rows: int = 200
    seed: int = 42


@dataclass(frozen=True)
class Residuals:
    """Columns ``cells(leaf, col_id, bk, depth, rn)``, rates ``rates(leaf, bk, row_id, root)`` of the rows that enter,
    the entries' part ``parts(leaf, col_id, row_id, bk, val, s, q, at, deal)`` and rows ``rows(leaf, row_id, tot, square)``.
    """

    cells: DataFrame
    rates: DataFrame
    parts: DataFrame
    asked: DataFrame
    rows: DataFrame


@dataclass(frozen=True)
class Tree:
    """``labels(col_id, level, leaf)``, ``codes(col_id, code)`` with ``widths`` of bits from fine to coarse, ``splits`` and ``loadings(split, row_id, loading, of_left, of_right)``."""

    labels: DataFrame
    codes: DataFrame
    widths: list[int]
    splits: DataFrame
    loadings: DataFrame


def residuals(m: SparseMatrix, leaves: DataFrame, how: Growth) -> Residuals:
    """Pearson residuals of ``leaves(leaf, col_id, batch)`` against the rates of each leaf and batch; clipped at the root of the leaf's columns."""
    depth = m.entries.groupBy("col_id").agg(F.sum("val").alias("depth"))
    cells = leaves.join(depth, "col_id", "left").fillna(0.0, ["depth"])
    size = cells.groupBy("leaf", "batch").agg(F.count("*").alias("n"), F.sum("depth").alias("mass"))
    own = size.select("leaf", "batch", ((F.col("n") >= how.least) & (F.col("mass") > 0)).alias("own"))
    n = cells.groupBy("leaf").agg(F.count("*").alias("n_leaf"))
    keyed = cells.join(own, ["leaf", "batch"]).join(n, "leaf")
    cells = stored(keyed.select("leaf", "col_id", F.when(F.col("own"), F.concat(F.lit("="), F.col("batch"))).otherwise(F.lit("")).alias("bk"), "depth", F.sqrt("depth").alias("rn"), "n_leaf"), "tree-cells")
    e = m.entries.join(cells, "col_id")
    by_key = stored(e.groupBy("leaf", "bk", "row_id").agg(F.sum("val").alias("y")), "tree-sums")
    mass = cells.groupBy("leaf", "bk").agg(F.sum("depth").alias("mass"))
    whole = cells.groupBy("leaf").agg(F.sum("depth").alias("whole"))
    node = by_key.groupBy("leaf", "row_id").agg(F.sum("y").alias("tot")).filter(F.col("tot") >= how.floor)
    pooled = node.join(whole, "leaf").join(mass.filter("bk = ''"), "leaf").select("leaf", "bk", "row_id", F.sqrt(F.col("tot") / F.col("whole")).alias("root"))
    single = by_key.filter("bk <> ''").join(mass, ["leaf", "bk"]).join(node, ["leaf", "row_id"], "left_semi").select("leaf", "bk", "row_id", F.sqrt(F.col("y") / F.col("mass")).alias("root"))
    rates = stored(pooled.union(single), "tree-rates")
    mean = F.col("rn") * F.col("root")  # the root of an entry's mean
    clip = F.sqrt(F.col("n_leaf").cast("double"))
    r = F.least(F.greatest((F.col("val") - mean * mean) / mean, -clip), clip)
    part = e.join(rates, ["leaf", "bk", "row_id"]).select("leaf", "col_id", "row_id", "bk", "val", (r + mean).alias("s"), (r * r - mean * mean).alias("q"))
    deal = F.pmod(F.xxhash64("col_id"), F.lit(width(m.entries.sparkSession)))
    parts = stored(part.withColumn("deal", deal), "tree-parts")
    total = parts.groupBy("leaf", "row_id").agg(F.sum("q").alias("q"))
    zeros = rates.join(mass, ["leaf", "bk"]).groupBy("leaf", "row_id").agg(F.sum(F.col("root") ** 2 * F.col("mass")).alias("z"))
    rows = stored(node.join(zeros, ["leaf", "row_id"]).join(total, ["leaf", "row_id"], "left").select("leaf", "row_id", "tot", (F.coalesce("q", F.lit(0.0)) + F.col("z")).alias("square")), "tree-rows")
    if how.rows is not None:
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("square"), "row_id"))
        rows = stored(rows.withColumn("_r", rank).filter(F.col("_r") <= how.rows).drop("_r"), "tree-rows")
        rates = rates.join(rows, ["leaf", "row_id"], "left_semi")
        parts = parts.join(rows, ["leaf", "row_id"], "left_semi")
    return Residuals(cells, rates, parts, stored(parts.select("leaf", "row_id", "deal").distinct(), "tree-asked"), rows)


def _sums(p: int, by: Column, of: str) -> list[Column]:
    return [F.sum(by * F.col(f"{of}{k}")).alias(f"{of}{k}") for k in range(p)]


def along(x: Residuals, v: DataFrame, p: int) -> DataFrame:
    """``(leaf, col_id, bk, rn, v0, ...)``: residuals times the vectors of rows ``v(leaf, row_id, v0, ...)``.

    A row that every column holds is asked for by groups of columns, so no task gets all its entries.
    """
    met = x.parts.join(x.asked.join(v, ["leaf", "row_id"]), ["leaf", "row_id", "deal"])
    seen = met.groupBy("leaf", "col_id").agg(*_sums(p, F.col("s"), "v"))
    rest = x.rates.join(v, ["leaf", "row_id"]).groupBy("leaf", "bk").agg(*_sums(p, F.col("root"), "v")).withColumnsRenamed({f"v{k}": f"t{k}" for k in range(p)})
    out = x.cells.join(seen, ["leaf", "col_id"], "left").join(rest, ["leaf", "bk"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("leaf", "col_id", "bk", "rn", *[(zero(F.col(f"v{k}")) - F.col("rn") * zero(F.col(f"t{k}"))).alias(f"v{k}") for k in range(p)])


def across(x: Residuals, u: DataFrame, p: int) -> DataFrame:
    """``(leaf, row_id, v0, ...)``: transposed residuals times the vectors of columns."""
    seen = x.parts.join(u.drop("bk", "rn"), ["leaf", "col_id"]).groupBy("leaf", "row_id").agg(*_sums(p, F.col("s"), "v"))
    rest = u.groupBy("leaf", "bk").agg(*_sums(p, F.col("rn"), "v"))
    less = x.rates.join(rest, ["leaf", "bk"]).groupBy("leaf", "row_id").agg(*_sums(p, -F.col("root"), "v"))
    return seen.unionByName(less).groupBy("leaf", "row_id").agg(*_sums(p, F.lit(1.0), "v"))


def gram(v: DataFrame, p: int) -> dict[int, np.ndarray]:
    """The p x p Gram matrix of each leaf."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    out = {}
    for r in v.groupBy("leaf").agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"g{i}_{j}") for i, j in pairs]).collect():
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        out[r["leaf"]] = g
    return out


def turned(v: DataFrame, by: dict[int, np.ndarray], p: int) -> DataFrame:
    """Each leaf's vectors times its p x q matrix; leaves without one go."""
    q = next(iter(by.values())).shape[1] if by else p
    rows = [(int(leaf), [[float(z) for z in col] for col in m.T]) for leaf, m in by.items()]
    small = v.sparkSession.createDataFrame(rows, "leaf long, turn array<array<double>>")
    at = lambda k: sum((F.col(f"v{i}") * F.get(F.get("turn", F.lit(k)), F.lit(i)) for i in range(p)), F.lit(0.0))
    keep = [c for c in v.columns if c not in {f"v{k}" for k in range(p)}]
    return v.join(F.broadcast(small), "leaf").select(*keep, *[at(k).alias(f"v{k}") for k in range(q)])


def orthonormal(g: np.ndarray) -> np.ndarray:
    """``m`` such that vectors with Gram matrix ``g`` times ``m`` are orthonormal; directions of no length become zero."""
    values, vectors = np.linalg.eigh(g)
    on = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    return vectors * np.where(on, 1 / np.sqrt(np.where(on, values, 1.0)), 0.0)


def leading(x: Residuals, how: Growth) -> tuple[DataFrame, DataFrame, dict[int, tuple[float, float]]]:
    """``(leaf, row_id, loading)``, ``(leaf, col_id, score)`` and the two largest singular values of each leaf.

    The largest loading is positive. Vectors start from hashes of row and place.
    """
    p = how.vectors
    start = [(F.pmod(F.xxhash64(F.lit(how.seed + k), "row_id"), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias(f"v{k}") for k in range(p)]
    v = x.rows.select("leaf", "row_id", *start)
    v = turned(v, {leaf: orthonormal(g) for leaf, g in gram(v, p).items()}, p)
    for _ in range(how.rounds):
        raw = stored(across(x, along(x, v, p), p), "tree-vectors")
        v = turned(raw, {leaf: orthonormal(g) for leaf, g in gram(raw, p).items()}, p)
    u = stored(along(x, v, p), "tree-scores")
    turn, size = {}, {}
    for leaf, g in gram(u, p).items():
        values, vectors = np.linalg.eigh(g)
        turn[leaf], size[leaf] = vectors[:, [-1]], tuple(np.sqrt(np.maximum(values[::-1][:2], 0)))
    loading = stored(turned(v, turn, p).select("leaf", "row_id", F.col("v0").alias("loading")), "tree-loadings")
    # A loading's size is compared at nine digits, so that ties go to the lower row whatever the order of sums.
    sign = loading.groupBy("leaf").agg(F.signum(F.max_by("loading", F.struct(F.round(F.abs("loading"), 9), -F.col("row_id")))).alias("sign"))
    flip = lambda df, c: df.join(F.broadcast(sign), "leaf").withColumn(c, F.col(c) * F.col("sign")).drop("sign")
    return flip(loading, "loading"), flip(turned(u, turn, p).select("leaf", "col_id", F.col("v0").alias("score")), "score"), size


def explained(x: Residuals, labels: DataFrame, top: int = 200) -> DataFrame:
    """``(leaf, ratio)``: variance of the residuals between ``labels(leaf, col_id, lab)`` over what random labels explain.

    Averaged over the ``top`` rows of the largest variance; 1 for a leaf with one label.
    """
    of = x.cells.join(labels, ["leaf", "col_id"])
    mass = of.groupBy("leaf", "lab", "bk").agg(F.sum("rn").alias("w"))
    n_lab = of.groupBy("leaf", "lab").agg(F.count("*").alias("n_lab"))
    n = n_lab.groupBy("leaf").agg(F.sum("n_lab").alias("n"), F.count("*").alias("k"))
    seen = x.parts.join(labels, ["leaf", "col_id"]).groupBy("leaf", "row_id", "lab").agg(F.sum("s").alias("t"))
    less = x.rates.join(mass, ["leaf", "bk"]).groupBy("leaf", "row_id", "lab").agg(F.sum(-F.col("root") * F.col("w")).alias("t"))
    sums = seen.unionByName(less).groupBy("leaf", "row_id", "lab").agg(F.sum("t").alias("t")).join(n_lab, ["leaf", "lab"])
    row = sums.groupBy("leaf", "row_id").agg(F.sum("t").alias("t"), F.sum(F.col("t") ** 2 / F.col("n_lab")).alias("b")).join(x.rows, ["leaf", "row_id"]).join(n, "leaf")
    off = F.col("t") ** 2 / F.col("n")
    row = row.select("leaf", "row_id", "n", "k", (F.col("square") - off).alias("all"), (F.col("b") - off).alias("between"))
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("all"), "row_id"))
    kept = row.withColumn("_r", rank).filter((F.col("_r") <= top) & (F.col("all") > 0) & (F.col("k") > 1))
    ratio = kept.groupBy("leaf").agg(F.avg(F.col("between") / F.col("all") * (F.col("n") - 1) / (F.col("k") - 1)).alias("ratio"))
    return n.join(ratio, "leaf", "left").select("leaf", F.coalesce("ratio", F.lit(1.0)).alias("ratio"))


def side_sums(x: Residuals, sides: DataFrame) -> DataFrame:
    """``(leaf, row_id, of_left, of_right)`` of ``sides(leaf, col_id, lab)``, 1 on the right."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("lab") == k, F.col("val"))), F.lit(0.0))
    return x.parts.join(sides, ["leaf", "col_id"]).groupBy("leaf", "row_id").agg(side(0).alias("of_left"), side(1).alias("of_right"))


def likelihood_ratio(sums: DataFrame) -> DataFrame:
    """``(leaf, llr)``: Poisson profile likelihood of two sides with rates of their own over that of one."""
    n = sums.groupBy("leaf").agg(F.sum("of_left").alias("nl"), F.sum("of_right").alias("nr"))
    part = lambda y, n: F.when(y > 0, y * F.log(y / n)).otherwise(F.lit(0.0))
    left, right, nl, nr = (F.col(c) for c in ("of_left", "of_right", "nl", "nr"))
    gain = F.when((nl > 0) & (nr > 0), part(left, nl) + part(right, nr) - part(left + right, nl + nr)).otherwise(F.lit(0.0))
    return sums.join(n, "leaf").groupBy("leaf").agg(F.sum(gain).alias("llr"))


def proposals(m: SparseMatrix, leaves: DataFrame, how: Growth) -> tuple[list[dict], DataFrame, DataFrame]:
    """Records of the splits of all given leaves, ``sides(leaf, col_id, lab)`` and ``(leaf, row_id, loading, of_left, of_right)``."""
    x = residuals(m, leaves, how)
    loading, score, size = leading(x, how)
    sides = stored(score.select("leaf", "col_id", (F.col("score") > 0).cast("int").alias("lab")), "tree-sides")
    sums = stored(side_sums(x, sides), "tree-contrast")
    info = {r["leaf"]: r for r in sides.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("lab").alias("n_right")).collect()}
    noise = x.rows.join(x.cells.select("leaf", "n_leaf").distinct(), "leaf").groupBy("leaf").agg(F.median(F.col("square") / F.col("n_leaf")).alias("var"), F.count("*").alias("rows"))
    more = {r["leaf"]: r for r in noise.join(likelihood_ratio(sums), "leaf").join(explained(x, sides, how.explained_rows), "leaf").collect()}
    out = []
    for leaf in sorted(set(info) & set(more)):
        n, right, rest = info[leaf]["n"], info[leaf]["n_right"], more[leaf]
        sigma = float(np.sqrt(max(rest["var"], np.finfo(float).eps)))
        edge = sigma * (np.sqrt(n) + np.sqrt(rest["rows"]))
        even = min(right, n - right) >= max(how.least // 2, 1) and rest["rows"] > 1 and size[leaf][0] > 0
        clear = bool(even and size[leaf][0] > (1 + how.margin) * edge)
        out.append({"split": leaf, "n": n, "n_left": n - right, "n_right": right, "n_rows": rest["rows"], "s1": float(size[leaf][0]), "s2": float(size[leaf][1]) if len(size[leaf]) > 1 else 0.0, "sigma": sigma, "edge": float(edge), "clear": clear, "llr": float(rest["llr"]), "ve_ratio": float(rest["ratio"]), "fits": bool(even and (clear or not how.stop))})
    return out, sides, loading.join(sums, ["leaf", "row_id"])


def packed(labels: DataFrame, levels: int) -> tuple[DataFrame, list[int]]:
    """``(col_id, code)`` of nested labels and the bits of each level from fine to coarse.

    The low bits name the coarsest leaf, each further field a leaf within its parent, so
    a code under a level's mask names that level's leaf. Ranks run over leaves, not over columns.
    """
    wide = labels.groupBy("col_id").pivot("level", list(range(levels))).agg(F.first("leaf"))
    names = [str(i) for i in range(levels)]
    paths = stored(wide.select(*names).distinct(), "tree-paths")  # a row a finest leaf
    fields, widths, used = paths, [], 0
    for i, name in enumerate(names):
        within = Window.partitionBy(*names[:i]).orderBy(name) if i else Window.orderBy(name)
        fields = fields.withColumn(f"f{i}", F.dense_rank().over(within) - 1)
    fields = stored(fields, "tree-fields")
    top = fields.agg(*[F.max(f"f{i}").alias(f"f{i}") for i in range(levels)]).first()
    code = F.lit(0).cast("long")
    for i in range(levels):
        code = code + F.shiftleft(F.col(f"f{i}").cast("long"), used)
        used += max(int(top[f"f{i}"] or 0).bit_length(), 1)
        widths.append(used)
    if used > 62:
        raise MatrixError(f"codes of {used} bits")
    return wide.join(fields.select(*names, code.alias("code")), names).select("col_id", "code"), widths[::-1]


def grown(m: SparseMatrix, nodes: DataFrame, targets: list[int], how: Growth = Growth()) -> Tree:
    """The tree over ``nodes(col_id, batch, leaf)``, top nodes numbered from 0, with ``targets`` leaves from coarse to fine.

    In each round the splits of new leaves are proposed together; of all open ones those with the largest
    likelihood ratio are applied, ties to the lower leaf, until the next level has its leaves. Where no leaf
    can be split the remaining levels repeat the last. Columns without counts go left. ``targets`` bounds
    the records that the driver holds.
    """
    if list(targets) != sorted(targets) or not targets:
        raise MatrixError("levels run from coarse to fine")
    cur = stored(nodes.select("col_id", F.col("batch").cast("string").alias("batch"), F.col("leaf").cast("long").alias("leaf")), "tree-nodes")
    sizes = {r["leaf"]: r["n"] for r in cur.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    root = {leaf: (leaf, 0, None) for leaf in sizes}  # root, depth, parent
    fresh, ready, splits, new_id = set(sizes), {}, [], max(sizes, default=-1) + 1
    sides, shown, levels, alive = None, None, [], set(sizes)
    for level, target in enumerate(targets):
        while len(alive) < target:
            large = [leaf for leaf in fresh if sizes[leaf] >= how.least]
            if large:
                records, side, load = proposals(m, cur.filter(F.col("leaf").isin(large)), how)
                ready.update({r["split"]: r for r in records if r["fits"]})
                sides = side if sides is None else sides.unionByName(side)
                shown = load if shown is None else shown.unionByName(load)
            fresh = set()
            best = sorted(ready.values(), key=lambda r: (-r["llr"], r["split"]))[: target - len(alive)]
            if not best:
                break
            moved = []
            for r in best:
                leaf = r["split"]
                del ready[leaf]
                alive.discard(leaf)
                top, deep, _ = root[leaf]
                splits.append(r | {"root": top, "depth": deep + 1, "left": new_id, "right": new_id + 1})
                for k, n in ((0, r["n_left"]), (1, r["n_right"])):
                    moved.append((leaf, k, new_id))
                    root[new_id], sizes[new_id] = (top, deep + 1, leaf), n
                    alive.add(new_id)
                    fresh.add(new_id)
                    new_id += 1
            to = cur.sparkSession.createDataFrame(moved, "leaf long, lab int, to long")
            step = sides.join(F.broadcast(to), ["leaf", "lab"]).select("leaf", "col_id", "to")
            cur = stored(cur.join(step, ["leaf", "col_id"], "left").select("col_id", "batch", F.coalesce("to", "leaf").alias("leaf")), "tree-nodes")
        levels.append(cur.select("col_id", F.lit(level).alias("level"), "leaf"))
    labels = levels[0]
    for x in levels[1:]:
        labels = labels.unionByName(x)
    codes, widths = packed(labels, len(targets))
    schema = "split long, n long, n_left long, n_right long, n_rows long, s1 double, s2 double, sigma double, edge double, clear boolean, llr double, ve_ratio double, root long, depth long, left long, right long"
    spark = cur.sparkSession
    done = spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in splits], schema)
    none = "split long, row_id long, loading double, of_left double, of_right double"
    loadings = spark.createDataFrame([], none) if shown is None else shown.withColumnRenamed("leaf", "split").join(F.broadcast(done.select("split")), "split", "left_semi")
    return Tree(labels, codes, widths, done, loadings)
