"""Pseudobulk: sums over groups of columns, Gamma posteriors, the batch model and its refinements."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..plans.storage import stored
from .knn import softmax_weights

A0 = B0 = 1.0
ITERATIONS = 100
#: Features of one block of the batch model, which are fitted together.
BLOCK_FEATURES = 256


def group_sums(m: SparseMatrix, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row_id, grp, val)`` and ``(grp, size)``, weighted by the columns' ``mult`` where they have one."""
    mult = m.cells.select("col_id", F.col("mult") if "mult" in m.cells.columns else F.lit(1.0).alias("mult"))
    of = groups.select("col_id", "grp").join(mult, "col_id")
    sums = m.entries.join(of, "col_id").groupBy("row_id", "grp").agg(F.sum(F.col("val") * F.col("mult")).alias("val"))
    return sums, of.groupBy("grp").agg(F.sum("mult").alias("size"))


def batch_sums(m: SparseMatrix, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row_id, batch, val)`` and ``(batch, grp, n)`` of ``cells(col_id, batch, grp)``."""
    sums = m.entries.join(cells.select("col_id", "batch"), "col_id").groupBy("row_id", "batch").agg(F.sum("val").alias("val"))
    return sums, cells.groupBy("batch", "grp").agg(F.count("*").cast("double").alias("n"))


def soft_sums(m: SparseMatrix, members: DataFrame) -> DataFrame:
    """``(individual, kind, row_id, val)`` of ``members(col_id, individual, kind, w)``."""
    return m.entries.join(members, "col_id").groupBy("individual", "kind", "row_id").agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def posterior(total: Column, weight: Column, a0: float = A0, b0: float = B0) -> list[Column]:
    """Gamma posterior columns ``a, b, mean, sd``."""
    a, b = total + a0, weight + b0
    return [a.alias("a"), b.alias("b"), (a / b).alias("mean"), (F.sqrt(a) / b).alias("sd")]


def pseudobulk(m: SparseMatrix, members: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(individual, kind, row_id, a, b, mean, sd)`` for every row and pair with members; ``weights(row_id, weight)`` scale the sums."""
    sums = soft_sums(m, members)
    if weights is not None:
        sums = sums.join(weights, "row_id").withColumn("val", F.col("val") * F.col("weight")).drop("weight")
    size = members.groupBy("individual", "kind").agg(F.sum("w").alias("size"))
    frame = size.crossJoin(m.features.select("row_id")).join(sums, ["individual", "kind", "row_id"], "left").fillna(0.0, ["val"])
    return frame.select("individual", "kind", "row_id", *posterior(F.col("val"), F.col("size")))


def group_means(m: SparseMatrix, groups: DataFrame) -> DataFrame:
    """``(row_id, grp, mean)`` over all columns of a group, zeros included."""
    sums, sizes = group_sums(m, groups)
    return sums.join(sizes, "grp").select("row_id", "grp", (F.col("val") / F.col("size")).alias("mean"))


def labelled_groups(cells: DataFrame, label: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    """``(col_id, grp)``: labels numbered in string order; up to ``cap`` columns of each, drawn by hash."""
    named = cells.select("col_id", F.col(label).alias("_label"))
    ids = named.select("_label").distinct().withColumn("grp", (F.row_number().over(Window.orderBy("_label")) - 1).cast("long"))
    out = named.join(F.broadcast(ids), "_label").select("col_id", "grp")
    if cap is None:
        return out
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64(F.lit(seed), "col_id"), "col_id"))
    return out.withColumn("_r", rank).filter(F.col("_r") <= cap).drop("_r")


def batch_model(obs: np.ndarray, imp: np.ndarray, by_batch: np.ndarray, n_bs: np.ndarray, w_bs: np.ndarray, iterations: int = ITERATIONS, frame: np.ndarray | None = None, seen: np.ndarray | None = None, counted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Rates of a block of features by alternating closed forms.

    ``obs, imp``: features x groups, observed and imputed sums; ``by_batch``:
    features x batches; ``n_bs, w_bs``: batches x groups, cells and imputed
    mass. Batch factors are pinned to a geometric mean of one, weighted by ``frame`` (the mass of each
    batch). ``seen``: features x batches, 0 where a batch does not measure a feature: its mass
    counts neither for a rate nor for a factor. ``counted``: groups that count for the factors.
    """
    mass = n_bs + w_bs
    frame = mass.sum(axis=1) if frame is None else frame
    seen = np.ones_like(by_batch) if seen is None else seen
    counted = np.ones(mass.shape[1]) if counted is None else counted
    delta = np.ones_like(by_batch)
    for _ in range(iterations):
        mu = (A0 + obs + imp) / (B0 + (delta * seen) @ mass)
        part = (delta * seen) @ w_bs
        num = by_batch + delta * seen * ((imp * counted / np.where(part > 0, part, 1) * (part > 0)) @ w_bs.T)
        den = seen * ((mu * counted) @ mass.T)
        ratio = np.log((A0 + num) / (B0 + den))
        weight = frame * seen
        pin = np.exp((ratio * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-300))
        den = np.maximum((B0 + den) * pin[:, None] - B0, 0)
        delta = np.where(seen > 0, (A0 + num) / (B0 + den), 1.0)
    size = seen @ n_bs
    return {
        "mu": mu,
        "delta": delta,
        "residual": (A0 + obs) / (B0 + mu * size),
        "imputed": (A0 + imp) / (B0 + mu * (seen @ w_bs)),
        "observed": (A0 + obs) / (B0 + size),
    }


def collapsed_fit(sums: DataFrame, imputed: DataFrame, by_batch: DataFrame, sizes: DataFrame, features: DataFrame, iterations: int = ITERATIONS, anchors: tuple[str, ...] = (), seen: DataFrame | None = None, private: bool = False) -> tuple[DataFrame, DataFrame]:
    """The profiles and factors of ``drawn_fits`` over all groups."""
    profiles, factors = drawn_fits(sums, imputed, by_batch, sizes, features, iterations, anchors, seen, private)
    return profiles.drop("draw"), factors.drop("draw")


def drawn_fits(sums: DataFrame, imputed: DataFrame, by_batch: DataFrame, sizes: DataFrame, features: DataFrame, iterations: int = ITERATIONS, anchors: tuple[str, ...] = (), seen: DataFrame | None = None, private: bool = False, draws: int = 0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(draw, row_id, grp, mu, observed, residual, imputed)`` and ``(draw, row_id, batch, delta)`` of the batch model.

    ``sums, imputed (row_id, grp, val)``, ``by_batch(row_id, batch, val)``,
    ``sizes(batch, grp, n, w)``. Features are independent, so they are dealt to
    blocks of a bounded size; the table of batches and groups goes to each. ``seen(row_id, batch)``: where a
    feature is measured; ``private``: groups without imputed mass do not count for the factors.
    ``draws``: so many fits, each over half of the groups by a seeded hash, with the batches' sums whole; a block
    makes all of them, so what is summed is shuffled once.
    """
    table = sizes.toPandas()
    batches, groups = sorted(table["batch"].unique()), sorted(table["grp"].unique())
    at_b, at_g = {b: i for i, b in enumerate(batches)}, {g: i for i, g in enumerate(groups)}
    n_bs, w_bs = np.zeros((len(batches), len(groups))), np.zeros((len(batches), len(groups)))
    for b, g, n, w in table[["batch", "grp", "n", "w"]].itertuples(index=False):
        n_bs[at_b[b], at_g[g]], w_bs[at_b[b], at_g[g]] = n, w
    frame = np.array([float(b in anchors) for b in batches]) if anchors else None
    counted = (w_bs.sum(axis=0) > 0).astype(float) if private else None
    halves = [half(groups, seed, i) for i in range(draws)] or [np.arange(len(groups))]
    kinds = {"grp": dict(sums.dtypes)["grp"], "batch": dict(by_batch.dtypes)["batch"]}
    tagged = lambda df, what, key: df.select("row_id", F.lit(what).alias("what"), F.col(key).cast("string").alias("key"), F.col("val").cast("double").alias("val"))
    rows = tagged(sums, "obs", "grp").unionByName(tagged(imputed, "imp", "grp")).unionByName(tagged(by_batch, "batch", "batch"))
    rows = rows.unionByName(features.select("row_id", F.lit("row").alias("what"), F.lit("").alias("key"), F.lit(0.0).alias("val")))
    if seen is not None:
        rows = rows.unionByName(tagged(seen.withColumn("val", F.lit(1.0)), "seen", "batch"))
    name_g, name_b, masked = {str(g): i for g, i in at_g.items()}, {str(b): i for b, i in at_b.items()}, seen is not None

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(part["row_id"])
        at = np.searchsorted(ids, part["row_id"])
        planes = {what: np.zeros((len(ids), len(names))) for what, names in (("obs", groups), ("imp", groups), ("batch", batches), ("seen", batches))}
        for what, names in (("obs", name_g), ("imp", name_g), ("batch", name_b), ("seen", name_b)):
            own = (part["what"] == what).to_numpy()
            np.add.at(planes[what], (at[own], part["key"][own].map(names).to_numpy(int)), part["val"][own])
        long = lambda keys, names: {"row_id": np.repeat(ids, len(names)), keys: np.tile(np.array(names), len(ids))}
        out = []
        for draw, own in enumerate(halves):
            fit = batch_model(planes["obs"][:, own], planes["imp"][:, own], planes["batch"], n_bs[:, own], w_bs[:, own], iterations, frame, planes["seen"] if masked else None, None if counted is None else counted[own])
            by_group = pd.DataFrame(long("grp", [groups[i] for i in own]) | {k: fit[k].ravel() for k in ("mu", "observed", "residual", "imputed")})
            out += [by_group.assign(draw=draw), pd.DataFrame(long("batch", batches) | {"delta": fit["delta"].ravel()}).assign(draw=draw)]
        return pd.concat(out, ignore_index=True).assign(of_group=lambda d: d["mu"].notna())

    block = F.pmod(F.xxhash64("row_id"), F.greatest(F.lit(1), F.lit(-(-features.count() // BLOCK_FEATURES))))
    schema = f"draw int, row_id long, grp {kinds['grp']}, mu double, observed double, residual double, imputed double, batch {kinds['batch']}, delta double, of_group boolean"
    fit = stored(rows.groupBy(block.alias("block")).applyInPandas(run, schema), "fit")
    return fit.filter("of_group").select("draw", "row_id", "grp", "mu", "observed", "residual", "imputed"), fit.filter("NOT of_group").select("draw", "row_id", "batch", "delta")


def half(groups: list, seed: int, draw: int) -> np.ndarray:
    """Places of half of the groups, by a hash of seed, draw and group."""
    rank = sorted(range(len(groups)), key=lambda i: (zlib.crc32(f"{seed}:{draw}:{groups[i]}".encode()), i))
    return np.array(sorted(rank[: max(len(groups) // 2, 1)]), dtype=int)


def resampled(sums: DataFrame, imputed: DataFrame, by_batch: DataFrame, sizes: DataFrame, features: DataFrame, draws: int = 10, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """``(row_id, grp, n, mu, spread)``: number of draws that held a group, mean and deviation of its rate over them.

    A group that no draw held has no row; a group of one draw has the spread 0.
    """
    fits, _ = drawn_fits(sums, imputed, by_batch, sizes, features, iterations, draws=draws, seed=seed)
    return fits.groupBy("row_id", "grp").agg(F.count("*").alias("n"), F.avg("mu").alias("mu"), F.stddev_pop("mu").alias("spread"))


def collapsed(sums: DataFrame, imputed: DataFrame, by_batch: DataFrame, sizes: DataFrame, features: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The profiles of ``collapsed_fit``."""
    return collapsed_fit(sums, imputed, by_batch, sizes, features, iterations)[0]


def matched_stat(m: SparseMatrix, matches: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row_id, grp, val)`` and ``(batch, grp, w)``: imputed sums, and from which batches their mass comes.

    ``matches(source, batch, match, dist)`` are neighbours in other batches, ``cells(col_id, grp)`` the groups of
    the sources. Each source is imputed as the mean of its matches under weights ``exp(-dist)`` that sum
    up to one. Weights are added up by match and group first, so entries are
    joined once for each group that needs them, not once for each source.
    """
    own = softmax_weights(matches).join(cells.select(F.col("col_id").alias("source"), "grp"), "source")
    need = own.groupBy("match", "grp").agg(F.sum("w").alias("w"))
    sums = m.entries.join(need.withColumnRenamed("match", "col_id"), "col_id").groupBy("row_id", "grp").agg(F.sum(F.col("w") * F.col("val")).alias("val"))
    return sums, own.groupBy("batch", "grp").agg(F.sum("w").alias("w"))


def collapsed_columns(m: SparseMatrix, matches: DataFrame, cells: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """``(row_id, grp, mu, observed, residual, imputed)`` of ``cells(col_id, batch, grp)`` with what their matches in other batches impute."""
    sums, _ = group_sums(m, cells)
    by_batch, n = batch_sums(m, cells)
    imputed, w = matched_stat(m, matches, cells)
    sizes = n.join(w, ["batch", "grp"], "full").fillna(0.0, ["n", "w"])
    return collapsed(sums, imputed, by_batch, sizes, m.features, iterations)


def merged_levels(sums: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sums of coarser groups, ``mapping(grp, coarse)``."""
    return sums.join(mapping, "grp").groupBy("row_id", F.col("coarse").alias("grp")).agg(F.sum("val").alias("val"))


def level_bits(fine: int, levels: int, coarsest: int = 7) -> list[int]:
    """Bits of each level from fine to coarse, each once."""
    low = min(coarsest, fine)
    steps = [round(fine - (fine - low) * (i / (levels - 1) if levels > 1 else 0)) for i in range(levels)]
    return list(dict.fromkeys(steps))


def level_groups(codes: DataFrame, bits: list[int]) -> DataFrame:
    """``(col_id, level, grp)``: the low bits of each code, so coarser groups hold finer ones."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.col("code").bitwiseAND(F.lit((1 << b) - 1)).alias("grp")) for i, b in enumerate(bits)])
    return codes.select("col_id", F.explode(levels).alias("l")).select("col_id", "l.level", "l.grp")


def pb_samples(codes: DataFrame, cells: DataFrame) -> DataFrame:
    """``(col_id, batch, grp, pb)``: a sample for each batch and finest group, numbered in order of batch and group."""
    both = codes.join(cells.select("col_id", "batch"), "col_id").select("col_id", "batch", F.col("code").alias("grp"))
    ids = both.select("batch", "grp").distinct().withColumn("pb", (F.row_number().over(Window.orderBy("batch", "grp")) - 1).cast("long"))
    return both.join(ids, ["batch", "grp"])


def centroids(vecs: DataFrame, samples: DataFrame, dims: int) -> DataFrame:
    """``(pb, batch, grp, n, vec)``: mean projection of each sample."""
    place = F.array(*[F.avg(F.get("vec", F.lit(k))) for k in range(dims)])
    return vecs.join(samples, "col_id").groupBy("pb", "batch", "grp").agg(F.count("*").alias("n"), place.alias("vec"))


def refined(profiles: DataFrame, moves: int = 10, prior: float = 0.5, gain: float = 0.0) -> DataFrame:
    """``(entity, was, grp)`` after greedy Poisson moves between siblings.

    ``profiles(parent, entity, grp, row_id, val)``: entities only move among
    groups of their own parent, so each parent is a task of its own. An entity
    goes where its counts are likeliest under the group's rates without it;
    ties and gains of no more than ``gain`` do not move it.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ents, e = np.unique(part["entity"], return_inverse=True)
        rows, r = np.unique(part["row_id"], return_inverse=True)
        y = np.zeros((len(ents), len(rows)))
        np.add.at(y, (e, r), part["val"])
        first = part.drop_duplicates("entity").set_index("entity")["grp"].reindex(ents).to_numpy()
        groups, own = np.unique(first, return_inverse=True)
        depth = y.sum(axis=1)
        pooled = y.sum(axis=0) / max(depth.sum(), 1e-300)
        totals = np.zeros((len(groups), len(rows)))
        np.add.at(totals, own, y)
        sizes = np.bincount(own, minlength=len(groups))
        for _ in range(moves):
            moved = False
            for i in range(len(ents)):
                t = totals.copy()
                t[own[i]] -= y[i]
                rate = (t + prior * pooled) / (t.sum(axis=1) + prior)[:, None]
                like = y[i] @ np.log(np.maximum(rate, 1e-300)).T - depth[i] * rate.sum(axis=1)
                best = int(like.argmax())
                if like[best] > like[own[i]] + gain + 1e-9 and sizes[own[i]] > 1:
                    totals[own[i]] -= y[i]
                    totals[best] += y[i]
                    sizes[own[i]] -= 1
                    sizes[best] += 1
                    own[i], moved = best, True
            if not moved:
                break
        return pd.DataFrame({"entity": ents, "was": first, "grp": groups[own]})

    kinds = dict(profiles.dtypes)
    return profiles.groupBy("parent").applyInPandas(run, f"entity {kinds['entity']}, was {kinds['grp']}, grp {kinds['grp']}")


def multilevel(m: SparseMatrix, vecs: DataFrame, dims: int, bits: int, levels: int = 2, coarsest: int = 7, refine: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(col_id, level, grp)`` of nested levels, and posteriors ``(level, row_id, grp, a, b, mean, sd)``.

    Samples of batch and finest group move between siblings of the coarser
    level; coarser groups are unions of finer ones, so counts are conserved.
    """
    from .project import sign_groups

    codes = sign_groups(vecs, dims, bits)
    sizes = level_bits(bits, levels, coarsest)
    if refine and len(sizes) > 1:
        samples = pb_samples(codes, m.cells)
        mask = (1 << sizes[1]) - 1
        sums = m.entries.join(samples, "col_id").groupBy("pb", "grp", "row_id").agg(F.sum("val").alias("val"))
        moved = refined(sums.select(F.col("grp").bitwiseAND(F.lit(mask)).alias("parent"), F.col("pb").alias("entity"), "grp", "row_id", "val"))
        new = samples.join(moved.select(F.col("entity").alias("pb"), F.col("grp").alias("to")), "pb", "left")
        codes = new.select("col_id", F.coalesce("to", "grp").alias("code"))
    groups = level_groups(codes, sizes)
    size = groups.groupBy("level", "grp").agg(F.count("*").cast("double").alias("size"))
    sums = m.entries.join(groups, "col_id").groupBy("level", "row_id", "grp").agg(F.sum("val").alias("val"))
    return groups, sums.join(size, ["level", "grp"]).select("level", "row_id", "grp", *posterior(F.col("val"), F.col("size")))


def batch_factors(obs: DataFrame, rounds: int = 4, prior: float = 10.0, bound: float = 8.0) -> DataFrame:
    """``(row_id, batch, factor)`` of ``obs(row_id, stratum, batch, val, size)`` by alternating sums.

    ``val ~ Poisson(size * rate(row, stratum) * factor(row, batch))``.
    """
    cur = obs.withColumn("factor", F.lit(1.0))
    out = None
    for _ in range(rounds):
        rate = cur.groupBy("row_id", "stratum").agg((F.sum("val") / F.sum(F.col("size") * F.col("factor"))).alias("rate"))
        o = obs.join(rate, ["row_id", "stratum"]).groupBy("row_id", "batch").agg(F.sum("val").alias("o"), F.sum(F.col("size") * F.col("rate")).alias("e"))
        factor = F.least(F.greatest((F.col("o") + prior) / (F.col("e") + prior), F.lit(1 / bound)), F.lit(bound))
        out = stored(o.select("row_id", "batch", factor.alias("factor")), "factors")
        cur = obs.join(out, ["row_id", "batch"])
    return out


def visit_groups(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """A visitor over groups as pandas frames."""
    return df.groupBy(key).applyInPandas(run, schema)


def visit_pairs(pairs: DataFrame, run, schema: str) -> DataFrame:
    """A visitor over blocks of edges."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield run(p)

    return pairs.mapInPandas(each, schema)
