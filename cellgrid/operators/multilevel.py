"""Multilevel collapse: nested groups of columns, and the batch model of every level and layer.

Columns get codes whose low bits are their coarser group. Samples (a batch in a
finest group) are refined from the coarsest level to the finest, matched
with samples of other batches, and summed up once by batch and finest group; every level's sums
follow from these, so counts are conserved and levels nest. Several
layers (matrices over the same columns) share one partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import MatrixError, SparseMatrix
from ..plans.storage import stored
from .collapse import centroids, collapsed_fit, level_bits
from .knn import nearest, softmax_weights
from .poisson import Refinement, near_groups, refined_codes, rescaled


@dataclass(frozen=True)
class Levels:
    """How to collapse: ``bits`` of the finest code, ``levels`` down to ``coarsest`` bits."""

    bits: int = 10
    levels: int = 2
    coarsest: int = 7
    #: Matches of a sample in each other batch.
    neighbours: int = 10
    iterations: int = 100
    refine: Refinement | None = Refinement()
    #: Batches that others are matched with and that define the frame: their factors have a geometric mean of one.
    anchors: tuple[str, ...] = ()
    #: Batches whose columns are mixtures already: each is a sample of its own, and nothing is matched with them.
    bulk: tuple[str, ...] = ()
    #: Whether a feature without an entry in a whole batch counts as unmeasured there instead of as zero.
    panels: bool = False


@dataclass(frozen=True)
class Collapsed:
    #: ``(col_id, level, grp)``, level 0 the finest.
    groups: DataFrame
    #: ``(layer, level, row_id, grp, size, total, mu, observed, residual, imputed)``.
    profiles: DataFrame
    #: ``(layer, level, row_id, batch, delta)``.
    factors: DataFrame


def roles(batches: list[str], anchors: tuple[str, ...], bulk: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Anchors and bulk batches; unknown names and a batch in both roles are refused. Bulk without anchors is anchored to all others."""
    for role, names in (("anchor", anchors), ("bulk", bulk)):
        for name in names:
            if name not in batches:
                raise MatrixError(f"{role} batch {name!r} is not among {sorted(batches)}")
    if both := set(anchors) & set(bulk):
        raise MatrixError(f"{sorted(both)} cannot be anchor and bulk")
    return (anchors or (tuple(sorted(set(batches) - set(bulk))) if bulk else ())), bulk


def stratum_bits(most: int | None, occupied: int) -> int:
    """Bits of the strata ``0..most``; none for a single one."""
    return 0 if occupied <= 1 else max(1, int(most).bit_length())


def with_strata(codes: DataFrame, strata: DataFrame) -> tuple[DataFrame, int]:
    """``codes(col_id, code)`` with the stratum of ``strata(col_id, stratum)`` in the low bits, so no group of any level mixes strata; and these bits."""
    most, occupied = strata.agg(F.max("stratum"), F.count_distinct("stratum")).first()
    bits = stratum_bits(most, occupied)
    if not bits:
        return codes, 0
    both = codes.join(strata.select("col_id", "stratum"), "col_id", "left").select("col_id", F.shiftleft("code", bits).bitwiseOR(F.coalesce("stratum", F.lit(0)).cast("long")).alias("code"))
    return both, bits


def samples_of(codes: DataFrame, cells: DataFrame, single: tuple[str, ...] = ()) -> DataFrame:
    """``(col_id, batch, code, pb)``: a sample for each batch and code, and for each column of the ``single`` batches."""
    own = codes.join(cells.select("col_id", "batch"), "col_id")
    one = F.when(F.col("batch").isin(list(single)), F.col("col_id")) if single else F.lit(None).cast("long")
    return own.withColumn("pb", F.concat_ws("/", "batch", "code", one)).select("col_id", "batch", "code", "pb")


def sample_matches(middle: DataFrame, k: int, anchors: tuple[str, ...], bulk: tuple[str, ...], strata: DataFrame | None = None) -> DataFrame:
    """``(source, batch, match, dist)`` of ``middle(pb, batch, vec)``: the ``k`` nearest samples of each other batch.

    With anchors only these are matched with, anchors also with themselves. Bulk is
    never matched with. ``strata(pb, stratum)``: matches of the same stratum only.
    """
    points = middle.select(F.col("pb").alias("id"), "batch", "vec")
    to = points.filter(~F.col("batch").isin(list(bulk))) if bulk else points
    if not anchors:
        parts = [(points, to, True)]
    else:
        fixed = F.col("batch").isin(list(anchors))
        parts = [(points.filter(~fixed), to.filter(fixed), True), (points.filter(fixed), to.filter(fixed), False)]
    out = None
    for source, match, other in parts:
        if strata is None:
            found = nearest(source, match, k, other)
            if not other:  # a sample stands for itself
                own = source.select(F.col("id").alias("source"), "batch", F.col("id").alias("match"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
                found = found.filter(F.col("rank") < k).unionByName(own)
        else:
            tagged = lambda df: df.join(strata.withColumnRenamed("pb", "id"), "id").withColumn("batch", F.concat_ws("\n", F.col("stratum").cast("string"), "batch"))
            # Every stratum is a batch of its own; matches of other strata are dropped after the search.
            found = nearest(tagged(source).select("id", "batch", "vec"), tagged(match).select("id", "batch", "vec"), k, False)
            s, b = F.split("batch", "\n", 2)[0], F.split("batch", "\n", 2)[1]
            at = source.join(strata.withColumnRenamed("pb", "id"), "id").select(F.col("id").alias("source"), F.col("batch").alias("_b"), F.col("stratum").cast("string").alias("_s"))
            found = found.withColumn("_stratum", s).withColumn("batch", b).join(at, "source").filter((F.col("_stratum") == F.col("_s")) & (F.lit(not other) | (F.col("batch") != F.col("_b")))).drop("_stratum", "_b", "_s")
        found = found.select("source", "batch", "match", "dist")
        out = found if out is None else out.unionByName(found)
    return out


def finest_stats(m: SparseMatrix, samples: DataFrame, groups: DataFrame, matches: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Sums by batch and group, ``(what, row_id, batch, grp, val)``, and masses ``(what, batch, grp, val)``.

    ``what``: observed counts of the batch's own columns, or what matches in the
    batch impute for the group; the mass is the number of columns behind it. ``groups(pb, grp)``.
    """
    mult = m.cells.select("col_id", F.col("mult") if "mult" in m.cells.columns else F.lit(1.0).alias("mult"))
    own = samples.join(mult, "col_id")
    sums = stored(m.entries.join(own, "col_id").groupBy("pb", "row_id").agg(F.sum(F.col("val") * F.col("mult")).alias("val")), "samples")
    size = stored(own.groupBy("pb", "batch").agg(F.sum("mult").alias("n")).join(groups, "pb"), "sizes")
    tag = lambda df, what: df.select(F.lit(what).alias("what"), *df.columns)
    seen = sums.join(size, "pb").groupBy("row_id", "batch", "grp").agg(F.sum("val").alias("val"))
    stat, mass = tag(seen, "observed"), tag(size.groupBy("batch", "grp").agg(F.sum("n").alias("val")), "observed")
    if matches is None:
        return stat, mass
    to = size.select(F.col("pb").alias("match"), F.col("n").alias("_of"))
    drawn = softmax_weights(matches).join(size.select(F.col("pb").alias("source"), "grp", "n"), "source").join(to, "match")
    need = drawn.groupBy("match", "batch", "grp").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.first("_of").alias("_of"))
    imputed = sums.withColumnRenamed("pb", "match").join(need, "match").groupBy("row_id", "batch", "grp").agg(F.sum(F.col("val") * F.col("w") / F.col("_of")).alias("val"))
    return stat.unionByName(tag(imputed, "imputed")), mass.unionByName(tag(need.groupBy("batch", "grp").agg(F.sum("w").alias("val")), "imputed"))


def _at(stat: DataFrame, group: Column) -> DataFrame:
    """Sums or masses of coarser groups."""
    keys = [c for c in stat.columns if c in ("what", "row_id", "batch")]
    return stat.groupBy(*keys, group.alias("grp")).agg(F.sum("val").alias("val"))


def fitted_level(stat: DataFrame, mass: DataFrame, m: SparseMatrix, how: Levels, anchors: tuple[str, ...], private: bool, iterations: int) -> tuple[DataFrame, DataFrame]:
    """Profiles and factors of one level; with ``private`` groups without any match do not count for the factors."""
    sums = stat.filter("what = 'observed'").groupBy("row_id", "grp").agg(F.sum("val").alias("val"))
    imputed = stat.filter("what = 'imputed'").groupBy("row_id", "grp").agg(F.sum("val").alias("val"))
    wide = mass.groupBy("batch", "grp").agg(F.sum(F.when(F.col("what") == "observed", F.col("val")).otherwise(0.0)).alias("n"), F.sum(F.when(F.col("what") == "imputed", F.col("val")).otherwise(0.0)).alias("w"))
    own = stat.filter("what = 'observed'")
    if private:
        matched = mass.filter("what = 'imputed' AND val > 0").select("grp").distinct()
        own = own.join(matched, "grp", "left_semi")
    by_batch = own.groupBy("row_id", "batch").agg(F.sum("val").alias("val"))
    seen = stat.filter("what = 'observed' AND val > 0").select("row_id", "batch").distinct() if how.panels else None
    profiles, factors = collapsed_fit(sums, imputed, by_batch, wide, m.features, iterations, anchors, seen, private)
    size = wide.groupBy("grp").agg(F.sum("n").alias("size"))
    return profiles.join(size, "grp").join(sums.withColumnRenamed("val", "total"), ["row_id", "grp"], "left").fillna(0.0, ["total"]), factors


def collapse_levels(layers: list[SparseMatrix], codes: DataFrame, vecs: DataFrame, dims: int, how: Levels = Levels(), strata: DataFrame | None = None) -> Collapsed:
    """Collapse ``layers`` over the same cells into the groups of ``codes(col_id, code)``.

    The first layer is the one that refines; ``vecs(col_id, vec)`` places samples for
    matching. ``strata(col_id, stratum)`` never share a group, are matched within
    themselves only, and what has no match outside does not pull the factors.
    """
    cells = layers[0].cells
    names = [r[0] for r in cells.select("batch").distinct().collect()]
    anchors, bulk = roles(names, how.anchors, how.bulk)
    low = 0
    if strata is not None:
        codes, low = with_strata(codes, strata)
    bits = [b + low for b in level_bits(how.bits, how.levels, how.coarsest)]
    samples = stored(samples_of(codes, cells, tuple(how.anchors) + bulk), "samples")
    of_code = samples.select("pb", "code").distinct()
    stratum = of_code.select("pb", F.col("code").bitwiseAND(F.lit((1 << low) - 1).cast("long")).alias("stratum")) if low else None
    middle = stored(centroids(vecs, samples.withColumnRenamed("code", "grp"), dims).select("pb", "batch", "vec"), "centroids")
    matches = stored(sample_matches(middle, how.neighbours, anchors, bulk, stratum), "matches") if len(names) > 1 else None
    if how.refine:
        sums = layers[0].entries.join(samples, "col_id").groupBy("pb", "row_id").agg(F.sum("val").alias("val"))
        coarse = of_code.select(F.col("pb").alias("entity"), F.col("code").bitwiseAND(F.lit((1 << bits[-1]) - 1).cast("long")).alias("stratum"))
        batch_of = samples.select(F.col("pb").alias("entity"), "batch").distinct()
        profiles = stored(rescaled(stored(sums.withColumnRenamed("pb", "entity"), "profiles"), batch_of, coarse), "profiles")
        near = matches.select(F.col("source").alias("entity"), "match") if matches is not None else None
        proposer = near_groups(near, stratum.withColumnRenamed("pb", "entity") if stratum is not None else None) if near is not None else None
        of_code = refined_codes(profiles, of_code.select(F.col("pb").alias("entity"), "code"), bits, how.refine, proposer).select(F.col("entity").alias("pb"), "code")
    finest = stored(of_code.select("pb", F.col("code").alias("grp")), "groups")
    return _collapsed(layers, samples, finest, matches, [F.col("grp").bitwiseAND(F.lit((1 << b) - 1).cast("long")) for b in bits], how, anchors, strata is not None)


def collapse_partition(layers: list[SparseMatrix], partition: DataFrame, vecs: DataFrame, dims: int, how: Levels = Levels()) -> Collapsed:
    """Collapse into groups of another run, ``partition(col_id, level, grp)``; levels that do not nest are made to by vote.

    A group of a finer level goes to the coarser group that most of its columns are in, the smallest of equals.
    """
    cells = layers[0].cells
    names = [r[0] for r in cells.select("batch").distinct().collect()]
    anchors, bulk = roles(names, how.anchors, how.bulk)
    levels = [r[0] for r in partition.select("level").distinct().orderBy("level").collect()]
    finest = partition.filter(F.col("level") == levels[0]).select("col_id", F.col("grp").cast("long").alias("code"))
    up = finest.select("col_id", F.col("code").alias("grp"))
    paths = finest.select(F.col("code").alias("grp")).distinct().withColumn("path", F.array("grp"))
    for level in levels[1:]:
        votes = up.join(partition.filter(F.col("level") == level).select("col_id", F.col("grp").cast("long").alias("to")), "col_id").groupBy("grp", "to").agg(F.count("*").alias("n"))
        won = stored(votes.groupBy("grp").agg(F.min_by("to", F.struct(-F.col("n"), F.col("to"))).alias("to")), "votes")
        up = up.join(won, "grp").select("col_id", F.col("to").alias("grp"))
        paths = paths.join(won.withColumnRenamed("grp", "_g"), F.element_at("path", -1) == F.col("_g")).select("grp", F.concat("path", F.array("to")).alias("path"))
    samples = stored(samples_of(finest, cells, tuple(how.anchors) + bulk), "samples")
    middle = stored(centroids(vecs, samples.withColumnRenamed("code", "grp"), dims).select("pb", "batch", "vec"), "centroids")
    matches = stored(sample_matches(middle, how.neighbours, anchors, bulk), "matches") if len(names) > 1 else None
    groups = stored(samples.select("pb", F.col("code").alias("grp")).distinct().join(paths, "grp"), "groups")
    return _collapsed(layers, samples, groups, matches, [F.get("path", F.lit(i)) for i in range(len(levels))], how, anchors, False)


def _collapsed(layers: list[SparseMatrix], samples: DataFrame, groups: DataFrame, matches: DataFrame | None, levels: list[Column], how: Levels, anchors: tuple[str, ...], private: bool) -> Collapsed:
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), g.alias("grp")) for i, g in enumerate(levels)]))
    cells = samples.select("col_id", "pb").join(groups.select("pb", spread.alias("l")), "pb").select("col_id", "l.level", "l.grp")
    path = groups.drop("pb").distinct()
    profiles = factors = None
    for k, m in enumerate(layers):
        stat, mass = (stored(x, "sums") for x in finest_stats(m, samples, groups.select("pb", "grp"), matches))
        for i, group in enumerate(levels):
            up = lambda df, g=group: _at(df.join(path, "grp"), g)
            iterations = how.iterations if i == 0 else max(how.iterations // 2, 10)
            p, f = fitted_level(up(stat), up(mass), m, how, anchors, private, iterations)
            p, f = (df.select(F.lit(k).alias("layer"), F.lit(i).alias("level"), *df.columns) for df in (p, f))
            profiles, factors = (p, f) if profiles is None else (profiles.unionByName(p), factors.unionByName(f))
    return Collapsed(cells, profiles.select("layer", "level", "row_id", "grp", "size", "total", "mu", "observed", "residual", "imputed"), factors.select("layer", "level", "row_id", "batch", "delta"))

