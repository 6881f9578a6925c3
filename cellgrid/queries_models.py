"""Registered queries of the models: Poisson refinement, multilevel collapse, the neighbour index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import coarsen, collapse, genes, index, multilevel, poisson, project, refine, tree
from .operators.multilevel import Levels
from .operators.poisson import Refinement
from .operators.tree import Growth
from .plans.datasets import orders_matrix, orders_sql, table, vectors
from .plans.storage import stored
from .queries import query, segment_profiles

_MEAN, _VAR = poisson.null_moments(0.5)
_line = lambda t: f"{t}[i + 1] + (place - i) * ({t}[i + 2] - {t}[i + 1])"
_M = "(mu + 0.5)"
_V = f"(mu / ({_M} * {_M}))"
_SCORES = f"""{orders_sql()}, z AS (SELECT {_MEAN} AS tm, {_VAR} AS tv),
y AS (SELECT row_id, col_id, val, batch, grp AS was, sum(val) OVER (PARTITION BY col_id) AS size, sum(val) OVER (PARTITION BY row_id) AS pooled, sum(val) OVER () AS total FROM entries JOIN cells USING (col_id)),
s AS (SELECT batch, was AS grp, row_id, sum(val) AS g FROM y GROUP BY 1, 2, 3), b AS (SELECT batch, grp, sum(g) AS mass FROM s GROUP BY 1, 2),
p AS (SELECT y.*, b.grp, coalesce(s.g, 0) AS g, b.mass, CASE WHEN pooled - val > 1e-9 * pooled AND total > size THEN (pooled - val) / (total - size) ELSE 0 END AS pi FROM y JOIN b USING (batch) LEFT JOIN s ON s.batch = y.batch AND s.grp = b.grp AND s.row_id = y.row_id),
m AS (SELECT *, CASE WHEN grp = was THEN greatest(g - val, 0) ELSE g END AS own, CASE WHEN grp = was THEN greatest(mass - size, 0) ELSE mass END * pi AS mu FROM p),
i AS (SELECT *, CASE WHEN mu > 0 THEN greatest((ln(mu) + 16) * 16, 0) ELSE 0 END AS place FROM m), j AS (SELECT *, CAST(least(floor(place), {len(_MEAN) - 2}) AS BIGINT) AS i FROM i),
n AS (SELECT *, CASE WHEN mu <= exp(-16.0) THEN 0 WHEN mu >= exp(6.0) THEN ln({_M} / 0.5) - {_V} / 2 + {_V} / {_M} / 3 - (3 * mu * mu + mu) / (4 * {_M} ** 4) ELSE {_line('tm')} END AS e, CASE WHEN mu <= exp(-16.0) THEN 0 WHEN mu >= exp(6.0) THEN {_V} ELSE {_line('tv')} END AS v FROM j CROSS JOIN z)
SELECT col_id, was, grp, round(sum(val * (ln(1 + own / 0.5) - e)), 4) AS score, round(sum(val * val * v), 4) AS noise FROM n GROUP BY 1, 2, 3"""


@query(_SCORES)
def q_poisson_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every customer in every segment of its region, as a refinement scores it."""
    m = orders_matrix(spark, d)
    labels = m.cells.select(F.col("col_id").alias("entity"), F.col("batch").alias("parent"), "grp")
    y = stored(poisson.prepared(m.entries.withColumnRenamed("col_id", "entity")), "profiles")
    some = labels.join(y.select("entity").distinct(), "entity", "left_semi")  # a segment without orders in a region is no block
    out = poisson.scores(y, labels, some.select("parent", "grp").distinct(), 0.5)
    return out.select(F.col("entity").alias("col_id"), "was", "grp", F.round("like", 4).alias("score"), F.round("noise", 4).alias("noise"))


@query()
def q_reassigned_cells(spark: SparkSession, d: str) -> DataFrame:
    """Customers moved between the segments of their region by what they order."""
    m = orders_matrix(spark, d)
    how = Refinement(gibbs=1, greedy=2, size_floor=0, size_cap=0)
    return poisson.reassigned(m, m.cells.select("col_id", "batch", F.col("grp").alias("node")), how)


def _layers(spark: SparkSession, d: str):
    m = orders_matrix(spark, d)
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("row_id"), F.col("o_custkey").alias("col_id")).agg(F.count("*").cast("double").alias("val"))
    return [m, m.with_(entries=lines)]


_GRP = "((col_id % 8) * 4 + col_id % 3)"


@query(f"""{orders_sql()}, lines AS (SELECT l_partkey AS row_id, o_custkey AS col_id, CAST(count(*) AS DOUBLE) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
u AS (SELECT 0 AS layer, * FROM entries UNION ALL SELECT 1, * FROM lines), k AS (SELECT 0 AS level, col_id, {_GRP} AS grp FROM cells UNION ALL SELECT 1, col_id, {_GRP} & 7 FROM cells),
n AS (SELECT level, grp, count(*) AS size FROM k GROUP BY 1, 2), t AS (SELECT layer, level, grp, row_id, sum(val) AS total FROM u JOIN k USING (col_id) GROUP BY 1, 2, 3, 4)
SELECT layer, level, grp, row_id, CAST(size AS DOUBLE) AS size, coalesce(total, 0) AS total, round((1 + coalesce(total, 0)) / (1 + size), 6) AS observed FROM (VALUES (0), (1)) AS l(layer) CROSS JOIN n CROSS JOIN features LEFT JOIN t USING (layer, level, grp, row_id)""")
def q_collapsed_levels(spark: SparkSession, d: str) -> DataFrame:
    """Two layers in two levels of groups that three strata never share."""
    layers = _layers(spark, d)
    codes = layers[0].cells.select("col_id", (F.col("col_id") % 8).alias("code"))
    strata = layers[0].cells.select("col_id", (F.col("col_id") % 3).cast("int").alias("stratum"))
    vecs = project.project(layers[0], 6)
    out = multilevel.collapse_levels(layers, codes, vecs, 6, Levels(bits=3, levels=2, coarsest=1, neighbours=2, iterations=10, refine=None), strata)
    return out.profiles.select("layer", "level", "grp", "row_id", "size", "total", F.round("observed", 6).alias("observed"))


@query()
def q_multilevel_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Groups of two levels after refinement of the samples of 6-bit codes, with batch-corrected rates of each."""
    m = orders_matrix(spark, d)
    vecs = stored(project.project(m, 8), "projection")
    how = Levels(bits=6, levels=2, coarsest=3, neighbours=3, iterations=30, refine=Refinement(gibbs=0, greedy=1))
    return multilevel.collapse_levels([m], project.sign_groups(vecs, 8, 6), vecs, 8, how).profiles


@query()
def q_collapse_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rates of parts by segment, with what the nearest customers of other regions impute."""
    m = orders_matrix(spark, d)
    points = stored(project.project(m, 8).join(m.cells.select("col_id", "batch"), "col_id").select(F.col("col_id").alias("id"), "batch", "vec"), "projection")
    matches, _ = index.searched(index.built(points), points, 2)
    return collapse.collapsed_columns(m, matches.select("source", "batch", "match", "dist"), m.cells.select("col_id", "batch", "grp"), 20)


@query("WITH v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS batch, embedding AS vec FROM embeddings), p AS (SELECT q.id AS source, r.batch, r.id AS match, sqrt(list_sum(list_transform(list_zip(q.vec, r.vec), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))) AS dist FROM v q JOIN v r ON q.batch <> r.batch), k AS (SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY dist, match) AS rank FROM p) SELECT source, batch, match, round(dist, 5) AS dist, rank FROM k WHERE rank <= 2")
def q_indexed_knn(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest vectors of every other label for every vector, over the index."""
    v = vectors(spark, d)
    return index.searched(index.built(v), v, 2)[0].withColumn("dist", F.round("dist", 5))


# Residuals of every place, empty ones too, of customers in their segment against the rates of segment and region.
_DENSE = f"""{orders_sql()}, dep AS (SELECT col_id, sum(val) AS depth FROM entries GROUP BY 1),
c AS (SELECT grp AS leaf, batch, col_id, coalesce(depth, 0) AS depth FROM cells LEFT JOIN dep USING (col_id)),
o AS (SELECT leaf, batch, count(*) >= 8 AND sum(depth) > 0 AS own FROM c GROUP BY 1, 2),
k AS (SELECT leaf, col_id, depth, CASE WHEN own THEN batch ELSE '' END AS bk FROM c JOIN o USING (leaf, batch)),
n AS (SELECT leaf, count(*) AS n, sum(depth) AS whole FROM k GROUP BY 1), m AS (SELECT leaf, bk, sum(depth) AS mass FROM k GROUP BY 1, 2),
e AS (SELECT leaf, bk, col_id, row_id, val FROM entries JOIN k USING (col_id)), y AS (SELECT leaf, bk, row_id, sum(val) AS y FROM e GROUP BY 1, 2, 3),
t AS (SELECT leaf, row_id, sum(val) AS tot FROM e GROUP BY 1, 2 HAVING sum(val) >= 5),
q AS (SELECT leaf, bk, row_id, CASE WHEN bk = '' THEN tot / whole ELSE y / mass END AS rate FROM m JOIN n USING (leaf) JOIN t USING (leaf) LEFT JOIN y USING (leaf, bk, row_id)),
d AS (SELECT k.leaf, k.col_id, q.row_id, e.val, CASE WHEN e.val IS NULL THEN -sqrt(depth * rate) ELSE least(greatest((e.val - depth * rate) / sqrt(depth * rate), -sqrt(n)), sqrt(n)) END AS r FROM k JOIN q ON k.leaf = q.leaf AND k.bk = q.bk AND q.rate > 0 JOIN n ON n.leaf = k.leaf LEFT JOIN e ON e.col_id = k.col_id AND e.row_id = q.row_id),
g AS (SELECT leaf, row_id, sum(r * r) AS square FROM d GROUP BY 1, 2)"""


def _segments(spark: SparkSession, d: str):
    m = orders_matrix(spark, d)
    return m, tree.residuals(m, m.cells.select(F.col("grp").alias("leaf"), "col_id", "batch"), Growth())


@query(f"{_DENSE} SELECT leaf, row_id, tot, round(square, 4) AS square FROM t JOIN g USING (leaf, row_id)")
def q_node_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Sums and squared residuals of parts in every segment."""
    return _segments(spark, d)[1].rows.select("leaf", "row_id", "tot", F.round("square", 4).alias("square"))


_PART = lambda y, n: f"CASE WHEN {y} > 0 THEN {y} * ln({y} / {n}) ELSE 0 END"


@query(f"""{_DENSE}, s AS (SELECT leaf, row_id, coalesce(sum(val) FILTER (col_id % 2 = 0), 0) AS l, coalesce(sum(val) FILTER (col_id % 2 = 1), 0) AS r FROM d GROUP BY 1, 2),
w AS (SELECT *, sum(l) OVER (PARTITION BY leaf) AS nl, sum(r) OVER (PARTITION BY leaf) AS nr FROM s), a AS (SELECT leaf, sum({_PART('l', 'nl')} + {_PART('r', 'nr')} - {_PART('(l + r)', '(nl + nr)')}) AS llr FROM w GROUP BY 1),
b AS (SELECT leaf, col_id % 2 AS lab, count(*) AS nb FROM k GROUP BY 1, 2), h AS (SELECT leaf, row_id, col_id % 2 AS lab, sum(r) AS x FROM d GROUP BY 1, 2, 3),
j AS (SELECT leaf, row_id, sum(x) AS x, sum(x * x / nb) AS xb FROM h JOIN b USING (leaf, lab) GROUP BY 1, 2),
v AS (SELECT leaf, row_id, n, square - x * x / n AS total, xb - x * x / n AS between_ FROM j JOIN g USING (leaf, row_id) JOIN n USING (leaf)),
z AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY total DESC, row_id) AS rk FROM v)
SELECT leaf, round(llr, 3) AS llr, round(ratio, 5) AS ve_ratio FROM a JOIN (SELECT leaf, avg(between_ / total * (n - 1)) AS ratio FROM z WHERE rk <= 200 AND total > 0 GROUP BY 1) USING (leaf)""")
def q_split_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """How much better two halves of every segment, by the parity of the customer, explain the counts than one."""
    _, x = _segments(spark, d)
    sides = x.cells.select("leaf", "col_id", (F.col("col_id") % 2).cast("int").alias("lab"))
    llr = tree.likelihood_ratio(tree.side_sums(x, sides))
    return llr.join(tree.explained(x, sides), "leaf").select("leaf", F.round("llr", 3).alias("llr"), F.round("ratio", 5).alias("ve_ratio"))


@query()
def q_cell_tree(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of every customer in the tree that grows from the segments to 8 and 12 leaves."""
    m = orders_matrix(spark, d)
    ids = collapse.labelled_groups(m.cells, "grp")
    return tree.grown(m, ids.join(m.cells.select("col_id", "batch"), "col_id").select("col_id", "batch", F.col("grp").alias("leaf")), [8, 12]).labels


_SKETCH = 16
_SIGNED = ", ".join(f"sum(CASE WHEN substr(dg, {i + 1}, 1) >= '8' THEN r ELSE -r END)" for i in range(_SKETCH))


@query(f"""{orders_sql()}, g AS (SELECT col_id AS grp, 1.0 / count(*) OVER () AS share, count(*) OVER () AS n, md5('42:0:' || col_id) AS dg FROM cells), t AS (SELECT row_id, sum(val) AS tot FROM entries GROUP BY 1),
d AS (SELECT t.row_id, dg, least(greatest((coalesce(val, 0) - tot * share) / sqrt(tot * share), -sqrt(n)), sqrt(n)) AS r FROM t CROSS JOIN g LEFT JOIN entries e ON e.row_id = t.row_id AND e.col_id = g.grp),
v AS (SELECT row_id, [{_SIGNED}] AS x FROM d GROUP BY 1), u AS (SELECT row_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v)
SELECT row_id, i AS place, round(x[i + 1] / norm, 5) + 0.0 AS x FROM u CROSS JOIN range({_SKETCH}) AS k(i)""")
def q_feature_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of what every part's customers order beyond their even share."""
    m = orders_matrix(spark, d)
    v = coarsen.sketched_profiles(m.entries.withColumnRenamed("col_id", "grp"), m.cells.select(F.col("col_id").alias("grp"), F.lit(1.0).alias("size")), _SKETCH)
    return v.select("row_id", F.posexplode("vec").alias("place", "x")).select("row_id", F.col("place").cast("long").alias("place"), (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query(f"""{orders_sql()}, s AS (SELECT row_id, grp, sum(val) AS v FROM entries JOIN cells USING (col_id) GROUP BY 1, 2), a AS (SELECT row_id, sum(v) AS rt FROM s GROUP BY 1), b AS (SELECT grp, sum(v) AS ct FROM s GROUP BY 1), o AS (SELECT sum(v) AS tt, count(DISTINCT grp) AS n FROM s),
f AS (SELECT row_id, grp, least(greatest((coalesce(v, 0) - rt * ct / tt) / sqrt(rt * ct / tt), -sqrt(n)), sqrt(n)) AS r FROM a CROSS JOIN b CROSS JOIN o LEFT JOIN s USING (row_id, grp)),
u AS (SELECT row_id, grp, r / sqrt(sum(r * r) OVER (PARTITION BY row_id)) AS r FROM f), k AS (SELECT row_id, CAST(substr(p_brand, 7) AS BIGINT) AS coarse FROM features WHERE row_id % 4 <> 0),
c AS (SELECT coarse, grp, sum(r) AS x FROM u JOIN k USING (row_id) GROUP BY 1, 2), l AS (SELECT coarse, grp, x / sqrt(sum(x * x) OVER (PARTITION BY coarse)) AS x FROM c),
w AS (SELECT row_id, coarse, sum(r * x) AS cos FROM u JOIN l USING (grp) WHERE row_id % 4 = 0 GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cos DESC, coarse DESC) AS rk FROM w)
SELECT row_id, coarse FROM z WHERE rk = 1 UNION ALL SELECT row_id, coarse FROM k WHERE row_id IN (SELECT row_id FROM a)""")
def q_grown_features(spark: SparkSession, d: str) -> DataFrame:
    """Brands of every part that sells; each fourth part joins the brand whose profile over segments it resembles."""
    m, r = orders_matrix(spark, d), segment_profiles(spark, d)
    known = m.features.filter("row_id % 4 <> 0").select("row_id", F.substring("p_brand", 7, 9).cast("long").alias("coarse"))
    return coarsen.grown_groups(known, r, 5)


@query()
def q_coarse_levels(spark: SparkSession, d: str) -> DataFrame:
    """Nested groups of parts by their profiles over segments; the background is what one rate explains."""
    m, r = orders_matrix(spark, d), segment_profiles(spark, d)
    told = stored(genes.informative_features(m).filter("informative").select("row_id"), "informative")
    return coarsen.coarsened_levels(m.features, r.join(told, "row_id", "left_semi"), [4, 12])


@query()
def q_resampled_rates(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the rates of parts in quarters of the customers of each segment, over ten halves of those groups."""
    m = orders_matrix(spark, d)
    of = m.cells.select("col_id", "batch", F.concat_ws(":", "grp", F.col("col_id") % 4).alias("grp"))
    sums, _ = collapse.group_sums(m, of)
    by_batch, n = collapse.batch_sums(m, of)
    return collapse.resampled(sums, sums.limit(0), by_batch, n.withColumn("w", F.lit(0.0)), m.features, 10, 20)


def _fit_round(i: int) -> str:
    """SQL of one round: rates of groups given the factors of batches, then the factors."""
    return f"""u{i} AS (SELECT grp, row_id, (coalesce(yp, 0) + rate) / (sum(n * omega) + 1) AS mu FROM f JOIN w{i - 1} USING (row_id) JOIN np USING (batch) LEFT JOIN pg USING (grp, row_id) GROUP BY grp, row_id, yp, rate),
w{i} AS (SELECT batch, row_id, (coalesce(yi, 0) + 1) / (sum(n * mu) + 1) AS omega FROM u{i} JOIN np USING (grp) LEFT JOIN ig USING (batch, row_id) GROUP BY batch, row_id, yi)"""


@query(f"""{orders_sql()}, k AS (SELECT col_id, batch, col_id % 8 AS grp FROM cells), y AS (SELECT row_id, col_id, val, batch, grp FROM entries JOIN k USING (col_id) WHERE val > 0),
np AS (SELECT grp, batch, sum(val) AS n FROM y GROUP BY 1, 2), pg AS (SELECT grp, row_id, sum(val) AS yp FROM y GROUP BY 1, 2), ig AS (SELECT batch, row_id, sum(val) AS yi FROM y GROUP BY 1, 2),
f AS (SELECT row_id, sum(val) / (SELECT sum(val) FROM y) AS rate FROM y GROUP BY 1), w0 AS (SELECT batch, row_id, 1.0 AS omega FROM f CROSS JOIN (SELECT DISTINCT batch FROM k)),
{_fit_round(1)}, {_fit_round(2)},
a AS (SELECT grp, batch, sum(mu * omega) AS a FROM u2 JOIN w2 USING (row_id) GROUP BY 1, 2), o AS (SELECT grp AS was, xor(grp, b) AS grp FROM (SELECT DISTINCT grp FROM k) CROSS JOIN (VALUES (1), (2), (4)) AS t(b)),
s AS (SELECT col_id, was, o.grp, batch, sum(val * (ln(t.mu) - ln(h.mu))) AS fit, sum(val) AS depth FROM y JOIN o ON o.was = y.grp JOIN u2 t ON t.grp = o.grp AND t.row_id = y.row_id JOIN u2 h ON h.grp = o.was AND h.row_id = y.row_id GROUP BY 1, 2, 3, 4)
SELECT col_id, was, s.grp, round(fit - depth * (t.a - h.a), 3) + 0.0 AS gain FROM s JOIN a t ON t.grp = s.grp AND t.batch = s.batch JOIN a h ON h.grp = s.was AND h.batch = s.batch""")
def q_mixed_gains(spark: SparkSession, d: str) -> DataFrame:
    """What every customer would gain in the groups one bit away, with rates of groups and factors of regions after two rounds."""
    m = orders_matrix(spark, d)
    y = stored(m.entries.filter("val > 0").withColumn("val", F.col("val").cast("double")), "counts")
    depth = y.groupBy("col_id").agg(F.sum("val").alias("depth"))
    code = F.col("col_id") % 8
    labels = stored(m.cells.select("col_id", "batch", code.alias("code"), code.alias("grp")).join(depth, "col_id", "left").fillna(0.0, ["depth"]), "labels")
    out = refine.gains(y, labels, refine.candidates(labels, 3), refine.MixedRefinement(rounds=2, tolerance=0.0))
    return out.select("col_id", "was", F.inline("options")).select("col_id", "was", "grp", (F.round("gain", 3) + F.lit(0.0)).alias("gain"))


@query()
def q_refined_mixed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sign-code groups of three regions each at least, refined by what the customers order."""
    m = orders_matrix(spark, d)
    of = m.cells.select("col_id", "batch")
    mixed = project.mixed_groups(project.adjusted(m, 8, of), 8, of, bits=5, min_batches=3)
    return refine.refined_mixed(m, mixed, 5, 3)
