"""More registered queries: graphs, names, gene sets, groups, stacked metrics, stores and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import align, annotate, collapse, genes, graph, knn, project, qc, sample, select, stats
from .plans.datasets import CELLS, FEATURES, orders_matrix, orders_sql, supply_matrix, table, vectors
from .plans.storage import run_dir
from .matrix import SparseMatrix
from .queries import _KNN, _METRICS, ORACLE_SQL, _matches, query, r6
from .sources import fragments, loading, mtx, store, tables

# -- graphs -----------------------------------------------------------------


@query("WITH n AS (SELECT p_partkey AS node, CASE WHEN lag(p_size) OVER (ORDER BY p_partkey) > 10 AND lag(p_partkey) OVER (ORDER BY p_partkey) = p_partkey - 1 THEN 0 ELSE 1 END AS cut FROM part), g AS (SELECT node, CAST(sum(cut) OVER (ORDER BY node) - 1 AS BIGINT) AS part FROM n) SELECT node, part, count(*) OVER (PARTITION BY part) AS size FROM g")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    """Parts linked to the next one where their size is above 10."""
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node"))
    edges = p.filter("p_size > 10").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")).join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    return graph.sized_components(nodes, edges)


@query("WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1), u AS (SELECT child, parent FROM e UNION SELECT u.child, e.parent FROM u JOIN e ON e.child = u.parent) SELECT child, parent FROM u")
def q_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors in the tree in which half a part's number is its parent."""
    return graph.reachable(table(spark, d, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent")))


# -- sets of rows and columns -----------------------------------------------


@query(f"WITH {FEATURES} SELECT row_name AS name, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM features WHERE row_id % 3 <> 0")
def q_rows_in_two(spark: SparkSession, d: str) -> DataFrame:
    return align.aligned_rows([orders_matrix(spark, d), supply_matrix(spark, d)], at_least=2)


@query(f"{orders_sql()} SELECT row_id, col_id, val FROM entries WHERE row_id IN (SELECT row_id FROM features WHERE p_brand LIKE 'Brand#1%') AND col_id IN (SELECT col_id FROM cells WHERE grp = 'BUILDING')")
def q_subset_both(spark: SparkSession, d: str) -> DataFrame:
    m = orders_matrix(spark, d)
    return select.keep_columns(select.keep_rows(m, m.features.filter("p_brand like 'Brand#1%'")), m.cells.filter("grp = 'BUILDING'")).entries


@query(f"{orders_sql()} SELECT row_id, val FROM entries WHERE col_id = 7")
def q_single_column(spark: SparkSession, d: str) -> DataFrame:
    return select.read_column(orders_matrix(spark, d), 7)


@query(f"{orders_sql()} SELECT col_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS row_ids, string_agg(CAST(CAST(val AS BIGINT) AS VARCHAR), ',' ORDER BY row_id) AS vals, count(*) AS n FROM entries GROUP BY 1")
def q_column_arrays(spark: SparkSession, d: str) -> DataFrame:
    a = select.dense_arrays(orders_matrix(spark, d))
    return a.select("col_id", F.array_join("row_ids", ",").alias("row_ids"), F.array_join(F.transform("vals", lambda v: v.cast("long")), ",").alias("vals"), F.size("vals").cast("long").alias("n"))


_TWICE = "CASE WHEN p_partkey % 4 = 0 THEN p_brand || '-' || (p_partkey % 7 + 1) ELSE p_brand END"


@query(f"WITH RECURSIVE f AS (SELECT p_partkey AS row_id, {_TWICE} AS n FROM part), k AS (SELECT row_id, n, row_number() OVER (PARTITION BY n ORDER BY row_id) - 1 AS k FROM f), t AS (SELECT DISTINCT regexp_extract(n, '^(.*)-([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(n, '^(.*)-([1-9][0-9]*)$', 2) AS BIGINT) AS s FROM f WHERE regexp_matches(n, '^(.*)-([1-9][0-9]*)$')), free AS (SELECT b.n, i.range AS s, row_number() OVER (PARTITION BY b.n ORDER BY i.range) AS k FROM (SELECT DISTINCT n FROM f) b CROSS JOIN (SELECT row_id + 1 AS range FROM f) i ANTI JOIN t ON t.base = b.n AND t.s = i.range) SELECT row_id, CASE WHEN k.k = 0 THEN n ELSE n || '-' || free.s END AS name FROM k LEFT JOIN free USING (n, k)")
def q_unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Brands as names, some of which hold a suffix already."""
    p = table(spark, d, "part")
    held = F.concat_ws("-", "p_brand", (F.col("p_partkey") % 7 + 1).cast("string"))
    named = p.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 4 == 0, held).otherwise(F.col("p_brand")).alias("name"))
    return select.unique_names(named, "name", "row_id")


@query(f"WITH {CELLS}, q AS (SELECT col_name AS query FROM cells UNION ALL SELECT col_name || '@x' FROM cells UNION ALL SELECT left(col_name, length(col_name) - 1) FROM cells), x AS (SELECT DISTINCT query FROM q), e AS (SELECT q.query, col_id FROM q JOIN cells ON col_name = query), b AS (SELECT q.query, col_id FROM q JOIN cells ON col_name = split_part(query, '@', 1) WHERE query NOT IN (SELECT query FROM e)) SELECT query, col_id, 0 AS tier FROM e UNION ALL SELECT query, col_id, 1 FROM b UNION ALL SELECT q.query, col_id, 2 FROM q JOIN cells ON starts_with(col_name, query) OR starts_with(query, col_name) WHERE query NOT IN (SELECT query FROM e) AND query NOT IN (SELECT query FROM b)")
def q_membership_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are, with a batch behind, and cut off: exact, base and prefix matches."""
    c = orders_matrix(spark, d).cells.select("col_id", "col_name")
    asked = c.select(F.col("col_name").alias("query")).union(c.select(F.concat("col_name", F.lit("@x")))).union(c.select(F.expr("left(col_name, length(col_name) - 1)")))
    return select.membership_matches(c, "col_name", asked).select("query", "col_id", "tier")


@query(f"WITH {CELLS} SELECT col_id, c_mktsegment AS grp FROM cells JOIN customer ON c_name = col_name")
def q_joined_groups(spark: SparkSession, d: str) -> DataFrame:
    return align.joined_groups(orders_matrix(spark, d), table(spark, d, "customer").select(F.col("c_name").alias("col_name"), F.col("c_mktsegment").alias("grp")))


@query("SELECT c_custkey AS col_id, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS label FROM customer")
def q_annotated_cells(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_name").alias("col_name"), F.col("c_mktsegment").alias("label"))
    return align.annotated(orders_matrix(spark, d), known, "label")


@query(f"WITH {FEATURES}, {CELLS} SELECT row_id, feature_type, p_brand FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, feature_type, p_brand FROM features WHERE row_id % 3 <> 0)")
def q_merged_types(spark: SparkSession, d: str) -> DataFrame:
    """Further columns of the features after a merge on the common rows."""
    return align.merge([orders_matrix(spark, d), supply_matrix(spark, d)], ["a", "b"], common_rows=True).features.select("row_id", "feature_type", "p_brand")


# -- names ------------------------------------------------------------------


@query(f"WITH {FEATURES} SELECT row_id FROM features WHERE lower(row_name) LIKE '%#_brand##13#_%' ESCAPE '#'")
def q_flexible_match(spark: SparkSession, d: str) -> DataFrame:
    return orders_matrix(spark, d).features.filter(names.flexible_match(F.col("row_name"), "brand#13")).select("row_id")


_SPELLED = "SELECT p_partkey AS row_id, 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS ens, 'x' || p_partkey AS plain, CASE p_size % 3 WHEN 0 THEN 'March' || p_size WHEN 1 THEN 'sept' || p_size ELSE 'tgfb' || p_size END AS symbol, CASE p_size % 3 WHEN 0 THEN 'MARCHF' || p_size WHEN 1 THEN 'SEPTIN' || p_size ELSE 'TGFB' || p_size END AS now, p_size FROM part"


@query(f"WITH s AS ({_SPELLED}) SELECT row_id, true AS is_ens, false AS plain_is_ens, now AS renamed, symbol AS gene, 'chr' || (row_id % 22 + 1) || ':' || row_id || '-' || (row_id + 5) AS locus FROM s")
def q_gene_spellings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").selectExpr("p_partkey AS row_id", "concat('ENSG', lpad(cast(p_partkey as string), 11, '0')) AS ens", "concat('x', p_partkey) AS plain", "concat(case p_size % 3 when 0 then 'March' when 1 then 'sept' else 'tgfb' end, p_size) AS symbol")
    spelled = F.concat_ws("-", F.concat(F.lit("chr"), F.col("row_id") % 22 + 1), "row_id", F.col("row_id") + 5)
    return s.select("row_id", names.is_ensembl(F.col("ens")).alias("is_ens"), names.is_ensembl(F.col("plain")).alias("plain_is_ens"), names.renamed(F.col("symbol")).alias("renamed"), names.gene_symbol(F.concat_ws("_", "ens", "symbol")).alias("gene"), names.spelled_locus(spelled).alias("locus"))


@query("SELECT p_partkey AS row_id, 'u' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '/x' ELSE '' END AS unit, 'm6a' AS modality, CASE WHEN p_size % 2 = 0 THEN 's' || p_size END AS subunit, 'site' AS channel FROM part")
def q_feature_row_grammar(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    unit = F.concat(F.lit("u"), F.col("p_partkey"), F.when(even, F.lit("/x")).otherwise(F.lit("")))
    name = F.concat_ws("/", unit, F.lit("m6a"), F.when(even, F.concat(F.lit("s"), F.col("p_size"))), F.lit("site"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), names.feature_row(name).alias("r")).select("row_id", "r.*")


@query("SELECT 'a' AS source, 'gene' AS kind UNION ALL SELECT 'b', 'locus' UNION ALL SELECT 'c', 'mixed' UNION ALL SELECT 'd', 'exact' FROM (SELECT count(*) AS n FROM part) WHERE n > 0")
def q_name_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    gene, locus = F.concat_ws("_", "p_partkey", "p_brand"), F.concat(F.lit("chr1:"), F.col("p_partkey"), F.lit("-"), F.col("p_partkey") + 1)
    kinds = {"a": gene, "b": locus, "c": F.when(F.col("p_partkey") % 2 == 0, gene).otherwise(locus), "d": F.concat(F.lit("7 "), F.col("p_partkey"))}
    out = None
    for k, c in kinds.items():
        one = names.name_kind(p.select(c.alias("n")), "n").select(F.lit(k).alias("source"), "kind")
        out = one if out is None else out.union(one)
    return out


_TIERS = """WITH v AS (SELECT p_partkey AS row_id, 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS ens, 'GENE' || p_partkey || 'Q' AS sym FROM part), f AS (SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'chr1:' || row_id || '-' || (row_id + 9) WHEN 1 THEN ens WHEN 2 THEN ens || '_' || sym WHEN 3 THEN ens || '_' || sym WHEN 4 THEN 'SEPTIN' || row_id ELSE ens || '_mid' || row_id || '_' || sym END AS row_name FROM v),
q AS (SELECT row_id, CASE row_id % 6 WHEN 0 THEN '1:' || row_id || '-' || (row_id + 9) WHEN 1 THEN lower(ens) WHEN 2 THEN lower(sym) WHEN 3 THEN ens || '.7' WHEN 4 THEN 'sept' || row_id ELSE 'MID' || row_id END AS query, CASE row_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS tier FROM v)"""


@query(f"{_TIERS} SELECT query, row_id, tier FROM q")
def q_gene_name_tiers(spark: SparkSession, d: str) -> DataFrame:
    """A query for each part, one of each of the six tiers in turn."""
    v = table(spark, d, "part").selectExpr("p_partkey AS row_id", "p_partkey % 6 AS k", "concat('ENSG', lpad(cast(p_partkey as string), 11, '0')) AS ens", "concat('GENE', p_partkey, 'Q') AS sym")
    f = v.selectExpr("row_id", "case k when 0 then concat('chr1:', row_id, '-', row_id + 9) when 1 then ens when 4 then concat('SEPTIN', row_id) when 5 then concat(ens, '_mid', row_id, '_', sym) else concat(ens, '_', sym) end AS row_name")
    q = v.selectExpr("case k when 0 then concat('1:', row_id, '-', row_id + 9) when 1 then lower(ens) when 2 then lower(sym) when 3 then concat(ens, '.7') when 4 then concat('sept', row_id) else concat('MID', row_id) end AS query")
    return names.reconciled(q, f)


@query(f"{orders_sql()}, n AS (SELECT count(*) AS n FROM cells) SELECT row_id, round(ln(n / count(*)), 6) AS idf FROM entries CROSS JOIN n GROUP BY row_id, n")
def q_idf(spark: SparkSession, d: str) -> DataFrame:
    m = orders_matrix(spark, d)
    total = m.cells.agg(F.count("*").alias("n"))
    return m.entries.groupBy("row_id").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("row_id", F.round(names.idf(F.col("n"), F.col("df")), 6).alias("idf"))


# -- gene sets --------------------------------------------------------------


@query("SELECT DISTINCT p_brand AS term, 'G' || p_partkey AS gene FROM part")
def q_set_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return annotate.parse_pairs(p.select(F.concat(F.lit("g"), F.col("p_partkey"), F.lit("\t"), F.col("p_brand")).alias("value")).union(spark.createDataFrame([("gene\tlabel",)], "value string")))


@query("WITH g AS (SELECT p_partkey AS k, 'GO:' || p_size AS term FROM part WHERE p_size > 5 AND p_size <= 45) SELECT term, 'S' || k AS gene, 'S' || k AS alias FROM g UNION ALL SELECT term, 'S' || k, 'A' || k FROM g UNION ALL SELECT term, 'S' || k, 'X' || k FROM g")
def q_annotation_file(spark: SparkSession, d: str) -> DataFrame:
    k, blank = F.col("p_partkey"), F.lit("")
    cols = [F.lit("db"), F.concat(F.lit("a"), k), F.concat(F.lit("s"), k), F.when(F.col("p_size") > 45, "NOT|part_of").otherwise(blank), F.concat(F.lit("GO:"), F.col("p_size")), blank, F.when(F.col("p_size") <= 5, "IEA").otherwise("EXP"), blank, blank, blank, F.concat(F.lit("x"), k, F.lit("| ")), F.lit("protein"), blank, blank, blank]
    return annotate.parse_gaf(table(spark, d, "part").select(F.concat_ws("\t", *cols).alias("value")), iea=False)


@query("SELECT count(*) AS genes, count(*) FILTER (p_size > 25) AS matched, round(count(*) FILTER (p_size > 25) / count(*), 6) AS share FROM part")
def q_set_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.concat(F.lit("G"), F.col("p_partkey")).alias("gene"), "p_size")
    return annotate.coverage(p, p.filter("p_size > 25")).select("genes", "matched", *r6("share"))


@query("SELECT c_custkey AS col_id, c_mktsegment AS kind, 1.0 AS w FROM customer UNION ALL SELECT c_custkey, 'rich', c_acctbal FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey > 0")
def q_memberships(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    hard = annotate.onehot(c.select(F.col("c_custkey").alias("col_id"), F.col("c_mktsegment").alias("label")))
    return hard.union(annotate.soft_members(c.select(F.col("c_custkey").alias("col_id"), F.col("c_acctbal").alias("rich"), F.col("c_nationkey").cast("double").alias("nation"))))


@query(f"WITH {FEATURES} SELECT row_id, row_name, CAST(row_id * 2 AS DOUBLE) AS first FROM features WHERE row_id % 3 <> 0")
def q_frozen_features(spark: SparkSession, d: str) -> DataFrame:
    known = supply_matrix(spark, d).features.select("row_name", F.array((F.col("row_id") * 2).cast("double")).alias("vec"))
    return annotate.frozen(orders_matrix(spark, d).features, known).select("row_id", "row_name", F.get("vec", F.lit(0)).alias("first"))


# -- groups and metrics -----------------------------------------------------


@query(f"{orders_sql()} SELECT col_id, CAST(count(*) FILTER (val > 0) + count(*) FILTER (val > 0 AND row_id % 3 <> 0) AS BIGINT) AS n_genes, coalesce(sum(val), 0) + coalesce(sum(val) FILTER (row_id % 3 <> 0), 0) AS total_counts FROM cells LEFT JOIN entries USING (col_id) GROUP BY 1")
def q_stacked_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = orders_matrix(spark, d)
    some = select.keep_rows(m, m.features.filter("row_id % 3 <> 0"))
    return qc.stacked_metrics([qc.metrics(m), qc.metrics(some)]).select("col_id", "n_genes", "total_counts")


_EXEMPT = """o AS (SELECT q.*, grp = 'BUILDING' AS ex, grp <> 'BUILDING' AND n_genes < 2 AS near_empty, grp <> 'BUILDING' AND n_genes >= 2 AND total_counts < 60 AS out_ FROM q JOIN cells USING (col_id)), v AS (SELECT col_id, near_empty, out_ AND (SELECT bool_or(NOT out_) FROM o) AS outlier FROM o)"""


@query(f"{orders_sql()}, {_METRICS}, {_EXEMPT} SELECT col_id, near_empty, outlier, NOT outlier AS train_keep, NOT outlier AND NOT near_empty AS emitted FROM v")
def q_qc_exempt(spark: SparkSession, d: str) -> DataFrame:
    m = orders_matrix(spark, d)
    cells = qc.metrics(m).join(m.cells.select("col_id", "grp"), "col_id")
    return qc.verdicts(cells, qc.QcRules(min_counts=60, mads_on=()), F.col("grp") == "BUILDING").select("col_id", "near_empty", "outlier", "train_keep", "emitted")


@query("SELECT c_custkey AS col_id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS grp FROM customer")
def q_labelled_groups(spark: SparkSession, d: str) -> DataFrame:
    return collapse.labelled_groups(table(spark, d, "customer").select(F.col("c_custkey").alias("col_id"), "c_mktsegment"), "c_mktsegment")


@query("SELECT c_mktsegment AS label, least(count(*), 15) AS n FROM customer GROUP BY 1")
def q_capped_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("col_id"), "c_mktsegment")
    return collapse.labelled_groups(c, "c_mktsegment", cap=15).join(c, "col_id").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))


@query(f"{orders_sql()} SELECT 'sums' AS part, row_id AS a, batch AS b, round(sum(val), 6) AS val FROM entries JOIN cells USING (col_id) GROUP BY 2, 3 UNION ALL SELECT 'sizes', CAST(NULL AS BIGINT), batch || '/' || grp, CAST(count(*) AS DOUBLE) FROM cells GROUP BY batch, grp")
def q_batch_sums(spark: SparkSession, d: str) -> DataFrame:
    m = orders_matrix(spark, d)
    sums, sizes = collapse.batch_sums(m, m.cells.select("col_id", "batch", "grp"))
    return sums.select(F.lit("sums").alias("part"), F.col("row_id").alias("a"), F.col("batch").alias("b"), *r6("val")).union(sizes.select(F.lit("sizes"), F.lit(None).cast("long"), F.concat_ws("/", "batch", "grp"), "n"))


@query(f"{orders_sql()} SELECT row_id, batch AS grp, round(sum(val), 6) AS val FROM entries JOIN cells USING (col_id) GROUP BY 1, 2")
def q_merged_levels(spark: SparkSession, d: str) -> DataFrame:
    """Sums by batch and segment, added up to those of the batches."""
    m = orders_matrix(spark, d)
    fine = m.cells.select("col_id", F.concat_ws("/", "batch", "grp").alias("grp"), "batch")
    sums, _ = collapse.group_sums(m, fine)
    return collapse.merged_levels(sums, fine.select("grp", F.col("batch").alias("coarse")).distinct()).select("row_id", "grp", *r6("val"))


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey AS row_id, round(CAST(n AS DOUBLE) - ln(n), 6) AS val FROM part JOIN n USING (p_brand)")
def q_expanded_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    mapping = p.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("coarse"))
    coarse = p.groupBy(F.col("p_brand").alias("row_id")).agg(F.count("*").cast("double").alias("val"))
    return genes.expanded(coarse, mapping, log_split=True).select("row_id", *r6("val"))


@query("SELECT greatest(1, least(count(DISTINCT n_name) - 1, CAST(round(0.3 * count(DISTINCT n_name)) AS BIGINT))) AS n_test, count(DISTINCT n_name) AS n FROM nation")
def q_test_groups(spark: SparkSession, d: str) -> DataFrame:
    f = sample.folds(table(spark, d, "nation").select(F.col("n_name").alias("grp")), test_fraction=0.3)
    return f.agg(F.sum(F.col("test").cast("long")).alias("n_test"), F.count("*").alias("n"))


@query("SELECT c_custkey AS left_id, c_custkey + 1 AS right_id FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)")
def q_pair_visitor(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("left"))
    pairs = c.withColumn("right", F.col("left") + 1).join(c.withColumnRenamed("left", "right"), "right", "left_semi").select("left", "right")
    return collapse.visit_pairs(pairs, lambda p: p.rename(columns={"left": "left_id", "right": "right_id"})[["left_id", "right_id"]], "left_id long, right_id long")


@query(f"{orders_sql()}, p AS (SELECT col_id AS l, col_id + 1 AS r FROM cells WHERE col_id + 1 IN (SELECT col_id FROM cells)), a AS (SELECT l, r, row_id, val FROM p JOIN entries ON col_id = l), b AS (SELECT l, r, row_id, val FROM p JOIN entries ON col_id = r) SELECT coalesce(a.l, b.l) AS l, coalesce(a.r, b.r) AS r, coalesce(a.row_id, b.row_id) AS row_id, coalesce(a.val, 0) AS of_left, coalesce(b.val, 0) AS of_right FROM a FULL JOIN b ON a.l = b.l AND a.r = b.r AND a.row_id = b.row_id")
def q_pair_values(spark: SparkSession, d: str) -> DataFrame:
    m = orders_matrix(spark, d)
    edges = m.cells.select(F.col("col_id").alias("left"), (F.col("col_id") + 1).alias("right")).join(m.cells.select(F.col("col_id").alias("right")), "right", "left_semi")
    return knn.pair_values(edges, m.entries).withColumnsRenamed({"left": "l", "right": "r"})


@query(f"{orders_sql()} SELECT c.col_name AS left_cell, e.col_name AS right_cell, CAST(1 AS DOUBLE) AS weight FROM cells c JOIN cells e ON e.col_id = c.col_id + 1")
def q_pair_table(spark: SparkSession, d: str) -> DataFrame:
    c = orders_matrix(spark, d).cells
    edges = c.select(F.col("col_id").alias("left"), (F.col("col_id") + 1).alias("right"), F.lit(1.0).alias("weight"))
    return tables.pair_table(edges, c)


# -- stores and files -------------------------------------------------------


@query(f"{orders_sql()} SELECT row_id, col_id, val FROM entries WHERE col_id IN (3, 7, 11)")
def q_store_columns(spark: SparkSession, d: str) -> DataFrame:
    path = _written(spark, d)
    return store.select_columns(spark, path, [3, 7, 11])


@query(f"{orders_sql()} SELECT row_id, col_id, val FROM entries WHERE row_id IN (2, 5, 9)")
def q_store_rows(spark: SparkSession, d: str) -> DataFrame:
    return store.select_rows(spark, _written(spark, d), [2, 5, 9])


def _written(spark: SparkSession, d: str) -> str:
    import uuid

    path = f"{run_dir(spark)}/matrix-{uuid.uuid4().hex}"
    store.write(orders_matrix(spark, d), path)
    return path


@query(f"{orders_sql()} SELECT row_name, col_name, val FROM entries JOIN features USING (row_id) JOIN cells USING (col_id)")
def q_mtx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The orders matrix written as a MatrixMarket set and read back, by names."""
    import uuid

    m = orders_matrix(spark, d)
    path = f"{run_dir(spark)}/mex-{uuid.uuid4().hex}"
    mtx.write_mex(m, path)
    back = mtx.read_mtx(spark, f"{path}/matrix.mtx", f"{path}/features.tsv", f"{path}/barcodes.tsv")
    return back.entries.join(back.features, "row_id").join(back.cells, "col_id").select("row_name", "col_name", "val")


@query("SELECT CAST(p_partkey % 22 + 1 AS VARCHAR) AS chrom, p_partkey * 10 AS start, p_partkey * 10 + p_size AS stop FROM part")
def q_bed_peaks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    lines = p.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_partkey") % 22 + 1), F.col("p_partkey") * 10, F.col("p_partkey") * 10 + F.col("p_size"), F.lit("peak")).alias("value"))
    return fragments.parse_bed(lines.union(spark.createDataFrame([("track x",), ("# c",), ("chr1\t9\t9",)], "value string")))


@query("SELECT c_name AS col_name, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y FROM customer WHERE c_nationkey <> 3")
def q_coordinates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return tables.coordinates(c.select("c_name", F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") == 3, "NaN").otherwise(F.col("c_acctbal").cast("string")).alias("y")))


@query(f"{orders_sql()} SELECT col_name AS cell, nnz FROM cells JOIN (SELECT col_id, count(*) AS nnz FROM entries GROUP BY 1) USING (col_id)")
def q_statistics_file(spark: SparkSession, d: str) -> DataFrame:
    """Statistics written as tab-separated text and read back."""
    import uuid

    m = orders_matrix(spark, d)
    path = f"{run_dir(spark)}/stats-{uuid.uuid4().hex}.tsv"
    own = stats.column_stats(m).filter("nnz > 0").join(m.cells, "col_id").select(F.col("col_name").alias("cell"), "nnz")
    tables.write_statistics(own, path)
    return spark.read.option("sep", "\t").option("header", True).schema("cell string, nnz long").csv(path)


# -- shared rows, contrasts, fixed-order sums -------------------------------

_SUPPLY = "supply AS (SELECT l_partkey AS row_id, l_suppkey AS sup, sum(l_quantity) AS val FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1, 2)"
_LOADED = f"""{_SUPPLY}, a AS (SELECT col_name || '@' || batch || '@orders' AS col_name, batch, count(val) AS n, coalesce(sum(val), 0) AS tot FROM cells LEFT JOIN entries USING (col_id) GROUP BY 1, 2), b AS (SELECT s_name || '@supply' AS col_name, 'supply' AS batch, count(val) AS n, coalesce(sum(val), 0) AS tot FROM supplier LEFT JOIN supply ON s_suppkey = sup GROUP BY 1, 2), c AS (SELECT *, n >= 2 AND tot < 60 AS bad FROM (SELECT *, false AS free FROM a UNION ALL SELECT *, true FROM b))"""


@query(f"{orders_sql()}, {_LOADED} SELECT col_name, batch, n AS n_genes, free OR n >= 2 AS emitted FROM c WHERE free OR NOT bad")
def q_shared_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers tagged with their region and suppliers without a tag, on all parts; suppliers are not judged."""
    m = orders_matrix(spark, d)
    tagged = m.with_(cells=m.cells.withColumn("col_name", F.concat_ws("@", "col_name", "batch")))
    got = loading.shared_rows([tagged, supply_matrix(spark, d)], ["orders", "supply"], keep_empty=True, exempt=[False, True], rules=qc.QcRules(min_counts=60, mads_on=()))
    n = got.matrix.entries.groupBy("col_id").agg(F.count("*").alias("n_genes"))
    out = got.matrix.cells.join(n, "col_id", "left").join(got.emitted.withColumn("_e", F.lit(True)), "col_id", "left")
    return out.select("col_name", "batch", F.coalesce("n_genes", F.lit(0)).cast("long").alias("n_genes"), F.coalesce("_e", F.lit(False)).alias("emitted"))


@query(f"{orders_sql()} SELECT col_id, CASE WHEN grp = 'BUILDING' THEN 'all' ELSE grp END AS batch, coalesce(sum(val), 0) * 2 AS tot, count(DISTINCT row_id) * 2 AS n_rows FROM cells LEFT JOIN entries USING (col_id) GROUP BY 1, 2")
def q_folded_columns(spark: SparkSession, d: str) -> DataFrame:
    """The same customers in two parts whose rows are kept apart: each is one column with the values of both; segments are tags but for one."""
    m = orders_matrix(spark, d)
    name = F.when(F.col("grp") == "BUILDING", F.col("col_name")).otherwise(F.concat_ws("@", "col_name", "grp"))
    m = m.with_(cells=m.cells.withColumn("col_name", name))
    got = loading.shared_rows([m, m], ["a", "b"], columns="union", row_suffixes=["plain", "again"], keep_empty=True).matrix
    sums = got.entries.groupBy("col_id").agg(F.sum("val").alias("tot"), F.count("*").alias("n_rows"))
    out = got.cells.join(sums, "col_id", "left").join(m.cells.select("col_name", F.col("col_id").alias("_id")), "col_name")
    return out.select(F.col("_id").alias("col_id"), "batch", F.coalesce("tot", F.lit(0.0)).alias("tot"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


@query(f"{orders_sql()} SELECT col_id, col_name, grp FROM cells WHERE batch = 'ASIA'")
def q_kept_sides(spark: SparkSession, d: str) -> DataFrame:
    """Names and groups of the cells under one mask."""
    c = orders_matrix(spark, d).cells
    names_, groups = select.keep_sides(c.filter("batch = 'ASIA'"), "col_id", c.select("col_id", "col_name"), c.select("col_id", "grp"))
    return names_.join(groups, "col_id")


@query(f"{orders_sql()} SELECT row_id, round(sum(val / 3), 6) AS tot FROM entries GROUP BY 1")
def q_fixed_order_sums(spark: SparkSession, d: str) -> DataFrame:
    e = orders_matrix(spark, d).entries.withColumn("val", F.col("val") / 3)
    return stats.fixed_order_sums(e, "row_id", "col_id", block=64).select("row_id", *r6("tot"))


@query(f"{orders_sql()}, s AS (SELECT batch AS split, row_id, coalesce(sum(val) FILTER (grp <> 'BUILDING'), 0) AS l, coalesce(sum(val) FILTER (grp = 'BUILDING'), 0) AS r FROM entries JOIN cells USING (col_id) GROUP BY 1, 2), t AS (SELECT split, greatest(sum(l), 1) AS nl, greatest(sum(r), 1) AS nr FROM s GROUP BY 1), o AS (SELECT *, CASE WHEN r * 4 > l THEN 'right' ELSE 'left' END AS side, r * 4 - l AS loading FROM s JOIN t USING (split) WHERE r * 4 <> l), k AS (SELECT *, row_number() OVER (PARTITION BY split, side ORDER BY abs(loading) DESC, CASE side WHEN 'right' THEN row_id ELSE -row_id END) AS rank FROM o) SELECT split, side, rank, row_id, loading, round(ln((r + 0.5) / nr) - ln((l + 0.5) / nl), 6) AS lfc, CAST(1 AS DOUBLE) AS weight FROM k WHERE rank <= 20")
def q_contrast_features(spark: SparkSession, d: str) -> DataFrame:
    """Parts that tell one segment from the rest within each region."""
    m = orders_matrix(spark, d)
    own = F.col("grp") == "BUILDING"
    sums = m.entries.join(m.cells, "col_id").groupBy(F.col("batch").alias("split"), "row_id").agg(F.sum(F.when(own, 0.0).otherwise(F.col("val"))).alias("of_left"), F.sum(F.when(own, F.col("val")).otherwise(0.0)).alias("of_right"))
    loadings = sums.select("split", "row_id", (F.col("of_right") * 4 - F.col("of_left")).alias("loading"))
    return genes.contrast_features(loadings, sums, 20).select("split", "side", "rank", "row_id", "loading", *r6("lfc"), "weight")


@query("WITH k AS (SELECT CAST(label AS VARCHAR) AS batch, vec_id AS match, sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.125) * (CAST(x AS DOUBLE) - 0.125)))) AS dist FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY dist, match) AS rank FROM k) SELECT batch, match, round(dist, 5) AS dist, rank FROM r WHERE rank <= 3")
def q_nearest_to_vector(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest_to([0.125] * 64, vectors(spark, d), 3).select("batch", "match", F.round("dist", 5).alias("dist"), "rank")


_WEIGHED = f"WITH {_KNN}, b AS (SELECT *, min(dist) OVER (PARTITION BY source) AS low FROM k WHERE rank <= 3), x AS (SELECT source, batch, match, exp(low - dist) AS w FROM b), n AS (SELECT source % 4 AS grp, batch, match, w / sum(w) OVER (PARTITION BY source) AS w FROM x)"


def _vector_stat(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, d)
    e = v.select(F.posexplode("vec").alias("row_id", "val"), F.col("id").alias("col_id")).select(F.col("row_id").cast("long").alias("row_id"), "col_id", F.col("val").cast("double").alias("val"))
    cells = v.select(F.col("id").alias("col_id"), (F.col("id") % 4).alias("grp"))
    return collapse.matched_stat(SparseMatrix(e, e.select("row_id").distinct(), cells), _matches(spark, d, 3), cells)


@query(f"{_WEIGHED}, e AS (SELECT vec_id AS match, unnest(range(0, 64)) AS row_id, unnest(embedding) AS val FROM embeddings) SELECT row_id, grp, round(sum(w * val), 5) AS val FROM n JOIN e USING (match) GROUP BY 1, 2")
def q_matched_sums(spark: SparkSession, d: str) -> DataFrame:
    """Places of the vectors imputed for the sources, by group."""
    return _vector_stat(spark, d)[0].select("row_id", "grp", F.round("val", 5).alias("val"))


@query(f"{_WEIGHED} SELECT batch, grp, round(sum(w), 5) AS w FROM n GROUP BY 1, 2")
def q_matched_mass(spark: SparkSession, d: str) -> DataFrame:
    """Batches from which each group's imputed mass comes."""
    return _vector_stat(spark, d)[1].select("batch", "grp", F.round("w", 5).alias("w"))


@query("SELECT (SELECT least(count(*), 40) FROM customer) AS cells, (SELECT least(count(*), 60) FROM part) AS features, true AS inside")
def q_sampled_both(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of a draw of 40 columns and 60 rows, and whether the entries lie on both."""
    m = sample.both(orders_matrix(spark, d), 40, 60)
    off = m.entries.join(m.cells, "col_id", "left_anti").union(m.entries.join(m.features, "row_id", "left_anti"))
    return m.cells.agg(F.count("*").alias("cells")).crossJoin(m.features.agg(F.count("*").alias("features"))).crossJoin(off.agg((F.count("*") == 0).alias("inside")))


@query(ORACLE_SQL["fisher_weights"])
def q_weights_file(spark: SparkSession, d: str) -> DataFrame:
    """Weights written by name and read back."""
    import uuid

    m = orders_matrix(spark, d)
    path = f"{run_dir(spark)}/weights-{uuid.uuid4().hex}"
    tables.write_weights(m.features, genes.fisher_weights(stats.row_stats(m), m.cells.count()), path)
    return tables.read_weights(m.features, path).select("row_id", *r6("weight"))


@query("SELECT p_partkey AS row_id, p_type AS feature_type FROM part")
def q_types_file(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    m = orders_matrix(spark, d)
    path = f"{run_dir(spark)}/types-{uuid.uuid4().hex}"
    tables.write_types(m.features, path)
    return tables.read_types(m.features.select("row_id", "row_name"), path).select("row_id", "feature_type")


@query()
def q_mixed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sign-code groups of the adjusted projection, of three regions each at least."""
    m = orders_matrix(spark, d)
    of = m.cells.select("col_id", "batch")
    return project.mixed_groups(project.adjusted(m, 8, of), 8, of, bits=5, min_batches=3)
