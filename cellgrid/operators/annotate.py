"""Gene sets and ontologies: readers, propagation along the hierarchy, and reconciliation with features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import reachable


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """``(term, gene)``: upper-case genes, empty sets skipped, repeated terms joined."""
    return parse_gmt(spark.read.text(path))


def parse_gmt(lines: DataFrame) -> DataFrame:
    p = lines.select(F.split("value", "\t").alias("p")).filter(F.size("p") > 2)
    genes = p.select(F.trim(F.get("p", F.lit(0))).alias("term"), F.explode(F.slice("p", F.lit(3), F.size("p"))).alias("gene"))
    return genes.select("term", F.upper(F.trim("gene")).alias("gene")).filter("gene <> ''").distinct()


def parse_pairs(lines: DataFrame) -> DataFrame:
    """``(term, gene)`` of lines ``gene label``; a header line is skipped."""
    p = lines.select(F.split(F.trim("value"), "[\t, ]+").alias("p")).filter(F.size("p") >= 2)
    out = p.select(F.get("p", F.lit(1)).alias("term"), F.upper(F.get("p", F.lit(0))).alias("gene"))
    return out.filter(~F.lower("gene").isin("gene", "symbol", "gene_name")).distinct()


def parse_gaf(lines: DataFrame, iea: bool = True, evidence: list[str] | None = None) -> DataFrame:
    """``(term, gene, alias)`` of an annotation file: negated ones go, genes and proteins only; aliases are symbol, accession and synonyms."""
    p = lines.filter(~F.col("value").startswith("!")).select(F.split("value", "\t", -1).alias("p")).filter(F.size("p") >= 15)
    c = lambda i: F.get("p", F.lit(i))
    ok = c(4).startswith("GO:") & ~F.array_contains(F.split(c(3), "\\|"), "NOT") & F.lower(F.trim(c(11))).isin("protein", "gene", "gene_product", "")
    if not iea:
        ok = ok & (c(6) != "IEA")
    if evidence:
        ok = ok & c(6).isin(*evidence)
    names = F.array_distinct(F.concat(F.array(F.upper(c(2)), F.upper(c(1))), F.transform(F.split(c(10), "\\|"), lambda s: F.upper(F.trim(s)))))
    out = p.filter(ok).select(c(4).alias("term"), F.upper(c(2)).alias("gene"), F.explode(names).alias("alias"))
    return out.filter("alias <> '' and gene <> ''").distinct()


def parse_obo(text: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """Terms ``(id, name, namespace)`` and edges ``(child, parent, rel)`` of an ontology file; obsolete terms go."""
    terms, edges = [], []
    for block in text.split("\n[")[1:]:
        if not block.startswith("Term]"):
            continue
        fields: dict[str, list[str]] = {}
        for line in block.splitlines()[1:]:
            k, sep, v = line.partition(": ")
            if sep:
                fields.setdefault(k.strip(), []).append(v.split(" ! ")[0].strip())
        if "id" not in fields or fields.get("is_obsolete") == ["true"]:
            continue
        id_ = fields["id"][0]
        terms.append((id_, fields.get("name", [""])[0], fields.get("namespace", [""])[0]))
        edges += [(id_, p.split(" ")[0], "is_a") for p in fields.get("is_a", [])]
        edges += [(id_, r.split()[1], "part_of") for r in fields.get("relationship", []) if r.startswith("part_of ") and len(r.split()) > 1]
    return terms, edges


def closure(edges: DataFrame, part_of: bool = False) -> DataFrame:
    """``(term, ancestor)`` with each term itself, over ``edges(child, parent, rel)``."""
    used = edges if part_of else edges.filter("rel = 'is_a'")
    every = edges.select(F.col("child").alias("t")).union(edges.select("parent")).distinct()
    return every.select(F.col("t").alias("term"), F.col("t").alias("ancestor")).union(reachable(used)).distinct()


def propagated(annotations: DataFrame, up: DataFrame) -> DataFrame:
    """``(term, gene)`` along the true path: a gene of a term belongs to all its ancestors."""
    return annotations.join(up, "term").select(F.col("ancestor").alias("term"), "gene").distinct()


def set_rows(sets: DataFrame, features: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """``(term, row_id)`` of ``features(row_id, gene)``: terms with a size in bounds after matching."""
    met = sets.join(features.select("row_id", F.upper("gene").alias("gene")), "gene").select("term", "row_id").distinct()
    size = met.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most if most is not None else 1 << 62))
    return met.join(size.select("term"), "term", "left_semi")


def coverage(sets: DataFrame, features: DataFrame) -> DataFrame:
    """One row ``(genes, matched, share)``."""
    genes = sets.select("gene").distinct()
    n, k = genes.agg(F.count("*").alias("genes")), genes.join(features.select(F.upper("gene").alias("gene")), "gene", "left_semi").agg(F.count("*").alias("matched"))
    return n.crossJoin(k).select("genes", "matched", F.when(F.col("genes") > 0, F.col("matched") / F.col("genes")).otherwise(F.lit(0.0)).alias("share"))


def onehot(labels: DataFrame) -> DataFrame:
    """``(col_id, kind, w)``: weight 1 for the label of each cell."""
    return labels.select("col_id", F.col("label").alias("kind"), F.lit(1.0).alias("w"))


def soft_members(wide: DataFrame, key: str = "col_id") -> DataFrame:
    """``(col_id, kind, w)`` from a table with a weight column for each kind; zeros go."""
    kinds = [c for c in wide.columns if c != key]
    return wide.unpivot([key], kinds, "kind", "w").filter("w > 0")


def frozen(target: DataFrame, table: DataFrame) -> DataFrame:
    """``(row_id, row_name, vec)`` of the target's features that the table has a vector for, in the target's order."""
    return target.select("row_id", "row_name").join(table.select("row_name", "vec"), "row_name").select("row_id", "row_name", "vec")


def type_counts(features: DataFrame) -> DataFrame:
    """``(feature_type, n)``."""
    return features.groupBy(F.coalesce("feature_type", F.lit("")).alias("feature_type")).agg(F.count("*").alias("n"))
