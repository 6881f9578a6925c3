"""License scan: ordered signature rules over the words of a text, in DataFrame operations alone.

A text's words are first met with the keywords of all rules; the patterns of
rules whose keywords all occur run over the numbered words, so each match
carries its place. A detection inside another of the same or a higher priority
is suppressed; the labels of the base phrases always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .license_rules import BASE, parsed
from .quality_rules import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEPT = "struct<active:array<struct<until:int,p:int>>,found:array<struct<start:int,end:int,label:string,p:int,base:boolean>>>"


def compiled(pattern: str) -> str:
    """A rule's pattern over numbered words, ``' word:0  word:1 '``."""
    return " " + pattern.replace(" ", ":[0-9]+  ") + ":[0-9]+ "


def detections(words: Column, present: Column) -> Column:
    """Kept detections of one text, by start: ``array<struct<start, end, label, p, base>>``; places count words from 0."""
    rules = F.array(*[
        F.struct(F.array(*map(F.lit, gates)).alias("gates"), F.lit(compiled(pattern)).alias("regex"), F.lit(label).alias("label"), F.lit(p).alias("p"), F.lit(base).alias("base"), F.lit(i).alias("order"))
        for i, (label, p, gates, pattern, base) in enumerate(parsed())
    ])
    numbered = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit(":"), i, F.lit(" "))), "")

    def matches(text: Column) -> Column:
        tried = F.filter(rules, lambda r: F.forall(r["gates"], lambda g: F.array_contains(present, g)))
        found = F.transform(tried, lambda r: F.transform(F.regexp_extract_all(text, r["regex"], F.lit(0)), lambda m: F.struct(
            F.regexp_extract(m, ":([0-9]+)", 1).cast("int").alias("start"),
            (-F.regexp_extract(m, ":([0-9]+) $", 1).cast("int")).alias("back"),
            (-r["p"]).alias("low"),
            r["order"].alias("order"),
            r["label"].alias("label"),
            r["base"].alias("base"),
        )))
        return F.sort_array(F.flatten(found))

    def step(s: Column, d: Column) -> Column:
        # In order of start, and from long to short, what holds a detection comes before it.
        return let(F.filter(s["active"], lambda a: a["until"] >= d["start"]), lambda active: F.struct(
            F.concat(active, F.array(F.struct((-d["back"]).alias("until"), (-d["low"]).alias("p")))).alias("active"),
            F.when(~d["base"] & F.exists(active, lambda a: (a["until"] >= -d["back"]) & (a["p"] >= -d["low"])), s["found"])
            .otherwise(F.concat(s["found"], F.array(F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), (-d["low"]).alias("p"), d["base"].alias("base"))))).alias("found"),
        ).cast(_KEPT))

    start = F.expr("named_struct('active', array(), 'found', array())").cast(_KEPT)
    return F.aggregate(let(numbered, matches), start, step, lambda s: s["found"])


def scanned(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, detections)``, a row for each row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no words and no detections. Row by row, without a
    shuffle: repeated rows give equal rows, other columns are ignored.
    """
    lowered = F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS, " "))
    keywords = sorted({g for r in parsed() for g in r[2]})
    none = F.expr("cast(array() as array<struct<start:int,end:int,label:string,p:int,base:boolean>>)")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.split(lowered, " "), lambda w: F.length(w) > 0).alias("words"))
        .withColumn("present", F.array_intersect("words", F.array(*map(F.lit, keywords))))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("present") > 0, detections(F.col("words"), F.col("present"))).otherwise(none).alias("detections"))
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, places and score of every document's licenses."""
    found = scanned(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform("based", lambda d: d["start"].cast("long"))
    labels = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    priority = F.coalesce(F.array_max(F.transform("detections", lambda d: d["p"])), F.lit(0))
    return found.withColumn("based", base).select(
        "doc_id", "n_words", F.size("based").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("based").alias("base_labels"), labels("detections").alias("labels"), (priority / 3.0).alias("score"),
    )
