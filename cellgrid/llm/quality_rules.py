"""Quality rules with risk-controlled cutoffs, in DataFrame operations alone.

Each rule rejects a document whose ratio exceeds a cutoff. The cutoffs come
from labelled documents: in every stratum and for every rule the cutoffs are
tried from lenient to strict, and the strictest one is taken whose exact
binomial (Clopper-Pearson) bound on the share of good documents it rejects
stays below the rule's part of the risk. Going from lenient to strict is a
fixed sequence of tests and needs no further correction; the error level is
divided over strata and rules (Bonferroni), the risk over the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, stored, table

#: Strata with cutoffs of their own; any other language counts as "other".
STRATA = ("en", "de", "fr", "es")
#: Good documents that may be rejected wrongly in a stratum, and the chance that this is exceeded anywhere.
RISK, DELTA = 0.03, 0.05
#: Cutoffs of each rule from lenient to strict.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015),
    "dup_line_share": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12),
    "long_words": (60, 40, 30, 24, 20, 17, 15, 13, 12, 11),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows become 64-bit hashes; only texts with an equal pair are sorted.
    """
    n = F.size(words)
    m = F.greatest(n - 2, F.lit(0))
    windows = F.transform(F.arrays_zip(F.slice(words, 1, m), F.slice(words, 2, m), F.slice(words, 3, m)), lambda x: F.xxhash64(x["0"], x["1"], x["2"]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(1), F.size(h)).alias("at")))

        def repeated(p: Column) -> Column:
            twice = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)))
            at = F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
            return F.size(F.array_distinct(F.flatten(at)))

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, repeated)).otherwise(F.lit(0))

    return F.when(n >= 4, let(windows, covered)).otherwise(F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and ratios that the rules use; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(rf"[^{WS}]"))
    out = docs.withColumn("_text", text).withColumns({"_words": F.regexp_extract_all("_text", F.lit(rf"[^{WS}]+"), F.lit(0)), "_lines": lines})
    chars = F.length(F.regexp_replace("_text", rf"[{WS}]+", ""))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": chars,
        "n_symbols": F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeat_words(F.col("_words")),
        "n_upper": F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", "")),
    }
    return out.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_text", "_words", "_lines")


def ratios(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "long_words": share("word_chars", "n_words"),
        "stratum": F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(F.lit("other")),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) of n trials of chance p, by the recurrence of the terms in logarithms."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + odds
        return let(term, lambda t: F.struct(t.alias("term"), (F.greatest(s["total"], t) + F.log1p(F.exp(-F.abs(s["total"] - t)))).alias("total")))

    start = F.struct(first.alias("term"), first.alias("total"))
    return F.when(k == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, step, lambda s: s["total"]))


def cutoffs(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(stratum, cut_<rule>...)`` from good documents with ``ratios``; no cutoff (null) where no test passes.

    At most ``len(STRATA) + 1`` rows.
    """
    level = F.log(F.lit(delta / (len(RULES) * (len(STRATA) + 1))))
    part = risk / len(RULES)
    over = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)]
    counted = good.groupBy("stratum").agg(F.count("*").alias("n"), *over)

    def strictest(rule: str, cs: tuple[float, ...]) -> Column:
        # The counts grow from lenient to strict, so the cutoffs that pass come first.
        passed = [F.when((F.col(f"{rule}_{i}") <= part * F.col("n")) & (log_binomial_cdf(F.col(f"{rule}_{i}"), F.col("n"), part) <= level), F.lit(float(c))) for i, c in enumerate(cs)]
        return F.array_min(F.array_compact(F.array(*passed)))

    return counted.select("stratum", *[strictest(r, cs).alias(f"cut_{r}") for r, cs in RULES.items()])


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by)``, a row a document.

    Null texts have no words and fail the base rules; a document with several
    labels counts as good if one says so; strata without enough labels have no
    cutoffs and reject nothing beyond the base rules. Repeated rows give equal
    rows, an empty table an empty result, other columns are ignored.
    """
    counts = stored(measured(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    seen = ratios(counts)
    good = labels.filter("quality = 1").select("doc_id").distinct()
    limits = F.broadcast(cutoffs(seen.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi"), risk, delta))
    by = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = seen.join(limits, "stratum", "left").withColumn("rejected_by", by)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("rejected_by", ",").alias("rejected_by"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the base rules and the cutoffs of its language."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def passing(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass; columns stay as they are.

    Each text is measured once: the rows are written with their counts, the
    cutoffs come from the labelled ones, then each row is judged where it is.
    No text is shuffled.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "lang", "text")
    seen = ratios(stored(measured(rows).drop("text"), "quality"))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    limits = F.broadcast(cutoffs(seen.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi"), risk, delta))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return seen.join(limits, "stratum", "left").filter(~F.col("base_failed") & ~rejected).select("row.*")
