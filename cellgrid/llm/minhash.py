"""Near-duplicate detection with circulant MinHash.

Two fixed permutations of a circle of ``POSITIONS`` places generate every
signature coordinate: the first sends a shingle to a place, the second,
shifted by ``k`` places, ranks the places for coordinate ``k``. Runs of
coordinates are hashed into bands; documents that share a band are candidates,
and every candidate pair is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.graph import components
from .common import looked_up, perhaps_in, stored, table
from .words import batches, mix

POSITIONS = 1 << 20
BANDS, ROWS = 28, 6
_BLOCK = 4096


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than a shingle give one, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(width, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix(acc ^ words[i : len(words) - n + 1 + i])
    return np.unique(acc)


class Circulant:
    """Signatures of all coordinates from two permutations, the second circularly shifted."""

    def __init__(self, coordinates: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.coordinates = coordinates
        # Place k of a circle of POSITIONS; the odd multiplier permutes the circle.
        self.mul = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        rank = rng.permutation(POSITIONS).astype(np.int32)
        self.runs = sliding_window_view(np.concatenate([rank, rank[:coordinates]]), coordinates)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = ((hashes * self.mul) >> np.uint64(44)).astype(np.int64)
        least = np.full(self.coordinates, POSITIONS, np.int32)
        for i in range(0, len(at), _BLOCK):
            np.minimum(least, self.runs[at[i : i + _BLOCK]].min(axis=0), out=least)
        return least

    def bands(self, hashes: np.ndarray, rows: int) -> np.ndarray:
        """One 64-bit key a band, the band's number mixed in."""
        sig = self(hashes).astype(np.uint64).reshape(-1, rows)
        acc = np.arange(len(sig), dtype=np.uint64)
        for i in range(rows):
            acc = mix(acc * np.uint64(31) ^ sig[:, i])
        return acc.view(np.int64)


def similar(inter: Column, a: Column, b: Column, percent: int) -> Column:
    """Jaccard similarity of at least ``percent`` hundredths, in whole numbers."""
    return 100 * inter >= percent * (a + b - inter)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n, node, bands)`` a row: shingle count, digest of the set (null if empty) and band keys."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = Circulant(BANDS * ROWS)
        for part in parts:
            n, node, bands = [], [], []
            for i, j, words, at, _ in batches(part.column("text")):
                for k in range(j - i):
                    own = shingles(words[at[k] : at[k + 1]], width)
                    n.append(len(own))
                    node.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    bands.append(circle.bands(own, ROWS) if len(own) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, node binary, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(node, own)``: every shingle hash of each document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, words, at, _ in batches(part.column("text")):
                node, own = [], []
                for k in range(j - i):
                    own.append(shingles(words[at[k] : at[k + 1]], width))
                    node.append(hashlib.blake2b(own[-1].tobytes(), digest_size=16).digest())
                    own[-1] = own[-1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    return docs.select("text").mapInArrow(run, "node binary, own array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(similar(inter, F.size("of_a"), F.size("of_b"), percent)).select("a", "b")


def near_in_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def central_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Of each band, its most central member with every other: a star, never all pairs.

    Central: in the fullest bands. An original shares more bands with its edited
    copies than they do with one another, so its star holds most links.
    """
    score = rows.groupBy("node").agg(F.sum("size").alias("score"))
    led = rows.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node", "n")).alias("lead"))
    return (
        looked_up(rows, "band", "node", led)
        .filter(F.col("lead.node") != F.col("node"))
        .filter(near_in_size(F.col("lead.n"), F.col("n"), percent))
        .select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b"))
        .distinct()
    )


def remaining_pairs(rows: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair that may still join two components: members of bands that hold several.

    Shingles are ordered from rare to common. Similar sets share one among the
    first ``n - ceil(percent * n) + 1`` of each, and what follows the first
    shared one bounds the intersection; both conditions are necessary, so no
    link is lost, and copies edited apart from one another meet in few pairs.
    """
    labelled = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_bands = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    members = looked_up(labelled, "band", "node", open_bands).select("node", "comp").distinct()
    held = stored(members.join(sets, "node").select("node", "comp", F.size("own").alias("n"), F.explode("own").alias("h")), "shingles")
    often = held.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("node")
    ranked = looked_up(held, "h", "node", often).withColumn("shared", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("df", "h")) - 1 + F.col("n") - F.col("shared"))
    first = stored(ranked.filter(F.col("at") < F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).select("node", "comp", "n", "h", F.col("at").cast("int").alias("at")), "prefixes")
    x, y = first.alias("x"), first.alias("y")
    bound = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return (
        x.join(y, "h")
        .filter((F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")))
        .filter(near_in_size(F.col("x.n"), F.col("y.n"), percent))
        .filter(similar(bound, F.col("x.n"), F.col("y.n"), percent))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )


def with_node(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``_node``: the digest of each row's set, null if empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            node = []
            for i, j, words, at, _ in batches(part.column(part.schema.get_field_index("text"))):
                for k in range(j - i):
                    own = shingles(words[at[k] : at[k + 1]], width)
                    node.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node, pa.binary())], [*part.schema.names, "_node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_node", BinaryType())]))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs(doc_id, text, ...)``.

    ``component_id``: the smallest ``doc_id`` reachable over links, a link being a
    similarity of word-shingle sets of at least ``percent`` hundredths. Null and
    empty texts have an empty set and no links; exact copies share one set, so
    one node stands for them all. Repeated rows give equal rows. A row without
    ``doc_id`` is its own component (null) and is kept unless it has links.
    An empty table gives an empty result; other columns are ignored.
    """
    out = grouped(docs, width, percent).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def shared_bands(drawn: DataFrame) -> DataFrame:
    """``(band, node, n, size)``: the bands of each set that another set has too, and how many have it.

    Nearly all bands are of one row. Bands of several rows are known to tasks as
    a bitmap, so that few others are shuffled with their sets.
    """
    rows = drawn.filter("n > 0").select("node", "n", F.explode("bands").alias("band"))
    several = stored(rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band"), "several")
    rows = stored(perhaps_in(rows, "band", several, "_several").filter("_several").select("node", "n", "band").distinct(), "dealt")
    full = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    return stored(looked_up(rows, "band", "node", full), "bands")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, node, comp, component_id)`` a row: its set and the component of sets, both null if empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = stored(sketch(docs, width).withColumn("at", F.monotonically_increasing_id()), "sketch")
    rows = shared_bands(drawn)
    shown = drawn.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(rows.select("node").distinct(), "node", "left_semi")
    shown = stored(shown.filter("doc_id is not null").select("doc_id"), "shown")
    # Only texts that may be asked for are shuffled. A text may stand only in rows without doc_id.
    holders = perhaps_in(docs, "doc_id", shown, "_shown").filter("_shown").select("doc_id", "text").join(shown, "doc_id", "left_semi").union(docs.filter("doc_id is null"))
    sets = stored(full_sets(holders, width).dropDuplicates(["node"]), "sets")
    links = stored(verified(central_pairs(rows, percent), sets, percent), "links")
    comps = components(links)
    more = stored(verified(remaining_pairs(rows, comps, sets, percent), sets, percent), "links")
    if not more.isEmpty():
        of = comps.select(F.col("node").alias("b"), F.col("comp").alias("of_b"))
        joined = more.join(of.withColumnsRenamed({"b": "a", "of_b": "of_a"}), "a", "left").join(of, "b", "left")
        over = components(joined.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
        over = over.withColumnsRenamed({"node": "was", "comp": "to"})
        ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("comp"))
        comps = comps.union(ends).join(over, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    least = stored(drawn.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "nodes")
    whole = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = looked_up(least, "comp", "node", whole).select("node", "comp", "component_id")
    # Exact copies share a node, rows without words have none; each row is dealt by itself.
    return looked_up(drawn.select("doc_id", F.col("n").alias("n_shingles"), "node", "at"), "node", "at", named, "left").drop("at")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 85 hundredths of their 3-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component the rows of its smallest ``doc_id`` stay.

    Of a component without any ``doc_id`` one row stays; rows without words all stay.
    """
    rows = stored(grouped(docs, width, percent), "groups")
    stays = F.bool_or(F.col("doc_id") == F.coalesce("component_id", "doc_id"))
    ids = stored(rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(stays.alias("stays")), "verdicts")
    kept, gone = ids.filter("stays").select("_id"), ids.filter("not stays").select("_id")
    # A row that is only in one of two bitmaps is decided where it is; no other text is shuffled.
    marked = perhaps_in(perhaps_in(docs.withColumn("_id", F.col("doc_id").cast("long")).filter("_id is not null"), "_id", kept, "_kept"), "_id", gone, "_gone").filter("_kept")
    named = marked.filter("not _gone").select(*docs.columns).union(marked.filter("_gone").join(kept, "_id", "left_semi").select(*docs.columns))
    alone = rows.filter("comp is not null and component_id is null").groupBy("comp").agg(F.min("node").alias("_node"))
    unnamed = with_node(docs.filter(F.col("doc_id").cast("long").isNull()), width)
    one = unnamed.join(alone, "_node", "left_semi").dropDuplicates(["_node"])
    return named.union(unnamed.filter("_node is null").select(*docs.columns)).union(one.select(*docs.columns))
