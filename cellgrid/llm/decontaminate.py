"""Benchmark decontamination by pigeonhole edit matching.

An item may stand in a document with up to ``budget`` edits for each of its
characters. Cut into one piece more than the edits allowed, at least one piece
stands there unchanged; one automaton finds the pieces of all items, and each
hit is verified with Myers' bit-parallel edit distance around its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Edits allowed for each character of an item; items with fewer characters than ``SHORT`` allow none.
BUDGET, SHORT = 0.08, 24
#: Items matched in one pass over the documents; a larger benchmark takes several.
BLOCK_ITEMS = 4000


def normalized(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join(text.lower().split()) if text else ""


def allowed(item: str, budget: float) -> int:
    return int(budget * len(item)) if len(item) >= SHORT else 0


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Fewest edits that turn ``pattern`` into some part of ``text``, and the end of the first such part."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks = masks if masks is not None else bit_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Places of benchmark items in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: float) -> None:
        self.items = [(i, t) for i, t in items if t]
        self.edits = [allowed(t, budget) for _, t in self.items]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int, int]]] = {}
        for n, ((_, text), k) in enumerate(zip(self.items, self.edits, strict=True)):
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(text[a:b], []).append((n, a, b - a))
        self.pieces = ahocorasick.Automaton()
        for piece, where in found.items():
            self.pieces.add_word(piece, where)
        if found:
            self.pieces.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """``(item_id, edits, end)`` of the items in ``text``, fewest edits, first place."""
        if not self.items or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, list[int]] = {}
        for last, where in self.pieces.iter(text):
            for n, a, size in where:
                item, k = self.items[n][1], self.edits[n]
                start = last + 1 - size - a
                if len(item) < SHORT and not _bounded(text, start, start + len(item)):
                    continue  # a later place may be whole words
                if best.get(n, (1,))[0] == 0 or any(abs(start - s) <= k for s in done.get(n, ())[-8:]):
                    continue
                done.setdefault(n, []).append(start)
                lo = max(0, start - 2 * k)
                window = text[lo : start + len(item) + 2 * k]
                if (at := window.find(item)) >= 0:
                    edits, end = 0, at + len(item)
                else:
                    if n not in self.masks:
                        self.masks[n] = bit_masks(item)
                    edits, end = myers(item, window, self.masks[n])
                if edits <= k and (n not in best or edits < best[n][0]):
                    best[n] = (edits, lo + end)
        return sorted((self.items[n][0], e, end) for n, (e, end) in best.items())


def _bounded(text: str, a: int, b: int) -> bool:
    """A short item counts only as whole words."""
    return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded size, each block once on the driver."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    blocks = math.ceil(items.count() / BLOCK_ITEMS)
    for b in range(blocks):
        yield [(r[0], normalized(r[1])) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``(doc_id, item_id, edits, end)``: the items in each row of ``docs(doc_id, text, ...)``.

    ``end``: where the best place ends, in characters of the normalized text.
    Null and empty texts and items match nothing; repeated rows give equal
    rows; other columns are ignored. Without items the result is empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in item_blocks(benchmark):

        def run(parts: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            match = Matcher(items, budget)
            for part in parts:
                rows = [(d, *m) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True) for m in match(normalized(t.as_py()))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "end"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, edits long, end long")
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, end long") if out is None else out


def without_matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` in which no item stands; row by row, without a shuffle."""
    for items in item_blocks(benchmark):

        def run(parts: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            match = Matcher(items, budget)
            for part in parts:
                at = part.schema.get_field_index("text")
                yield part.filter(pa.array([not match(normalized(t.as_py())) for t in part.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a benchmark item stands, with the item."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
