"""Best-fit packing of documents into sequences by a configuration linear program.

The program runs over the histogram of piece lengths, at most ``capacity``
entries whatever the input: a configuration is a multiset of lengths that fits
one sequence, and each length must be covered as often as it occurs.
Multiplicative weights are prices that fall as a length gets covered; a
knapsack dynamic program gives the highest price that fits any room, from which
every length that lags behind gets its best configuration. The solution is
rounded down, then each fraction once while its pieces last, and the program
is solved again for the rest. The last few pieces fill gaps best-fit, by counts
of a length. Time and memory depend on the number of lengths, not of pieces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, width
from .tokens import VOCABULARY, pieces

CAPACITY = 2048
#: Rounds of a solution, and how fast the price of a covered length falls.
ROUNDS, FALL = 12, 4.0
#: The share of the pieces that fills gaps in the end; never more pieces than ``capacity``.
REST = 0.05


def knapsack(price: np.ndarray, capacity: int) -> np.ndarray:
    """The highest price that fits in each room from 0 to ``capacity``; ``price``: of each length, 0 for absent ones."""
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max(best[room - 1], (price[room:0:-1] + best[:room]).max())
    return best


def filled(price: np.ndarray, best: np.ndarray, counts: np.ndarray, first: int) -> list[int]:
    """``first`` and the lengths of the highest price beside it, longest first among equals; none more often than it occurs."""
    config, room, gone = [first], len(best) - 1 - first, {}
    if counts[first] == 1:
        gone[first], price[first] = price[first], 0
    while room > 0:
        x = room - int((price[room:0:-1] + best[:room]).argmax())
        if price[x] <= 0:  # the room was priced before a length ran out
            on = np.flatnonzero(price[1 : room + 1])
            if not len(on):
                break
            x = int(on[-1]) + 1
        config.append(x)
        room -= x
        if config.count(x) >= counts[x]:
            gone[x], price[x] = price[x], 0
    for x, p in gone.items():
        price[x] = p
    return config


def program(counts: np.ndarray, capacity: int, full: bool) -> dict[tuple[int, ...], float]:
    """A solution of the linear program: how often each configuration is used; no length is covered beyond its count.

    ``full``: configurations with a gap wait for the last round.
    """
    lengths = np.flatnonzero(counts)[::-1].tolist()
    part = np.arange(capacity + 1) / capacity
    base = np.where(counts > 0, part * (1 + 0.1 * part), 0)
    price, covered, taken = base.copy(), [0.0] * (capacity + 1), Counter()
    for t in range(1, ROUNDS + 1):
        best = knapsack(price, capacity)
        for x in lengths:
            if covered[x] >= t / ROUNDS - 1e-9:
                continue
            config = filled(price, best, counts, x)
            if full and t < ROUNDS and sum(config) < capacity:
                continue  # a later price may fill it
            uses = Counter(config)
            times = min((t / ROUNDS - covered[x]) * counts[x] / uses[x], *((1 - covered[y]) * counts[y] / k for y, k in uses.items()))
            if times <= 1e-9:
                continue
            for y, k in uses.items():
                covered[y] += times * k / counts[y]
                price[y] = base[y] * math.exp(-FALL * covered[y]) if covered[y] < 1 - 1e-9 else 0
            taken[tuple(sorted(config, reverse=True))] += times
    return taken


def best_fit(histogram: dict[int, int], capacity: int, plan: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """``plan`` with the pieces of ``histogram`` in its gaps or in new sequences: best-fit decreasing, by counts."""
    rooms: dict[int, list[tuple[int, list[int]]]] = {}

    def add(times: int, config: list[int]) -> None:
        if times:
            rooms.setdefault(capacity - sum(config), []).append((times, config))

    for times, config in plan:
        add(times, config)
    for x in sorted(histogram, reverse=True):
        n = histogram[x]
        while n:
            room = min((r for r, held in rooms.items() if r >= x and held), default=capacity)
            k = room // x
            times, config = rooms[room].pop() if rooms.get(room) else (-(-n // k), [])
            full = min(times, n // k)
            part = min(1, times - full) if n > full * k else 0
            add(full, config + [x] * k)
            add(part, config + [x] * (n - full * k))
            add(times - full - part, config)
            n = max(0, n - full * k) if not part else 0
    return [g for held in rooms.values() for g in held if g[1]]


def solved(histogram: dict[int, int], capacity: int, full: bool) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` of sequences that hold every piece, from solutions rounded until few pieces are left."""
    left = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        left[x] = n
    plan: list[tuple[int, list[int]]] = []

    def take(config: tuple[int, ...], most: int) -> None:
        uses = Counter(config)
        times = min(most, *(int(left[x]) // k for x, k in uses.items()))
        if times > 0:
            for x, k in uses.items():
                left[x] -= times * k
            plan.append((times, list(config)))

    if left[capacity]:
        plan.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    rest = min(capacity, REST * left.sum())
    while (before := left.sum()) > rest:
        taken = program(left.copy(), capacity, full)
        for config, times in taken.items():
            take(config, int(times + 1e-6))
        for config, _ in sorted(taken.items(), key=lambda x: (-sum(x[0]), math.floor(x[1]) - x[1], len(x[0]), x[0])):
            take(config, 1)
        if left.sum() == before:
            break
    return best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity, plan)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` of sequences that hold every piece of ``histogram`` once.

    Smooth histograms do best with full configurations first, lengths that fit
    badly without; the plan of fewer sequences is taken.
    """
    size = lambda plan: sum(times for times, _ in plan)
    plan = solved(histogram, capacity, True)
    if size(plan) * capacity - sum(x * n for x, n in histogram.items()) < capacity:
        return plan  # as few as the sum of the lengths allows
    return min(plan, solved(histogram, capacity, False), key=size)


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (pieces with ``length``) with ``sequence_id`` and ``offset``.

    Pieces of one length are numbered without meeting in one task: each is
    dealt to a salt by its place in its partition, so repeated rows part as well,
    numbered there, and moved by the counts of the salts before.
    Only the histogram of lengths comes to the driver.
    """
    salts = max(1, width(cut.sparkSession))
    key = ["doc_id", "piece", "start", "ids_crc32"]
    cut = stored(cut.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "pieces")
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packing_plan(histogram, capacity)
    # For each length its slots in order: from which number, the sequence of the first, the place in it.
    used, slots, sequence = dict.fromkeys(histogram, 0), [], 0
    for times, config in plan:
        at = 0
        for x in config:
            slots.append((x, used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    slots.sort()
    where, first, place = np.array([(x << 44) + n for x, n, _, _ in slots], np.int64), np.array([s for _, _, s, _ in slots], np.int64), np.array([p for _, _, _, p in slots], np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            asked = (part.column("length").to_numpy() << 44) + part.column("number").to_numpy()
            k = np.searchsorted(where, asked, side="right") - 1
            own = [part.column(c) for c in (*key[:3], "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[k] + asked - where[k]), pa.array(place[k])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = cut.withColumn("inside", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*key)) - 1)
    numbered = inside.join(before, ["length", "salt"]).withColumn("number", F.col("inside") + F.col("before"))
    return numbered.select(*key, "length", "number").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, end: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece of ``docs(doc_id, text, ...)``.

    Null and empty texts are one piece, the end id. Repeated rows are packed as
    often as they come; an empty table gives no rows; other columns are ignored.
    """
    return placed(pieces(docs, capacity, path, end), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packed(table(spark, sf_dir, "documents"))
