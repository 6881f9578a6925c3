"""Ranked search, collocations and mixing against plain computations, and their edge cases."""

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import collocations, mixing, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, query string, n long"


def prose(rng, n, words):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "x1", "naïve", "THE"]
    rows = [(i, prose(rng, int(rng.integers(0, 60)), words), ["en", "fr", None][i % 3], ["a", "b", "c", None][min(i % 7, 3)], "q", 1) for i in range(150)]
    rows += [(200, None, None, None, None, None), (201, "", "en", "a", "", 0), (None, rows[3][1] + " rare", "en", "b", "", 0), (4, rows[4][1], *rows[4][2:]), (4, rows[4][1], *rows[4][2:]), (300, prose(rng, 20_000, words), "en", "c", "", 0), (301, "!!! ...", "und", "d", "", 0)]
    return rows


# -- ranked search ------------------------------------------------------------


def best_documents(rows, item, k=10):
    docs = [(r[0], TERM.findall((r[1] or "").translate(ABC))) for r in rows]
    n, total = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    out = []
    for i, (doc, t) in enumerate(docs):
        tf, score = Counter(t), 0
        for w in TERM.findall((item or "").translate(ABC)):
            if tf[w]:
                m = 25 + 75 * len(t) * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m))
        if score > 0:
            out.append((-score, doc is None, doc or 0, i, doc))
    return [(rank, d[4], -d[0]) for rank, d in enumerate(sorted(out)[:k], 1)]


def test_search_equals_a_plain_ranking(spark, corpus):
    items = [(0, "w1 w2 THE the été"), (1, "rare"), (2, "nothing here"), (3, None), (4, " ".join(f"w{i}" for i in range(60)) + " w5 w5"), (None, "x1")]
    docs = spark.createDataFrame(corpus, DOCS).repartition(3)
    got = treaps.ranked(docs, spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, query string")).collect()
    for item, text in items:
        assert sorted((r.rank, r.doc_id, r.score) for r in got if r.item_id == item) == best_documents(corpus, text)


def test_search_in_many_small_blocks_and_passes(spark, corpus, monkeypatch):
    docs, items = spark.createDataFrame(corpus, DOCS).repartition(2), [(i, f"w{i} w{i + 1} rare THE") for i in range(6)]
    index = treaps.build(docs, block_bytes=600)
    assert index.blocks.count() > 10
    queries = spark.createDataFrame(items, "query long, text string")
    got = treaps.search(index, queries, pass_terms=5).collect()
    for item, text in items:
        assert sorted((r.rank, r.doc_id, r.score) for r in got if r["query"] == item) == best_documents(corpus, text)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert treaps.ranked(none, item).count() == 0
    assert treaps.ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), item.limit(0)).count() == 0
    assert treaps.ranked(spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string"), item).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=40), min_size=1, max_size=5))
def test_treaps_are_heaps_in_search_order(lists):
    impact = np.array(sum(lists, []))
    end = np.cumsum([len(x) for x in lists])
    start = end - [len(x) for x in lists]
    sizes = end - start
    left, right = treaps.treaps(impact, np.repeat(start, sizes), np.repeat(end, sizes))

    def walk(n, lo, hi):
        """In order, all of the range, no child above its parent."""
        assert lo <= n < hi
        out = []
        if left[n]:
            assert impact[n - left[n]] <= impact[n]
            out += walk(n - left[n], lo, n)
        out.append(n)
        if right[n]:
            assert impact[n + right[n]] <= impact[n]
            out += walk(n + right[n], n + 1, hi)
        return out

    for a, b in zip(start, end, strict=True):
        assert walk(a + int(impact[a:b].argmax()), a, b) == list(range(a, b))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(1, 5))
def test_a_walk_finds_what_sums_find(seed, k, terms):
    rng = np.random.default_rng(seed)
    texts = pa.array([" ".join(rng.choice(["a", "b", "c", "d", "e", "f"], rng.integers(0, 9))) for _ in range(50)])
    cols = treaps._block(pa.array(range(50), pa.int64()), texts, 50, 300)
    names = ["ids", "unnamed", "terms", "sizes", "docs", "impacts", "lefts", "rights"]
    row = {c: pa.array([x.to_pylist() if isinstance(x, pa.Array) else x.tolist()])[0] if c in ("terms", "sizes") else pa.scalar(x) for c, x in zip(names, cols, strict=True)}
    lists = treaps.Lists(row)
    own = rng.permutation(len(lists.sizes if hasattr(lists, "sizes") else lists.end))[:terms]
    weight = rng.integers(1, 20, len(own))
    full = np.zeros(50, np.int64)
    for t, w in zip(own, weight, strict=True):
        at = slice(lists.start[t], lists.end[t])
        full[lists.doc[at]] += w * lists.impact[at]
    want = sorted(((-s, d) for d, s in enumerate(full) if s > 0))[:k]
    _, docs, scores, _ = treaps.walk(lists, np.zeros(len(own), np.int64), own, weight, np.zeros(1, np.int64), k)
    assert sorted(zip(-scores, docs, strict=True)) == want


# -- collocations ---------------------------------------------------------------


def plain_collocations(rows, least, top, covered):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (r[1] or "").translate(ABC)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        held = any(q[0] == lang and len(q[1]) > len(p) and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) and 100 * b >= covered * a for q, b in cand.items())
        if not held:
            out.append((lang, -score, -a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort(key=lambda x: (x[0], x[1], x[2], x[3].encode()))
    return [(lang, i, x[3], -x[2], x[4], x[5], n[lang], -x[1]) for lang, own in groupby(out, key=lambda x: x[0]) for i, x in enumerate(own, 1) if i <= top]


def test_collocations_equal_plain_counts(spark, corpus, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("new york city ," if rng.random() < 0.2 else prose(rng, 2, ["a", "b", "C", "é x", "d"]) for _ in range(30)) + ".\tend\r\nof", ["en", None, "und", "fr"][i % 4], "s", "", 0) for i in range(40)] + [(90, None, "en", None, "", 0), (91, "", None, None, "", 0), (92, "... ,,", "zz", None, "", 0)]
    monkeypatch.setattr(collocations, "SHARD_WORDS", 400)
    for least, covered in ((10, 80), (3, 101)):
        got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least, 25, covered).collect()
        want = plain_collocations(rows, least, 25, covered)
        assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == sorted(want) and want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en", "", "", 0)], DOCS)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "x y", 2, big, [big], [big]), ("en", "p q r", 3, big - 7, [big, big - 5], [big - 1, big])]
    out = {r.phrase: r for r in collocations.scored(spark.createDataFrame(rows, "lang string, path string, depth int, n long, lefts array<long>, rights array<long>")).collect()}
    assert out["x y"].score == 1_000_000
    assert out["p q r"].score == min(2_000_000 * (big - 7) // (2 * big - 1), 2_000_000 * (big - 7) // (2 * big - 5))


# -- mixing -----------------------------------------------------------------------


def filled(sizes, passes=3):
    """Targets by sharing again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    out, live, rest = {}, set(order), sum(sizes.values())
    while live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if rest * weight[s] / total > passes * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in live}
        for s in over:
            out[s] = passes * sizes[s]
            live.discard(s)
        rest = sum(sizes.values()) - sum(out.values())
    return out


def test_mix_meets_its_targets(spark, corpus):
    got = mixing.mixed(spark.createDataFrame(corpus, DOCS).repartition(4)).collect()
    again = mixing.mixed(spark.createDataFrame(corpus[::-1], DOCS).repartition(2)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    want = {}
    for r in corpus:
        want[r[3]] = want.get(r[3], 0) + len((r[1] or "").split())
    target = filled(want)
    assert len(got) == len(corpus)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in corpus)
    by_size = {}
    for r in got:
        by_size.setdefault(r.source_size, []).append(r)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    for source, size in want.items():
        own = by_size[size]
        assert own[0].target == pytest.approx(target[source])
        miss = abs(sum(r.taken for r in own) - target[source])
        assert miss <= 1 or (source == "c" and miss <= 20_000 - target["c"]) or sum(r.taken for r in own) == 3 * size  # one document is most of c


def test_targets_with_full_sources(spark):
    sizes = {"a": 1000, "b": 1, "c": 5, None: 10, "z": 0}
    df = spark.createDataFrame([("t" if s is None else "s" + s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = filled(sizes)
    assert all(got["t" if s is None else "s" + s] == pytest.approx(want[s]) for s in sizes)
    zero = spark.createDataFrame([("sa", 0), ("sb", 0)], "source string, source_size long")
    assert [r.target for r in mixing.targets(zero).collect()] == [0.0, 0.0]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 400))
def test_subsets_are_as_near_as_any(counts, budget):
    length = np.array(sorted(counts))
    count = np.array([counts[x] for x in length])
    take = mixing.bounded_knapsack(length, count, budget)
    sums = {0}
    for x, c in counts.items():
        sums = {s + k * x for s in sums for k in range(c + 1)}
    assert (take <= count).all() and (length * take).sum() == max(s for s in sums if s <= budget)
    some = mixing.subset(length, count, budget)
    assert (some <= count).all() and (some >= 0).all()
    assert abs((length * some).sum() - budget) <= max(length.max(), budget - int((length * count).sum()))


def test_a_draw_of_equal_rows_takes_as_many_as_asked(spark):
    rows = [("k", 7, i - 20, 11) for i in range(40)] + [("l", i * 10**17, i, 3) for i in range(-5, 5)]
    out = mixing.drawn(spark.createDataFrame(rows, "key string, h long, p long, need long")).collect()
    assert sum(r.more for r in out if r.key == "k") == 11
    assert [r.more for r in sorted((r for r in out if r.key == "l"), key=lambda r: r.h)] == [1, 1, 1] + [0] * 7


def test_mix_of_nothing_and_of_the_same(spark):
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c", "en", "s", "", 0)] * 30 + [(1, "a", "en", "r", "", 0)]
    out = mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 31 and abs(sum(r.taken for r in out if r.source_size == 90) - out[0].target) <= 90
