"""License scan, quality rules, near-duplicates, decontamination and chat against brute force."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cellgrid.llm import chat, decontaminate, licenses, minhash, quality_rules
from cellgrid.llm.license_rules import parsed
from cellgrid.operators import graph
from cellgrid.plans.storage import perhaps_in, stored

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
#: Extra columns whose names clash with those that the operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, node string, kept string, stratum string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", "y", "z") for i, t in texts], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# -- licenses ---------------------------------------------------------------


def base_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at}))


def test_licenses(spark, tmp_path):
    texts = [(1, "Licensed under CC BY-NC 4.0. ALL rights\nreserved! cc by cc-by"), (2, None), (3, ""), (4, "é general public license v3, GNU General Public License, version 3"), (4, "é general public license v3, GNU General Public License, version 3"), (5, "Released under the MIT License."), (6, "x " * 3000 + "all rights reserved " * 200), (7, "the Apache License, Version 2.0 or the apache license"), (None, "plain words")]
    (tmp_path / "d").mkdir()
    docs(spark, texts).write.parquet(str(tmp_path / "d" / "documents.parquet"))
    rows = licenses.op1_licenses(spark, str(tmp_path / "d")).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    for i, t in texts:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_licenses(t)
    assert got[1].labels == "cc-by,cc-by-nc-4.0,reserved" and got[5].labels == "mit" and got[4].labels == "gpl,gpl-3.0"
    assert got[7].labels == "apache,apache-2.0" and got[None].labels == "" and got[2].score == 0 and 0 < got[5].score <= 1
    assert licenses.scanned(docs(spark, [])).count() == 0


def test_suppression_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["gnu", "general", "public", "license", "version", "3", "lesser", "apache", "2", "0", "cc", "by", "nc", "4", "mit", "the", "x"]
    texts = [(i, " ".join(rng.choice(parts) for _ in range(60))) for i in range(30)]
    got = {r.doc_id: r.detections for r in licenses.scanned(docs(spark, texts)).collect()}
    from cellgrid.llm.license_rules import parsed

    for i, t in texts:
        w = t.split()
        numbered = "".join(f" {x}:{k} " for k, x in enumerate(w))
        found = []
        for order, (label, p, gates, pattern, base) in enumerate(parsed()):
            if all(g in w for g in gates):
                for m in re.finditer(licenses.compiled(pattern), numbered):
                    n = [int(x) for x in re.findall(r":(\d+)", m[0])]
                    found.append((n[0], n[-1], p, order, label, base))
        found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
        kept = [d for k, d in enumerate(found) if d[5] or not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in found[:k])]
        assert [(d[0], d[1], d[4]) for d in kept] == [(d.start, d.end, d.label) for d in got[i]]


def spellings(pattern):
    """Every text of a rule's pattern: each option taken and left, each alternative, a placeholder for any word."""

    def sequence(nodes):
        out = [""]
        for op, arg in nodes:
            out = [a + b for a in out for b in single(str(op), arg)]
        return out

    def single(op, arg):
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return ["x"] if str(arg[0][0]) == "CATEGORY" else [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        if op == "BRANCH":
            return [x for b in arg[1] for x in sequence(b)]
        if op == "SUBPATTERN":
            return sequence(arg[3])
        assert op == "MAX_REPEAT", op
        low, high, inner = arg
        return ["".join(c) for n in sorted({low, min(high, max(low, 1))}) for c in itertools.product(sequence(inner), repeat=n)]

    return sorted(set(sequence(re._parser.parse(pattern))))


def test_every_rule_fires_in_every_spelling(spark):
    rules = parsed()
    texts = []
    for label, _, gates, pattern, _ in rules:
        for text in spellings(pattern):
            w = text.split()
            assert set(gates) <= set(w), (label, gates, text)
            assert re.fullmatch(licenses.compiled(pattern), "".join(f" {x}:{i} " for i, x in enumerate(w))), (label, text)
        texts.append((len(texts), text))
    got = {r.doc_id: r.detections for r in licenses.scanned(docs(spark, texts)).collect()}
    for i, t in texts:
        assert any((d.start, d.end) == (0, len(t.split()) - 1) for d in got[i]), (rules[i], t)


TITLES = [
    ("Eclipse Public License - v 2.0", "epl-2.0"), ("Apache License, v. 2.0", "apache-2.0"), ("GNU GPL v. 3", "gpl-3.0"), ("Artistic License v 2.0", "artistic-2.0"),
    ("European Union Public Licence v. 1.2", "eupl-1.2"), ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"), ("creativecommons.org/licenses/by/2.5", "cc-by-2.5"),
    ("EPL-2.0", "epl-2.0"), ("SSPL", "sspl-1.0"), ("MIT licensed", "mit"), ("Dual licensed MIT/GPL", "gpl-any,mit"), ("Mozilla Public License, version 2.0", "mpl-2.0"), ("GPL v. 2 or later", "gpl-2.0-or-later"),
]


def test_titles_keep_their_version(spark):
    got = {r.doc_id: sorted({d.label for d in r.detections}) for r in licenses.scanned(docs(spark, list(enumerate(t for t, _ in TITLES)))).collect()}
    assert [",".join(got[i]) for i in range(len(TITLES))] == [w for _, w in TITLES]


def test_license_sentences(spark):
    sentences = {
        "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution Share Alike"],
        "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0", "creative commons attribution non-commercial"],
        "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0", "Creative Commons Attribution-No Derivative"],
        "cc-by-nc-sa": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "Creative Commons Attribution-Non Commercial-Share Alike"],
        "cc-by-nc-nd": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "Creative Commons Attribution Non-Commercial No Derivatives"],
        "gpl-3.0-or-later": ["GPL v3 or later", "GPLv3 or later", "GPL3 plus", "x " * 2000 + "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
        "bsd-3-clause": ["x " * 2000 + "Neither the name of the Regents of the University of California, Lawrence Berkeley National Laboratory, nor the names of its contributors may be used to endorse or promote products derived from this software"],
        "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
        "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
        "zlib": ["Altered source versions must be plainly marked as such"],
        "openssl": ["This product includes software developed by the OpenSSL Project"],
        "apache": ["the ASF licence"],
        "osl": ["an Open Software Licence"],
        "ruby": ["Ruby license", "Ruby's license"],
        "openrail": ["BigScience RAIL License", "Open RAIL-M license", "CreativeML OpenRAIL-M"],
        "llama-community": ["Llama Community License", "Llama 2 Community License", "Llama 3.1 Community License Agreement"],
        "proprietary": ["a proprietary licence"],
        "no-redistribution": ["may not be published, broadcast, rewritten or redistributed", "may not be copied or redistributed"],
        "noncommercial": ["for noncommercial use only", "for non-commercial use only"],
        "copyright": ["Copyright by Someone", "Copyright (c) 2020"],
    }
    texts = [(label, t) for label, ts in sentences.items() for t in ts]
    got = {r.doc_id: {d.label for d in r.detections} for r in licenses.scanned(docs(spark, [(i, t) for i, (_, t) in enumerate(texts)])).collect()}
    missed = [(label, t[-80:]) for i, (label, t) in enumerate(texts) if label not in got[i]]
    assert not missed


# -- quality rules ----------------------------------------------------------


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c a"), (5, "a a a a"), (6, "l1 x\nl1 x\n\nl1 x é$"), (7, words(rng, 300, 9)), (8, words(rng, 3000)), (8, words(rng, 60)), (9, "one two")]
    labels = spark.createDataFrame([(8, 1)], "doc_id long, quality int")
    rows = quality_rules.judged(docs(spark, texts), labels).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == collections.Counter((i, *counts(t)) for i, t in texts)
    assert quality_rules.judged(docs(spark, []), labels).count() == 0
    assert quality_rules.passing(docs(spark, texts), labels).columns == docs(spark, []).columns


def test_binomial_bound_is_exact(spark):
    for k, n, p in ((0, 50, 0.01), (3, 200, 0.02), (40, 5000, 0.01)):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        got = spark.range(1).select(quality_rules.log_binomial_cdf(F.lit(k), F.lit(n), p).alias("v")).first().v
        assert got == pytest.approx(math.log(want), abs=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    rng = random.Random(2)
    good = [(i, " ".join(["word"] * 0) + words(rng, 80, 5000) + (" #" * (40 if i % 300 == 0 else 0))) for i in range(1500)]
    junk = [(9000 + i, words(rng, 80, 5000) + " #" * 60) for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.judged(docs(spark, good + junk), labels).collect()}
    assert sum(not out[i].kept for i, _ in good) <= 0.03 * len(good)
    assert not any(out[i].kept for i, _ in junk) and "symbol_share" in out[9000].rejected_by
    few = quality_rules.judged(docs(spark, good[:50] + junk), labels).collect()
    assert all(r.kept for r in few if not r.base_failed)


# -- near-duplicates --------------------------------------------------------


def brute_components(texts, width, percent):
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(texts)}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rng = random.Random(width)
    texts = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, " \t\n")]
    base = words(rng, 150, 10**5)
    for i in range(60):  # copies near the threshold, edited apart from one another
        texts.append((100 + i, edited(rng, base, rng.randrange(0, 7))))
    shared = words(rng, 80, 10**5)
    texts += [(300 + i, shared + " " + words(rng, rng.randrange(5, 120), 10**5)) for i in range(40)]
    texts += [(400 + i, words(rng, rng.randrange(1, 12), 6)) for i in range(60)]
    texts += [(500 + i, base.upper()) for i in range(30)]
    rng.shuffle(texts)
    rows = minhash.near_duplicates(docs(spark, texts).repartition(5), width, percent).collect()
    want = brute_components(texts, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    rows = minhash.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s t u v")])).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in rows) == [(-1, True), (1, True), (1, True)]
    out = minhash.one_of_each(docs(spark, [(5, "a b c d e f g"), (7, "A b c d e f g"), (None, "z")]))
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 5] and out.columns == docs(spark, []).columns


def test_near_copies_without_id(spark):
    rng = random.Random(5)
    one, two, three = (words(rng, 150, 10**5) for _ in range(3))
    texts = [(1, one), (None, edited(rng, one, 1)), (None, two), (None, edited(rng, two, 1)), (None, two), (None, three), (None, None), (None, ""), (2, None)]
    rows = minhash.near_duplicates(docs(spark, texts)).collect()
    assert [(r.doc_id, r.kept) for r in rows if r.component_id == 1] in ([(1, True), (None, False)], [(None, False), (1, True)])
    left = [(r.doc_id, r.text) for r in minhash.one_of_each(docs(spark, texts)).collect()]
    assert len(left) == 6 and {(1, one), (None, three), (None, None), (None, ""), (2, None)} < set(left)


def test_texts_without_copies_are_not_shuffled(spark):
    rng = random.Random(9)
    texts = [(i, words(rng, 400, 10**6)) for i in range(600)]
    texts += [(1000 + i, edited(rng, texts[i][1], 2)) for i in range(12)]
    sc = spark.sparkContext

    def shuffled():
        time.sleep(0.3)
        spark.range(1).count()  # the figures are brought up to date by a task's end
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        return sc._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    limit, start = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = {r.doc_id: r.text for r in minhash.one_of_each(docs(spark, texts)).collect()}
        moved = shuffled() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert left == dict(texts[:600])
    assert 0 < moved < 0.6 * sum(len(t) for _, t in texts)


def test_bitmaps_miss_no_key(spark):
    keys = stored(spark.range(0, 90_000, 3).select(F.col("id").alias("k")), "keys")
    seen = perhaps_in(spark.range(100_000).withColumn("k", F.when(F.col("id") < 99_000, F.col("id"))), "k", keys, "hit").groupBy(((F.col("k") % 3 == 0) & (F.col("k") < 90_000)).alias("true"), "hit").count().collect()
    counts = {(r["true"], r["hit"]): r["count"] for r in seen}
    assert counts[True, True] == 30_000 and (True, False) not in counts
    assert counts[None, False] == 1_000 and counts.get((False, True), 0) < 0.03 * 69_000
    empty = stored(spark.range(0).select(F.col("id").alias("k")), "keys")
    assert perhaps_in(spark.range(5), "id", empty, "hit").filter("hit").count() == 0


def test_circulant_estimates_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    c = minhash.Circulant(512)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    assert abs((c(a) == c(b)).mean() - 300 / 500) < 0.08


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (103, 102), (7, 7)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 104)} == {100}


# -- decontamination --------------------------------------------------------


def least_edits(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for ch in t:
        cur = [0]
        for i in range(1, len(p) + 1):
            cur.append(min(prev[i - 1] + (p[i - 1] != ch), prev[i] + 1, cur[i - 1] + 1))
        prev = cur
        best = min(best, prev[-1])
    return best


def test_matches_equal_brute_force(spark):
    rng = random.Random(4)
    letters = "abcd e"
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30, 70)))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny item")]
    texts = [(900, None), (901, ""), (902, "a tiny  ITEM here"), (903, "untiny items")]
    for d in range(80):
        t = list("".join(rng.choice(letters) for _ in range(120)))
        if d % 2:
            own = list(items[d % 12][1])
            for _ in range(rng.randrange(0, 8)):
                k, op = rng.randrange(len(own)), rng.random()
                if op < 0.4:
                    own[k] = rng.choice(letters)
                elif op < 0.7:
                    del own[k]
                else:
                    own.insert(k, rng.choice(letters))
            t[40:40] = own
        texts.append((d, "".join(t)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    want = {}
    for d, t in texts:
        n = decontaminate.normalized(t)
        for i, x in items:
            x = decontaminate.normalized(x)
            if len(x) >= decontaminate.SHORT and (e := least_edits(x, n)) <= decontaminate.allowed(x, decontaminate.BUDGET):
                want[d, i] = e
    want[902, 52] = 0
    assert got == want
    clean = {r.doc_id for r in decontaminate.without_matches(docs(spark, texts), bench).collect()}
    assert clean == {d for d, _ in texts} - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs(spark, texts), none).count() == 0 and decontaminate.matches(docs(spark, []), bench).count() == 0


def test_short_items_at_every_hit(spark):
    bench = spark.createDataFrame([(1, "tiny item"), (2, "aa aa")], "item_id long, text string")
    texts = [(1, "untiny items and then a tiny item here"), (2, "tiny items, untiny item"), (3, "tiny item"), (4, "xaa aaaa aa aa"), (5, "untiny item tiny items " * 50 + "tiny item")]
    got = {(r.doc_id, r.item_id): (r.edits, r.end) for r in decontaminate.matches(docs(spark, texts), bench).collect()}
    assert got == {(1, 1): (0, 33), (3, 1): (0, 9), (4, 2): (0, 14), (5, 1): (0, 23 * 50 + 9)}
    assert [r.doc_id for r in decontaminate.without_matches(docs(spark, texts), bench).collect()] == [2]


# -- chat -------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<", "[", "\\", "<s></s>", "$1 \\2", "é\n\n", ""]
    rows = [(i, k, "assistant" if k % 2 else "user", t, "x") for i in range(3) for k, t in enumerate(nasty)]
    rows += [(7, None, None, None, "x"), (7, 1, "</s>", "t", "x"), (8, 1, "user", "same", "x"), (8, 1, "user", "same", "x"), (None, 0, "assistant", "null id", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_turn_rows(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    groups = collections.defaultdict(list)
    for c, k, role, t, _ in rows:
        groups[c].append((-1 if k is None else k, role or "", t or ""))
    for c, turns in groups.items():
        turns.sort()
        assert [(t.role, t.text) for t in out[c].back.turns] == [(r, t) for _, r, t in turns]
        assert out[c].back.loss == "".join(t for _, r, t in turns if r == "assistant")
    assert out[0].formatted.text.count("</s>") == len(nasty) and out[8].formatted.text.count("</s>") == 2
    assert chat.format_turn_rows(df.limit(0)).count() == 0


def test_turns_without_a_conversation_stay_apart(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", None), (1, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    out = chat.format_turn_rows(df).select("conv_id", chat.read_back(F.col("formatted")).alias("back")).collect()
    assert sorted((r.conv_id or 0, [(t.role, t.text) for t in r.back.turns]) for r in out) == [(0, [("assistant", "")]), (0, [("user", "a")]), (0, [("user", "a")]), (1, [("user", "b")])]


def plain_paths(value, at=""):
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in plain_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list) and value:
        return plain_paths(value[0], f"{at}[]")
    return [f"{at}[]" if isinstance(value, list) else at]


def test_record_paths_equal_a_walk(spark):
    records = [{"a": {"b": [{"c": 1, "d": {"e": None}}], "f": 1.5}, "g": True, "STRING": "x"}, {"m": []}, {"m": [[{"x": "y"}]], "n": [1]}, {"z": {"y": {"x": {"w": 10**30}}}}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string")
    got = df.select(chat.record_paths(F.schema_of_variant(F.try_parse_json("record"))).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [sorted(plain_paths(r)) for r in records]
    odd = spark.createDataFrame([('{"messages[].role": "a", "messages[].content": "b"}',), ("5",), ("{}",)], "record string")
    rows = chat.canonical_records(odd).collect()
    assert rows[0].turns is None and rows[0].layout != chat.fingerprint(["messages[].role", "messages[].content"])
    assert rows[1].layout is None and rows[2].layout == hashlib.sha256(b"").hexdigest()


def test_chat_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "a"}]}, {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "z", "output": "o"}, {"conversations": [{"from": "gpt", "value": "w"}]}, {"other": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{",), (None,)], "record string")
    rows = chat.canonical_records(df).collect()
    got = [[(t.role, t.text) for t in r.turns] if r.turns else None for r in rows]
    assert got == [[("user", "a")], [("user", "p"), ("assistant", "r")], [("user", "i\n\nz"), ("assistant", "o")], [("assistant", "w")], None, None, None]
    assert rows[0].layout == chat.fingerprint(["messages[].role", "messages[].content"]) == hashlib.sha256(b"messages[].content\nmessages[].role").hexdigest()
    assert rows[4].layout == chat.fingerprint(["other"]) and rows[5].layout is rows[6].layout is None
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(df, ["record"])
