"""Collocations: phrases of two to four words, counted in tries, scored at their weakest cut.

Each shard of documents counts its phrases in a trie of bounded depth: a node is
its parent's number and a word, so the nodes of a depth are one sorted array,
and the tries are written out in the order of their paths. The runs of
all shards are merged by ranges of paths, a range a task, so a frequent first word is
split at its second. Two rounds: words and pairs first; then depths three and
four below pairs that are frequent, since no phrase is more frequent than a part
of it. Frequent pairs go to the tasks as a bitmap of their hashes, 16 bits a
pair and 128 MB at most; a false positive costs a node that the merge drops, a
frequent pair is never missed, so counts are exact.

Left parts are the ancestors of a node, right parts are reached over suffix
links (the path without its first word). Every part of a candidate is at least as frequent
as the candidate, so both ends of each link are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, stored, table, width
from .spans import cut_words, members, sorted_codes
from .words import hash_words, mix, texts

LEAST, DEPTH, TOP, COVERED = 30, 4, 2000, 80
#: Words of one shard; its trie is written when it has as many.
SHARD_WORDS = 1 << 21
#: Bits of the bitmap of frequent pairs, as powers of two: 16 a pair within these bounds.
LEAST_BITS, MOST_BITS = 15, 30

_BREAK = members(*b".,;:!?", range(10, 14))
_WORD = ~(_BREAK | members(0x20, 0x09))
_NODE = "lang string, path string, depth int, n long"


class Shard:
    """Words of rows, numbered in byte order, with the language and the piece each stands in."""

    def __init__(self, langs: pa.Array, text: pa.Array) -> None:
        data, offsets = texts(text)
        words, starts = cut_words(data, offsets, _WORD)
        self.code, self.words = sorted_codes(words)
        row = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.cumsum(_BREAK[data])[starts] + row if len(starts) else row
        known = langs.cast(pa.string()).fill_null("und").dictionary_encode()
        self.langs = known.dictionary
        self.lang = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]

    def joined(self, n: int) -> np.ndarray:
        """Whether ``n`` words from each place on stand in one piece."""
        out = np.zeros(len(self.code), bool)
        if len(out) >= n:
            out[: len(out) - n + 1] = self.piece[n - 1 :] == self.piece[: len(out) - n + 1]
        return out

    def nodes(self, places: np.ndarray, n: int) -> pa.RecordBatch:
        """The phrases of ``n`` words at ``places`` with their counts, sorted by path: parent's number and word, depth by depth."""
        node = self.lang[places]
        for k in range(n):
            key = node * (len(self.words) + 1) + self.code[places + k]
            _, first, node, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        at = places[first] if len(places) else places
        path = self.words.take(pa.array(self.code[at]))
        for k in range(1, n):
            path = pc.binary_join_element_wise(path, self.words.take(pa.array(self.code[at + k])), pa.scalar(" ", pa.large_string()))
        lang = self.langs.take(pa.array(self.lang[at]))
        return pa.RecordBatch.from_arrays([lang, path.cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(count.astype(np.int64) if len(at) else np.empty(0, np.int64))], ["lang", "path", "depth", "n"])

    def pairs(self) -> np.ndarray:
        """A hash of the language and the two words at each place."""
        return pair_hash(*(v[i] for v, i in ((word_hashes(self.words), self.code[:-1]), (word_hashes(self.words), self.code[1:]), (lang_hashes(self.langs), self.lang[:-1]))))


def word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = texts(words)
    return hash_words(data, offsets)[0]


def lang_hashes(langs: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(blake2b((x or "").encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()], np.uint64)


def pair_hash(a: np.ndarray, b: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(mix(a + lang) * np.uint64(3) + b)


def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Rows of ``(lang, text)`` in shards of about ``SHARD_WORDS`` words, at four bytes a word and more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in parts:
        at = 0
        data, offsets = texts(part.column("text"))
        while at < part.num_rows:
            room = offsets[at] + max(4 * SHARD_WORDS - size, 0)
            to = max(at + 1, int(np.searchsorted(offsets, room, side="right")) - 1)
            to = min(to, part.num_rows)
            held.append(part.slice(at, to - at))
            size += int(offsets[to] - offsets[at])
            at = to
            if size >= 4 * SHARD_WORDS or at < part.num_rows:
                yield _shard(held)
                held, size = [], 0
    if held:
        yield _shard(held)


def _shard(held: list[pa.RecordBatch]) -> Shard:
    whole = pa.Table.from_batches(held).combine_chunks()
    return Shard(*(c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in (whole["lang"], whole["text"])))


def _low_tries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Root, words and pairs of each shard."""
    for s in shards(parts):
        n = np.bincount(s.lang, minlength=len(s.langs))
        yield pa.RecordBatch.from_arrays([s.langs, pa.array([""] * len(n)), pa.array(np.zeros(len(n), np.int32)), pa.array(n.astype(np.int64))], ["lang", "path", "depth", "n"])
        yield s.nodes(np.arange(len(s.code)), 1)
        yield s.nodes(np.flatnonzero(s.joined(2)), 2)


def merged(tries: DataFrame, least: int) -> DataFrame:
    """Counts over all shards of phrases with ``least`` at least (and the roots), by ranges of paths."""
    return tries.repartitionByRange("lang", "path").groupBy("lang", "path").agg(F.first("depth").alias("depth"), F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("depth") == 0))


def pair_bits(low: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes of the pairs in ``low`` and the power of two of its bits."""
    pairs = low.filter("depth = 2")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * pairs.count()).bit_length()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = texts(part.column("path"))
            h = hash_words(data, offsets)[0].reshape(-1, 2)
            langs = part.column("lang").dictionary_encode()
            own = lang_hashes(langs.dictionary)[langs.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.empty(0, np.uint64)
            place = pair_hash(h[:, 0], h[:, 1], own) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64))], ["place"])

    places = pairs.select("lang", "path").mapInArrow(run, "place long")
    pages = places.groupBy(F.shiftright("place", 15).alias("page")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
    out = np.zeros((max(1, 1 << bits >> 15), 4096), np.uint8)  # 128 MB at most
    for r in pages.toLocalIterator():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel(), bits


def tries(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(lang, path, depth, n)``: all words and phrases with a count of ``least`` or more; and ``(lang, n)``, words of a language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    low = stored(merged(stored(rows.mapInArrow(_low_tries, _NODE), "tries"), least), "trie")
    bitmap, bits = pair_bits(low)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def high(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for s in shards(parts):
            good = s.joined(2)
            if len(good) > 2:
                place = s.pairs() >> np.uint64(64 - bits)
                good[:-1] &= (known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                three = np.flatnonzero(good[:-1] & good[1:])
                yield s.nodes(three, 3)
                four = three[good[np.minimum(three + 2, len(good) - 1)] & (three + 3 < len(good))]
                yield s.nodes(four, 4)

    deep = stored(merged(stored(rows.mapInArrow(high, _NODE), "tries"), least), "trie")
    return low.filter("depth > 0").unionByName(deep), low.filter("depth = 0").select("lang", "n")


def _key(path: Column | str) -> Column:
    return F.concat(F.col("lang"), F.lit("\n"), F.col(path) if isinstance(path, str) else path)


def candidates(trie: DataFrame) -> DataFrame:
    """``(lang, path, depth, n, lefts, rights)`` of two words and more: counts of the first 1, 2, ... words and of the rests without the first 1, 2, ... words.

    A node takes its ancestors' counts from its parent and the counts of its
    suffixes over its suffix link, one depth after another.
    """
    above = trie.filter("depth = 1").select(_key("path").alias("key"), F.array("n").alias("lefts"), F.array("n").alias("rights"))
    out = None
    for depth in range(2, DEPTH + 1):
        own = trie.filter(F.col("depth") == depth).withColumn("parent", _key(F.substring_index("path", " ", depth - 1))).withColumn("link", _key(F.expr("substring(path, instr(path, ' ') + 1)")))
        own = looked_up(own, "parent", "path", above.select(F.col("key").alias("parent"), "lefts"))
        own = looked_up(own, "link", "path", above.select(F.col("key").alias("link"), "rights")).drop("parent", "link")
        own = stored(own, "phrases")
        out = own if out is None else out.unionByName(own)
        above = own.select(_key("path").alias("key"), F.concat("lefts", F.array("n")).alias("lefts"), F.concat(F.array("n"), F.col("rights")).alias("rights"))
    return out


def scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, depth, a, l, r, score)`` at the cut with the lowest score, the first of equal ones; exact whatever the counts."""
    cuts = """array_min(transform(sequence(1, size(lefts)), k -> struct(
        2000000BD * CAST(n AS DECIMAL(20, 0)) div (CAST(lefts[k - 1] AS DECIMAL(20, 0)) + rights[k - 1]) AS score,
        k, lefts[k - 1] AS l, rights[k - 1] AS r)))"""
    return phrases.withColumn("c", F.expr(cuts)).select("lang", F.col("path").alias("phrase"), "depth", F.col("n").alias("a"), "c.l", "c.r", "c.score")


def uncovered(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """``phrases`` without those of which a longer one that holds them has ``covered`` percent of the count."""
    words = F.split("phrase", " ", -1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("depth") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("depth") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    longer = phrases.filter("depth > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    dec = lambda c, f: F.col(c).cast("decimal(20,0)") * F.lit(f)
    return phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (dec("most", 100) < dec("a", covered))).drop("most")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language with ``rank``; the best of each part are found first, so no task gets a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(width(phrases.sparkSession))))
    kept = part.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_r") <= top).drop("_r", "_part")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language of ``docs(lang, text, ...)``.

    Null and empty texts have no words; a null language is ``und``, together
    with rows that say so; repeated rows count again; other columns are ignored. Without a
    candidate the result is empty. Texts are cut whole whatever their length: a shard holds at least one document.
    """
    trie, words = tries(docs, least)
    best = ranked(uncovered(scored(candidates(stored(trie, "trie"))), covered), top)
    return best.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_W = r"list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '')"
SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, {_W} AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS path FROM w, (VALUES (1), (2), (3), (4)) AS z(k)),
f AS (SELECT lang, path, k, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
c AS (SELECT lang, path, k, f AS a, string_split(path, ' ') AS w FROM f WHERE k > 1),
p AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT p.*, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score FROM p JOIN f l ON l.lang = p.lang AND l.path = array_to_string(p.w[1:cut], ' ') JOIN f r ON r.lang = p.lang AND r.path = array_to_string(p.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, cut) = 1),
i AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c WHERE k > 2),
j AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS z FROM i),
x AS (SELECT lang, array_to_string(w[z:z + m - 1], ' ') AS path, max(a) AS most FROM j GROUP BY 1, 2),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.path) AS rank, b.path AS phrase, a, l, r, score FROM b LEFT JOIN x ON x.lang = b.lang AND x.path = b.path WHERE most IS NULL OR 100 * most < {COVERED} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {TOP}"""
