"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of those of its hash and of its beginning's hash.
Filters of widths 1 to 3 run over the words, the largest response of each over
the whole text feeds a logistic output. The threshold of each language, guessed
from the function words of the text alone, is calibrated on all labelled documents
of a fifth that the fit never sees; scores are scaled so that it lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .features import Words, hash_of, word_runs
from .sampling import calibration, labelled_sample, threshold

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 12, (1, 2, 3), 8
EPOCHS, STEPS, BATCH, RATE = 5, 300, 32, 0.01
PAD = max(WIDTHS) - 1
#: Function words by which the language of a text is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was on are by this from it as be".split(),
    "de": "der die das und von den zu mit sich auf ist nicht ein eine dem des im für".split(),
    "fr": "le la les des et du un une est que pour dans sur au par en qui pas".split(),
    "es": "el los las del y una que para por con se no su es al lo como más".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_TONGUES = [np.array(sorted(hash_of(w) for w in ws), np.uint64) for ws in FUNCTION_WORDS.values()]


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return (words.word % np.uint64(BUCKETS)).astype(np.int32), (words.prefix % np.uint64(BUCKETS)).astype(np.int32)


def language(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index into ``LANGUAGES`` of each text; ``at``: where the words of each begin, and the end."""
    seen = []
    for known in _TONGUES:
        k = np.minimum(np.searchsorted(known, words), len(known) - 1)
        total = np.append(0, np.cumsum(known[k] == words))
        seen.append(total[at[1:]] - total[at[:-1]])
    counts = np.array(seen)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(_TONGUES))


def padded(w: np.ndarray, p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket sequences of all texts with PAD empty words after each, and where each text begins."""
    sizes = np.diff(at)
    begin = at[:-1] + PAD * np.arange(len(sizes))
    out_w = np.full(len(w) + PAD * len(sizes), BUCKETS, np.int32)
    out_p = out_w.copy()
    to = np.arange(len(w)) + np.repeat(PAD * np.arange(len(sizes)), sizes)
    out_w[to], out_p[to] = w, p
    return out_w, out_p, begin


@dataclass
class Model:
    words: np.ndarray  # (BUCKETS + 1, DIM); the last row is the empty word
    starts: np.ndarray
    filters: np.ndarray  # (DIM, sum of widths * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray
    cut: np.ndarray | None = None  # a threshold for each of LANGUAGES

    def responses(self, w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded words, and the filters' responses at each place."""
        x = self.words[w] + self.starts[p]
        z = x @ self.filters
        total = np.zeros((len(w), FILTERS * len(WIDTHS)), self.filters.dtype)
        k = 0
        for f, width in enumerate(WIDTHS):
            for j in range(width):
                total[: len(w) - j or None, f * FILTERS : (f + 1) * FILTERS] += z[j:, k * FILTERS : (k + 1) * FILTERS]
                k += 1
        total[w == BUCKETS] = 0  # a window of empty words alone, not one that reaches into the next text
        return x, total + self.bias

    def pooled(self, w: np.ndarray, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        out_w, out_p, begin = padded(w, p, at)
        _, total = self.responses(out_w, out_p)
        return np.maximum(np.maximum.reduceat(total, begin, axis=0), 0)

    def raw(self, w: np.ndarray, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of each text, before calibration."""
        if len(at) < 2:
            return np.empty(0)
        return sigmoid(self.pooled(w, p, at) @ self.out + self.base[0])

    def uncalibrated(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability and language of each row; a null row is an empty text."""
        raw, tongue = [np.empty(0)], [np.empty(0, np.int64)]
        for _, _, words, at in word_runs(column):
            raw.append(self.raw(*buckets(words), at))
            tongue.append(language(words.word, at))
        # Sums of float32 products differ in the last places with the rows around them.
        return np.round(np.concatenate(raw), 6), np.concatenate(tongue)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated score of each row."""
        raw, tongue = self.uncalibrated(column)
        cut = self.cut[tongue]
        return np.round(np.where(raw < cut, 0.5 * raw / cut, 0.5 + 0.5 * (raw - cut) / (1 - cut)), 6)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam; a gradient may be ``(rows, values)`` with repeated rows, of which then only those rows move."""

    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            at: slice | np.ndarray = slice(None)
            if isinstance(g, tuple):
                at, where = np.unique(g[0], return_inverse=True)
                g = summed(where, g[1], len(at))
            m[at] += 0.1 * (g - m[at])
            v[at] += 0.001 * (g * g - v[at])
            p[at] -= (scale * m[at] / (np.sqrt(v[at]) + 1e-8)).astype(p.dtype)


def summed(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values added up by row."""
    out = np.zeros((n, values.shape[1]), np.float32)
    np.add.at(out, where, values)
    return out


def evidence(ids: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of each bucket from the number of documents of each class that hold it."""
    doc, ids = np.divmod(np.unique(doc * BUCKETS + ids), BUCKETS)
    pos = np.bincount(ids, weights=y[doc], minlength=BUCKETS)
    neg = np.bincount(ids, weights=1 - y[doc], minlength=BUCKETS)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    seen = pos + neg
    return (np.clip(odds, -3, 3) * seen / (seen + 3)).astype(np.float32)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and prefix buckets of all rows, and where each row begins."""
    w, p, at, n = [], [], [np.zeros(1, np.int64)], 0
    for _, _, words, cuts in word_runs(column):
        a, b = buckets(words)
        w.append(a)
        p.append(b)
        at.append(cuts[1:] + n)
        n += len(a)
    return np.concatenate(w), np.concatenate(p), np.concatenate(at)


def rows_of(w: np.ndarray, p: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index = np.concatenate([np.arange(at[i], at[i + 1]) for i in pick]) if len(pick) else np.empty(0, np.int64)
    sizes = at[pick + 1] - at[pick]
    return w[index], p[index], np.append(0, np.cumsum(sizes))


def gradients(model: Model, w: np.ndarray, p: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list:
    """Gradients of the weighted mean log-loss; those of the embeddings are rows and values."""
    ow, op, begin = padded(w, p, at)
    x, total = model.responses(ow, op)
    top = np.maximum.reduceat(total, begin, axis=0)
    pooled = np.maximum(top, 0)
    g = ((sigmoid(pooled @ model.out + model.base[0]) - y) * weight / len(y)).astype(np.float32)
    filters, bias = np.zeros_like(model.filters), np.zeros_like(model.bias)
    down = np.outer(g, model.out) * (top > 0)
    of = np.repeat(np.arange(len(y)), np.diff(np.append(begin, len(ow))))
    row, col = np.nonzero(total == top[of])
    first = np.unique(of[row] * total.shape[1] + col, return_index=True)[1]
    row, col = row[first], col[first]
    slope = down[of[row], col]
    np.add.at(bias, col, slope)
    offsets = np.cumsum([0, *WIDTHS])
    rows_w, rows_p, backs = [], [], []
    for j in range(max(WIDTHS)):
        use = (col // FILTERS >= j) & (ow[row] < BUCKETS)  # filters at least that wide
        r, c, s = row[use], col[use], slope[use]
        inside = r + j < len(ow)
        r, c, s = r[inside] + j, c[inside], s[inside]
        k = (offsets[c // FILTERS] + j) * FILTERS + c % FILTERS
        np.add.at(filters.T, k, s[:, None] * x[r])
        real = ow[r] < BUCKETS  # the empty word stays zero
        rows_w.append(ow[r][real])
        rows_p.append(op[r][real])
        backs.append((s[:, None] * model.filters[:, k].T)[real])
    back = np.concatenate(backs)
    return [(np.concatenate(rows_w), back), (np.concatenate(rows_p), back), filters, bias, pooled.T @ g, np.array([g.sum()])]


def fit(texts: pa.Array, labels: list[int], seed: int = 5) -> Model:
    """A model with cuts of 0.5; without both classes one that scores by the base rate alone."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    scale = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    model = Model(scale(BUCKETS + 1, DIM), scale(BUCKETS + 1, DIM), scale(DIM, FILTERS * sum(WIDTHS)), np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.1, np.float32), np.zeros(1, np.float32))
    model.words[-1], model.starts[-1] = 0, 0
    model.cut = np.full(len(LANGUAGES), 0.5)
    if not 0 < y.sum() < len(y):
        model.out[:] = 0
        model.base[:] = -2 if not y.sum() else 2
        return model
    w, p, at = flat(texts)
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    # The first two places of an embedding start from the evidence of its bucket; one filter reads them.
    model.words[:-1, 0] = evidence(w, doc, y)
    model.starts[:-1, 1] = evidence(p, doc, y)
    model.words[:, 1], model.starts[:, 0] = 0, 0
    model.filters[:2, 0] = 1.0
    model.out[0] = 1.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    model.base[:] = -1
    adam = Adam([model.words, model.starts, model.filters, model.bias, model.out, model.base], RATE)
    for _ in range(max(EPOCHS, min(12, STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            grads = gradients(model, *rows_of(w, p, at, pick), y[pick], weight[pick])
            grads[4] = grads[4] + 1e-4 * model.out
            adam.step(grads)
    return model


def calibrated(model: Model, docs: DataFrame, labels: DataFrame) -> Model:
    """The model with a cut for each language from all labelled rows kept for it; one of too few takes the cut of all."""
    counts = calibration(docs, labels, "toxic", model.uncalibrated)
    whole = threshold(sum(counts.values()), 0.5) if counts else 0.5
    model.cut = np.array([threshold(counts[k], whole) if k in counts else whole for k in range(len(LANGUAGES))])
    return model


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    texts, known, _ = labelled_sample(docs, labels, "toxic")
    return calibrated(fit(texts, known), docs, labels)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs(doc_id, text, ...)``.

    Only texts enter a score; null texts count as empty. Repeated rows give
    equal rows, an empty table an empty result; without labels of both classes
    all scores are alike. Other columns are ignored.
    """
    model = trained(docs, labels)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; row by row, without a shuffle."""
    model = trained(docs, labels)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(model.scores(part.column(part.schema.get_field_index("text"))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
