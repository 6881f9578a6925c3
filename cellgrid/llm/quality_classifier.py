"""Quality: attention-based multiple-instance learning over the passages of a text, trained in numpy.

A passage of ``PASSAGE`` words is encoded from the mean of its hashed word and
word-end embeddings and from shares that describe its form. Gated attention,
learnt from labels of whole documents only, weighs the passages; the weighted
representation gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .features import STATS, Words, word_runs
from .sampling import calibration, labelled_sample, threshold
from .toxicity import Adam, sigmoid

PASSAGE = 40
BUCKETS, DIM, HIDDEN, GATE = 1 << 13, 8, 24, 12
EPOCHS, STEPS, BATCH, RATE = 5, 300, 32, 0.01
#: A score of at least this much predicts good quality.
CUT = 0.3
#: Share of words equal to the one before, of words met before in the passage, and words of the passage, join the byte counts.
FORM = len(STATS) + 3


@dataclass
class Passages:
    """Passages of some texts: word buckets, where each passage's words begin, form shares, and where each text's passages begin."""

    word: np.ndarray
    end: np.ndarray
    at: np.ndarray
    form: np.ndarray
    text: np.ndarray


def passages(words: Words, cuts: np.ndarray) -> Passages:
    """Every text is cut into passages; one without words is a single empty passage."""
    sizes = np.diff(cuts)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    text = np.append(0, np.cumsum(counts))
    inner = np.arange(text[-1]) - np.repeat(text[:-1], counts)
    start = np.repeat(cuts[:-1], counts) + inner * PASSAGE
    stop = np.minimum(start + PASSAGE, np.repeat(cuts[1:], counts))
    n = stop - start
    at = np.append(0, np.cumsum(n))
    of = np.repeat(np.arange(len(n)), n)
    form = np.zeros((len(n), FORM), np.float32)
    if len(of):
        some = np.maximum(n, 1)[:, None]
        total = np.stack([np.bincount(of, weights=words.stats[:, k], minlength=len(n)) for k in range(len(STATS))], axis=1)
        form[:, 0] = total[:, 0] / some[:, 0] / 10
        form[:, 1 : len(STATS)] = total[:, 1:] / np.maximum(total[:, :1], 1)
        same = np.append(False, (words.word[1:] == words.word[:-1]) & (of[1:] == of[:-1]))
        order = np.lexsort((words.word, of))
        again = np.append(False, (words.word[order][1:] == words.word[order][:-1]) & (of[order][1:] == of[order][:-1]))
        form[:, -3] = np.bincount(of, weights=same, minlength=len(n)) / some[:, 0]
        form[:, -2] = np.bincount(of[order], weights=again, minlength=len(n)) / some[:, 0]
        form[:, -1] = n / PASSAGE
    return Passages((words.word % np.uint64(BUCKETS)).astype(np.int32), (words.suffix % np.uint64(BUCKETS)).astype(np.int32), at, form, text)


def mean_rows(table_: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the rows of each passage; zero for an empty one."""
    sizes = np.diff(at)
    if not len(ids):
        return np.zeros((len(sizes), table_.shape[1]), np.float32)
    total = np.add.reduceat(table_[ids], np.minimum(at[:-1], len(ids) - 1), axis=0)
    total[sizes == 0] = 0
    return total / np.maximum(sizes, 1)[:, None].astype(np.float32)


def shares(logits: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Softmax within each text."""
    of = np.repeat(np.arange(len(text) - 1), np.diff(text))
    e = np.exp(logits - np.maximum.reduceat(logits, text[:-1])[of])
    return e / np.add.reduceat(e, text[:-1])[of]


@dataclass
class Model:
    words: np.ndarray
    ends: np.ndarray
    encode: np.ndarray  # (2 * DIM + FORM, HIDDEN)
    bias: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    gate_w: np.ndarray
    out: np.ndarray
    base: np.ndarray
    cut: float = 0.5

    def forward(self, p: Passages) -> tuple:
        x = np.concatenate([mean_rows(self.words, p.word, p.at), mean_rows(self.ends, p.end, p.at), p.form], axis=1)
        h = np.tanh(x @ self.encode + self.bias)
        v, u = np.tanh(h @ self.gate_v), sigmoid(h @ self.gate_u)
        a = shares((v * u) @ self.gate_w, p.text)
        z = np.add.reduceat(a[:, None] * h, p.text[:-1], axis=0)
        return x, h, v, u, a, z, sigmoid(z @ self.out + self.base[0])

    def uncalibrated(self, column: pa.Array) -> np.ndarray:
        """Probability of each row; a null row is an empty text."""
        out = [self.forward(passages(words, cuts))[-1] for _, _, words, cuts in word_runs(column)]
        # Sums of float32 products differ in the last places with the rows around them.
        return np.round(np.concatenate([np.empty(0), *out]), 6)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated score of each row."""
        raw = self.uncalibrated(column)
        return np.round(np.where(raw < self.cut, CUT * raw / self.cut, CUT + (1 - CUT) * (raw - self.cut) / (1 - self.cut)), 6)


def joined(parts: list[Passages]) -> Passages:
    shift = lambda xs: np.concatenate([[0], *(x[1:] + n for x, n in zip(xs, np.cumsum([0, *(x[-1] for x in xs)]), strict=False))])
    return Passages(np.concatenate([p.word for p in parts]), np.concatenate([p.end for p in parts]), shift([p.at for p in parts]), np.concatenate([p.form for p in parts]), shift([p.text for p in parts]))


def gradients(model: Model, p: Passages, y: np.ndarray, weight: np.ndarray) -> list:
    """Gradients of the weighted mean log-loss; those of the embeddings are rows and values."""
    x, h, v, u, a, z, q = model.forward(p)
    of = np.repeat(np.arange(len(y)), np.diff(p.text))
    g = ((q - y) * weight / len(y)).astype(np.float32)
    dz = np.outer(g, model.out)
    da = (dz[of] * h).sum(axis=1)
    dl = a * (da - np.add.reduceat(a * da, p.text[:-1])[of])
    dvu = np.outer(dl, model.gate_w)
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh = a[:, None] * dz[of] + dv @ model.gate_v.T + du @ model.gate_u.T
    de = dh * (1 - h * h)
    dx = de @ model.encode.T
    n = np.diff(p.at)
    per = (dx / np.maximum(n, 1)[:, None])[np.repeat(np.arange(len(n)), n)]
    return [(p.word, per[:, :DIM]), (p.end, per[:, DIM : 2 * DIM]), x.T @ de, de.sum(axis=0), h.T @ dv, h.T @ du, (v * u).T @ dl, z.T @ g, np.array([g.sum()])]


def fit(texts: pa.Array, labels: list[int], seed: int = 11) -> Model:
    """A model with a cut of 0.5; without both classes one that scores all texts alike."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    draw = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
    model = Model(draw(BUCKETS, DIM, by=0.1), draw(BUCKETS, DIM, by=0.1), draw(2 * DIM + FORM, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1, np.float32))
    if not 0 < y.sum() < len(y):
        model.out[:] = 0
        model.base[:] = -2 if len(y) and not y.sum() else 2
        return model
    each: list[Passages] = []
    for i, j, words, cuts in word_runs(texts):
        for k in range(j - i):
            a, b = cuts[k], cuts[k + 1]
            each.append(passages(Words(words.word[a:b], words.prefix[a:b], words.suffix[a:b], words.stats[a:b]), np.array([0, b - a])))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    adam = Adam([model.words, model.ends, model.encode, model.bias, model.gate_v, model.gate_u, model.gate_w, model.out, model.base], RATE)
    for _ in range(max(EPOCHS, min(12, STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            grads = gradients(model, joined([each[i] for i in pick]), y[pick], weight[pick])
            grads[2] = grads[2] + 1e-4 * model.encode
            grads[7] = grads[7] + 1e-4 * model.out
            adam.step(grads)
    return model


def calibrated(model: Model, docs: DataFrame, labels: DataFrame) -> Model:
    """The model with a cut from all labelled rows kept for it."""

    def score(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = model.uncalibrated(column)
        return raw, np.zeros(len(raw), np.int64)

    counts = calibration(docs, labels, "quality", score)
    # Good documents are the many; the cut is drawn from their side, as for the rejected class.
    model.cut = 1 - threshold(counts[0][::-1, ::-1], 0.5) if counts else 0.5
    return model


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    texts, known, _ = labelled_sample(docs, labels, "quality")
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
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
