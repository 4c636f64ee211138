"""Operator 6: quality classifier by positive-unlabelled learning.

Only texts marked good are trusted; the rest of the training signal is unlabelled text.  A linear
model minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic loss, where the class prior (the share of good text among the unlabelled) is
estimated from the two samples.  The fit uses bounded samples (``max_positive``,
``max_unlabelled``), taken in hash order; every text is scored as a whole.

Features of a text: square roots of the shares of its byte-class trigrams (letters, capitals,
digits, marks, ...), and how much of it repeats (distinct words, word pairs, lines and five-word
runs, equal neighbours), with its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import mix, shingles, utf8, words
from .common import slices, text_batches, tidy

SLICE_BYTES = 1 << 18
FOLDS = 5


def _classes() -> np.ndarray:
    c = np.full(256, 11, np.int64)               # control
    c[0x80:] = 10
    c[0x21:0x7F] = 8
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" ", 3),
                     (b"\t\n\r\x0b\x0c", 4), (b".;:", 5), (b",'\"()-", 6), (b"!?", 7), (b"|", 9)):
        c[list(chars)] = k
    return c


_CLASS = _classes()
_N = 12
_EXTRA = 8
WIDTH = _N ** 3 + _EXTRA


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each row."""
    if len(rows) == 0:
        return np.zeros(n)
    _, where = np.unique(values ^ mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.bincount(rows[where], minlength=n).astype(float)


def text_features(column) -> np.ndarray:
    """One row of WIDTH numbers per text; a null or empty text has zeros only."""
    raw, at = utf8(column)
    n = len(at) - 1
    sizes = np.diff(at)
    out = np.zeros((n, WIDTH), np.float32)
    if len(raw) == 0:
        return out
    owner = np.repeat(np.arange(n), sizes)
    c = _CLASS[raw]
    if len(raw) >= 3:
        whole = owner[:-2] == owner[2:]
        code = ((c[:-2] * _N + c[1:-1]) * _N + c[2:])[whole]
        counts = np.bincount(owner[:-2][whole] * _N ** 3 + code, minlength=n * _N ** 3).reshape(n, _N ** 3)
        out[:, :_N ** 3] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    w, first = words(raw, at)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)
    word_row = np.repeat(np.arange(n), n_words)
    pair_row = word_row[:-1][word_row[:-1] == word_row[1:]]
    pairs = mix(w[:-1] * np.uint64(3) + mix(w[1:]))[word_row[:-1] == word_row[1:]]
    equal = (w[:-1] == w[1:])[word_row[:-1] == word_row[1:]]
    s, s_at = shingles(raw, at, 5)
    s_row = np.repeat(np.arange(n), np.diff(s_at))
    breaks = (raw == 10)
    n_lines = np.bincount(owner[breaks], minlength=n) + 1
    extra = out[:, _N ** 3:]
    extra[:, 0] = _distinct(word_row, w, n) / some
    extra[:, 1] = _distinct(pair_row, pairs, n) / np.maximum(some - 1, 1)
    extra[:, 2] = np.bincount(pair_row[equal], minlength=n) / some
    extra[:, 3] = _distinct(s_row, s, n) / np.maximum(np.diff(s_at), 1)
    extra[:, 4] = np.log1p(n_words) / 10
    extra[:, 5] = np.log(np.maximum(_distinct(word_row, w, n), 1)) / np.maximum(np.log(some), 1)
    extra[:, 6] = (sizes / some) / 20
    extra[:, 7] = n_lines / some
    extra[sizes == 0] = 0
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, column) -> np.ndarray:
        """Probability of good quality per text."""
        z = ((text_features(column) - self.mean) / self.scale) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _minimise(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk, or on plain positives against unlabelled without a prior."""
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        pos, neg_p, neg_u = (sp - 1) / len(p), sp / len(p), su / len(u)
        if prior is None:
            dp, du = pos, neg_u
        else:
            rest = np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
            if rest >= 0:
                dp, du = prior * (pos - neg_p), neg_u
            else:                                # the negative part went below zero: step back from it
                dp, du = prior * neg_p, -neg_u
        g = np.append(dp @ p + du @ u + decay * w, dp.sum() + du.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int, rate: float, decay: float) -> float:
    """Largest share of positives that the unlabelled sample allows.

    A model of positives against unlabelled is fitted on one half and scores the other, both ways.
    Above any threshold the unlabelled share is at least the prior times that of the positives, so
    the smallest ratio of the two bounds the prior; thresholds that leave fewer than half of the
    positives are too noisy to be used.
    """
    scores = []
    for side in (0, 1):
        w, b = _minimise(p[side::2], u[side::2], None, steps, rate, decay)
        scores.append((p[1 - side::2] @ w + b, u[1 - side::2] @ w + b))
    ratios = []
    for share in np.linspace(0.02, 0.5, 25):
        above = [(np.mean(y >= c), np.mean(x >= c)) for x, y in scores for c in [np.quantile(x, share)]]
        ratios.append(sum(y for y, _ in above) / max(sum(x for _, x in above), 1e-9))
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit_quality(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None,
                steps: int = 240, rate: float = 0.02, decay: float = 3e-3) -> QualityModel:
    """Fit on two feature matrices; with fewer than four of either every text gets the same score
    (0.5 without positives, otherwise nearly 1)."""
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, WIDTH), np.float32)
    mean, scale = both.mean(0), both.std(0) + 0.02
    if len(positive) < 4 or len(unlabelled) < 4:
        return QualityModel(np.zeros(WIDTH, np.float32), 5.0 if len(positive) else 0.0, mean, scale, prior or 0.5)
    p, u = (((x - mean) / scale).astype(np.float32) for x in (positive, unlabelled))
    if prior is None:
        prior = estimate_prior(p, u, steps // 3, rate, decay)
    w, b = _minimise(p, u, prior, steps, rate, decay)
    return QualityModel(w, b, mean, scale, prior)


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _features_of(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of a bounded set of documents, on the driver."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x = text_features(part.column(0)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(run, "x binary").collect()
    return np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(-1, WIDTH)


def train_quality(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 3000) -> QualityModel:
    """Fit on trusted positives (labels.quality = 1) and on documents whatever their label, which stays unread.

    Labels and unlabelled texts come only from rows whose crc32(doc_id) mod 5 is not 0.  Both
    samples are the first rows by a hash of doc_id, at most ``max_positive`` and
    ``max_unlabelled``; only these come to the driver.  Nothing else is taken from the labels.
    """
    training = _fold(F.col("doc_id")) != 0
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    positives = labels.filter(training & (F.col("quality") == 1)).select("doc_id").distinct()
    unlabelled = docs.filter(training).select("doc_id").distinct()
    return fit_quality(_features_of(docs, positives.orderBy(*by_hash).limit(max_positive)),
                       _features_of(docs, unlabelled.orderBy(*by_hash).limit(max_unlabelled)))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, held_out, score and predicted for every text.

    A null text scores like an empty one; a null id is not held out; repeated rows score alike; an
    empty table gives no rows.  Only the text goes into a score.
    """
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                score = model.score(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(part.num_columns - 1)), pa.array(score, pa.float64()),
                     pa.array((score >= threshold).astype(np.int32), pa.int32())],
                    [*part.schema.names[:-1], "score", "predicted"])

    rows = docs.select(*keep, F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(tidy(run), schema + ", score double, predicted int")


def good_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all of their columns."""
    text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield part.filter(pa.array(model.score(part.column(part.schema.get_field_index("text"))) >= threshold))
    return docs.mapInArrow(tidy(run), docs.schema)
