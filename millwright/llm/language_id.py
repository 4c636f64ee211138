"""Operator 13: language identification by averaged hashed subword embeddings.

A text is lower-cased, everything but letters becomes a blank, and each of its words, with a blank
on either side, gives its character n-grams (2 to 4 characters).  Every n-gram is hashed to one of
``BUCKETS`` rows of an embedding table; the mean of the rows goes through a linear softmax.  Table
and softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled texts.  A part of the sample that the descent never sees sets the temperature of the
softmax, and the least score at which the answers on that part are wrong at most ``error`` of the
time; texts that score below are rejected.

Texts are scored whole.  As the softmax is linear, a text's logits are the mean of its n-grams'
own logits, so a worker keeps one row of numbers per bucket and language.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import utf8
from .common import slices, worker_cache

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (2, 3, 4)
FOLDS = 5
SLICE_BYTES = 1 << 18
UNDETERMINED = "und"
_BLANK = np.uint32(32)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case if it is a letter or mark, else 0; and whether it is a letter."""
    cache = worker_cache("letters")
    if "tables" not in cache:
        low, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L" or kind == "M":
                small = chr(c).lower()
                low[c] = ord(small) if len(small) == 1 else c
                letter[c] = kind == "L"
        cache["tables"] = (low, letter)
    return cache["tables"]


def _code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their offsets per text, from UTF-8 laid end to end."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = (raw & 0xC0) != 0x80
    if int(lead.sum()) != len(points):           # not valid UTF-8: decode text by text
        parts = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
                 for a, b in zip(at[:-1], at[1:])]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return points, np.concatenate([[0], np.cumsum(lead)])[at]


def subwords(column) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per n-gram length (text number, bucket) of all n-grams of a batch, texts in order; and which texts hold a letter."""
    points, at = _code_points(*utf8(column))
    n = len(at) - 1
    sizes = np.diff(at)
    text = np.repeat(np.arange(n, dtype=np.int32), sizes)
    low, is_letter = _letters()
    has_letter = np.bincount(text[is_letter[points]], minlength=n) > 0
    # every text gets a blank before and after it; of other blanks those after a word stay
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes + 2)
    chars = np.zeros(len(owner), np.uint32)
    chars[np.arange(len(points)) + 2 * text + 1] = low[points]
    letter = chars > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1] + 2 * np.arange(n)] = True
    chars, owner, blank = np.where(letter, chars, _BLANK)[keep], owner[keep], ~letter[keep]
    out = []
    name = np.zeros(len(chars), np.uint32)
    whole = np.ones(len(chars), bool)            # one text, and no blank but at the ends
    for size in range(1, max(NGRAMS) + 1):
        m = len(chars) - size + 1
        if m <= 0:
            break
        name = (name[:m] + chars[size - 1:]) * np.uint32(0x01000193) ^ np.uint32(size)
        if size > 1:
            whole = whole[:m] & (owner[:m] == owner[size - 1:])
        if size == 2:
            whole &= ~(blank[:m] & blank[1:])
        elif size > 2:
            whole &= ~blank[size - 2:size - 2 + m]
        if size in NGRAMS:
            mixed = name[whole]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((owner[:m][whole], (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)))
    return out, has_letter


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray                           # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float                             # least score of an accepted answer

    def probabilities(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) probabilities, and which texts hold a letter."""
        grams, letters = subwords(column)
        n = len(letters)
        z, counts = np.zeros((n, len(self.languages))), np.zeros(n)
        for text, bucket in grams:
            if len(text):
                first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                z[text[first]] += np.add.reduceat(self.logits[bucket], first, axis=0, dtype=np.float64)
                counts += np.bincount(text, minlength=n)
        return _softmax((z / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature), letters


def _softmax(z: np.ndarray) -> np.ndarray:
    if z.shape[1] == 0:
        return z
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_language(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: tuple[str, ...], error: float = 0.01,
                 dim: int = 16, epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 13) -> LanguageModel:
    """Train on (distinct buckets, shares) of every text; every fourth text calibrates only."""
    n, classes = len(texts), len(languages)
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim))
    weights, bias = np.zeros((dim, classes)), np.zeros(classes)
    if classes == 0 or n == 0:
        return LanguageModel(languages, np.zeros((BUCKETS, classes), np.float32), bias, 1.0, 1.0)
    calibration = np.arange(n) % 4 == 3
    train = np.flatnonzero(~calibration)
    steps = max(1, epochs * -(-len(train) // batch))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for start in range(0, len(order), batch):
            step = rate * (1 - done / steps)
            done += 1
            chosen = order[start:start + batch]
            buckets = np.concatenate([texts[i][0] for i in chosen])
            share = np.concatenate([texts[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(texts[i][0]) for i in chosen])
            hidden = np.stack([np.bincount(owner, weights=share * table[buckets, k], minlength=len(chosen)) for k in range(dim)], axis=1)
            wrong = _softmax(hidden @ weights + bias)
            wrong[np.arange(len(chosen)), labels[chosen]] -= 1
            back = wrong @ weights.T
            weights -= step * hidden.T @ wrong
            bias -= step * wrong.sum(axis=0)
            table -= step * np.stack([np.bincount(buckets, weights=share * back[owner, k], minlength=BUCKETS) for k in range(dim)], axis=1)
    logits = (table @ weights).astype(np.float32)
    held = np.flatnonzero(calibration)
    if not len(held):
        return LanguageModel(languages, logits, bias, 1.0, 0.0)
    z = np.array([(share[:, None] * logits[b]).sum(axis=0) for b, share in (texts[i] for i in held)]) + bias
    temperature, threshold = calibrate(z, labels[held], error)
    return LanguageModel(languages, logits, bias, temperature, threshold)


def calibrate(z: np.ndarray, labels: np.ndarray, error: float) -> tuple[float, float]:
    """Temperature of least log loss, and the least score from which on the answers are wrong at most ``error`` of the time."""
    rows = np.arange(len(z))
    grid = np.geomspace(0.05, 10, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[rows, labels], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    # equal scores are accepted or rejected together
    last = np.concatenate([score[order][1:] != score[order][:-1], [True]])
    good = np.flatnonzero((wrong <= error) & last)
    return temperature, float(score[order][good[-1]]) if len(good) else 1.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train_language(docs: DataFrame, per_language: int = 400, max_rows: int = 4000, error: float = 0.01) -> LanguageModel:
    """Learn from text and language of the rows whose crc32(doc_id) mod 5 is not 0.

    The sample holds at most ``per_language`` texts of a language and ``max_rows`` in all, the first
    ones by a hash of the text; of repeated texts one is taken.  Each text's n-grams are counted
    whole, in the tasks; only their buckets and shares come to the driver.  Rows with a null text,
    language or id, or without a letter, are not learnt from.
    """
    rows = (docs.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
            .select("lang", "text", F.xxhash64("text").alias("_h")))
    # before they are ranked, a language's texts are thinned out by their hash to about four times the sample
    distinct = rows.select("lang", "_h").dropDuplicates()
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))
    place = F.expr(f"pmod(_h, {1 << 30})")
    thin = distinct.join(sizes, "lang").filter((F.col("_n") <= 4 * per_language) | (place * F.col("_n") < 4.0 * per_language * (1 << 30)))
    order = Window.partitionBy("lang").orderBy(place, "_h")
    first = (thin.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language)
             .orderBy("_r", "lang").limit(max_rows).select("lang", "_h"))
    chosen = rows.join(F.broadcast(first), ["lang", "_h"]).select("lang", "_h", "text")   # at most max_rows rows

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                grams, letters = subwords(part.column(2))
                pair, count = np.unique(np.concatenate([np.zeros(0, np.int64), *(t.astype(np.int64) * BUCKETS + b for t, b in grams)]), return_counts=True)
                cut = np.searchsorted(pair, np.arange(part.num_rows + 1) * BUCKETS)
                parts = [(pair[a:b] % BUCKETS, count[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([b.astype(np.int32).tobytes() for b, _ in parts], pa.binary()),
                     pa.array([(c / c.sum()).astype(np.float32).tobytes() for _, c in parts], pa.binary()), pa.array(letters)],
                    ["lang", "_h", "buckets", "shares", "letters"])

    got = {}
    for r in chosen.mapInArrow(run, "lang string, _h long, buckets binary, shares binary, letters boolean").filter("letters").collect():
        got[r["lang"], r["_h"]] = (np.frombuffer(r["buckets"], np.int32).astype(np.int64), np.frombuffer(r["shares"], np.float32).astype(float))
    names = sorted(got, key=lambda k: (k[1], k[0]))
    languages = tuple(sorted({k[0] for k in names}))
    place = {x: i for i, x in enumerate(languages)}
    return fit_language([got[k] for k in names], np.array([place[k[0]] for k in names], np.int64), languages, error)


def identify_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, held_out, lang_pred, score and accepted for every text.

    lang_pred is the likeliest learned language, ``und`` with score 0 for a text that is null or has
    no letter (and for all texts if nothing was learned); accepted says whether the score reaches
    the calibrated threshold.  A null id is not held out; repeated rows get equal answers; ties go to
    the first language by code point; an empty table gives no rows.
    """
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                p, letters = model.probabilities(part.column(part.num_columns - 1))
                known = letters & (len(model.languages) > 0)
                best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(known), int)
                score = np.where(known, p.max(axis=1), 0.0) if p.shape[1] else np.zeros(len(known))
                names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(part.num_columns - 1)), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                     pa.array(known & (score >= model.threshold), pa.bool_())],
                    [*part.schema.names[:-1], "lang_pred", "score", "accepted"])

    rows = docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, schema + ", lang_pred string, score double, accepted boolean")
