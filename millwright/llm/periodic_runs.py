"""Operator 11: periodic runs of words by an online sparse diagonal DP.

The words of a text are passed from left to right.  A diagonal is a lag; its match length counts
the words in a row that equal the word one lag earlier.  Earlier occurrences of what ends at a word
open diagonals, every later word lengthens the open ones or ends them, and a diagonal that ends
after enough matches emits its run at once.  A run of period q and length n has n - q matches, so
at least ``max(MIN_LENGTH - q, q)`` of them.

Sparse means that only diagonals which can become runs are opened:

* lags below ``MIN_LENGTH`` open where enough matches in a row have been seen;
* a lag from L to 2L - 1, for L = 12, 24, 48, ..., needs L matches in a row, so it opens where the
  last L words occurred before, at that distance.  An L-gram whose nearest earlier occurrence is at
  most L / 2 away lies inside a run of that smaller period, and needs no diagonal: if every L-gram
  of a diagonal were such, the smaller period would divide the lag (Fine and Wilf), and the run
  would be that of the smaller period.  Nor does the first L-gram of a run of a small period t
  (its next occurrence is t away) whose nearest earlier occurrence is L + t or more away: a
  diagonal that starts there crosses the words between the two runs, or is opened after them.

So a word opens at most a few diagonals per L, also where one word fills the whole text.  Diagonals
of multiples of a run's period cover the same words as the run itself; of runs over the same
stretch the smallest period stays.  Texts are taken whole, many at a time; a separator that equals
no word keeps runs inside their text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import mix
from .common import WORD, slices

MIN_LENGTH = 12
SLICE_BYTES = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_WORD = re.compile(WORD)


def _need(lag: int) -> int:
    return max(MIN_LENGTH - lag, lag)


def _short_openings(w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, lag) where a lag below MIN_LENGTH has just collected its matches."""
    out = []
    for lag in range(1, min(MIN_LENGTH, len(w))):
        edges = np.diff(np.concatenate([[False], w[lag:] == w[:-lag], [False]]).astype(np.int8))
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        first = first[end - first >= _need(lag)]
        out.append((first + lag + _need(lag) - 1, np.full(len(first), lag)))
    return out


def _long_openings(w: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, lag) where the last L words occurred before in the same text, L to 2L - 1 words ago."""
    out = []
    size = MIN_LENGTH
    if len(w) < 2 * size:
        return out
    one = mix(w.astype(np.uint64) + mix(text.astype(np.uint64)))
    two = mix(one[:-1] + mix(one[1:] + np.uint64(1)))
    three = mix(two[:-1] + mix(one[2:] + np.uint64(2)))
    six = mix(three[:-3] + mix(three[3:] + np.uint64(3)))
    gram = mix(six[:-6] + mix(six[6:] + np.uint64(4)))
    at = np.arange(len(gram))                    # first words of the grams that still repeat
    while len(at):
        name = gram[at]
        order = np.argsort(name, kind="stable")
        place, name = at[order], name[order]
        same = name[1:] == name[:-1]
        repeats = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rows = np.flatnonzero(same) + 1
        before = place[rows] - place[rows - 1]
        after = np.full(len(place), len(w) + size)
        after[:-1][same] = (place[1:] - place[:-1])[same]
        after = after[rows]
        rows = rows[(before > size // 2) & ((after > size // 2) | (before < size + after))]
        back = 1
        while len(rows):
            lag = place[rows] - place[rows - back]
            fits = (lag >= size) & (lag < 2 * size)
            out.append((place[rows[fits]] + size - 1, lag[fits]))
            rows = rows[lag < 2 * size]
            back += 1
            rows = rows[rows >= back]
            rows = rows[name[rows] == name[rows - back]]
        # twice as long: both halves must repeat
        held = np.zeros(len(gram) + size, bool)
        held[place[repeats]] = True
        at = np.flatnonzero(held[:-size] & held[size:])
        at = at[at + 2 * size <= len(w)]
        longer = np.zeros(len(gram), np.uint64)
        longer[at] = mix(gram[at] + mix(gram[at + size] + np.uint64(5)))
        gram = longer
        size *= 2
    return out


def find_runs(w: np.ndarray, text: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then period.

    ``text`` numbers the text of every word; texts must be parted by words that equal no other.
    """
    text = np.zeros(len(w), np.int64) if text is None else text
    opened = _short_openings(w) + _long_openings(w, text)
    at = np.concatenate([a for a, _ in opened]) if opened else np.zeros(0, np.int64)
    if not len(at):
        return []
    lags = np.concatenate([b for _, b in opened])
    order = np.lexsort((lags, at))
    at, lags = at[order].tolist(), lags[order].tolist()
    words, n = w.tolist(), len(w)
    smallest: dict[tuple[int, int], int] = {}
    active: dict[int, int] = {}                  # lag -> matches in a row up to the last word
    i, k = 0, 0
    while active or k < len(at):
        if not active:
            i = at[k]
        for lag in list(active):
            if i < n and words[i] == words[i - lag]:
                active[lag] += 1
                continue
            matches = active.pop(lag)
            if matches >= _need(lag):
                stretch = (i - matches - lag, i)
                smallest[stretch] = min(lag, smallest.get(stretch, lag))
        while k < len(at) and at[k] == i:
            lag = lags[k]
            k += 1
            if lag not in active:
                matches = 0
                while i - matches >= lag and words[i - matches] == words[i - matches - lag]:
                    matches += 1
                if matches:
                    active[lag] = matches
        i += 1
    return sorted((start, end - start, period) for (start, end), period in smallest.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that are in no run after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(kept)])


def _scan(texts: list) -> tuple[list[list[str]], list[list[tuple[int, int, int]]]]:
    """Words and runs of every text of a slice."""
    split = [_WORD.findall(t) if t else [] for t in texts]
    numbers: dict[str, int] = {}
    ids = np.empty(sum(len(s) + 1 for s in split), np.int64)
    first = []
    used = 0
    for k, s in enumerate(split):
        first.append(used)
        ids[used:used + len(s)] = [numbers.setdefault(x, len(numbers)) for x in s]
        used += len(s) + 1
        ids[used - 1] = -1 - k                   # a separator of its own
    sizes = np.array([len(s) + 1 for s in split], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in split]
    starts = np.array(first, np.int64)
    for start, length, period in find_runs(ids, np.repeat(np.arange(len(split)), sizes)):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        found[k].append((start - first[k], length, period))
    return split, found


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``runs`` and ``collapsed`` added.

    ``runs`` are the stretches of words with smallest period q and a length of at least
    ``max(12, 2 q)`` that no neighbouring word extends, by start, then period; ``collapsed`` is the
    text without the words that a run contains after its first q, joined by one space.  A null,
    empty or white-space text has no runs and collapses to an empty text; words differ by case;
    repeated rows and rows without an id each give their own row; an empty table gives no rows;
    columns named ``runs`` or ``collapsed`` in the input are replaced.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                words, runs = _scan(part.column(part.num_columns - 1).to_pylist())
                flat = [r for one in runs for r in one]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                columns = np.array(flat, np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(columns[:, j]) for j in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j) for j in range(part.num_columns - 1)), pa.ListArray.from_arrays(pa.array(offsets), items),
                     pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.string())],
                    [*part.schema.names[:-1], "runs", "collapsed"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{schema}, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts in which every tenth document, by the CRC-32 of its decimal id, ends in a period.

    With h the checksum, g = floor(h / 10) and n > 0 words, such a document (h % 10 = 0) keeps its
    words before a = g % n, and word i from there on becomes word a + (i - a) % p, with
    p = 1 + floor((n - a) / (3 + g % 8)).  Other texts, and those without an id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    rows = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w")).withColumn("_g", F.floor(h / 10).cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.expr("cast(_g % _n as int)")))
    rows = rows.withColumn("_p", F.expr("cast(1 + floor((_n - _a) / (3 + _g % 8)) as int)"))
    turned = F.expr("array_join(transform(sequence(0, _n - 1), i -> _w[if(i >= _a, _a + (i - _a) % _p, i)]), ' ')")
    return rows.withColumn(text_col, F.when(F.col("_n") > 0, turned).otherwise(F.col(text_col))).drop("_w", "_n", "_g", "_a", "_p")


def run_digests(found: DataFrame, *keep: str) -> DataFrame:
    """Number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_b", best).select(
        *keep, F.size("runs").cast("long").alias("n_runs"), F.col("_b.s").alias("start"), (-F.col("_b.l")).alias("length"),
        F.col("_b.p").alias("period"), F.expr("(1000 * -_b.l) div _b.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
