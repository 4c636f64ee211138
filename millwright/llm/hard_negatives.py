"""Operator 12: hard-negative mining by a secondary-sort shuffle.

The pair scores of an anchor reach one task in the order (anchor, descending score, id): they are
dealt by a hash of the anchor and sorted by that key inside the shuffle.  A streaming iterator
passes them once.  A row of the anchor's own label opens a window (its first ``positives`` rows);
a row of another label is given out for every open window that its score falls into and that is
not full yet.  The iterator holds the windows of one anchor, never its pairs.

Only scores that can be in the result are shuffled:

1. anchors meet the rows of their own label, in blocks, and every block keeps the ``positives``
   best rows of each anchor; merged, these are the anchor's positives and fix its windows;
2. anchors with windows meet all rows, in blocks, and every block keeps, for each window, the first
   ``negatives`` rows of another label inside it.

A block is a group of at most ``ANCHOR_BLOCK`` anchors and a part of about ``ROW_PART`` rows, which
pass through the task in steps; a label or a vector that a third of the rows share is cut by a
hash of the rows like all others.  A row is sent once per block of anchors it meets.  That work
grows with anchors times rows, as every pair of them is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settled
from .crosspoly import _vectors

ANCHOR_BLOCK = 2048
ROW_PART = 1 << 18                               # rows of a part where there are more than enough parts
SMALL_PART = 1 << 12                             # and the fewest that are worth a part of their own
STEP_CELLS = 1 << 20
_EXACT = 2.0 ** 52


def usable(id_col: str, label_col: str, vector_col: str, scale: float) -> Column:
    """Rows that take part: an id, a label, and a vector whose scaled components are finite."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * F.lit(float(scale))) == float("inf")))
    return F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def _scaled(column, scale: float) -> np.ndarray:
    return np.floor(scale * _vectors(column))


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; vectors too large for exact doubles are multiplied as integers."""
    if len(a) == 0 or len(x) == 0 or np.abs(a).max() * np.abs(x).max() * a.shape[1] < _EXACT:
        return np.rint(a @ x.T).astype(np.int64)
    left, right = ([[int(v) for v in row] for row in m] for m in (a, x))
    return np.array([[max(-2 ** 63, min(2 ** 63 - 1, sum(p * q for p, q in zip(u, v)))) for v in right] for u in left], np.int64)


class _Best:
    """The first k rows per slot by (descending score, id), over rows that come in steps."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.least = np.full(slots, np.iinfo(np.int64).min)
        self.slot = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, fits: np.ndarray, slots: np.ndarray) -> None:
        """``score`` and ``fits`` have a line per slot of ``slots`` and a column per row."""
        fits = fits & (score >= self.least[slots][:, None])
        if score.shape[1] > 4 * self.k:          # all that can matter reaches the k-th best of the step
            masked = np.where(fits, score, np.iinfo(np.int64).min)
            fits &= score >= np.partition(masked, -self.k, axis=1)[:, -self.k][:, None]
        line, row = np.nonzero(fits)
        if not len(line):
            return
        slot = np.concatenate([self.slot, slots[line]])
        value = np.concatenate([self.score, score[line, row]])
        name = np.concatenate([self.id, ids[row]])
        order = np.lexsort((name, -value, slot))
        slot, value, name = slot[order], value[order], name[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate([first, [len(slot)]])))
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], value[kept], name[kept]
        full = rank == self.k - 1
        self.least[slot[full]] = value[full]


def _blocks(anchors: DataFrame, rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """Let anchors and rows of equal ``by`` meet in blocks; ``work(anchors table, steps of rows)``.

    ``anchors`` comes with ``_block``, the number of its group; the parts of the rows of a key
    follow from their number.  Anchors precede rows in a block, so a task holds a group of anchors
    and a step of rows.
    """
    groups = anchors.groupBy(*by).agg(F.max("_block").alias("_blocks"))
    n = partitions(rows.sparkSession)
    count = F.count(F.lit(1))
    sizes = rows.groupBy(*by).agg(F.greatest(F.ceil(count / F.lit(ROW_PART)), F.least(F.lit(n), F.ceil(count / F.lit(SMALL_PART))))
                                  .cast("int").alias("_parts"))
    met = settled(groups.join(sizes, by), "negatives-blocks")
    a = anchors.join(met.select(*by, "_parts"), by).withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)")))
    x = (rows.join(met, by).withColumn("_part", F.expr("cast(pmod(xxhash64(id, v), _parts) as int)"))
         .withColumn("_block", F.explode(F.expr("sequence(0, _blocks)"))))
    columns = ["_key", "_is_row", "_a", "id", "label", "v", "_lows", "_highs"]
    key = F.xxhash64(*by, "_block", "_part").alias("_key")
    windows = ["_lows", "_highs"] if "_lows" in anchors.columns else [F.lit(None).cast("array<bigint>").alias(c) for c in ("_lows", "_highs")]
    both = (a.select(key, F.lit(0).alias("_is_row"), "_a", "id", "label", "v", *windows)
            .unionByName(x.select(key, F.lit(1).alias("_is_row"), F.lit(None).cast("long").alias("_a"), "id", "label", "v",
                                  *[F.lit(None).cast("array<bigint>").alias(c) for c in ("_lows", "_highs")])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pending, last = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if end == start:
                    continue
                part = batch.slice(start, end - start)
                if keys[start] != last:
                    if state is not None:
                        yield from state.result()
                    state, pending, last = None, [], keys[start]
                if kinds[start] == 0:
                    pending.append(part)
                    continue
                if state is None and pending:
                    state = work(pa.Table.from_batches(pending))
                    pending = []
                if state is not None:
                    step = max(1, STEP_CELLS // max(1, state.size))
                    for at in range(0, part.num_rows, step):
                        state.add(part.slice(at, step))
        if state is not None:
            yield from state.result()

    return both.select(*columns).repartition(n, "_key").sortWithinPartitions("_key", "_is_row").mapInArrow(run, schema)


class _Positives:
    """The first rows of the anchors' own label."""

    def __init__(self, table: pa.Table, k: int, scale: float):
        self.a = table.column("_a").to_numpy()
        self.ids = table.column("id").to_numpy()
        self.scale = scale
        self.v = _scaled(table.column("v"), scale)
        self.size = len(self.a)
        self.best = _Best(self.size, k)

    def add(self, rows: pa.RecordBatch) -> None:
        ids = rows.column(3).to_numpy(zero_copy_only=False)
        self.best.add(_scores(self.v, _scaled(rows.column(5), self.scale)), ids, self.ids[:, None] != ids[None, :], np.arange(self.size))

    def result(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.a[self.best.slot]), pa.array(self.best.id), pa.array(self.best.score)],
                                         ["_a", "id", "score"])


class _Negatives:
    """The first rows of other labels inside each window of the anchors."""

    def __init__(self, table: pa.Table, k: int, scale: float):
        self.a = table.column("_a").to_numpy()
        self.label = table.column("label").to_numpy()
        self.scale = scale
        self.v = _scaled(table.column("v"), scale)
        self.size = len(self.a)
        lows, highs = table.column("_lows").to_pylist(), table.column("_highs").to_pylist()
        self.width = max((len(x) for x in lows), default=0)
        self.low = np.full((self.size, self.width), np.iinfo(np.int64).max)
        self.high = np.full((self.size, self.width), np.iinfo(np.int64).min)
        for i, (x, y) in enumerate(zip(lows, highs)):
            self.low[i, :len(x)], self.high[i, :len(y)] = x, y
        self.best = [_Best(self.size, k) for _ in range(self.width)]

    def add(self, rows: pa.RecordBatch) -> None:
        ids = rows.column(3).to_numpy(zero_copy_only=False)
        other = self.label[:, None] != rows.column(4).to_numpy(zero_copy_only=False)[None, :]
        score = _scores(self.v, _scaled(rows.column(5), self.scale))
        for w, best in enumerate(self.best):
            best.add(score, ids, other & (score >= self.low[:, w][:, None]) & (score <= self.high[:, w][:, None]), np.arange(self.size))

    def result(self) -> Iterator[pa.RecordBatch]:
        # a row that several windows kept is sent once; its copies in the table stay apart by their
        # number among equal (anchor, id, score) of one window
        parts = []
        for best in self.best:
            order = np.lexsort((best.id, best.score, best.slot))
            key = np.stack([best.slot[order], best.score[order], best.id[order]], axis=1)
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(1)]) if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            copy = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
            parts.append(np.concatenate([key, copy[:, None]], axis=1))
        rows = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(self.a[rows[:, 0]]), pa.array(rows[:, 2]), pa.array(rows[:, 1])], ["_a", "id", "score"])


def _emit(k: int, low: int, high: int, base: int):
    """One pass over rows sorted by (anchor, descending score, positives apart, id)."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, windows = None, []
        for batch in batches:
            out = []
            for a, anchor, minus, same, other in zip(*(c.to_pylist() for c in batch.columns)):
                score = -minus
                if a != last:
                    last, windows = a, []
                if same:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    positive, best, given = window
                    if given < k and low * best <= base * score <= high * best:
                        window[2] = given + 1
                        out.append((anchor, positive, given + 1, other, best, score))
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    return run


def mine_hard_negatives(rows: DataFrame, anchors: DataFrame, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10,
                        low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors become floor(scale * x); a score is the integer inner product with the anchor, clamped
    to the range of a long.  An
    anchor's positives are its first ``positives`` other rows of the same label by descending score,
    then id; the negatives of a positive are the first ``negatives`` rows of another label with
    ``low_percent * positive_score <= 100 * score <= high_percent * positive_score``.

    Rows with a null id or label, or a vector that is null, empty or holds null or non-finite
    components, take no part.  Rows that carry the anchor's id are not other rows.  Repeated rows
    count as often as they occur, also as anchors.  Vectors meet only those of their length.
    Anchors without positives or negatives, and empty tables, give no rows.
    """
    def clean(df: DataFrame) -> DataFrame:
        return df.filter(usable(id_col, label_col, vector_col, scale)).select(
            F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("label"), F.col(vector_col).alias("v"),
            F.size(vector_col).alias("_size"))

    x = clean(rows)
    a = settled(clean(anchors).withColumn("_a", F.monotonically_increasing_id()), "negatives-anchors")

    def grouped(df: DataFrame, by: list[str]) -> DataFrame:
        """Number the groups of at most about ANCHOR_BLOCK anchors of each key."""
        n = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(ANCHOR_BLOCK)).cast("int").alias("_n"))
        return df.join(n, by).withColumn("_block", F.expr("cast(pmod(xxhash64(_a), _n) as int)")).drop("_n")

    best = _blocks(grouped(a, ["label", "_size"]), x, ["label", "_size"], lambda t: _Positives(t, positives, scale), "_a long, id long, score long")
    order = Window.partitionBy("_a").orderBy(F.desc("score"), "id")
    chosen = settled(best.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= positives).select("_a", "id", "score"),
                     "negatives-positives")
    # ceil(low * s / 100) and floor(high * s / 100); negative scores leave the window empty
    low = F.expr(f"cast((cast(score as decimal(20, 0)) * {low_percent} + 99) div 100 as bigint)")
    high = F.expr(f"cast((cast(score as decimal(20, 0)) * {high_percent}) div 100 as bigint)")
    windows = (chosen.filter("score >= 0").withColumn("_low", low).withColumn("_high", high)
               .groupBy("_a").agg(F.collect_list("_low").alias("_lows"), F.collect_list("_high").alias("_highs")))
    found = _blocks(grouped(a.join(windows, "_a"), ["_size"]), x, ["_size"], lambda t: _Negatives(t, negatives, scale),
                    "_a long, id long, score long")
    names = a.select("_a", F.col("id").alias("anchor_id"))
    keyed = (chosen.withColumn("_same", F.lit(True)).unionByName(found.withColumn("_same", F.lit(False))).join(names, "_a")
             .select("_a", "anchor_id", (-F.col("score")).alias("_minus"), "_same", "id"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return (keyed.repartition(partitions(rows.sparkSession), "_a").sortWithinPartitions("_a", "_minus", F.desc("_same"), "id")
            .mapInArrow(_emit(negatives, low_percent, high_percent, 100), schema))
