"""Ordered time-series features.

Every feature is a window column over one shared ordered spec, so a whole
feature set costs one exchange.  Three execution forms:

* ``mode="native"``: ``Window.partitionBy(*partition_by)`` - one hash shuffle
  by machine; right when no single machine dominates the data.
* ``mode="chunked"`` (default): range-partitioned chunks with halo rows
  (see ``ordering.bounded_window``) - bounded tasks even when one machine
  holds a third of all rows, and the only form for a global order
  (``partition_by=None`` reproduces the reference's whole-table features).

Frames never look forward, and the back-fill runs over the reversed order
(a running frame) instead of an unbounded-following frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering

DEFAULT_ORDER = ("ts", "event_id")
DEFAULT_PARTITION = ("machine_id",)
#: A machine with more rows than this is spread over several tasks.
HOT_ROWS = 5_000_000


@dataclass(frozen=True)
class FeatureConfig:
    """Feature grid.  Fixed values: the defaults are the input contract's configuration."""
    windows: tuple = (6,)
    # column -> (stats, prefix)
    rolling: dict = field(default_factory=lambda: {
        "air_temp": (("mean",), "air_temp"),
        "process_temp": (("mean",), "process_temp"),
        "rotational_speed": (("std",), "rpm"),
        "torque": (("std",), "torque"),
    })
    # column -> (lags, prefix)
    lags: dict = field(default_factory=lambda: {"air_temp": ((1, 2), "air_temp")})
    ewm: dict = field(default_factory=lambda: {"rotational_speed": (6, "rpm_ema")})
    fill_patterns: tuple = ("_mean_", "_std_", "_lag", "temp_diff", "wear_torque")


# The model's feature columns.
MODEL_FEATURES = [
    "air_temp", "process_temp", "rotational_speed", "torque", "tool_wear", "Type_L", "Type_M",
    "air_temp_mean_6", "process_temp_mean_6", "rpm_std_6", "torque_std_6",
    "air_temp_lag1", "air_temp_lag2", "temp_diff", "wear_torque", "rpm_ema",
]

_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def ewm_horizon(span: float, tol: float = 1e-17) -> int:
    """Rows after which the EWM weight q^i falls below ``tol`` (q = 1 - 2/(span+1)).

    Beyond this horizon the remaining terms are smaller than one unit in the
    last place of a double, so the bounded sum equals the full recursion to
    machine precision.
    """
    q = 1.0 - 2.0 / (span + 1.0)
    if q <= 0:
        return 1
    return max(1, int(math.ceil(math.log(tol) / math.log(q))))


# ---------------------------------------------------------------------------
# column builders: (window spec) -> list[Column]
# ---------------------------------------------------------------------------

def rolling_columns(df_columns: Sequence[str], specs: dict, windows: Sequence[int],
                    strict: bool = False) -> tuple[callable, int]:
    """W2-W7 grid; names ``prefix_stat_window``; missing columns skipped."""
    def build(w: Window) -> list[Column]:
        out = []
        for win in windows:
            frame = w.rowsBetween(-(win - 1), 0)
            for col, (stats, prefix) in specs.items():
                if col not in df_columns:
                    continue
                for stat in stats:
                    value = _STATS[stat](col).over(frame)
                    if strict:
                        value = F.when(F.count(col).over(frame) == win, value)
                    out.append(value.alias(f"{prefix}_{stat}_{win}"))
        return out
    return build, max(windows) - 1


def lag_columns(df_columns: Sequence[str], specs: dict) -> tuple[callable, int]:
    """``prefix_lagK``."""
    def build(w: Window) -> list[Column]:
        return [F.lag(col, k).over(w).alias(f"{prefix}_lag{k}")
                for col, (ks, prefix) in specs.items() if col in df_columns for k in ks]
    horizon = max([k for ks, _ in specs.values() for k in ks] or [0])
    return build, horizon


def ewm_columns(df_columns: Sequence[str], specs: dict) -> tuple[callable, int]:
    """Adjusted EWM mean Σ q^i x_{t-i} / Σ q^i over present terms.

    The horizon sum is split in two levels so the plan holds ~2·sqrt(H) lags
    instead of H: y_t = Σ_{r<B} q^r x_{t-r} (first window pass), then
    N_t = Σ_{b<K} q^{Bb} y_{t-Bb} (second pass over the same partitioning).
    The denominator uses the same form on a presence indicator.
    """
    horizon = 0
    for _, (span, _name) in specs.items():
        horizon = max(horizon, ewm_horizon(span))

    def build(w: Window) -> list[list[Column]]:
        first, second = [], []
        for col, (span, name) in specs.items():
            if col not in df_columns:
                continue
            q = 1.0 - 2.0 / (span + 1.0)
            n_terms = ewm_horizon(span)
            block = max(1, int(math.ceil(math.sqrt(n_terms))))
            n_blocks = int(math.ceil(n_terms / block))
            num, den = F.lit(0.0), F.lit(0.0)
            for r in range(block):
                x = F.col(col) if r == 0 else F.lag(col, r).over(w)
                num = num + F.coalesce(x, F.lit(0.0)) * F.lit(q ** r)
                den = den + F.when(x.isNotNull(), F.lit(q ** r)).otherwise(F.lit(0.0))
            first += [num.alias(f"_ewn_{name}"), den.alias(f"_ewd_{name}")]
            tn, td = F.lit(0.0), F.lit(0.0)
            for b in range(n_blocks):
                yn = F.col(f"_ewn_{name}") if b == 0 else F.lag(f"_ewn_{name}", b * block).over(w)
                yd = F.col(f"_ewd_{name}") if b == 0 else F.lag(f"_ewd_{name}", b * block).over(w)
                tn = tn + F.coalesce(yn, F.lit(0.0)) * F.lit(q ** (b * block))
                td = td + F.coalesce(yd, F.lit(0.0)) * F.lit(q ** (b * block))
            second.append(F.when(td > 0, tn / td).alias(name))
        return [first, second] if first else []
    return build, horizon


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_ewn_") or c.startswith("_ewd_")])


def _apply(df: DataFrame, builders: list, order_by, partition_by, mode: str,
           num_chunks: int | None, keep_layout: bool = False) -> DataFrame:
    order_by = list(order_by)
    partition_by = list(partition_by or [])
    horizon = max([h for _, h in builders] or [0])

    def build(w):
        passes: list[list[Column]] = [[]]
        for b, _ in builders:
            cols = b(w)
            if cols and isinstance(cols[0], list):
                for i, group in enumerate(cols):
                    if i >= len(passes):
                        passes.append([])
                    passes[i] += group
            else:
                passes[0] += cols
        return passes

    if mode == "native" and partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order_by)
        out = df
        for cols in build(w):
            out = out.select("*", *cols)
        return _drop_helpers(out)
    out = ordering.bounded_window(df, order_by, partition_by, build, horizon, num_chunks, keep_layout)
    return _drop_helpers(out)


def rolling(df: DataFrame, specs: dict | None = None, windows: Sequence[int] = (6,),
            order_by=DEFAULT_ORDER, partition_by=DEFAULT_PARTITION, strict: bool = False,
            mode: str = "chunked", num_chunks: int | None = None) -> DataFrame:
    specs = specs if specs is not None else FeatureConfig().rolling
    return _apply(df, [rolling_columns(df.columns, specs, windows, strict)], order_by, partition_by, mode, num_chunks)


def lags(df: DataFrame, specs: dict | None = None, order_by=DEFAULT_ORDER,
         partition_by=DEFAULT_PARTITION, mode: str = "chunked", num_chunks: int | None = None) -> DataFrame:
    specs = specs if specs is not None else FeatureConfig().lags
    return _apply(df, [lag_columns(df.columns, specs)], order_by, partition_by, mode, num_chunks)


def ewm_mean(df: DataFrame, specs: dict | None = None, order_by=DEFAULT_ORDER,
             partition_by=DEFAULT_PARTITION, mode: str = "chunked", num_chunks: int | None = None) -> DataFrame:
    specs = specs if specs is not None else FeatureConfig().ewm
    return _apply(df, [ewm_columns(df.columns, specs)], order_by, partition_by, mode, num_chunks)


EWM_BLOCK = 256


def _ewm_fold(x, state: tuple, powers, triangle):
    """Weighted sums and weights after each value of ``x`` (NaN: absent), from the state before it."""
    import numpy as np
    present = ~np.isnan(x)
    values = np.where(present, x, 0.0)
    total, weight = np.empty(len(x)), np.empty(len(x))
    n, d = state
    for a in range(0, len(x), EWM_BLOCK):
        b = min(a + EWM_BLOCK, len(x))
        lower, back = triangle[:b - a, :b - a], powers[1:b - a + 1]
        total[a:b] = lower @ values[a:b] + back * n
        weight[a:b] = lower @ present[a:b].astype(float) + back * d
        n, d = total[b - 1], weight[b - 1]
    return total, weight


def ewm_carried(df: DataFrame, column: str, span: float, name: str, order_by=DEFAULT_ORDER, partition_by=DEFAULT_PARTITION,
                num_chunks: int | None = None) -> DataFrame:
    """W9 for any span: the exact recursion, with a carry between chunks.

    Rows lie in range chunks of the order.  A chunk is summed up by the triple (decay, weighted sum,
    weight) of its last group; triples compose, (d1, n1, w1) then (d2, n2, w2) = (d1 d2, n1 d2 + n2,
    w1 d2 + w2), so a prefix scan over the chunk table (one row per chunk) gives the state before
    every chunk, and a second pass folds on from there.  Plan, halo and memory do not depend on the
    span or on the size of a group.  Absent values decay the others but have no weight; the mean is
    null until a value is seen.
    """
    import numpy as np
    import pyarrow as pa
    q = 1.0 - 2.0 / (span + 1.0)
    powers = q ** np.arange(EWM_BLOCK + 1)
    away = np.arange(EWM_BLOCK)[:, None] - np.arange(EWM_BLOCK)[None, :]
    triangle = np.where(away >= 0, q ** np.maximum(away, 0), 0.0)
    kept = df.columns
    group = F.xxhash64(*partition_by) if partition_by else F.lit(0).cast("long")
    placed, _ = ordering.sorted_layout(df, list(order_by), list(partition_by or []), num_chunks)
    placed = placed.select(*kept, ordering.CHUNK, group.alias("_g"), F.col(column).cast("double").alias("_x"), ordering.LPOS)
    placed = placed.sortWithinPartitions(ordering.CHUNK, ordering.LPOS)

    def pieces(batch):
        """(first row, end, chunk, group) of the runs of a batch, and its values."""
        at = batch.num_columns - 4
        chunk, g, x = (batch.column(at + i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (g[1:] != g[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(g)]
        return [(a, b, int(chunk[a]), int(g[a])) for a, b in zip(bounds[:-1], bounds[1:]) if b > a], x.astype(float)

    def summary(batches):
        rows = {}                                # chunk -> [first group, last group, rows of the last one, its sums]
        for batch in batches:
            runs, x = pieces(batch)
            for a, b, chunk, g in runs:
                r = rows.setdefault(chunk, [g, g, 0, (0.0, 0.0), True])
                if r[1] != g:
                    r[1:] = [g, 0, (0.0, 0.0), False]
                total, weight = _ewm_fold(x[a:b], r[3], powers, triangle)
                r[2], r[3] = r[2] + b - a, (total[-1], weight[-1])
        if rows:
            names = ["chunk", "first", "last", "n", "total", "weight", "whole"]
            cells = zip(*[(c, f, g, n, t, w, one) for c, (f, g, n, (t, w), one) in rows.items()])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cells], names)

    found = (placed.mapInArrow(summary, "chunk long, first long, last long, n long, total double, weight double, whole boolean")
             .orderBy("chunk").collect())        # one row per chunk
    carry, last, state = {}, None, (0.0, 0.0)
    for r in found:
        before = state if last == r["first"] else (0.0, 0.0)
        carry[r["chunk"]] = (r["first"], before)
        decay = q ** r["n"] if r["whole"] else 0.0
        last, state = r["last"], (before[0] * decay + r["total"], before[1] * decay + r["weight"])

    def fold(batches):
        now, state = None, (0.0, 0.0)
        for batch in batches:
            runs, x = pieces(batch)
            out = np.full(len(x), np.nan)
            for a, b, chunk, g in runs:
                if (chunk, g) != now:
                    first, before = carry[chunk]
                    state = before if g == first and (now is None or now[0] != chunk) else (0.0, 0.0)
                    now = (chunk, g)
                total, weight = _ewm_fold(x[a:b], state, powers, triangle)
                state = (total[-1], weight[-1])
                seen = weight > 0
                out[a:b][seen] = total[seen] / weight[seen]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, from_pandas=True)], [*kept, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return placed.mapInArrow(fold, f"{schema}, `{name}` double")


def derived(df: DataFrame) -> DataFrame:
    """Temperature difference and wear x torque, if the inputs exist."""
    cols = []
    if {"process_temp", "air_temp"} <= set(df.columns):
        cols.append((F.col("process_temp") - F.col("air_temp")).alias("temp_diff"))
    if {"tool_wear", "torque"} <= set(df.columns):
        cols.append((F.col("tool_wear") * F.col("torque")).alias("wear_torque"))
    return df.select("*", *cols)


def fill_columns(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(p in c for p in patterns)]


def fill_nulls(df: DataFrame, columns: Sequence[str], order_by=DEFAULT_ORDER,
               partition_by=DEFAULT_PARTITION, mode: str = "chunked",
               num_chunks: int | None = None, drop_remaining: bool = True) -> DataFrame:
    """W10 + W12: back-fill, then forward-fill, then drop rows still holding nulls."""
    columns = list(columns)
    partition_by = list(partition_by or [])
    if columns:
        if mode == "native" and partition_by:
            back = (Window.partitionBy(*partition_by).orderBy(*[F.col(c).desc() for c in order_by])
                    .rowsBetween(Window.unboundedPreceding, 0))
            fwd = (Window.partitionBy(*partition_by).orderBy(*order_by)
                   .rowsBetween(Window.unboundedPreceding, 0))
            df = df.select(*[F.last(c, ignorenulls=True).over(back).alias(c) if c in columns else F.col(c)
                             for c in df.columns])
            df = df.select(*[F.last(c, ignorenulls=True).over(fwd).alias(c) if c in columns else F.col(c)
                             for c in df.columns])
        else:
            df = ordering.fill_carry(df, columns, order_by, partition_by, "both", num_chunks)
    return df.dropna() if drop_remaining else df


def forward_fill_all(df: DataFrame, order_by=DEFAULT_ORDER, partition_by=DEFAULT_PARTITION,
                     mode: str = "chunked", num_chunks: int | None = None) -> DataFrame:
    """Forward fill of every non-key column."""
    keys = set(order_by) | set(partition_by or [])
    cols = [c for c in df.columns if c not in keys]
    if mode == "native" and partition_by:
        fwd = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[F.last(c, ignorenulls=True).over(fwd).alias(c) if c in cols else F.col(c)
                           for c in df.columns])
    return ordering.fill_carry(df, cols, order_by, partition_by, "forward", num_chunks)


def retain_last_n(df: DataFrame, n: int, order_by=DEFAULT_ORDER, partition_by=DEFAULT_PARTITION) -> DataFrame:
    """Keep the newest ``n`` rows per group."""
    w = Window.partitionBy(*partition_by).orderBy(*[F.col(c).desc() for c in order_by])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def feature_pipeline(df: DataFrame, cfg: FeatureConfig | None = None, order_by=DEFAULT_ORDER,
                     partition_by=DEFAULT_PARTITION, mode: str = "auto",
                     num_chunks: int | None = None, fill: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rolling grid + lags + derived + EWM in one ordered pass, then null repair.

    Chunked form: one range layout is shared by the windows and both fills, and
    every window runs on the same (chunk, machine) partitioning.  Native form: one
    hash shuffle by machine.  ``auto`` takes the native form for machines of at most
    ``hot_rows`` rows and the chunked one, which splits a machine, for the others; the
    results are the same.
    """
    if mode == "auto" and partition_by:
        by = list(partition_by)
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
        if sizes.isEmpty():
            return feature_pipeline(df, cfg, order_by, by, "native", num_chunks, fill)
        hot = F.broadcast(sizes.select(*by))  # at most (all rows / hot_rows) keys
        return feature_pipeline(df.join(hot, by, "left_anti"), cfg, order_by, by, "native", num_chunks, fill).unionByName(
            feature_pipeline(df.join(hot, by, "left_semi"), cfg, order_by, by, "chunked", num_chunks, fill))
    mode = "chunked" if mode == "auto" else mode
    cfg = cfg or FeatureConfig()
    cols = df.columns
    builders = [rolling_columns(cols, cfg.rolling, cfg.windows), lag_columns(cols, cfg.lags),
                ewm_columns(cols, cfg.ewm)]
    out = derived(_apply(df, builders, order_by, partition_by, mode, num_chunks, keep_layout=True))
    if fill:
        out = fill_nulls(out, fill_columns(out, cfg.fill_patterns), order_by, partition_by, mode, num_chunks)
    return out.drop(*[c for c in (ordering.CHUNK, ordering.LPOS, ordering.POS) if c in out.columns])
