"""Event-time state: features in time order, bounded windows and duplicates, live scoring (K3, K6-K8).

All state here ends: rows wait at most until the watermark (newest event time minus ``delay``) passes
them, and keys without news go after ``idle``.  Rows that come later than the watermark are left out by
Spark, as they are in any watermarked operator; rows late by less than ``delay`` change nothing
against the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from ..operators import features, state as state_ops
from ..operators.bucketed import BucketedTable
from ..operators.features import FeatureConfig
from ..plans import ensemble, scoring
from ..sources import messages

_US = "_event_us"
_EVENT = "_event_time"


def _seconds(interval: str) -> int:
    """'2 days' and the like in whole seconds."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _with_event_time(stream: DataFrame, ts_col: str, delay: str, needed: Sequence[str]) -> DataFrame:
    """Rows that have all of ``needed``, with a watermark on the event time and the time in microseconds."""
    kept = stream.filter(" and ".join(f"`{c}` is not null" for c in needed))
    timed = kept.withColumn(_EVENT, F.col(ts_col).cast("timestamp")).withWatermark(_EVENT, delay)
    return timed.withColumn(_US, F.unix_micros(_EVENT))


def _pack(frame: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream, the form in which they wait in the state."""
    batch = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_table(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes | None) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(pa.BufferReader(data)).read_all().to_pandas()] if data else []


# --------------------------------------------------------------------------
# K6: features in event-time order
# --------------------------------------------------------------------------

def _names(cfg: FeatureConfig, columns: Sequence[str]) -> list[str]:
    """Names of the stateful features, in the order of the batch operators."""
    grid = [f"{prefix}_{stat}_{w}" for w in cfg.windows for c, (stats, prefix) in cfg.rolling.items() if c in columns for stat in stats]
    lagged = [f"{prefix}_lag{k}" for c, (ks, prefix) in cfg.lags.items() if c in columns for k in ks]
    return grid + lagged + [name for c, (_, name) in cfg.ewm.items() if c in columns]


def _look_back(cfg: FeatureConfig) -> int:
    return max([w - 1 for w in cfg.windows] + [k for ks, _ in cfg.lags.values() for k in ks] + [1])


def _earlier(values: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The value ``k`` rows before, NaN where the run (``place`` counts its rows from 0) has none."""
    out = np.full(len(values), np.nan)
    if k < len(values):
        out[k:] = np.where(place[k:] >= k, values[:len(values) - k], np.nan)
    return out


def _rolled(values: np.ndarray, place: np.ndarray, window: int, stat: str) -> np.ndarray:
    """Statistic of the last ``window`` values of the run at every row; NaN is absent."""
    seen = np.stack([_earlier(values, place, k) for k in range(window - 1, -1, -1)], axis=1)
    present = ~np.isnan(seen)
    n = present.sum(axis=1)
    if stat in ("min", "max"):
        fill, pick = (np.inf, np.min) if stat == "min" else (-np.inf, np.max)
        return np.where(n > 0, pick(np.where(present, seen, fill), axis=1), np.nan)
    mean = np.where(present, seen, 0.0).sum(axis=1) / np.maximum(n, 1)
    if stat == "mean":
        return np.where(n > 0, mean, np.nan)
    spread = (np.where(present, seen - mean[:, None], 0.0) ** 2).sum(axis=1)
    return np.where(n > 1, np.sqrt(spread / np.maximum(n - 1, 1)), np.nan)


def _starts(rows: pd.DataFrame, key: str) -> np.ndarray:
    """Whether a row of rows in order of the key is its key's first."""
    k = rows[key].to_numpy()
    return np.concatenate([[True], k[1:] != k[:-1]])[:len(k)]


def _from_end(first: np.ndarray) -> np.ndarray:
    """Rows that follow in the same key, given its first rows."""
    ends = np.append(np.flatnonzero(first)[1:], len(first))
    return ends[np.cumsum(first) - 1] - 1 - np.arange(len(first))


def _features_of(ready: pd.DataFrame, past: pd.DataFrame | None, cfg: FeatureConfig, folds: dict, key: str, idle_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Features of the ordered rows of many machines after the rows of ``past``; and each machine's last rows then.

    A run is the rows of a machine without a gap of more than ``idle_us``; no feature looks beyond its run.
    """
    held = sorted({c for c in [*cfg.rolling, *cfg.lags] if c in ready})
    sums = {c: (f"_n_{name}", f"_d_{name}") for c, (_, name) in cfg.ewm.items() if c in ready}
    both = ready[[key, _US, *dict.fromkeys([*held, *sums])]].assign(_row=np.arange(len(ready)))
    if past is not None:
        both = pd.concat([past.assign(_row=-1), both], ignore_index=True).sort_values(key, kind="stable", ignore_index=True)
    row = both["_row"].to_numpy()
    now, n = row >= 0, len(both)
    first = _starts(both, key)
    begins = first | (np.diff(both[_US].to_numpy(), prepend=0) > idle_us)
    starts = np.flatnonzero(begins)
    place = np.arange(n) - starts[np.cumsum(begins) - 1]
    made, kept = {}, {key: both[key], _US: both[_US]}

    def column(c):
        return both[c].to_numpy(dtype=float, na_value=np.nan)
    for c in held:
        kept[c] = column(c)
    for w in cfg.windows:
        for c, (stats, prefix) in cfg.rolling.items():
            for stat in stats if c in ready else ():
                made[f"{prefix}_{stat}_{w}"] = _rolled(kept[c], place, w, stat)
    for c, (ks, prefix) in cfg.lags.items():
        for k in ks if c in ready else ():
            made[f"{prefix}_lag{k}"] = _earlier(kept[c], place, k)
    bounds = [*starts.tolist(), n]
    fresh = np.add.reduceat(now, starts).tolist()             # rows of a run that are not past ones: its last
    for c, (_, name) in cfg.ewm.items():
        if c not in ready:
            continue
        x = column(c)
        total, weight = (np.zeros(n) if past is None else column(s) for s in sums[c])
        for a, b, size in zip(bounds[:-1], bounds[1:], fresh):
            if size:
                at = b - size
                before = (total[at - 1], weight[at - 1]) if at > a else (0.0, 0.0)
                total[at:b], weight[at:b] = features._ewm_fold(x[at:b], before, *folds[name])
        made[name] = np.divide(total, weight, out=np.full(n, np.nan), where=weight > 0)
        kept[c], kept[sums[c][0]], kept[sums[c][1]] = x, total, weight
    out = ready.copy()
    for name, values in made.items():
        out[name] = values[now][np.argsort(row[now], kind="stable")]
    return out, pd.DataFrame(kept)[_from_end(first) < _look_back(cfg)]


_FEATURE_STATE = T.StructType([T.StructField("waiting", T.BinaryType()), T.StructField("past", T.BinaryType())])
#: Groups of machines that share a state; a checkpoint keeps the number it began with.
GROUPS = 256


def _grouped(timed: DataFrame, key: str, groups: int):
    """Machines dealt to ``groups`` by hash: a call of the state function takes all rows of a group, not of one machine."""
    return timed.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).groupBy("_group")


def _ordered(rows: pd.DataFrame, key: str, id_col: str) -> pd.DataFrame:
    """Rows by machine, time and id; of equal ones the first."""
    by = [key, _US, id_col]
    return rows.sort_values(by, kind="stable").drop_duplicates(by)


def _alive(rows: pd.DataFrame, last: np.ndarray, idle_us: int, watermark: int) -> tuple[pd.DataFrame, int | None]:
    """Rows of the machines that the watermark has not left behind by ``idle_us``, and when the next one is (ms)."""
    end = -(-(last + idle_us) // 1000)
    stays = end >= watermark
    return rows[stays], int(end[stays].min()) if stays.any() else None


def ordered_features(stream: DataFrame, delay: str = "1 hour", idle: str = "7 days", cfg: FeatureConfig | None = None,
                     ts_col: str = "ts", id_col: str = "event_id", key: str = "machine_id", groups: int = GROUPS) -> DataFrame:
    """K6: rolling, lag, exponential and derived features of each machine in event-time order.

    Rows wait in the state of their machine's group until the watermark is past them, are put in order of (time, id) over
    all micro-batches, and leave by data or by timer with the same features that the batch pipeline
    gives before its null repair.  Of rows with one time and id the first stays, so a message that is
    delivered again changes nothing.  Rows without key, time or id are left out (``live_rejects`` keeps them).

    A machine whose next row comes more than ``idle`` after the one before starts anew, and once the watermark
    is that far its rows go from the state, so neither the cut into micro-batches nor the timer changes a result.  Until
    then the state holds its rows of the last ``delay`` and its last look-back rows (a fixed number) with two
    sums per exponential mean.  The machines of one of the ``groups`` are computed together.  Rows still waiting
    when a bounded run ends stay in the checkpoint for the next run.
    """
    cfg = cfg or FeatureConfig()
    columns, idle_us = stream.columns, _seconds(idle) * 1_000_000
    names = _names(cfg, columns)
    folds = {}
    away = np.arange(features.EWM_BLOCK)[:, None] - np.arange(features.EWM_BLOCK)[None, :]
    for _, (span, name) in cfg.ewm.items():
        q = 1.0 - 2.0 / (span + 1.0)
        folds[name] = (q ** np.arange(features.EWM_BLOCK + 1), np.where(away >= 0, q ** np.maximum(away, 0), 0.0))

    def fn(group, frames: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        waiting, past = st.get if st.exists else (None, None)
        parts = [*_unpack(waiting), *([] if st.hasTimedOut else [f[[*columns, _US]] for f in frames])]
        past = (_unpack(past) or [None])[0]
        watermark, wakes = st.getCurrentWatermarkMs(), []
        later = None
        if parts:
            rows = _ordered(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0], key, id_col)
            due = -(-rows[_US] // 1000) < watermark          # whole milliseconds, as the watermark has them
            ready, later = rows[due].reset_index(drop=True), rows[~due]
            if len(ready):
                out, past = _features_of(ready, past, cfg, folds, key, idle_us)
                out = out.drop(columns=_US)
                out[names] = out[names].astype("Float64").mask(out[names].isna())
                yield out
            if len(later):
                wakes.append(-(-int(later[_US].min()) // 1000))
        if past is not None:
            last = past[_US].to_numpy()
            past, end = _alive(past, last[np.arange(len(past)) + _from_end(_starts(past, key))], idle_us, watermark)
            wakes += [end] if len(past) else []
        if not wakes:                                        # nothing waits and all machines are idle
            st.remove()
            return
        st.update((_pack(later) if later is not None and len(later) else None, _pack(past) if past is not None and len(past) else None))
        st.setTimeoutTimestamp(max(min(wakes), watermark, 1))

    schema = T.StructType([*stream.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    timed = _with_event_time(stream, ts_col, delay, [key, ts_col, id_col])
    return features.derived(_grouped(timed, key, groups).applyInPandasWithState(
        fn, schema, _FEATURE_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# --------------------------------------------------------------------------
# K7, K8: bounded per-key state
# --------------------------------------------------------------------------

def latest_per_unit(stream: DataFrame, unit: str = "1 second", delay: str = "1 hour", ts_col: str = "timestamp",
                    arrival: str = "id", key: str = "machine_id") -> DataFrame:
    """K7: of the rows of one machine and time unit the latest arrival, out once the watermark is past the unit.

    An event-time aggregate in append mode: the state holds a row per machine and unit of the
    last ``delay``, each unit leaves once, and a repeated row is the same maximum.  Rows without
    machine or time are left out.
    """
    columns = stream.columns
    timed = _with_event_time(stream, ts_col, delay, [key, ts_col]).drop(_US)
    best = timed.groupBy(F.window(_EVENT, unit), key).agg(F.max_by(F.struct(*columns), F.col(arrival)).alias("_r"))
    return best.select(*[F.col(f"_r.`{c}`").alias(c) for c in columns])


_WINDOW_STATE = T.StructType([T.StructField("rows", T.BinaryType())])


def last_n(stream: DataFrame, n: int = 30, delay: str = "1 hour", idle: str = "7 days", ts_col: str = "ts",
           id_col: str = "event_id", key: str = "machine_id", groups: int = GROUPS) -> DataFrame:
    """K8: the newest ``n`` readings of each machine by (time, id), kept in the stream's state.

    Update mode: a machine whose window changed emits its whole window, so a sink replaces the machine's rows
    (``window_writer``).  Readings more than ``idle`` before the newest one are not in the window, so the state (``n``
    rows per machine) can go when the watermark is that far past it; the rows in the sink stay.  A repeated (time, id)
    is one row.  Rows without key, time or id are left out.  The machines of one of the ``groups`` share a state.
    """
    columns, idle_us = stream.columns, _seconds(idle) * 1_000_000

    def fn(group, frames: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpack(st.get[0]) if st.exists else []
        window = held[0].assign(_new=False) if held else None
        for frame in () if st.hasTimedOut else frames:       # n rows of each machine and one frame at a time
            rows = frame[[*columns, _US]].assign(_new=True)
            window = _ordered(rows if window is None else pd.concat([window, rows], ignore_index=True), key, id_col)
            behind, times = _from_end(_starts(window, key)), window[_US].to_numpy()
            window = window[(behind < n) & (times >= times[np.arange(len(times)) + behind] - idle_us)]
        times = window[_US].to_numpy()
        first = _starts(window, key)
        changed = np.logical_or.reduceat(window["_new"].to_numpy(bool), np.flatnonzero(first))[np.cumsum(first) - 1]
        if changed.any():
            yield window.loc[changed, columns]
        window, end = _alive(window, times[np.arange(len(times)) + _from_end(first)], idle_us, st.getCurrentWatermarkMs())
        if end is None:
            st.remove()
            return
        st.update((_pack(window.drop(columns="_new")),))
        st.setTimeoutTimestamp(max(end, st.getCurrentWatermarkMs(), 1))

    timed = _with_event_time(stream, ts_col, delay, [key, ts_col, id_col])
    return _grouped(timed, key, groups).applyInPandasWithState(fn, stream.schema, _WINDOW_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def window_writer(table: BucketedTable, staging: str, key: str = "machine_id"):
    """``foreachBatch`` body: the windows of a batch replace their machines' rows; a replay does the same again.

    The batch is written to ``staging`` once, so that the stream's state is not computed again for each use.
    """
    def replaced(now: DataFrame, new: DataFrame) -> DataFrame:
        return now.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(staging)
        table.change(batch.sparkSession.read.schema(batch.schema).parquet(staging), replaced)
    return write


# --------------------------------------------------------------------------
# K3: readings -> ordered features -> fitted model -> log and registry
# --------------------------------------------------------------------------

def live_rejects(readings: DataFrame) -> DataFrame:
    """Readings that the live job does not score, with the reason: ``machine`` (no id) or ``time``."""
    blank = F.col("machine_id").isNull() | (F.trim("machine_id") == "")
    return readings.filter(blank | F.col("received_at").isNull()).withColumn("reason", F.when(blank, "machine").otherwise("time"))


def live_readings(readings: DataFrame) -> DataFrame:
    """Accepted readings (S7) as the feature stream's rows: machine, time, id, sensors, type columns.

    Id and type come from the metadata's JSON; a reading without a whole-number id gets a hash of its machine, time and
    sensors, which is the same when the message is delivered again.
    """
    accepted, _ = messages.live_ingest(readings)
    kind = F.get_json_object("metadata", "$.type")
    own = F.get_json_object("metadata", "$.event_id").try_cast("long")
    return accepted.select(
        F.coalesce(own, F.xxhash64("machine_id", F.col("received_at").cast("string"), *rules.SENSORS)).alias("event_id"),
        "machine_id", F.col("received_at").alias("ts"), *rules.SENSORS,
        *[F.coalesce((kind == k).cast("double"), F.lit(0.0)).alias(f"Type_{k}") for k in ("L", "M")], "source")


def scored_features(rows: DataFrame, model, feature_columns: Sequence[str]) -> DataFrame:
    """Rows scored by a fitted model; features that are missing or null count as 0.

    An ``Ensemble`` scales by its own scaler and columns and adds the votes of all its models (M11).
    """
    if isinstance(model, ensemble.Ensemble):
        return ensemble.votes(rows, model)
    present = set(rows.columns)
    others = [c for c in rows.columns if c not in feature_columns]
    aligned = rows.select(*others, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c)
                                     for c in feature_columns])
    return scoring.score_model(aligned, model, feature_columns)


def live_writer(model, feature_columns: Sequence[str], log_root: str, registry: BucketedTable):
    """``foreachBatch`` body: score a batch of features, log it under its batch id, bring the registry up to date.

    The log folder of a batch is overwritten on replay, and the registry's first and last times are a
    minimum and a maximum, so a batch that runs twice leaves the same tables.
    """
    empty = T.StructType.fromDDL("machine_id string, created_timestamp timestamp_ntz, last_seen timestamp_ntz, "
                                 "status string, location string, type string")

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{log_root.rstrip('/')}/batch={batch_id}"
        scored_features(batch, model, feature_columns).write.mode("overwrite").parquet(folder)
        spark = batch.sparkSession
        seen = spark.read.parquet(folder).select("machine_id", "ts")
        registry.change(seen, state_ops.registry_upsert, spark.createDataFrame([], empty))
    return write


def reject_writer(root: str):
    """``foreachBatch`` body: rejects of a batch under its id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")
    return write


def start_live_scoring(readings: DataFrame, model, feature_columns: Sequence[str], log_root: str, rejects_root: str,
                       registry: BucketedTable, checkpoint: str, delay: str = "1 hour", idle: str = "7 days",
                       cfg: FeatureConfig | None = None, trigger: dict | None = None) -> list:
    """Start the live path on a stream of readings (``messages.LIVE_SCHEMA``); two queries, returned started.

    The first orders readings, computes their features, scores them by ``model``, logs them and keeps
    the registry; the second keeps the rejects with their reasons.  Each has its own
    checkpoint below ``checkpoint``, from which a restart goes on where it stopped.  ``trigger`` holds the
    arguments of ``DataStreamWriter.trigger`` (default: all that is available, then end).
    """
    trigger = trigger or {"availableNow": True}
    rows = ordered_features(live_readings(readings.filter("received_at is not null")), delay, idle, cfg)
    scored = rows.writeStream.outputMode("append").option("checkpointLocation", f"{checkpoint}/scored") \
        .foreachBatch(live_writer(model, feature_columns, log_root, registry)).trigger(**trigger).start()
    rejects = live_rejects(readings).writeStream.option("checkpointLocation", f"{checkpoint}/rejects") \
        .foreachBatch(reject_writer(rejects_root)).trigger(**trigger).start()
    return [scored, rejects]
