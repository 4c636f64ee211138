"""Ordered operators without a one-partition window (W1, T1, T2, T7, T8 and the
global / skew-safe form of every ordered feature).

A plain ``Window.orderBy(...)`` with no ``partitionBy`` pulls all rows into one
task, and ``Window.partitionBy(machine)`` puts a hot machine into one task.  The
layout below avoids both:

1. ``repartitionByRange(n, *keys, *order)`` + ``sortWithinPartitions``: every
   range partition ("chunk") is a contiguous, bounded slice of the sort order,
   however skewed the keys are.  A hot key is simply spread over many chunks.
2. ``spark_partition_id()`` and ``monotonically_increasing_id()`` tag each row
   with its chunk and its local index; the tagged table is checkpointed into
   the shared checkpoint folder so that recomputation (lost executor, second
   action) can never move a row to another chunk.
3. Chunk sizes form a tiny table (one row per chunk) whose prefix sum gives the
   chunk start; it is broadcast (size bounded by the chunk count, a parameter)
   to turn local indexes into global positions.
4. Bounded look-back (rolling windows, lags, the EWM horizon) copies the ``h``
   rows before each chunk into it as *halo* rows, found by an equi-join on the
   global position against a broadcast table of ``n_chunks * h`` positions.
   Windows then run per ``(chunk, group)`` - each task holds at most one chunk.
5. Unbounded carries (per-group position, forward/back fill) are folded on the
   tiny per-chunk summary and broadcast back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

CHUNK, LPOS, POS, START, HALO = "_chunk", "_lpos", "_pos", "_start", "_halo"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in (xs or [])]


def default_chunks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sorted_layout(df: DataFrame, order_by: Sequence, partition_by: Sequence = (),
                  num_chunks: int | None = None, freeze: bool = True) -> tuple[DataFrame, DataFrame]:
    """Range-partition and sort; return (rows with _chunk/_lpos/_pos, chunk table).

    The chunk table has one row per non-empty chunk: ``_chunk, _n, _start``.
    """
    keys = _cols(partition_by) + _cols(order_by)
    n = num_chunks or default_chunks(df)
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn(CHUNK, F.spark_partition_id())
              .withColumn(LPOS, F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    if freeze:
        checkpoint_root(df.sparkSession)
        tagged = tagged.checkpoint(eager=True)
    sizes = tagged.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.withColumn(START, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    placed = (tagged.join(F.broadcast(chunks.select(CHUNK, START)), CHUNK)
              .withColumn(POS, F.col(START) + F.col(LPOS)).drop(START))
    return placed, chunks


def with_halo(placed: DataFrame, chunks: DataFrame, halo: int) -> DataFrame:
    """Union the ``halo`` rows preceding every chunk (by global position) into it.

    Adds a boolean ``_halo`` column; halo rows carry the *target* chunk id.
    """
    base = placed.withColumn(HALO, F.lit(False))
    if halo <= 0:
        return base
    wanted = (chunks.select(F.col(CHUNK).alias("_target"),
                            F.explode(F.sequence(F.col(START) - halo, F.col(START) - 1)).alias(POS))
              .filter(F.col(POS) >= 0))
    copies = (placed.join(F.broadcast(wanted), POS)
              .withColumn(CHUNK, F.col("_target")).drop("_target")
              .withColumn(HALO, F.lit(True)))
    return base.unionByName(copies)


def bounded_window(df: DataFrame, order_by: Sequence, partition_by: Sequence,
                   build: Callable[[Window], list[Column]], halo: int,
                   num_chunks: int | None = None, keep_layout: bool = False) -> DataFrame:
    """Apply window columns whose frames look back at most ``halo`` rows.

    ``build(w)`` receives the ordered window spec and returns aliased columns;
    it may also return a list of lists, evaluated as successive window passes
    over the same (chunk, group) partitioning (no extra exchange).  Works for
    the global order (``partition_by`` empty) and for skewed groups.  With
    ``keep_layout`` the chunk columns stay so that ``fill_carry`` can reuse them.
    """
    placed, chunks = sorted_layout(df, order_by, partition_by, num_chunks)
    rows = with_halo(placed, chunks, halo)
    w = Window.partitionBy(CHUNK, *_cols(partition_by)).orderBy(*_cols(order_by))
    passes = build(w)
    if passes and not isinstance(passes[0], list):
        passes = [passes]
    for cols in passes:
        rows = rows.select("*", *cols)
    out = rows.filter(~F.col(HALO)).drop(HALO)
    return out if keep_layout else out.drop(CHUNK, LPOS, POS)


def _group_struct(partition_by: Sequence) -> Column:
    cols = _cols(partition_by)
    return F.struct(*cols) if cols else F.lit(0)


def row_position(df: DataFrame, order_by: Sequence, partition_by: Sequence = (),
                 name: str = "row_position", num_chunks: int | None = None,
                 size_name: str | None = None) -> DataFrame:
    """0-based position in ``order_by`` (within each group if given).

    Global form: chunk start + local index, no window at all.  Grouped form:
    row_number per (chunk, group) + carry of the group's rows in earlier chunks
    (only the first group of a chunk can have any).  ``size_name`` adds the
    group size (rows of the group in earlier + this + later chunks).
    """
    placed, chunks = sorted_layout(df, order_by, partition_by, num_chunks)
    if not partition_by:
        out = placed.withColumn(name, F.col(POS))
        if size_name:
            total = chunks.agg(F.sum("_n").cast("long").alias(size_name))
            out = out.crossJoin(F.broadcast(total))
        return out.drop(CHUNK, LPOS, POS)
    part = Window.partitionBy(CHUNK, *_cols(partition_by))
    ranked = (placed.withColumn("_rn", F.row_number().over(part.orderBy(LPOS)).cast("long"))
              .withColumn("_cnt", F.count(F.lit(1)).over(part))
              .withColumn("_g", _group_struct(partition_by)))
    edge = (ranked.groupBy(CHUNK)
            .agg(F.min_by(F.struct("_g", "_cnt"), LPOS).alias("_fp"),
                 F.max_by(F.struct("_g", "_cnt"), LPOS).alias("_lp")))
    edge = edge.select(CHUNK, F.col("_fp._g").alias("_first"), F.col("_fp._cnt").alias("_nfirst"),
                       F.col("_lp._g").alias("_last"), F.col("_lp._cnt").alias("_nlast"))
    # rows of the chunk's first group in earlier chunks: running sum over chunks where it was last
    cum = edge.withColumn("_cum", F.sum("_nlast").over(Window.partitionBy("_last").orderBy(CHUNK)))
    # rows of the chunk's last group in later chunks: reverse running sum over chunks where it was first
    cum = cum.withColumn("_rcum", F.sum("_nfirst").over(Window.partitionBy("_first").orderBy(F.col(CHUNK).desc())))
    prev = Window.orderBy(CHUNK)
    nxt = Window.orderBy(F.col(CHUNK).desc())
    carry = cum.select(
        CHUNK, "_first", "_last",
        F.when(F.lag("_last").over(prev) == F.col("_first"), F.lag("_cum").over(prev)).otherwise(F.lit(0))
        .cast("long").alias("_before"),
        F.when(F.lag("_first").over(nxt) == F.col("_last"), F.lag("_rcum").over(nxt)).otherwise(F.lit(0))
        .cast("long").alias("_after"))
    out = ranked.join(F.broadcast(carry), CHUNK)
    before = F.when(F.col("_g") == F.col("_first"), F.col("_before")).otherwise(F.lit(0))
    out = out.withColumn(name, F.col("_rn") - 1 + before)
    if size_name:
        after = F.when(F.col("_g") == F.col("_last"), F.col("_after")).otherwise(F.lit(0))
        out = out.withColumn(size_name, F.col("_cnt") + before + after)
    return out.drop(CHUNK, LPOS, POS, "_rn", "_cnt", "_g", "_first", "_last", "_before", "_after")


def fill_carry(df: DataFrame, columns: Sequence[str], order_by: Sequence, partition_by: Sequence = (),
               direction: str = "forward", num_chunks: int | None = None) -> DataFrame:
    """Forward fill, backward fill, or ``both`` (back-fill, then forward-fill).

    Back-fill followed by forward-fill equals ``coalesce(next non-null at or
    after, last non-null before)`` on the original values, so ``both`` needs a
    single summary pass.  Within a chunk a running ``last(ignorenulls)`` frame
    does the work (the backward form runs over the reversed order instead of an
    unbounded-following frame, which Spark would recompute per row).  Across
    chunks the nearest non-null value of the same group is folded on the
    per-chunk summary (one row per chunk) and broadcast back.
    """
    if CHUNK in df.columns and LPOS in df.columns:
        placed = df  # already laid out (e.g. by bounded_window(keep_layout=True))
    else:
        placed, _ = sorted_layout(df, order_by, partition_by, num_chunks)
    keep = CHUNK in df.columns
    columns = list(columns)
    dirs = ["backward", "forward"] if direction == "both" else [direction]
    placed = placed.withColumn("_g", _group_struct(partition_by))
    aggs = [F.min_by("_g", LPOS).alias("_gfirst"), F.max_by("_g", LPOS).alias("_glast")]
    for c in columns:
        present = F.when(F.col(c).isNotNull(), F.col(LPOS))
        pair = F.struct(F.col("_g").alias("g"), F.col(c).alias("v"))
        aggs += [F.min_by(pair, present).alias(f"_fn_{c}"), F.max_by(pair, present).alias(f"_ln_{c}")]
    summary = placed.groupBy(CHUNK).agg(*aggs)
    sel = [CHUNK, "_gfirst", "_glast"]
    for d in dirs:
        back = d == "backward"
        # edge group facing the neighbour we borrow from, and its nearest non-null value in this chunk
        edge = "_gfirst" if back else "_glast"
        inner = "_glast" if back else "_gfirst"
        order = F.col(CHUNK).desc() if back else F.col(CHUNK).asc()
        for c in columns:
            src = f"_fn_{c}" if back else f"_ln_{c}"
            summary = summary.withColumn(f"_v{d[0]}_{c}", F.when(F.col(f"{src}.g") == F.col(edge), F.col(f"{src}.v")))
            summary = summary.withColumn(f"_k{d[0]}_{c}", F.last(f"_v{d[0]}_{c}", ignorenulls=True).over(
                Window.partitionBy(edge).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        look = Window.orderBy(order)
        for c in columns:
            sel.append(F.when(F.lag(edge).over(look) == F.col(inner), F.lag(f"_k{d[0]}_{c}").over(look))
                       .alias(f"_carry{d[0]}_{c}"))
    carry = summary.select(*sel)
    out = placed.join(F.broadcast(carry), CHUNK)
    part = Window.partitionBy(CHUNK, *_cols(partition_by))
    fwd = part.orderBy(F.col(LPOS).asc()).rowsBetween(Window.unboundedPreceding, 0)
    bwd = part.orderBy(F.col(LPOS).desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for c in columns:
        parts = []
        for d in dirs:
            if d == "backward":
                parts += [F.last(c, ignorenulls=True).over(bwd),
                          F.when(F.col("_g") == F.col("_glast"), F.col(f"_carryb_{c}"))]
            else:
                parts += [F.last(c, ignorenulls=True).over(fwd),
                          F.when(F.col("_g") == F.col("_gfirst"), F.col(f"_carryf_{c}"))]
        filled[c] = F.coalesce(*parts).alias(c)
    out = out.select(*[filled.get(c, F.col(c)) for c in out.columns])
    drop = ["_g", "_gfirst", "_glast"] + [c for c in out.columns if c.startswith("_carry")]
    if not keep:
        drop += [CHUNK, LPOS, POS]
    return out.drop(*drop)


def running_sums(df: DataFrame, columns: Sequence[str], order_by: Sequence,
                 num_chunks: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Inclusive prefix sums in global order: local running sum + chunk offset."""
    placed, _ = sorted_layout(df, order_by, (), num_chunks)
    w = Window.partitionBy(CHUNK).orderBy(LPOS).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(CHUNK).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(CHUNK, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                     for c in columns])
    out = placed.join(F.broadcast(offsets), CHUNK)
    for c in columns:
        out = out.withColumn(f"{c}{suffix}", F.sum(c).over(w) + F.col(f"_o_{c}"))
    return out.drop(CHUNK, LPOS, *[f"_o_{c}" for c in columns])


# --------------------------------------------------------------------------
# Top-k style operators: TakeOrderedAndProject, never a driver-side tail.
# --------------------------------------------------------------------------

def tail_n(df: DataFrame, n: int, order_by: Sequence) -> DataFrame:
    """Last ``n`` rows in ``order_by`` (per-partition top-k, then merge)."""
    return df.orderBy(*[c.desc() for c in _cols(order_by)]).limit(n)


def head_n(df: DataFrame, n: int, order_by: Sequence) -> DataFrame:
    """First ``n`` rows."""
    return df.orderBy(*_cols(order_by)).limit(n)


def time_split(df: DataFrame, order_by: Sequence, test_size: float = 0.2,
               num_chunks: int | None = None) -> DataFrame:
    """``split`` = 'train' for position < int(n*(1-test_size)), else 'test'.

    ``n`` is read from the tiny chunk table, not by a second full count.
    """
    placed, chunks = sorted_layout(df, order_by, (), num_chunks)
    total = chunks.agg(F.sum("_n").alias("_total"))
    cut = total.select(F.floor(F.col("_total") * F.lit(1.0 - test_size)).cast("long").alias("_cut"))
    out = placed.crossJoin(F.broadcast(cut))
    return (out.withColumn("split", F.when(F.col(POS) < F.col("_cut"), "train").otherwise("test"))
            .withColumn("row_position", F.col(POS)).drop(CHUNK, LPOS, POS, "_cut"))


def halves(df: DataFrame, order_by: Sequence, num_chunks: int | None = None) -> DataFrame:
    """``half`` = 0 for position < n div 2, else 1."""
    placed, chunks = sorted_layout(df, order_by, (), num_chunks)
    mid = chunks.agg(F.floor(F.sum("_n") / 2).cast("long").alias("_mid"))
    out = placed.crossJoin(F.broadcast(mid))
    return (out.withColumn("half", F.when(F.col(POS) < F.col("_mid"), 0).otherwise(1))
            .withColumn("row_position", F.col(POS)).drop(CHUNK, LPOS, POS, "_mid"))


# --------------------------------------------------------------------------
# The middle of an order without sorting the table.
# --------------------------------------------------------------------------

MIDDLE_BINS = 1024
MIDDLE_ROWS = 100_000


def _rankable(df: DataFrame, name: str) -> list[Column]:
    """Two columns that order like ``name``: its class (null, -inf, finite, inf, NaN), and a number
    without nulls that can be cut into bins."""
    kind = df.schema[name].dataType.typeName()
    value = F.col(name)
    if kind.startswith("timestamp"):
        value = F.unix_micros(value.cast("timestamp"))
    elif kind == "date":
        value = F.unix_date(value)
    place = F.when(value.isNull(), 0).otherwise(2)
    if kind in ("float", "double"):
        inf = float("inf")
        place = F.when(value.isNull(), 0).when(F.isnan(value), 4).when(value == -inf, 1).when(value == inf, 3).otherwise(2)
    return [place, F.when(place == 2, value).otherwise(F.lit(0).cast(value_type(kind)))]


def value_type(kind: str) -> str:
    return "double" if kind in ("float", "double") else "long"


def with_half(df: DataFrame, order_by: Sequence[str], position: int | None = None) -> DataFrame:
    """T8 without positions: ``half`` = 0 for the first n div 2 (or ``position``) rows in ``order_by``, else 1.

    The key in the middle is found by counting rows per bin of the first key that still differs
    and going on inside the bin that holds the middle; only ``MIDDLE_BINS`` counts per step and the
    middle one of at most ``MIDDLE_ROWS`` keys are gathered.  Keys are numbers, dates or timestamps;
    nulls come first and NaN last.  Rows that share the middle key are all in the second half.
    """
    parts = [c for name in order_by for c in _rankable(df, name)]
    names = [f"_o{i}" for i in range(len(parts))]
    rows = df.select(*[c.alias(n) for c, n in zip(parts, names)])
    n = rows.count()
    if n == 0:
        return df.withColumn("half", F.lit(0))
    position = n // 2 if position is None else min(position, n - 1)
    for name in names:
        while n > MIDDLE_ROWS:
            low, high = rows.agg(F.min(name), F.max(name)).first()
            if low == high:
                break
            step = (high - low) / MIDDLE_BINS
            bin_of = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(step)), F.lit(MIDDLE_BINS - 1)).cast("int")
            counts = sorted(rows.groupBy(bin_of.alias("_b")).count().collect())
            for b, count in counts:
                if position < count:
                    break
                position -= count
            rows, n = rows.filter(bin_of == b), count
    # more than MIDDLE_ROWS rows are left only where all of them share one key
    middle = rows.first() if n > MIDDLE_ROWS else rows.orderBy(*names).offset(position).first()
    first, equal = F.lit(False), F.lit(True)
    for c, name in zip(parts, names):
        first = first | (equal & (c < F.lit(middle[name])))
        equal = equal & (c == F.lit(middle[name]))
    return df.withColumn("half", F.when(first, 0).otherwise(1))
