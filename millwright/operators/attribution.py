"""Feature attributions (J2-J5) as Spark jobs.

* J2 linear attribution: φ_j = w_j·(x_j − E[x_j]) - exact Shapley values of a
  linear model with an independent background; column arithmetic + ``stack``.
* J3 top-k per row: an array of (|φ|, feature) structs is sorted inside the
  row; for linear scorers without any shuffle (``linear_top_k``), for
  attributions that come in long form after one grouping by row.
* J4 global importance: mean |φ| per feature, one aggregate.
* J5 model-agnostic values by weighted least squares over coalitions against a
  sample of background rows (``kernel_shapley``); and
  sampled Shapley: seeded permutations are exploded into
  coalition points, all points are scored by one ``transform``, and marginal
  contributions are differences of consecutive points - no row cap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scoring import TERMS


def linear_attribution(df: DataFrame, coefs: Sequence[float], id_col: str = "event_id",
                       background: DataFrame | None = None) -> DataFrame:
    """Long form (id, feature, phi) for a linear scorer (bias + weighted terms)."""
    names = [t.split(" - ")[0] for t in TERMS]
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(n).alias(f"_mu_{n}") for n in names])
    j = df.select(id_col, *names).crossJoin(F.broadcast(means))  # one row
    phis = [(F.lit(float(w)) * (F.col(n) - F.col(f"_mu_{n}"))).alias(f"_phi_{n}") for w, n in zip(coefs[1:], names)]
    wide = j.select(id_col, *phis)
    pieces = ", ".join(f"'{n}', _phi_{n}" for n in names)
    return wide.selectExpr(id_col, f"stack({len(names)}, {pieces}) AS (feature, phi)")


def linear_top_k(df: DataFrame, coefs: Sequence[float], k: int = 3, id_col: str = "event_id",
                 background: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """J2 + J3 in one projection: the k largest |φ| of a linear scorer per row, ranked inside the row."""
    names = [t.split(" - ")[0] for t in TERMS]
    means = (background if background is not None else df).agg(*[F.avg(n).alias(f"_mu_{n}") for n in names])
    entries = []
    for w, n in zip(coefs[1:], names):
        phi = F.lit(float(w)) * (F.col(n) - F.col(f"_mu_{n}"))
        entries.append(F.struct((-F.abs(phi)).alias("neg_abs"), F.lit(n).alias("feature"), phi.alias("phi")))
    ranked = df.select(id_col, *names).crossJoin(F.broadcast(means)).select(  # one row
        id_col, F.posexplode(F.slice(F.array_sort(F.array(*entries)), 1, k)).alias("_i", "_e"))
    return ranked.select(id_col, (F.col("_i") + 1).alias("rank"), F.col("_e.feature").alias("feature"),
                         F.round(F.col("_e.phi"), digits).alias("impact"))


def top_k_attribution(wide_or_long: DataFrame, k: int = 3, id_col: str = "event_id", digits: int = 4) -> DataFrame:
    """The k largest |φ| per row (ties by feature name), rounded; rank 1..k.

    Input is the long form; rows of one id are gathered with one aggregate
    (bounded: one entry per feature) and ranked inside the row.
    """
    per_row = wide_or_long.groupBy(id_col).agg(F.collect_list(
        F.struct((-F.abs(F.col("phi"))).alias("neg_abs"), F.col("feature"), F.col("phi"))).alias("_a"))
    ranked = per_row.select(id_col, F.posexplode(F.slice(F.array_sort("_a"), 1, k)).alias("_i", "_e"))
    return ranked.select(id_col, (F.col("_i") + 1).alias("rank"), F.col("_e.feature").alias("feature"),
                         F.round(F.col("_e.phi"), digits).alias("impact"))


def global_importance(long: DataFrame) -> DataFrame:
    """Mean |φ| per feature, largest first."""
    return (long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
            .orderBy(F.col("mean_abs_shap").desc(), F.col("feature")))


def sampled_shapley(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame],
                    background: DataFrame, n_permutations: int = 8, id_col: str = "event_id",
                    seed: int = 42) -> DataFrame:
    """Permutation-sampling Shapley values against a background mean.

    ``score(frame)`` must return the frame with a ``failure_probability`` column.
    For each row and permutation k, coalition sizes 0..d are exploded; feature j
    takes the row's value when its rank in the permutation is < size, else the
    background mean.  φ_j = mean over k of f(rank_j + 1) − f(rank_j).
    """
    d = len(features)
    means = background.agg(*[F.avg(c).alias(f"_bg_{c}") for c in features])
    base = df.select(id_col, *features).crossJoin(F.broadcast(means))  # one row
    perms = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("_k"))
    # rank of each feature in the seeded permutation of (row, k)
    keyed = F.array(*[F.struct(F.xxhash64(F.col(id_col), F.col("_k"), F.lit(seed), F.lit(j)).alias("h"),
                               F.lit(j).alias("j")) for j in range(d)])
    order = F.transform(F.array_sort(keyed), lambda e: e["j"])
    perms = perms.withColumn("_order", order)
    for j, c in enumerate(features):
        perms = perms.withColumn(f"_r_{c}", F.array_position("_order", F.lit(j)) - 1)
    points = perms.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_s"))
    coalition = points.select(id_col, "_k", "_s", "_order", *[
        F.when(F.col(f"_r_{c}") < F.col("_s"), F.col(c)).otherwise(F.col(f"_bg_{c}")).alias(c) for c in features])
    scored = score(coalition).select(id_col, "_k", "_s", "_order", "failure_probability")
    w = Window.partitionBy(id_col, "_k").orderBy("_s")
    deltas = scored.select(id_col, "_k", "_s", "_order",
                           (F.col("failure_probability") - F.lag("failure_probability").over(w)).alias("_delta"))
    deltas = deltas.filter(F.col("_s") > 0).select(
        id_col, F.element_at("_order", F.col("_s")).alias("_j"), "_delta")
    names = F.array(*[F.lit(c) for c in features])
    return deltas.groupBy(id_col, "_j").agg(F.avg("_delta").alias("phi")).select(
        id_col, F.element_at(names, F.col("_j") + 1).alias("feature"), "phi")


def coalitions(d: int, most: int, seed: int = 42) -> tuple[list[list[int]], list[float]]:
    """Coalitions of d features (0/1 per feature) with their Shapley kernel weights.

    All of them where there are at most ``most``; otherwise ``most`` drawn by the kernel, each with
    its complement, at equal weights.
    """
    import itertools
    import random
    from math import comb
    if d < 2:
        return [], []
    if 2 ** d - 2 <= most:
        every = [list(z) for z in itertools.product((0, 1), repeat=d) if 0 < sum(z) < d]
        return every, [(d - 1) / (comb(d, sum(z)) * sum(z) * (d - sum(z))) for z in every]
    rng = random.Random(seed)
    sizes = list(range(1, d))
    drawn = [[int(i == j) for i in range(d)] for j in range(d)]  # single features make the equations regular
    while 2 * len(drawn) < most:
        chosen = set(rng.sample(range(d), rng.choices(sizes, [1 / (s * (d - s)) for s in sizes])[0]))
        drawn.append([int(i in chosen) for i in range(d)])
    both = drawn + [[1 - v for v in z] for z in drawn]
    return both, [1.0] * len(both)


def kernel_shapley(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], background: DataFrame,
                   n_background: int = 100, n_coalitions: int = 256, id_col: str = "event_id", order_by: Sequence[str] | None = None,
                   value: str = "failure_probability", seed: int = 42) -> DataFrame:
    """Model-agnostic Shapley values by weighted least squares, one (id, feature, phi) row each.

    A row's features in a coalition are its own, the others come from ``n_background`` rows of
    ``background`` (the first by ``order_by``, by a hash of the id without it); ``score(frame)`` adds
    ``value`` to every such point.  The values fit the coalitions' mean scores by least squares under
    the Shapley kernel, with the sum over the features fixed to score - mean background score.  The
    coalitions are the same for all rows, so the inverse of the normal matrix (bounded by the
    features) is taken once, and a row needs one grouped sum over its points.  Exact where all
    coalitions fit into ``n_coalitions`` or the model is additive; no rows are left out.  ``id_col``
    must name a row; an empty background gives null values.
    """
    import numpy as np
    names, d = list(features), len(features)
    keys = list(order_by) if order_by else [F.xxhash64(id_col), F.col(id_col)]
    bg = background.orderBy(*keys).limit(n_background).select(*names)
    rows = df.select(id_col, *names)
    own = score(rows).select(id_col, F.col(value).alias("_fx"))
    base = score(bg).agg(F.avg(value).alias("_f0"))
    z, w = coalitions(d, n_coalitions, seed)
    if d == 1:
        return own.crossJoin(F.broadcast(base)).select(id_col, F.lit(names[0]).alias("feature"), (F.col("_fx") - F.col("_f0")).alias("phi"))
    z, w = np.array(z, float), np.array(w, float)
    x = z[:, :-1] - z[:, -1:]                    # the last feature takes what the others leave
    solve = np.linalg.inv((x * w[:, None]).T @ x) @ (x * w[:, None]).T
    table = F.array(*[F.struct(F.array(*[F.lit(int(v)) for v in row]).alias("z"), F.array(*[F.lit(float(v)) for v in solve[:, i]]).alias("k"))
                      for i, row in enumerate(z)])
    other = bg.select(*[F.col(c).alias(f"_b_{c}") for c in names])
    points = rows.select("*", F.explode(table).alias("_s")).crossJoin(F.broadcast(other))    # at most n_background rows
    points = points.select(id_col, F.col("_s.k").alias("_k"), *[F.when(F.col("_s.z")[j] == 1, F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c)
                                                               for j, c in enumerate(names)])
    sums = score(points).groupBy(id_col).agg(F.count(F.lit(1)).alias("_points"), *[F.sum(F.col("_k")[j] * F.col(value)).alias(f"_p{j}") for j in range(d - 1)])
    whole = sums.join(own, id_col).crossJoin(F.broadcast(base))                              # one row
    share = F.col("_points") / F.lit(float(len(z)))                                          # background rows per coalition
    gain = F.col("_fx") - F.col("_f0")
    phis = [F.col(f"_p{j}") / share - F.col("_f0") * float(solve[j].sum()) - gain * float(solve[j] @ z[:, -1]) for j in range(d - 1)]
    last = gain
    for phi in phis:
        last = last - phi
    wide = whole.select(id_col, *[p.alias(f"_q{j}") for j, p in enumerate([*phis, last])])
    return wide.selectExpr(id_col, f"stack({d}, " + ", ".join(f"'{c}', _q{j}" for j, c in enumerate(names)) + ") AS (feature, phi)")


# --------------------------------------------------------------------------
# Path-dependent tree attributions (Lundberg et al. 2018, Algorithm 2)
# --------------------------------------------------------------------------

def export_tree_ensemble(model) -> tuple[list[dict], list[float]]:
    """Flatten a fitted Spark ML tree ensemble (GBT) into per-tree node arrays.

    Size is bounded by trees × nodes of the model, not by the data.  Covers are
    the (weighted) training counts at each node, as the path formulation needs.
    """
    import numpy as np

    ens = model.stages[-1] if hasattr(model, "stages") else model
    trees = []
    for t in ens.trees:
        rows = []

        def walk(jnode):
            idx = len(rows)
            rows.append(None)
            cover = float(jnode.impurityStats().count())
            value = float(jnode.prediction())
            if jnode.getClass().getSimpleName() == "InternalNode":
                split = jnode.split()
                left = walk(jnode.leftChild())
                right = walk(jnode.rightChild())
                rows[idx] = (left, right, int(split.featureIndex()), float(split.threshold()), value, cover)
            else:
                rows[idx] = (-1, -1, -1, 0.0, value, cover)
            return idx

        walk(t._java_obj.rootNode())
        arr = np.array(rows, dtype=float)
        trees.append({"left": arr[:, 0].astype(int), "right": arr[:, 1].astype(int),
                      "feature": arr[:, 2].astype(int), "threshold": arr[:, 3], "value": arr[:, 4],
                      "cover": arr[:, 5]})
    return trees, [float(w) for w in ens.treeWeights]


def ensemble_of(model) -> tuple[list[dict], list[float]]:
    """Node arrays and weights of a boosted model of the library or of a fitted Spark ML ensemble."""
    if hasattr(model, "settings"):
        return [{"left": t.left, "right": t.right, "feature": t.feature, "threshold": t.threshold, "value": t.value, "cover": t.cover}
                for t in model.trees], [1.0] * len(model.trees)
    return export_tree_ensemble(model)


def leaf_paths(trees: list[dict], weights: Sequence[float]) -> list[tuple]:
    """The leaf-path table: per leaf (features, lows, highs, cover ratios, value).

    The splits of a path on one feature are merged: the row follows all of them if low < x <= high,
    and the ratio is the product of the covers kept at them.  Bounded by the leaves of the model.
    """
    import numpy as np
    out = []
    for t, w in zip(trees, weights):
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = int(t["feature"][node])
            if t["left"][node] < 0:
                if path and t["value"][node] != 0:
                    low, high, ratio = (np.array([p[i] for p in path.values()]) for i in range(3))
                    out.append((np.array(list(path)), low, high, ratio, w * float(t["value"][node])))
                continue
            low, high, ratio = path.get(f, (-np.inf, np.inf, 1.0))
            cut, cover = float(t["threshold"][node]), float(t["cover"][node])
            for child, interval in ((int(t["left"][node]), (low, min(high, cut))), (int(t["right"][node]), (max(low, cut), high))):
                kept = float(t["cover"][child]) / cover if cover > 0 else 0.0
                stack.append((child, {**path, f: (*interval, ratio * kept)}))
    return out


def path_attributions(x, paths: list[tuple], n_features: int):
    """Path-dependent Shapley values of all rows of ``x`` at once.

    For a leaf with m features, feature k gets (follows_k - ratio_k) * value times the sum over
    subsets S of the others of |S|! (m - 1 - |S|)! / m! * prod of follows in S * prod of ratios
    outside S.  The products by subset size are the coefficients of prod (ratio_j + follows_j t); they
    are taken once per pattern of followed features: of all patterns where these are fewer than the rows, else of those that occur.
    """
    from math import factorial

    import numpy as np
    phi = np.zeros((len(x), n_features))
    for features, low, high, ratio, value in paths:
        m = len(features)
        pattern = np.zeros(len(x), np.int64)
        for k in range(m):
            column = x[:, features[k]]
            pattern |= ((column > low[k]) & (column <= high[k])).astype(np.int64) << k
        seen, of = (np.arange(1 << m), pattern) if 1 << m <= len(x) else np.unique(pattern, return_inverse=True)
        follows = ((seen[:, None] >> np.arange(m)) & 1).astype(float)
        share = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
        part = np.empty((len(seen), m))
        for k in range(m):
            poly = np.zeros((len(seen), m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != k:
                    poly[:, 1:] = poly[:, 1:] * ratio[j] + poly[:, :-1] * follows[:, j:j + 1]
                    poly[:, 0] *= ratio[j]
            part[:, k] = (follows[:, k] - ratio[k]) * value * (poly @ share)
        phi[:, features] += part[of]
    return phi


def tree_expected_value(trees, weights) -> float:
    """Cover-weighted mean margin of the ensemble (the attribution base value)."""
    base = 0.0
    for t, w in zip(trees, weights):
        leaves = t["left"] < 0
        base += w * float((t["value"][leaves] * t["cover"][leaves]).sum() / t["cover"][0])
    return base


TABLE_CELLS = 1 << 23


def _plain_paths(paths: list[tuple]) -> bytes:
    """The leaf-path table as ``Trees.java`` reads it."""
    import struct

    import numpy as np
    sizes = np.array([len(p[0]) for p in paths], "<i4")
    out = [struct.pack("<2i", len(paths), int(sizes.sum())), sizes.tobytes()]
    out += [b"".join(np.asarray(p[i]).astype(kind).tobytes() for p in paths) for i, kind in enumerate(("<i4", "<f8", "<f8", "<f8"))]
    out.append(np.array([p[4] for p in paths], "<f8").tobytes())
    return b"".join(out)


def tree_attribution(df: DataFrame, model, features: Sequence[str], id_col: str = "event_id") -> DataFrame:
    """Exact path-dependent Shapley values of a boosted margin for every row.

    ``model`` is a ``boosting.BoostedModel`` or a fitted Spark ML GBT.  What a leaf gives for every
    pattern of followed features is worked out once and broadcast, if there are at most ``TABLE_CELLS``
    of these numbers, and looked up in the JVM, many rows at a time and leaf by leaf; else the leaf-path table (bounded by the
    model) travels in the task closure, and every Arrow batch is evaluated as a whole.  Output: (id, feature, phi) plus one ``__base__`` row per id holding the expected value,
    so that the values and the base add up to the margin of every row.  A null feature counts as
    smaller than all values for a ``BoostedModel`` and as larger for Spark ML.
    """
    import numpy as np
    import pyarrow as pa

    trees, weights = ensemble_of(model)
    base = tree_expected_value(trees, weights)
    paths = leaf_paths(trees, weights)
    names, spark = list(features), df.sparkSession
    missing = -1.7976931348623157e308 if hasattr(model, "settings") else float("inf")

    if sum(len(p[0]) << len(p[0]) for p in paths) <= TABLE_CELLS:
        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

        from ..plans import jvm
        rows = df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_{i}") for i, c in enumerate(names)])
        made = jvm.trees(spark).shares(spark.sparkContext._jsc, rows._jdf.toJavaRDD(), _plain_paths(paths), len(names), missing, base)
        phi = jvm.frame(spark, made, StructType([rows.schema[id_col], StructField("_phi", ArrayType(DoubleType(), False), False)]))
        named = F.array(*[F.lit(c) for c in [*names, "__base__"]])
        return phi.select(id_col, F.posexplode("_phi").alias("_at", "phi")).select(id_col, named[F.col("_at")].alias("feature"), "phi")

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))], axis=1)
            phi = path_attributions(np.where(np.isnan(x), missing, x), paths, len(names))
            n, width = len(x), len(names) + 1
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), width)))
            values = np.concatenate([phi, np.full((n, 1), base)], axis=1).reshape(-1)
            feature = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(width, dtype=np.int32), n)), pa.array([*names, "__base__"]))
            yield pa.RecordBatch.from_arrays([ids, feature.cast(pa.string()), pa.array(values)], [id_col, "feature", "phi"])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names])
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, feature string, phi double")
