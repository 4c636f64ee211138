import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millwright.operators import attribution
from millwright.plans import boosting, training


def _row_by_row(x, tree, phi, scale):
    left, right, feat, thr, value, cover = (tree["left"], tree["right"], tree["feature"], tree["threshold"],
                                            tree["value"], tree["cover"])

    def extend(m, pz, po, pi):
        depth = len(m)
        m.append([pi, pz, po, 1.0 if depth == 0 else 0.0])
        for i in range(depth - 1, -1, -1):
            m[i + 1][3] += po * m[i][3] * (i + 1) / (depth + 1)
            m[i][3] = pz * m[i][3] * (depth - i) / (depth + 1)

    def unwind(m, k):
        depth = len(m) - 1
        zf, of = m[k][1], m[k][2]
        nxt = m[depth][3]
        for i in range(depth - 1, -1, -1):
            if of != 0:
                tmp = m[i][3]
                m[i][3] = nxt * (depth + 1) / ((i + 1) * of)
                nxt = tmp - m[i][3] * zf * (depth - i) / (depth + 1)
            else:
                m[i][3] = m[i][3] * (depth + 1) / (zf * (depth - i))
        for i in range(k, depth):
            m[i][0], m[i][1], m[i][2] = m[i + 1][0], m[i + 1][1], m[i + 1][2]
        m.pop()

    def unwound_sum(m, k):
        depth = len(m) - 1
        zf, of = m[k][1], m[k][2]
        nxt, total = m[depth][3], 0.0
        for i in range(depth - 1, -1, -1):
            if of != 0:
                tmp = nxt * (depth + 1) / ((i + 1) * of)
                total += tmp
                nxt = m[i][3] - tmp * zf * (depth - i) / (depth + 1)
            elif zf != 0:
                total += (m[i][3] / zf) / ((depth - i) / (depth + 1))
        return total

    def recurse(j, m, pz, po, pi):
        m = [list(e) for e in m]
        extend(m, pz, po, pi)
        if left[j] < 0:
            for i in range(1, len(m)):
                w = unwound_sum(m, i)
                phi[m[i][0]] += scale * w * (m[i][2] - m[i][1]) * value[j]
            return
        f = feat[j]
        hot, cold = (left[j], right[j]) if x[f] <= thr[j] else (right[j], left[j])
        iz, io = 1.0, 1.0
        for k in range(1, len(m)):
            if m[k][0] == f:
                iz, io = m[k][1], m[k][2]
                unwind(m, k)
                break
        recurse(hot, m, iz * cover[hot] / cover[j], io, f)
        recurse(cold, m, iz * cover[cold] / cover[j], 0.0, f)

    recurse(0, [], 1.0, 1.0, -1)


def _frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2]) > 0.3).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "event_id long, f0 double, f1 double, f2 double, f3 double, machine_failure int")


NAMES = ["f0", "f1", "f2", "f3"]


def test_both_model_kinds_equal_the_recursion(spark):
    x, _, df = _frame(spark, 150)
    spark_model = training.fit(df, NAMES, "gbt", {"maxIter": 5, "maxDepth": 4}, weight_col=None)
    ours = boosting.fit_boosted(df, NAMES, [boosting.Settings(rounds=5, max_depth=4, pos_weight=2.0)])[0]
    for model in (spark_model, ours):
        trees, weights = attribution.ensemble_of(model)
        expected = np.zeros((len(x), 4))
        for row, phi in zip(x, expected):
            for t, w in zip(trees, weights):
                _row_by_row(row, t, phi, w)
        got = attribution.path_attributions(x, attribution.leaf_paths(trees, weights), 4)
        np.testing.assert_allclose(got, expected, atol=1e-9)
        assert np.abs(expected).max() > 0.01
        long = attribution.tree_attribution(df, model, NAMES).toPandas().pivot(index="event_id", columns="feature", values="phi")
        np.testing.assert_allclose(long[NAMES].to_numpy(), expected, atol=1e-9)
    np.testing.assert_allclose(long.sum(axis=1).to_numpy(), ours.margins(x), atol=1e-9)


def test_tree_shap_efficiency_identity(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2]) > 0.3).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, (a, b, c), t in zip(range(n), x, y)]
    df = spark.createDataFrame(rows, "event_id long, f0 double, f1 double, f2 double, machine_failure int")
    model = training.fit(df, ["f0", "f1", "f2"], "gbt", {"maxIter": 6, "maxDepth": 3}, weight_col=None)
    phi = attribution.tree_attribution(df, model, ["f0", "f1", "f2"])
    total = phi.groupBy("event_id").agg(F.sum("phi").alias("s"))
    margin = model.transform(df).select("event_id", vector_to_array("rawPrediction")[1].alias("m"))
    j = total.join(margin, "event_id").toPandas()
    np.testing.assert_allclose(j["s"], j["m"], atol=1e-9)
    # a feature that no tree splits on gets exactly zero, one that some tree splits on does not
    trees, _ = attribution.export_tree_ensemble(model)
    used = {int(f) for t in trees for f in t["feature"][t["left"] >= 0]}
    for i in range(3):
        most = phi.filter(F.col("feature") == f"f{i}").agg(F.max(F.abs("phi"))).first()[0]
        assert (most > 0) == (i in used)


def _exact(f, x, bg):
    """Shapley values by all subsets, the missing features averaged over the background."""
    from itertools import combinations
    from math import factorial
    d = x.shape[1]

    def v(row, subset):
        points = bg.copy()
        points[:, list(subset)] = row[list(subset)]
        return f(points).mean()
    out = np.zeros_like(x)
    for i, row in enumerate(x):
        for j in range(d):
            others = [k for k in range(d) if k != j]
            for s in range(d):
                for subset in combinations(others, s):
                    out[i, j] += factorial(s) * factorial(d - 1 - s) / factorial(d) * (v(row, (*subset, j)) - v(row, subset))
    return out


def test_kernel_values_equal_all_subsets_and_add_up_on_a_fitted_model(spark):
    x, _, df = _frame(spark, 60)
    model = boosting.fit_boosted(df, NAMES, [boosting.Settings(rounds=8, max_depth=3)])[0]
    score = lambda frame: boosting.score_boosted(frame, {"m": model})
    rows = df.filter("event_id >= 50")
    got = attribution.kernel_shapley(rows, NAMES, score, df.filter("event_id < 50"), n_background=12, order_by=["event_id"], value="margin_m")
    wide = got.toPandas().pivot(index="event_id", columns="feature", values="phi")[NAMES].to_numpy()
    np.testing.assert_allclose(wide, _exact(model.margins, x[50:], x[:12]), atol=1e-9)
    np.testing.assert_allclose(wide.sum(axis=1), model.margins(x[50:]) - model.margins(x[:12]).mean(), atol=1e-9)
    # fewer coalitions than there are: still exact on an additive score, and the sum still holds
    linear = lambda frame: frame.withColumn("s", F.expr("2 * f0 - f1 + 0.5 * f2 + 3"))
    few = attribution.kernel_shapley(rows, NAMES, linear, df, n_background=9, n_coalitions=10, order_by=["event_id"], value="s")
    wide = few.toPandas().pivot(index="event_id", columns="feature", values="phi")[NAMES].to_numpy()
    np.testing.assert_allclose(wide, (x[50:] - x[:9].mean(axis=0)) * [2, -1, 0.5, 0], atol=1e-9)
    some = attribution.kernel_shapley(rows, NAMES, score, df, n_background=9, n_coalitions=10, order_by=["event_id"], value="margin_m")
    total = some.groupBy("event_id").sum("phi").orderBy("event_id").toPandas()["sum(phi)"]
    np.testing.assert_allclose(total, model.margins(x[50:]) - model.margins(x[:9]).mean(), atol=1e-9)


def test_looked_up_shares_equal_those_of_whole_batches_without_python(spark, monkeypatch):
    x, _, df = _frame(spark, 120)
    df = df.withColumn(NAMES[1], F.when(F.col("event_id") % 7 > 0, F.col(NAMES[1])))
    model = boosting.fit_boosted(df, NAMES, [boosting.Settings(rounds=6, max_depth=5, pos_weight=2.0)])[0]
    fast = attribution.tree_attribution(df, model, NAMES)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
    monkeypatch.setattr(attribution, "TABLE_CELLS", 0)
    slow = attribution.tree_attribution(df, model, NAMES)
    assert fast.columns == slow.columns and fast.dtypes == slow.dtypes
    a, b = (t.orderBy("event_id", "feature").toPandas() for t in (fast, slow))
    assert a[["event_id", "feature"]].equals(b[["event_id", "feature"]])
    np.testing.assert_allclose(a["phi"], b["phi"], atol=1e-12)
