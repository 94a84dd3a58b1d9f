"""Trees and ridge fits for many training sets at once, against plain Python and against one fit at a time."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.folds import rolling_origins
from panelcast.plans import forests
from panelcast.plans.backtest import backtest_predictions, forecast
from panelcast.plans.models import ridge_by_group
from panelcast.plans.ridge import rolling_ridge, window_sums
from panelcast.plans.stacking import stack_predict

from .conftest import SF_SMALL

FEATURES = ["a", "b", "c", "half"]
SMALL = {k: {"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 2} for k in forests.TREE_KINDS}


def panel(spark, days=12, series=("s1", None, "s2"), gaps=True, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in series:
        for h in range(days * 24):
            if gaps and rng.random() < 0.05:
                continue
            x = rng.normal(size=3)
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), None if rng.random() < 0.04 else float(50 + 5 * x[0] + h % 24 + rng.normal()),
                         float(x[0]), float(round(x[1], 1)), float(h % 24), None if rng.random() < 0.3 else float(x[2] + 100)))
    schema = "series_key string, date_hour timestamp_ntz, y double, a double, b double, c double, half double"
    return spark.createDataFrame(rows, schema).repartition(3)


# --- trees -------------------------------------------------------------------------------------------------------------

def brute_tree(spec, bins, y, w, rows, depth):
    """A tree by trying every cut on lists of rows: nested (feature, cut, left, right) or a value."""
    g, n = sum(int(y[r]) * int(w[r]) for r in rows), sum(int(w[r]) for r in rows)
    value = int(np.rint(spec.step * g / (n + spec.ridge)))
    best = (g * g / (n + spec.ridge) * (1 + 1e-12) + 1e-9, None)
    if depth < spec.depth and n >= spec.min_split:
        for f in range(bins.shape[1]):
            for cut in range(int(bins[:, f].max())):
                left = [r for r in rows if bins[r, f] <= cut]
                gl, nl = sum(int(y[r]) * int(w[r]) for r in left), sum(int(w[r]) for r in left)
                if min(nl, n - nl) < max(1, spec.min_leaf):
                    continue
                score = gl * gl / (nl + spec.ridge) + (g - gl) ** 2 / (n - nl + spec.ridge)
                if score > best[0]:
                    best = (score, (f, cut))
    if best[1] is None:
        return value
    f, cut = best[1]
    return (f, cut, brute_tree(spec, bins, y, w, [r for r in rows if bins[r, f] <= cut], depth + 1),
            brute_tree(spec, bins, y, w, [r for r in rows if bins[r, f] > cut], depth + 1))


def ask(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("kind,params", [
    ("random_forest", {"n_estimators": 5, "max_depth": 4}), ("random_forest", {"n_estimators": 3, "max_depth": None, "min_samples_leaf": 3}),
    ("random_forest", {"n_estimators": 2, "max_depth": 3, "min_samples_split": 30}),
    ("xgboost", {"n_estimators": 6, "max_depth": 3}), ("lightgbm", {"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 6}),
    ("xgboost", {"n_estimators": 4, "max_depth": 2, "subsample": 0.6, "colsample_bytree": 0.5, "learning_rate": 0.3, "reg_lambda": 3.0})])
def test_trees_equal_a_brute_force_split_search(kind, params):
    spec = forests.tree_spec(kind, params)
    rng = np.random.default_rng(3)
    bins = np.column_stack([rng.integers(0, 9, 60), rng.integers(0, 3, 60), rng.integers(0, 40, 60)]).astype(np.uint8)
    y = (1_000_000 * (bins[:, 0] % 4 + bins[:, 1]).astype(np.int64) + rng.integers(-90_000, 90_000, 60)).astype(np.int64)
    y[:6], rid = y[0], rng.integers(0, 1 << 60, 60)
    model = forests.fit_trees(spec, bins, y, rid)
    rest, total = y - model.base, np.zeros(60, np.int64)
    for k, tree in enumerate(model.trees):
        w, used = forests.row_weights(spec, rid, k), forests.tree_columns(spec, 3, k)
        masked = np.where(used, bins, 0)
        want = brute_tree(spec, masked, rest, w, [r for r in range(60) if w[r]], 0)
        got = tree.value[tree.leaves(bins)]
        assert got.tolist() == [ask(want, row) for row in masked]
        total += got
        if spec.boost:
            rest = rest - got
    assert model.predict(spec, bins).tolist() == (model.base + (total if spec.boost else total / len(model.trees))).tolist()


def test_parameters_of_trees():
    assert forests.tree_spec("random_forest", {"max_depth": None}).depth == forests.MAX_DEPTH
    for bad in ({"num_leaves": 31}, {"max_depth": 99}):
        with pytest.raises(ValueError):
            forests.tree_spec("lightgbm", bad)
    with pytest.raises(ValueError):
        forests.tree_spec("svm")


def folds_of(spark):
    rows = forests.binned(panel(spark, days=6), FEATURES, ["series_key", "date_hour"], "y")
    train = rows.where("date_hour < '2024-01-06'").withColumns({
        "role": F.lit("train"), "fold": F.hour("date_hour") % 4 - 1}).withColumn("_set", F.explode(F.array(F.lit("u"), F.lit(None))))
    test = rows.where("date_hour >= '2024-01-06'").withColumns({"role": F.lit("test"), "fold": F.lit(None).cast("int")})
    return train.unionByName(test.withColumn("_set", F.explode(F.array(F.lit("u"), F.lit(None)))))


def test_spread_training_sets_give_the_same_trees(spark):
    specs = {k: forests.tree_spec(k, p) for k, p in SMALL.items()}
    variants = {"random_forest": [forests.FULL, 0, 2], "xgboost": [forests.FULL], "lightgbm": [1]}
    args = (specs, len(FEATURES), ["_set"], ["series_key", "date_hour"], "y", variants)
    folds = folds_of(spark)
    cols = ["_set", "series_key", "date_hour", "model", "variant", "role", "pred"]
    one = sorted(map(tuple, forests.fit_predict(folds, *args).select(*cols).collect()), key=str)
    spread = sorted(map(tuple, forests.fit_predict(folds, *args, local_cells=0).select(*cols).collect()), key=str)
    assert len(one) > 1000 and one == spread
    assert {r[1] for r in one} == {"s1", None, "s2"} and {r[0] for r in one} == {"u", None}


def test_bins_keep_order_and_gaps(spark):
    df = panel(spark, days=8)
    got = forests.binned(df.select("*", F.col("half").alias("kept")), ["half", "c"], ["series_key", "date_hour"], "y").toPandas()
    code = np.array([list(b) for b in got["_bins"]])
    assert code.max() < forests.MAX_BINS
    assert ((code[:, 0] == 0) == got["kept"].isna()).all()
    order = got["kept"].rank(method="dense").to_numpy()
    there = ~got["kept"].isna().to_numpy()
    assert (np.diff(code[there, 0][np.argsort(order[there], kind="stable")]) >= 0).all()
    assert len(set(code[:, 1])) == 24                        # few values: one bin each


def test_pooled_strategies_and_stacking_run_for_every_origin_and_series(spark):
    df = panel(spark, days=9)
    kinds = [*forests.TREE_KINDS, "stacking"]
    out = backtest_predictions(df, "2024-01-05", "2024-01-10", kinds, FEATURES, "y", train_days=4, model_params=SMALL).toPandas()
    days = df.where("date_hour >= '2024-01-05'").select("series_key", "date_hour").toPandas()
    assert len(out) == len(kinds) * len(days)
    assert out["pred"].notna().all() and set(out["series_key"].map(str)) == {"s1", "s2", "None"}
    error = (out["pred"] - out["actual"]).groupby(out["strategy"]).std()
    assert (error < df.toPandas()["y"].std()).all()
    again = backtest_predictions(df.repartition(5), "2024-01-05", "2024-01-10", kinds[:3], FEATURES, "y", train_days=4,
                                 model_params=SMALL).toPandas()
    key = ["strategy", "series_key", "date_hour"]
    a, b = (x[x["strategy"] != "stacking"].assign(series_key=x["series_key"].map(str)).sort_values(key)["pred"].tolist() for x in (out, again))
    assert a == b                                               # however the rows are dealt


def test_a_fit_sees_no_row_of_its_own_day_or_later(spark):
    df = panel(spark, days=8, gaps=False)
    changed = df.withColumn("y", F.when(F.col("date_hour") >= "2024-01-07", F.col("y") + 1000).otherwise(F.col("y")))
    get = lambda x: {(r["strategy"], str(r["series_key"]), r["date_hour"]): r["pred"] for r in backtest_predictions(
        x, "2024-01-07", "2024-01-08", ["xgboost", "stacking", "ridge"], FEATURES, "y", train_days=5, model_params=SMALL).collect()}
    a, b = get(df), get(changed)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-4) for k in a)


def test_stack_predict_of_one_frame(spark):
    df = panel(spark, days=7)
    train, test = df.where("date_hour < '2024-01-07'"), df.where("date_hour >= '2024-01-07'").drop("y")
    out = {mode: stack_predict(train, test, FEATURES, "y", model_params=SMALL, oof_mode=mode).toPandas() for mode in ("drop", "zero")}
    assert all(len(o) == test.count() and (o["pred"] >= 0).all() for o in out.values())
    assert not np.allclose(out["drop"].sort_values(["date_hour", "pred"])["pred"], out["zero"].sort_values(["date_hour", "pred"])["pred"])


def test_forecast_of_all_strategies(spark):
    df = panel(spark, days=8)
    hist, fut = df.where("date_hour < '2024-01-07'"), df.where("date_hour >= '2024-01-07'").drop("y")
    out = forecast(hist, fut, ["ridge", *forests.TREE_KINDS, "stacking"], FEATURES, "y", train_days=5, model_params=SMALL).toPandas()
    assert len(out) == fut.count()
    assert out.filter(like="pred_").notna().all().all()


# --- ridge -------------------------------------------------------------------------------------------------------------

def test_rolling_ridge_equals_one_solve_per_group(spark):
    df = panel(spark, days=14, seed=4).withColumn("flat", F.lit(3.0)).withColumn("empty", F.lit(None).cast("double"))
    features = [*FEATURES, "flat", "empty"]
    folds = rolling_origins(df, "2024-01-03", "2024-01-15", 5, 20)
    want = ridge_by_group(folds, ["series_key", "origin"], features, "y", alpha=2.5, min_train_rows=20).toPandas()
    got = rolling_ridge(df, "2024-01-03", "2024-01-15", features, "y", [2.5], 5, 20).toPandas()
    key = ["series_key", "origin", "date_hour"]
    both = want.merge(got, on=key, suffixes=("_a", "_b"))
    assert len(both) == len(want) == len(got) > 500
    assert np.abs(both["pred_a"] - both["pred_b"]).max() < 1e-8


def test_rolling_ridge_needs_no_row_twice_and_takes_many_penalties(spark):
    df = panel(spark, days=7)
    many = rolling_ridge(df, "2024-01-05", "2024-01-08", FEATURES, "y", [0.1, 1.0, 100.0], 4, 20)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan                              # no origin fan-out
    one = rolling_ridge(df, "2024-01-05", "2024-01-08", FEATURES, "y", [1.0], 4, 20).toPandas()
    assert len(many.toPandas()) == 3 * len(one)
    assert rolling_ridge(df.limit(0), "2024-01-05", "2024-01-08", FEATURES).collect() == []


@pytest.mark.parametrize("width", [1, 3, 7])
def test_window_sums(width):
    rng = np.random.default_rng(width)
    days = np.flatnonzero(rng.random(60) < 0.6) + 100
    values = rng.normal(size=(len(days), 2))
    first = np.arange(85, 175)
    want = [values[(days >= f) & (days < f + width)].sum(axis=0) for f in first]
    assert np.allclose(window_sums(days, values, first, width), want)




# --- registered queries ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("query", ["backtest_pooled", "stacking", "forecast"])
def test_registered_model_queries_run_over_all_days(spark, monkeypatch, query):
    """With small trees, every origin day, series and strategy comes back."""
    from panelcast import registry
    monkeypatch.setattr(forests, "MODEL_DEFAULTS", {k: {**v, "n_estimators": 3, "max_depth": 3} for k, v in forests.MODEL_DEFAULTS.items()})
    out = registry.QUERIES[query](spark, SF_SMALL).toPandas()
    panel_days = registry.panel_hourly(spark, SF_SMALL).withColumn("day", F.to_date("date_hour"))
    if query == "forecast":
        future = panel_days.where(F.col("date_hour") >= F.lit(registry.FUTURE_FROM).cast("timestamp_ntz"))
        assert len(out) == future.count() and out["pred_two_stage_stacking"].notna().mean() > 0.99
        return
    ridge = registry.q_backtest_ridge1(spark, SF_SMALL).toPandas()            # the same origins, checked against SQL
    days = set(zip(ridge["series_key"], ridge["date"]))
    if query == "stacking":
        got = set(zip(out["series_key"], out["date_hour"].dt.date))
        assert got == days and out["pred"].notna().all()
    else:
        for strategy in ("random_forest", "xgboost", "lightgbm", "stacking", "naive_2d"):
            rows = out[out["strategy"] == strategy]
            assert set(zip(rows["series_key"], rows["date"])) <= days and len(rows) > 0.6 * len(days)
        assert (out["strategy"] == "stacking").sum() == len(days)
