"""Literal micro-fixtures for edge cases (FIXTURES.md §D) and model checks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators.clean import clean_panel, clip_columns
from panelcast.operators.holidays import add_holidays
from panelcast.operators.metrics import best_strategy, metrics
from panelcast.operators.selection import prune_correlated, target_correlation
from panelcast.operators.windows import add_history_stats
from panelcast.plans.models import fit_model, ridge_solve
from panelcast.sources.scan import coerce_numeric


def test_clean_keeps_only_valid_targets(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (9999.99,), (10000.0,)], "y double")
    assert sorted(r["y"] for r in clean_panel(df).collect()) == [0.0, 9999.99]


def test_text_numbers_coerce(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r["v"] for r in coerce_numeric(df, ["v", "missing"]).collect()] == [1.5, None, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (150.0,), (50.0,)], "c double")
    got = [r["c"] for r in clip_columns(df, {"c": (0.0, 100.0)}).collect()]
    assert got == [None, 0.0, 100.0, 50.0]


def test_metric_edge_cases(spark):
    rows = [("zero", 0.0, 0.0), ("zero", 2.0, 2.0),           # sMAPE term 0 for the zero pair
            ("const_exact", 5.0, 5.0), ("const_exact", 5.0, 5.0),
            ("const_off", 5.0, 5.0), ("const_off", 5.0, 6.0),
            ("one", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, actual double, pred double")
    m = {r["g"]: r for r in metrics(df, ["g"]).collect()}
    assert m["zero"]["mape"] == 0.0
    assert m["const_exact"]["r2"] == 1.0
    assert m["const_off"]["r2"] == 0.0
    assert m["one"]["r2"] is None


def test_holiday_run_and_distance(spark):
    days = [dt.datetime(2024, 2, d) for d in range(9, 19)] + [dt.datetime(2023, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "date_hour timestamp_ntz")
    got = {r["date_hour"]: r for r in add_holidays(df).collect()}
    feb11 = got[dt.datetime(2024, 2, 11)]
    assert (feb11["is_holiday"], feb11["is_pre_holiday"], feb11["is_post_holiday"]) == (1, 1, 1)
    assert got[dt.datetime(2024, 2, 9)]["is_pre_holiday"] == 1
    assert got[dt.datetime(2024, 2, 9)]["is_holiday"] == 0
    assert got[dt.datetime(2024, 2, 18)]["is_post_holiday"] == 1
    assert got[dt.datetime(2024, 2, 12)]["is_major_holiday"] == 1
    assert got[dt.datetime(2023, 1, 1)]["days_to_nearest_holiday"] == 365


def test_constant_feature_correlation_is_null(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i % 3)) for i in range(20)], "y double, c double, z double")
    got = {r["feature"]: r["corr"] for r in target_correlation(df, "y", ["c", "z"]).collect()}
    assert got["c"] is None and got["z"] is not None


def test_twin_features_keep_exactly_one(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    pdf = pd.DataFrame({"y": x + rng.normal(scale=0.1, size=200), "a": x, "b": x, "c": rng.normal(size=200),
                        "d": rng.normal(size=200)})
    df = spark.createDataFrame(pdf)
    res = prune_correlated(df, "y", ["a", "b", "c", "d"], keep=0.5).toPandas()
    kept = sorted(res.loc[~res["dropped"], "feature"])
    assert len(kept) == 1 and kept[0] in ("a", "b")
    again = prune_correlated(df, "y", ["a", "b", "c", "d"], keep=0.5).toPandas()
    assert sorted(again.loc[~again["dropped"], "feature"]) == kept


def test_best_strategy_default_when_empty(spark):
    ev = spark.createDataFrame([], "series_key string, date date, strategy string, rmse double, mape double, "
                                   "r2 double, eval_type string")
    assert best_strategy(ev).first()["strategy"] == "LightGBM"


def test_ridge_closed_form_matches_mllib(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.2] + [10, -3, 0]
    y = X @ [1.5, -0.3, 4.0] + rng.normal(scale=0.5, size=300)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y)
    med, mu, sd, w, ym = ridge_solve(X, y, 1.0)
    local = ((X - mu) / sd) @ w + ym
    m = fit_model(spark.createDataFrame(pdf), "ridge", ["a", "b", "c"], "y", {"alpha": 1.0})
    got = m.predict(spark.createDataFrame(pdf)).select("pred").toPandas()["pred"].to_numpy()
    np.testing.assert_allclose(got, local, rtol=1e-6, atol=1e-6)


def test_unknown_model_type_raises(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "y double, a double")
    try:
        fit_model(df, "svm", ["a"], "y")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_stream_subset_of_batch(spark):
    from panelcast.registry import QUERIES
    from .conftest import SF_SMALL
    stream = {(r["series_key"], r["date_hour"], r["y_cents"]) for r in
              QUERIES["stream_hourly_panel"](spark, SF_SMALL).collect()}
    batch = {(r["series_key"], r["date_hour"], r["y_cents"]) for r in
             QUERIES["panel_hourly"](spark, SF_SMALL).collect()}
    assert stream and stream <= batch
    assert F is not None


def test_search_points_are_seeded_and_bounded():
    from panelcast.plans.tuning import SEARCH_BOUNDS, neighbourhood, random_points
    a = random_points("random_forest", 10, seed=42)
    assert a == random_points("random_forest", 10, seed=42)
    for p in a:
        for name, (lo, hi) in SEARCH_BOUNDS["random_forest"].items():
            assert lo <= p[name] <= hi
    g = neighbourhood("random_forest", {"n_estimators": 60, "max_depth": 3, "min_samples_leaf": 10})
    assert g["n_estimators"] == [50, 60, 80] and g["max_depth"] == [3, 4] and g["min_samples_leaf"] == [9, 10]


def test_time_folds_per_group_and_fold_rows(spark):
    from panelcast.operators.folds import fold_train_rows, time_folds
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h)) for s in ("a", "b") for h in range(10)]
    df = spark.createDataFrame(rows, "series_key string, date_hour timestamp_ntz, y double")
    f = time_folds(df, 3)
    assert f.where(fold_train_rows(0, 3)).where("series_key = 'a'").count() == 4
    assert f.where(fold_train_rows(2, 3)).where("series_key = 'b'").count() == 8


def test_scan_pushes_slice_and_prunes_columns(spark):
    from panelcast.sources.scan import scan_panel
    from .conftest import SF_SMALL
    df = scan_panel(spark, f"{SF_SMALL}/lineitem.parquet", key="l_suppkey", time="l_shipdate",
                    target="l_extendedprice", features=["l_quantity"], start="1996-01-01", end="1997-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    schema = plan[plan.index("ReadSchema: struct<"):].split(">", 1)[0]
    assert "l_comment" not in schema and "l_tax" not in schema and "l_returnflag" not in schema


# --- rows that must not get lost ---------------------------------------------------------------------------------------

def _hours(n, key="a", start="2024-01-01 00:00:00"):
    t0 = dt.datetime.fromisoformat(start)
    return [(key, t0 + dt.timedelta(hours=h), float(h % 13)) for h in range(n)]


PANEL_DDL = "series_key string, date_hour timestamp_ntz, y double"


def test_null_keys_and_times_stay(spark):
    from panelcast.operators.folds import chrono_split, rolling_origins, time_folds
    rows = _hours(8) + _hours(8, None) + [("a", None, 1.0), (None, None, 2.0)]
    df = spark.createDataFrame(rows, PANEL_DDL)
    split = chrono_split(df, 0.5).collect()
    assert len(split) == 18
    assert all(r["split"] == "test" for r in split if r["date_hour"] is None)
    assert sum(r["split"] == "train" for r in split if r["series_key"] is None) == 4
    assert time_folds(df).count() == 18
    origins = rolling_origins(spark.createDataFrame(_hours(96, None), PANEL_DDL), "2024-01-03", "2024-01-05")
    assert {r["origin"].day for r in origins.collect()} == {3, 4}


def test_time_mode_keeps_rows_off_the_grid(spark):
    rows = _hours(60)
    rows[0] = ("a", rows[0][1] + dt.timedelta(minutes=30), 5.0)
    got = {r["date_hour"]: r for r in add_history_stats(spark.createDataFrame(rows + [("a", None, 9.0)], PANEL_DDL), "y",
                                                        mode="time").collect()}
    assert set(got) == {t for _, t, _ in rows} | {None}
    assert got[rows[50][1]]["y_same_hour_2d_ago"] == rows[2][2] and got[rows[48][1]]["y_same_hour_2d_ago"] == 5.0


def test_time_mode_refuses_two_rows_in_one_step(spark):
    rows = _hours(5) + [("a", dt.datetime(2024, 1, 1, 2, 30), 1.0)]
    with pytest.raises(Exception, match="one step of the grid"):
        add_history_stats(spark.createDataFrame(rows, PANEL_DDL), "y", mode="time").collect()


def test_std_after_an_outlier(spark):
    rows = _hours(1600)
    rows = [(k, t, 1e8 if i == 0 else v / 10) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, PANEL_DDL)
    for options in ({}, {"split_rows": 800}):
        got = {r["date_hour"]: r["y_same_hour_30d_std"] for r in add_history_stats(df, "y", **options).collect()}
        for i in range(800, 1600, 37):
            window = np.array([v for _, _, v in rows[i - 743:i - 23]])
            assert abs(got[rows[i][1]] - window.std(ddof=1)) < 1e-6, i


def test_median_of_ties_and_empty_groups(spark):
    from panelcast.operators.stats import exact_median
    df = spark.range(50_000).select(
        F.when(F.col("id") % 5 == 0, None).otherwise("g").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("flag"),
        F.col("id").cast("double").alias("v"), F.lit(None).cast("double").alias("none"))
    got = {r["g"]: (r["flag"], r["v"], r["none"]) for r in exact_median(df, ["g"], ["flag", "v", "none"]).collect()}
    pdf = df.toPandas()
    for g, part in ((None, pdf[pdf.g.isna()]), ("g", pdf[pdf.g == "g"])):
        assert got[g] == (part.flag.median(), part.v.median(), None)
    whole = exact_median(df, [], ["flag", "v", "none"]).first()
    assert tuple(whole) == (0.0, 24999.5, None)
    assert exact_median(df.limit(0), [], ["v"]).first()["v"] is None


def test_correlation_matrix_of_gaps_and_constants(spark):
    from panelcast.operators.selection import correlation_pairs
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, n), "flat": np.full(n, 0.1), "none": np.full(n, np.nan)})
    pdf["b"] = pdf["a"] * 2 + rng.normal(0, 1, n)
    pdf["twin"] = pdf["a"]
    pdf.loc[rng.random(n) < 0.3, "b"] = np.nan
    cols = ["a", "flat", "none", "b", "twin"]
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols]).repartition(5)
    got = {(r["a"], r["b"]): r["corr"] for r in correlation_pairs(df, cols).collect()}
    exp = pdf[cols].corr()
    for (a, b), c in got.items():
        if "flat" in (a, b) or "none" in (a, b):
            assert c is None
        else:
            assert abs(c - exp.loc[a, b]) < 1e-9
    assert ("a", "twin") in got and ("a", "none") not in got


def test_zoned_time_slice_reaches_the_reader(spark, tmp_path):
    from panelcast.sources.scan import scan_panel
    path = str(tmp_path / "zoned")
    df = spark.createDataFrame(_hours(72), PANEL_DDL).withColumn("date_hour", F.col("date_hour").cast("timestamp"))
    df.write.parquet(path)
    got = scan_panel(spark, path, start="2024-01-02", end="2024-01-03")
    assert got.schema["date_hour"].dataType.simpleString() == "timestamp_ntz"
    assert sorted(r["date_hour"] for r in got.collect()) == [dt.datetime(2024, 1, 2, h) for h in range(24)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(date_hour" in pushed and "LessThan(date_hour" in pushed


def test_feature_contract_has_68_names():
    from panelcast.constants import BASE_FEATURES, all_feature_names, raw_features
    names = all_feature_names()
    assert len(names) == 68 == len(set(names)) and len(BASE_FEATURES) == 42 and len(raw_features()) == 21


def test_average_importance(spark):
    from panelcast.operators.selection import average_importance
    df = spark.createDataFrame([("m1", "a", 0.2), ("m1", "b", 0.8), ("m2", "a", 0.6), ("m2", "b", 0.4)],
                               "model string, feature string, importance double")
    got = {r["feature"]: r["importance"] for r in average_importance(df).collect()}
    assert got == pytest.approx({"a": 0.4, "b": 0.6})


def test_unknown_strategy_raises(spark):
    from panelcast.operators.clean import pred_best
    preds = spark.createDataFrame([("a", 1.0, 2.0)], "series_key string, pred_lightgbm double, pred_randomforest double")
    best = lambda s: spark.createDataFrame([("a", s)], "series_key string, strategy string")
    assert pred_best(preds, best("random_forest")).first()["pred_best"] == 2.0
    assert pred_best(preds, best("RandomForest")).first()["pred_best"] == 2.0
    assert pred_best(preds, best(None)).first()["pred_best"] == 1.0
    with pytest.raises(Exception, match="no prediction column"):
        pred_best(preds, best("other")).collect()


def test_registered_model_queries_do_the_whole_job(spark, monkeypatch):
    from panelcast import registry
    from panelcast.plans import backtest, models, tuning
    seen = {}

    def spy(name):
        def called(*args, **kw):
            seen[name] = args, kw
            raise InterruptedError
        return called

    lo, hi = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    four = ["random_forest", "xgboost", "lightgbm", "stacking"]
    monkeypatch.setattr(registry, "feature_table", lambda *a: spark.range(1).select(F.lit(1.0).alias("y")))
    monkeypatch.setattr(registry, "chrono_split", lambda ft: ft.withColumn("split", F.lit("train")))
    monkeypatch.setattr(registry, "_day_range", lambda *a: (lo, hi))
    for module, name in ((backtest, "backtest"), (backtest, "backtest_predictions"), (backtest, "forecast"), (models, "fit_model"),
                         (tuning, "train_eval"), (tuning, "grid_search"), (tuning, "auto_select"), (tuning, "feature_selection_pipeline")):
        monkeypatch.setattr(module, name, spy(name))
    for q in ("backtest_pooled", "stacking", "forecast", "feature_importance", "model_fit_predict", "grid_search", "auto_select",
              "feature_selection"):
        with pytest.raises(InterruptedError):
            registry.QUERIES[q](spark, "/root/testdata/sf0.001")
    assert seen["backtest"][0][1:3] == seen["backtest_predictions"][0][1:3] == (lo, hi)
    assert set(four) < set(seen["backtest"][0][3]) and set(four) < set(seen["forecast"][0][2])
    assert len(seen["grid_search"][0]) == 3 and "grid" not in seen["grid_search"][1]
    assert not any(isinstance(x, dict) for args, kw in seen.values() for x in (*args, *kw.values()))   # library defaults
