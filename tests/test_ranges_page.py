"""Range joins, the page forecast and the leakage report."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators.future import build_future_features
from panelcast.operators.leakage import future_builder, history_builder, leakage_report
from panelcast.operators.ranges import lookback_join, lookback_range
from panelcast.operators.windows import add_history_stats, leakage_check
from panelcast.plans.models import fit_model
from panelcast.plans.page import load_model, page_summary, predict_page, save_model

from .test_many_models import FEATURES, panel


@pytest.mark.parametrize("low,high", [(0, 3600), (3600, 7200), (1800, 90_000)])
def test_lookback_join_equals_brute_force(spark, low, high):
    rng = random.Random(high)
    t0 = dt.datetime(1969, 12, 31, 20)                                  # buckets before and after the epoch
    stamp = lambda: t0 + dt.timedelta(seconds=1800 * rng.randrange(60))
    left = [(rng.choice(["a", None]), stamp(), i) for i in range(60)] + [("a", None, 60)]
    right = [(rng.choice(["a", None, "b"]), stamp(), i) for i in range(90)] + [("a", None, 90)]
    got = lookback_join(spark.createDataFrame(left, "k string, at timestamp_ntz, l int"),
                        spark.createDataFrame(right, "k string, of timestamp_ntz, r int"), "at", "of", low, high, ["k"])
    want = [(x[2], y[2]) for x in left for y in right if x[0] == y[0] and x[1] and y[1]
            and x[1] - dt.timedelta(seconds=high) <= y[1] < x[1] - dt.timedelta(seconds=low)]
    assert sorted((r["l"], r["r"]) for r in got.collect()) == sorted(want) and want
    with pytest.raises(ValueError):
        lookback_join(got, got, "at", "of", 5, 5, ["k"])


def test_lookback_range_keeps_rows_without_history(spark):
    df = panel(spark, days=4)
    out = lookback_range(df, df, "y", 1, 2).collect()
    assert len(out) == df.count()
    assert all(r["n"] == 0 and r["total"] is None for r in out if r["date_hour"] < dt.datetime(2024, 1, 2))
    assert {r["series_key"] for r in out if r["n"]} == {"s1", "s2", None}


def test_page_model_in_another_session(spark, tmp_path):
    df = panel(spark, days=8)
    hist, fut = df.where("date_hour < '2024-01-07'"), df.where("date_hour >= '2024-01-07'").drop("y")
    model = fit_model(hist, "ridge", FEATURES, "y")
    path = f"file://{tmp_path}/model"
    out = {}
    for impute in ("train_median", "zero"):
        save_model(model, path, impute)
        page = predict_page(spark.newSession(), path, fut.withColumn("b", F.col("b").cast("string")))
        assert page.columns == ["series_key", "date_hour", "predicted_price", "day", "hour"]
        out[impute] = {(r["series_key"], r["date_hour"]): r["predicted_price"] for r in page.collect()}
        want = {(r["series_key"], r["date_hour"]): max(r["pred"], 0.0) for r in model.predict(fut, impute=impute).collect()}
        assert out[impute].keys() == want.keys() and all(abs(out[impute][k] - want[k]) < 1e-9 for k in want)
        assert load_model(spark, path)[1] == impute
    gaps = {(r["series_key"], r["date_hour"]) for r in fut.where("half is null").collect()}
    assert {k for k in gaps if out["zero"][k] == out["train_median"][k]} < gaps
    assert all(out["zero"][k] == out["train_median"][k] for k in out["zero"].keys() - gaps)
    assert predict_page(spark, path, fut.drop("half")).count() == fut.count()          # an absent feature counts as gaps
    summary = page_summary(page, fut, FEATURES).collect()
    assert all(r["min_v"] <= r["mean_v"] <= r["max_v"] and 0 < r["n_features"] <= 4 for r in summary) and len(summary) == 6
    with pytest.raises(ValueError):
        model.predict(fut, impute="mean")
    with pytest.raises(ValueError):
        load_model(spark, f"{path}-none")


def test_leakage_report_equals_one_cutoff_at_a_time(spark):
    df = panel(spark, days=10, gaps=False).select("series_key", "date_hour", "y")
    days = ["2024-01-06", "2024-01-09"]
    for lag in (24, 48):
        got = leakage_report(df, history_builder(add_history_stats, "y", min_lag=lag), days, "y").collect()
        assert {str(r["cutoff"]) for r in got} == set(days)
        for day in days:
            want = {(r["feature"], r["n_rows"], r["n_changed"]) for r in leakage_check(df, day, "y", min_lag=lag).collect()}
            assert {(r["feature"], r["n_rows"], r["n_changed"]) for r in got if str(r["cutoff"]) == day} == want
        assert any(r["n_changed"] for r in got) == (lag == 24)


def test_leakage_report_of_future_features(spark):
    df = panel(spark, days=9, gaps=False).select("series_key", "date_hour", "y")
    builder = future_builder(build_future_features, "y")
    none = leakage_report(df, builder, ["2024-01-08"], "y", gap_days=0).collect()       # the day itself is never looked at
    assert none and not any(r["n_changed"] for r in none)
    some = {r["feature"]: r["n_changed"] for r in leakage_report(df, builder, ["2024-01-08"], "y", gap_days=2).collect()}
    assert some["y_same_hour_2d_ago"] > 0 and some["hour"] == 0
