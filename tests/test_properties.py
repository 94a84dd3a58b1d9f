"""Properties of the feature, fold and evaluation operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators.folds import rolling_origins, series_row_number, time_folds
from panelcast.operators.future import add_future_stats
from panelcast.operators.reshape import blend
from panelcast.operators.stats import exact_median
from panelcast.operators.windows import add_history_stats
from panelcast.sources.sinks import replace_slice

STATS = ["y_same_hour_2d_ago", "y_same_hour_7d_ago", "y_same_hour_30d_mean", "y_same_hour_30d_std",
         "y_same_hour_30d_min", "y_same_hour_30d_max", "y_daily_mean_2d_ago", "y_daily_mean_7d_ago",
         "y_daily_mean_7d_rolling", "y_hourly_change", "y_daily_change", "y_hour8_30d_mean"]


def hourly(n_hours=1200, series=("a", "b"), seed=0, gaps=()):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for s in series:
        for h in range(n_hours):
            if h in gaps:
                continue
            rows.append((s, start + dt.timedelta(hours=h), float(rng.integers(0, 50000))))
    return pd.DataFrame(rows, columns=["series_key", "date_hour", "y"])


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf, "series_key string, date_hour timestamp_ntz, y double")


def brute_force(pdf):
    """The definitions of SURVEY §2.5, each value gathered on its own: for row i of a series, the rows it names are
    listed by position (or by day and hour) and summarised with numpy."""
    def mean(values):
        return sum(values) / len(values) if len(values) else math.nan

    out = []
    for name in sorted(set(pdf["series_key"])):
        stamps = sorted((t, y) for k, t, y in pdf.itertuples(index=False, name=None) if k == name)
        y = [v for _, v in stamps]
        of_day = {}
        for t, v in stamps:
            of_day.setdefault(t.date(), []).append(v)
        day = [mean(of_day[t.date()]) for t, _ in stamps]
        at = lambda values, i: values[i] if i >= 0 else math.nan
        eights = [i for i, (t, _) in enumerate(stamps) if t.hour == 8]
        for i, (t, _) in enumerate(stamps):
            window = np.array([y[j] for j in range(i - 743, i - 23) if j >= 0])
            row = {"series_key": name, "date_hour": t}
            row["y_same_hour_2d_ago"], row["y_same_hour_7d_ago"] = at(y, i - 48), at(y, i - 168)
            row["y_same_hour_30d_mean"] = window.mean() if len(window) else math.nan
            row["y_same_hour_30d_std"] = window.std(ddof=1) if len(window) > 1 else math.nan
            row["y_same_hour_30d_min"] = window.min() if len(window) else math.nan
            row["y_same_hour_30d_max"] = window.max() if len(window) else math.nan
            row["y_daily_mean_2d_ago"], row["y_daily_mean_7d_ago"] = at(day, i - 48), at(day, i - 168)
            row["y_daily_mean_7d_rolling"] = mean([day[j] for j in range(i - 30, i - 23) if j >= 0])
            row["y_hourly_change"] = at(y, i - 24) - at(y, i - 25)
            row["y_daily_change"] = at(y, i - 24) - at(y, i - 48)
            row["y_hour8_30d_mean"] = mean([y[j] for j in eights if j < i][-30:]) if t.hour == 8 else math.nan
            out.append(row)
    return pd.DataFrame(out)


def spark_features(spark, pdf, **kw):
    got = add_history_stats(to_spark(spark, pdf), "y", key_hours=(8,), **kw).toPandas()
    return got.sort_values(["series_key", "date_hour"]).reset_index(drop=True)


@pytest.mark.parametrize("algorithm", ["prefix", "frame"])
def test_windows_equal_brute_force_with_gaps(spark, algorithm):
    pdf = hourly(1000, gaps=set(range(300, 340)) | {500, 777})
    got = spark_features(spark, pdf, algorithm=algorithm)
    exp = brute_force(pdf).sort_values(["series_key", "date_hour"]).reset_index(drop=True)
    for c in STATS:
        np.testing.assert_allclose(got[c].astype(float), exp[c].astype(float), rtol=1e-9, atol=1e-6,
                                   equal_nan=True, err_msg=c)


def test_no_future_leakage(spark):
    pdf = hourly(900, series=("a",))
    cut = pdf["date_hour"].iloc[700]
    changed = pdf.copy()
    changed.loc[changed["date_hour"] >= cut, "y"] = -1.0
    a = spark_features(spark, pdf)
    b = spark_features(spark, changed)
    mask = a["date_hour"] <= cut
    for c in STATS:
        np.testing.assert_allclose(a.loc[mask, c].astype(float), b.loc[mask, c].astype(float), equal_nan=True)


def test_series_independence(spark):
    one = hourly(800, series=("a",))
    two = pd.concat([one, hourly(800, series=("zz",), seed=5)])
    a = spark_features(spark, one)
    b = spark_features(spark, two)
    b = b[b["series_key"] == "a"].reset_index(drop=True)
    pd.testing.assert_frame_equal(a[STATS], b[STATS])


def test_rows_equals_time_mode_on_dense_panel(spark):
    pdf = hourly(500)
    a = spark_features(spark, pdf, mode="rows")
    b = spark_features(spark, pdf, mode="time")
    pd.testing.assert_frame_equal(a[STATS], b[STATS])


def test_time_mode_differs_with_gaps(spark):
    pdf = hourly(300, series=("a",), gaps={100})
    a = spark_features(spark, pdf, mode="rows")
    b = spark_features(spark, pdf, mode="time")
    row = a["date_hour"] == dt.datetime(2024, 1, 1) + dt.timedelta(hours=120)  # lookback crosses the gap
    assert a.loc[row, "y_same_hour_2d_ago"].item() != b.loc[row, "y_same_hour_2d_ago"].item()


def test_time_folds_match_timeseriessplit(spark):
    pdf = hourly(10, series=("a",))
    f = time_folds(to_spark(spark, pdf), 3).orderBy("rn").toPandas()
    assert f["test_size"].unique().tolist() == [2]
    assert f["fold"].tolist()[:4] == [None] * 4 or f["fold"].isna().tolist()[:4] == [True] * 4
    assert f["fold"].tolist()[4:] == [0, 0, 1, 1, 2, 2]


def test_series_row_number_is_time_rank(spark):
    pdf = hourly(100, gaps={3, 50})
    got = series_row_number(to_spark(spark, pdf), "series_key", "date_hour").toPandas()
    got = got.sort_values(["series_key", "date_hour"])
    exp = got.groupby("series_key").cumcount() + 1
    assert (got["_rn"].values == exp.values).all()


def test_rolling_origins_windows(spark):
    pdf = hourly(24 * 10, series=("a",))
    f = rolling_origins(to_spark(spark, pdf), "2024-01-03", "2024-01-06", train_days=2, min_train_rows=24).toPandas()
    for origin, g in f.groupby("origin"):
        tr = g[g.role == "train"]["date_hour"]
        te = g[g.role == "test"]["date_hour"]
        o = pd.Timestamp(origin)
        assert tr.min() >= o - pd.Timedelta(days=2) and tr.max() < o
        assert (te.dt.normalize() == o).all() and len(te) == 24


def test_weighted_blend_of_constant_is_constant(spark):
    long = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), s, 7.0) for s in ("m1", "m2", "m3")],
                                 "series_key string, date_hour timestamp_ntz, strategy string, pred double")
    w = spark.createDataFrame([("m1", 1.0), ("m2", 2.0), ("m3", 5.0)], "strategy string, rmse double")
    got = blend(long, "weighted", weights=w).first()["pred"]
    assert abs(got - 7.0) < 1e-12


def test_replace_slice_twice_equals_once(spark):
    old = spark.createDataFrame(
        [("a", dt.date(2024, 1, d), "s", 1.0, 1.0, 1.0, "backtest") for d in range(1, 10)],
        "series_key string, date date, strategy string, rmse double, mape double, r2 double, eval_type string")
    new = old.where(F.col("date").between(dt.date(2024, 1, 2), dt.date(2024, 1, 3))).withColumn("rmse", F.lit(9.0))
    once = replace_slice(old, new, "2024-01-02", "2024-01-06")
    twice = replace_slice(once, new, "2024-01-02", "2024-01-06")
    a = sorted(map(tuple, once.collect()))
    b = sorted(map(tuple, twice.collect()))
    assert a == b
    days = [r["date"].day for r in once.collect()]
    assert 4 not in days and 5 not in days      # stale days of the slice are gone


def test_exact_median_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 3000), "v": rng.normal(size=3000)})
    got = {r["g"]: r["v"] for r in exact_median(spark.createDataFrame(pdf), ["g"], ["v"]).collect()}
    exp = pdf.groupby("g")["v"].median().to_dict()
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-12


def test_future_depleted_history(spark):
    hist = hourly(24 * 40, series=("a",))
    last = hist["date_hour"].max()
    fut = pd.DataFrame({"series_key": "a", "date_hour": [last + pd.Timedelta(hours=h) for h in range(1, 24 * 14 + 1)]})
    f = spark.createDataFrame(fut, "series_key string, date_hour timestamp_ntz")
    got = add_future_stats(f, to_spark(spark, hist), "y").toPandas().sort_values("date_hour")
    early = got.iloc[0]
    late = got.iloc[-1]
    assert not np.isnan(early["y_same_hour_30d_mean"])
    assert np.isnan(late["y_same_hour_2d_ago"]) and np.isnan(late["y_same_hour_7d_ago"])
    t = late["date_hour"]
    lb = hist[(hist["date_hour"] >= t - pd.Timedelta(days=31)) & (hist["date_hour"] < t - pd.Timedelta(days=1))]
    same = lb[lb["date_hour"].dt.hour == t.hour]["y"]
    assert abs(late["y_same_hour_30d_mean"] - same.mean()) < 1e-9      # shrinking history, as defined
    assert abs(late["y_hourly_change"] - (lb["y"].iloc[-1] - lb["y"].iloc[-2])) < 1e-9


@pytest.mark.parametrize("mode", ["rows", "time"])
def test_split_blocks_equal_plain_windows(spark, mode):
    """A hot series cut into position blocks with a halo gives exactly the unsplit features."""
    pdf = hourly(3000, series=("hot", "small"), gaps=set(range(1000, 1030)) | {2222}) if mode == "rows" \
        else hourly(2500, series=("hot",), gaps={100, 1500})
    plain = spark_features(spark, pdf, mode=mode)
    split = spark_features(spark, pdf, mode=mode, split_rows=800)
    assert len(plain) == len(split)
    for c in STATS:
        np.testing.assert_allclose(split[c].astype(float), plain[c].astype(float), rtol=1e-9, atol=1e-6,
                                   equal_nan=True, err_msg=c)


def test_leakage_check_d2_rule_is_clean(spark):
    from panelcast.operators.windows import leakage_check
    pdf = hourly(24 * 40, series=("a",))
    res = leakage_check(to_spark(spark, pdf), "2024-01-30", "y", min_lag=48).collect()
    assert res and all(r["n_changed"] == 0 for r in res)
    ref = {r["feature"]: r["n_changed"] for r in
           leakage_check(to_spark(spark, pdf), "2024-01-30", "y", min_lag=24).collect()}
    assert ref["y_same_hour_30d_mean"] > 0 and ref["y_same_hour_2d_ago"] == 0
