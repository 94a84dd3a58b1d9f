"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (or panels Spark derives from them),
so its work grows with the data.  The matching DuckDB SQL lives in
``panelcast.oracle_queries``.  Computed columns carry the same aliases on
both sides.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import KEY_HOURS, TIME_FEATURES
from .functions.calendar import add_calendar
from .functions.exprs import round_half_up
from .operators.holidays import add_holidays
from .operators.windows import add_history_stats
from .operators import metrics as M
from .operators.clean import (between_slice, clean_panel, clip_columns, error_column, impute_train_median,
                              impute_zero, pred_best)
from .operators.future import add_future_stats, build_future_features, future_timeline
from .operators.folds import chrono_split, eval_day_spine, rolling_origins, time_folds
from .operators.selection import (apply_standardizer, correlation_pairs, fit_standardizer, importance_cut,
                                  prune_correlated, rank_by_correlation, target_correlation)
from .operators.reshape import blend, to_long, to_wide
from .session import cut_lineage
from .session import ensure_checkpoint_dir as ensure_dir
from .sources.scan import coerce_numeric, scan_panel
from .sources.testdata import (FX_STRATEGIES, evaluations_fx, panel_daily, panel_hourly, panel_supply,
                               predictions_fx, predictions_fx_wide)

CAL_INT = ["year", "month", "dayofmonth", "dayofyear", "hour", "dayofweek", "week", "weekofyear",
           "quarter", "is_weekend", "season_num"]
CAL_CYC = [c for c in TIME_FEATURES if c not in CAL_INT]
HOL = ["is_holiday", "is_pre_holiday", "is_post_holiday", "days_to_nearest_holiday", "is_major_holiday"]

STD_DIGITS = 3     # std: engines use different (equally valid) formulas; differences are a few ulps
DAILY_DIGITS = 3   # rolling mean of day means (a double sum): same reason
CYC_DIGITS = 9     # sin/cos: libm and the JVM may differ in the last ulp


def _round(df: DataFrame, cols, digits: int) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in cols})


def exact_history_stats(panel: DataFrame, min_lag: int = 24, mode: str = "rows", split_rows=None,
                        extra_round: dict | None = None) -> DataFrame:
    """History statistics on an integer-cents target, scaled to currency units once.

    The comparison rounding (and ``extra_round``: column -> digits) is one projection.
    """
    out = add_history_stats(panel, "y_cents", prefix="y", divisor=100, min_lag=min_lag, mode=mode,
                            split_rows=split_rows)
    digits = {"y_same_hour_30d_std": STD_DIGITS, "y_daily_mean_7d_rolling": DAILY_DIGITS, **(extra_round or {})}
    return out.withColumns({c: round_half_up(F.col(c), n) for c, n in digits.items()})


STAT = {
    "lag": ["y_same_hour_2d_ago", "y_same_hour_7d_ago"],
    "rolling": ["y_same_hour_30d_mean", "y_same_hour_30d_std", "y_same_hour_30d_min", "y_same_hour_30d_max"],
    "daily": ["y_daily_mean_2d_ago", "y_daily_mean_7d_ago", "y_daily_mean_7d_rolling"],
    "change": ["y_hourly_change", "y_daily_change"],
    "key_hour": [f"y_hour{h}_30d_mean" for h in KEY_HOURS],
}
KEYS = ["series_key", "date_hour", "y"]


# ------------------------------------------------------------------------------------ queries
def q_panel_hourly(spark, d):
    return panel_hourly(spark, d)


def q_panel_daily(spark, d):
    return panel_daily(spark, d)


def q_panel_supply(spark, d):
    return panel_supply(spark, d)


def q_calendar_features(spark, d):
    return add_calendar(panel_daily(spark, d)).select(*KEYS, *CAL_INT)


def q_cyclic_features(spark, d):
    out = add_calendar(panel_hourly(spark, d)).select(*KEYS, *CAL_CYC)
    return _round(out, CAL_CYC, CYC_DIGITS)


def q_holiday_flags(spark, d):
    return add_holidays(panel_daily(spark, d)).select(*KEYS, *[c for c in HOL if c != "days_to_nearest_holiday"])


def q_nearest_holiday(spark, d):
    return add_holidays(panel_daily(spark, d)).select(*KEYS, "days_to_nearest_holiday")


def _stat_query(group):
    def q(spark, d):
        return exact_history_stats(panel_hourly(spark, d)).select(*KEYS, *STAT[group])
    q.__name__ = f"q_{group}_features"
    return q


def q_all_features(spark, d):
    p = add_holidays(add_calendar(panel_hourly(spark, d)))
    out = exact_history_stats(p, extra_round={c: CYC_DIGITS for c in CAL_CYC})
    return out.select(*KEYS, "n_events", "n_users", "k_avg", *CAL_INT, *CAL_CYC, *HOL,
                      *[c for g in STAT.values() for c in g])


def q_all_features_supply(spark, d):
    """The full feature build on the supplier panel (series count grows with the data)."""
    p = add_holidays(add_calendar(panel_supply(spark, d)))
    out = exact_history_stats(p, extra_round={c: CYC_DIGITS for c in CAL_CYC})
    return out.select(*KEYS, "n_lines", "qty", "disc_avg", *CAL_INT, *CAL_CYC, *HOL, *[c for g in STAT.values() for c in g])


def q_split_series_features(spark, d):
    """Hot-series path: the order panel's long series cut into 800-row blocks with a halo."""
    out = exact_history_stats(panel_daily(spark, d), split_rows=800)
    return out.select(*KEYS, *[c for g in STAT.values() for c in g])


def q_leakage_check(spark, d):
    """Which features of 2024-01-20 see day D-1 data (reference geometry, min_lag=24)?"""
    from .operators.windows import leakage_check
    return leakage_check(panel_hourly(spark, d), "2024-01-20", "y", min_lag=24)


LEAK_DAYS = [f"2024-01-{day:02d}" for day in range(11, 30, 2)]


def q_leakage_report(spark, d):
    """Ten cut-off days at once for the history features: what of day D changes when the target of D-1 and D is hidden."""
    from .operators.leakage import history_builder, leakage_report
    from .operators.windows import add_history_stats
    return leakage_report(panel_hourly(spark, d), history_builder(add_history_stats, "y"), LEAK_DAYS, "y")


def q_leakage_future(spark, d):
    """The same for the features of future rows, which look at least one day back."""
    from .operators.future import build_future_features
    from .operators.leakage import future_builder, leakage_report
    panel = panel_hourly(spark, d).select("series_key", "date_hour", "y")
    return leakage_report(panel, future_builder(build_future_features, "y"), LEAK_DAYS, "y", lookback_days=32)


def q_leakage_check_d2(spark, d):
    """Same check with the documented D-2 rule (min_lag=48): nothing may change."""
    from .operators.windows import leakage_check
    return leakage_check(panel_hourly(spark, d), "2024-01-20", "y", min_lag=48)


def q_time_mode_lags(spark, d):
    """Lags in time mode: the panel is densified per series so a 48-row lag is exactly 48 hours."""
    out = exact_history_stats(panel_hourly(spark, d), mode="time")
    return out.select(*KEYS, *STAT["lag"], *STAT["change"])


def q_daily_summary(spark, d, panel=panel_hourly):
    days = M.daily_summary(panel(spark, d), "y")
    days = days.withColumnsRenamed({"mean_v": "mean_y", "min_v": "min_y", "max_v": "max_y"})
    return days.withColumn("mean_y", round_half_up(F.col("mean_y"), 6))


MET = ["rmse", "mape", "r2"]


def _r6(df: DataFrame, cols) -> DataFrame:
    return _round(df, cols, 6)


def q_scan_time_slice(spark, d):
    return scan_panel(spark, f"{d}/events.parquet", key="event_type", time="ts", target="value",
                      features=["user_id"], start="2024-01-05", end="2024-01-12")


def q_scan_pruned(spark, d):
    return scan_panel(spark, f"{d}/lineitem.parquet", key="l_suppkey", time="l_shipdate", target="l_extendedprice",
                      features=["l_quantity", "l_discount", "tem_avg"], start="1996-01-01", end="1997-01-01")


def q_coerce_numeric(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    t = ev.select("event_id", F.get_json_object("props", "$.k").alias("k_text"),
                  F.col("value").cast("string").alias("value_text"), F.col("event_type").alias("type_text"))
    return coerce_numeric(t, ["k_text", "value_text", "type_text", "absent_col"])


def q_clean_panel(spark, d):
    return clean_panel(panel_supply(spark, d))


def q_clip_values(spark, d):
    return clip_columns(panel_hourly(spark, d), {"y": (5.0, 100.0), "n_users": (None, 3)}).select(
        *KEYS, "n_users")


def q_between_slice(spark, d):
    return between_slice(panel_hourly(spark, d), "2024-01-10 06:00:00", "2024-01-12 18:00:00")


def q_chrono_split(spark, d, panel=panel_hourly):
    return chrono_split(panel(spark, d)).select(*KEYS, "split")


def _lagged_split(spark, d, panel=panel_hourly):
    base = exact_history_stats(panel(spark, d)).select(*KEYS, *STAT["lag"])
    return chrono_split(base)


def q_impute_train_median(spark, d, panel=panel_hourly):
    sp = cut_lineage(_lagged_split(spark, d, panel))
    tr, te = impute_train_median(sp.where(F.col("split") == "train"), [sp.where(F.col("split") == "test")],
                                 STAT["lag"])
    return tr.unionByName(te)


def q_impute_zero(spark, d):
    return impute_zero(_lagged_split(spark, d), STAT["lag"])


def _joined(spark, d):
    return M.join_actuals(predictions_fx(spark, d), panel_hourly(spark, d))


def q_join_actuals(spark, d):
    return _joined(spark, d)


def q_error_column(spark, d):
    return error_column(_joined(spark, d))


def q_anti_unevaluated(spark, d):
    return M.unevaluated(predictions_fx(spark, d), evaluations_fx(spark, d), "online")


def q_daily_metrics(spark, d):
    return _r6(M.daily_metrics(_joined(spark, d), ["series_key", "strategy"]), MET)


def _strategy_metrics(spark, d):
    return M.metrics(_joined(spark, d), ["series_key", "strategy"])


def q_strategy_metrics(spark, d):
    return _r6(_strategy_metrics(spark, d), MET)


def q_eval_train_test(spark, d):
    return _r6(M.metrics(chrono_split(_joined(spark, d), key=["series_key", "strategy"]),
                         ["series_key", "strategy", "split"]), MET)


def q_evaluate_columns(spark, d):
    out = M.evaluate_columns(predictions_fx_wide(spark, d), panel_hourly(spark, d), FX_STRATEGIES,
                             "2024-01-10", "2024-01-25")
    return _r6(out, MET)


def q_online_eval(spark, d):
    out = M.evaluate_online(predictions_fx_wide(spark, d), panel_hourly(spark, d), evaluations_fx(spark, d),
                            pred_col="roll_30d")
    return _r6(out, MET)


def q_leaderboard(spark, d):
    return _r6(M.leaderboard(evaluations_fx(spark, d)), ["avg_rmse", "avg_mape", "avg_r2"])


def q_best_strategy(spark, d):
    return _r6(M.best_strategy(evaluations_fx(spark, d), by=["series_key"]), ["avg_metric"])


def q_best_strategy_global(spark, d):
    return _r6(M.best_strategy(evaluations_fx(spark, d), metric="mape"), ["avg_metric"])


def q_pred_best(spark, d):
    best = M.best_strategy(evaluations_fx(spark, d), by=["series_key"])
    return pred_best(predictions_fx_wide(spark, d), best, mapping={s: s for s in FX_STRATEGIES},
                     default="roll_30d")


def q_panel_profile(spark, d, panel=panel_hourly):
    return _r6(M.profile(panel(spark, d)), ["mean_y"])


def q_histogram50(spark, d, panel=panel_hourly):
    return M.histogram(panel(spark, d), "y", 50)


def q_feature_availability(spark, d):
    base = exact_history_stats(panel_hourly(spark, d))
    return M.feature_availability(base, ["y_same_hour_7d_ago", "y_hour8_30d_mean", "k_avg", "tem_avg"])


def q_predictions_long(spark, d):
    return to_long(predictions_fx_wide(spark, d), FX_STRATEGIES)


def q_predictions_wide(spark, d):
    return to_wide(predictions_fx(spark, d), FX_STRATEGIES)


def q_blend_mean(spark, d):
    return _r6(blend(predictions_fx(spark, d), "mean"), ["pred"])


def q_blend_median(spark, d):
    return blend(predictions_fx(spark, d), "median")


def q_blend_weighted(spark, d):
    w = _strategy_metrics(spark, d).select("series_key", "strategy", "rmse")
    return _r6(blend(predictions_fx(spark, d), "weighted", weights=w), ["pred"])


def q_time_folds(spark, d, panel=panel_hourly):
    return time_folds(panel(spark, d)).select(*KEYS, "rn", "fold", "test_size")


def _panel_days(spark, d):
    b = panel_hourly(spark, d).agg(F.min("date_hour").alias("lo"), F.max("date_hour").alias("hi")).first()
    return b["lo"].date(), b["hi"].date()


def q_rolling_origin_folds(spark, d):
    lo, hi = _day_range(spark, d)
    return rolling_origins(panel_hourly(spark, d), lo, hi, train_days=60, min_train_rows=24).select(
        *KEYS, "origin", "role")


def q_eval_day_spine(spark, d):
    return eval_day_spine(spark, *_day_range(spark, d))


def q_topk_preview(spark, d, panel=panel_hourly):
    from pyspark.sql import Window
    w = Window.partitionBy("series_key").orderBy(F.col("y").desc(), F.col("date_hour").asc())
    return panel(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(
        *KEYS, "rank")


FUTURE_FROM = "2024-01-24"
FUT = {
    "exact": ["y_same_hour_2d_ago", "y_same_hour_7d_ago"],
    "same_hour": STAT["rolling"] + STAT["key_hour"],
    "daily": STAT["daily"],
    "change": STAT["change"],
}


def _hist_future(spark, d):
    p = panel_hourly(spark, d)
    cut = F.lit(FUTURE_FROM).cast("timestamp_ntz")
    return p.where(F.col("date_hour") < cut), p.where(F.col("date_hour") >= cut).drop("y", "y_cents")


def _future_stats(spark, d):
    hist, fut = _hist_future(spark, d)
    out = add_future_stats(fut, hist, "y_cents", prefix="y", divisor=100)
    out = _round(out, ["y_same_hour_30d_std"], STD_DIGITS)
    return _round(out, ["y_daily_mean_7d_rolling"], DAILY_DIGITS)


def _future_query(group):
    def q(spark, d):
        return _future_stats(spark, d).select("series_key", "date_hour", *FUT[group])
    q.__name__ = f"q_future_{group}"
    return q


def q_future_timeline(spark, d):
    return future_timeline(panel_hourly(spark, d), days=7)


def q_future_features(spark, d):
    hist, fut = _hist_future(spark, d)
    out = build_future_features(fut, hist, "y_cents", prefix="y", divisor=100)
    out = _round(out, ["y_same_hour_30d_std"], STD_DIGITS)
    out = _round(out, ["y_daily_mean_7d_rolling"], DAILY_DIGITS)
    out = _round(out, CAL_CYC, CYC_DIGITS)
    return out.select("series_key", "date_hour", "n_events", "n_users", "k_avg", *CAL_INT, *CAL_CYC, *HOL,
                      *[c for g in STAT.values() for c in g])


ALL_FEATS = (["n_events", "n_users", "k_avg"] + CAL_INT + CAL_CYC + HOL +
             [c for g in STAT.values() for c in g])
PAIR_COLS = ["y", "n_events", "n_users", "k_avg", "y_same_hour_2d_ago", "y_same_hour_30d_mean"]
SCALE_COLS = ["n_events", "n_users", "k_avg", "y_same_hour_2d_ago", "y_same_hour_7d_ago", "is_weekend"]


def feature_table(spark, d):
    """The hourly feature table, materialised once in the checkpoint folder (selection reads it many times)."""
    return cut_lineage(q_all_features(spark, d))


def q_corr_target(spark, d):
    return _round(target_correlation(feature_table(spark, d), "y", ALL_FEATS), ["corr"], 9)


def q_corr_matrix(spark, d):
    return _round(correlation_pairs(feature_table(spark, d), PAIR_COLS), ["corr"], 9)


def q_corr_topk(spark, d):
    out = rank_by_correlation(target_correlation(feature_table(spark, d), "y", ALL_FEATS), 0.5)
    return _round(out.where("top"), ["abs_corr"], 9)


def q_corr_prune(spark, d):
    return _round(prune_correlated(feature_table(spark, d), "y", ALL_FEATS, 0.5, 0.95), ["abs_corr"], 9)


def q_importance_cut(spark, d):
    af = feature_table(spark, d)
    tc = target_correlation(af, "y", ALL_FEATS)
    cov = af.agg(*[F.covar_pop(F.when(F.col(c).isNotNull() & F.col("y").isNotNull(), F.col(c)),
                               F.when(F.col(c).isNotNull() & F.col("y").isNotNull(), F.col("y"))).alias(c)
                   for c in ALL_FEATS]).unpivot([], ALL_FEATS, "feature", "cov")
    imp = (tc.select(F.lit("abs_corr").alias("model"), "feature", F.abs("corr").alias("importance"))
           .unionByName(cov.select(F.lit("abs_cov").alias("model"), "feature", F.abs("cov").alias("importance"))))
    return _round(importance_cut(imp, "median"), ["importance"], 9)


def q_standardize(spark, d):
    base = chrono_split(exact_history_stats(panel_hourly(spark, d)).withColumn(
        "is_weekend", (F.weekday("date_hour") >= 5).cast("int")))
    stats = fit_standardizer(base.where(F.col("split") == "train"), SCALE_COLS)
    out = apply_standardizer(base, stats, SCALE_COLS).select(*KEYS, "split", *SCALE_COLS)
    return _round(out, SCALE_COLS, 9)


ML_FEATS = ["n_events", "n_users", "k_avg", "hour", "dayofweek", "is_weekend", "hoursin", "hourcos", "is_holiday",
            "days_to_nearest_holiday", "y_same_hour_2d_ago", "y_same_hour_7d_ago", "y_same_hour_30d_mean",
            "y_same_hour_30d_std", "y_daily_mean_2d_ago", "y_hourly_change", "y_daily_change"]
NAIVE = ["naive_2d", "naive_7d", "roll_30d"]
POOLED = ["random_forest", "xgboost", "lightgbm", "stacking"]


def _day_range(spark, d):
    lo, hi = _panel_days(spark, d)
    import datetime as _dt
    return lo, hi + _dt.timedelta(days=1)


def q_backtest_metrics(spark, d):
    from .plans.backtest import backtest
    start, end = _day_range(spark, d)
    ev = backtest(feature_table(spark, d), start, end, NAIVE, [], "y", prefix="y")
    return _r6(ev, MET)


def q_backtest_ridge(spark, d):
    from .plans.backtest import backtest
    start, end = _day_range(spark, d)
    return backtest(feature_table(spark, d), start, end, ["ridge"], ML_FEATS, "y", prefix="y")


RIDGE1 = ["n_events"]


def q_backtest_ridge1(spark, d):
    """The ridge backtest with one feature, whose solution is a plain formula."""
    from .plans.backtest import backtest_predictions
    start, end = _day_range(spark, d)
    preds = backtest_predictions(panel_hourly(spark, d), start, end, ["ridge"], RIDGE1, "y")
    m = M.metrics(_r6(preds, ["pred"]), ["series_key", "origin", "strategy"])
    return _r6(m.select("series_key", F.col("origin").alias("date"), "strategy", "n", *MET), MET)


def q_forecast_ridge1(spark, d):
    """The forecast of the days from FUTURE_FROM on by ridge with one feature."""
    from .plans.backtest import forecast
    p = panel_hourly(spark, d)
    cut = F.lit(FUTURE_FROM).cast("timestamp_ntz")
    out = forecast(p.where(F.col("date_hour") < cut), p.where(F.col("date_hour") >= cut).drop("y", "y_cents"), ["ridge"], RIDGE1, "y")
    return _r6(out.drop("created_at"), ["pred_ridge", "pred_best"])


def q_grid_ridge1(spark, d):
    """Grid search of the ridge penalty with one feature: mean RMSE over the expanding folds."""
    from .plans.tuning import grid_search
    return _r6(grid_search(panel_hourly(spark, d), "ridge", RIDGE1, target="y"), ["rmse"])


def q_backtest_pooled(spark, d):
    """Pooled refits per origin day (the reference's daily refit loop) over the whole panel, all four strategies."""
    from .plans.backtest import backtest
    start, end = _day_range(spark, d)
    return backtest(feature_table(spark, d), start, end, [*POOLED, "naive_2d"], ML_FEATS, "y", prefix="y")


def q_model_fit_predict(spark, d):
    from .plans.tuning import train_eval
    m, _, pred = train_eval(feature_table(spark, d), "random_forest", ML_FEATS, "y")
    return pred.select(*KEYS, "split", "pred")


def q_feature_importance(spark, d):
    from .plans.models import fit_model
    ft = feature_table(spark, d)
    return fit_model(chrono_split(ft).where("split = 'train'"), "xgboost", ML_FEATS, "y").importances()


def q_stacking(spark, d):
    """Stacked predictions of every day that has enough history."""
    from .plans.backtest import backtest_predictions
    start, end = _day_range(spark, d)
    return backtest_predictions(feature_table(spark, d), start, end, ["stacking"], ML_FEATS, "y").select(
        "series_key", "date_hour", "pred")


def q_grid_search(spark, d):
    from .plans.tuning import grid_search
    return grid_search(feature_table(spark, d), "ridge", ML_FEATS, target="y")


PAGE_FEATURES = ["y_same_hour_2d_ago"]


def _page(spark, d):
    """A ridge of one feature kept with ``impute='zero'``, and the future rows it predicts in a session of its own."""
    import os
    from .plans.models import fit_model
    from .plans.page import predict_page, save_model
    p = panel_hourly(spark, d)
    cut = F.lit(FUTURE_FROM).cast("timestamp_ntz")
    hist = exact_history_stats(p.where(F.col("date_hour") < cut))
    path = os.path.join(ensure_dir(spark), f"page-{uuid.uuid4().hex}")
    save_model(fit_model(hist, "ridge", PAGE_FEATURES, "y"), path, "zero")
    fut = cut_lineage(build_future_features(p.where(F.col("date_hour") >= cut).drop("y", "y_cents"), hist, "y"))
    return predict_page(spark.newSession(), path, fut), fut


def q_predict_page(spark, d):
    return _r6(_page(spark, d)[0], ["predicted_price"])


def q_predict_page_summary(spark, d):
    from .plans.page import page_summary
    pred, fut = _page(spark, d)
    out = page_summary(_r6(pred, ["predicted_price"]), fut, [*PAGE_FEATURES, "y_same_hour_7d_ago", "k_avg"])
    return _r6(out, ["mean_v"])


def q_lookback_range(spark, d):
    """History in [t - 31 days, t - 1 day) of each future row."""
    from .operators.ranges import lookback_range
    p = panel_hourly(spark, d)
    cut = F.lit(FUTURE_FROM).cast("timestamp_ntz")
    return lookback_range(p.where(F.col("date_hour") >= cut), p.where(F.col("date_hour") < cut), "y_cents")


def q_tune_once(spark, d):
    """The tuning job over the whole panel: feature selection, successive halving, the forest's neighbourhood grid."""
    from .plans.tuning import tune_once
    start, end = _day_range(spark, d)
    return tune_once(feature_table(spark, d), start, end, ML_FEATS, "y")


def q_auto_select(spark, d):
    from .plans.tuning import auto_select
    board, _ = auto_select(feature_table(spark, d), ML_FEATS, "y")
    return board


def q_forecast(spark, d):
    from .plans.backtest import forecast
    p = panel_hourly(spark, d)
    cut = F.lit(FUTURE_FROM).cast("timestamp_ntz")
    hist = cut_lineage(add_holidays(add_calendar(p.where(F.col("date_hour") < cut))).transform(
        lambda x: add_history_stats(x, "y")))
    fut = build_future_features(p.where(F.col("date_hour") >= cut).drop("y", "y_cents"), hist, "y")
    best = M.best_strategy(evaluations_fx(spark, d), by=["series_key"])
    return forecast(hist, fut, [*NAIVE, "ridge", *POOLED], ML_FEATS, "y", best=best).drop("created_at")


def q_feature_selection(spark, d):
    """Two-stage selection on the hourly feature table (correlation pruning, then importance cut)."""
    from .plans.tuning import feature_selection_pipeline
    return feature_selection_pipeline(feature_table(spark, d), ALL_FEATS, "y")


def q_stream_online_eval(spark, d):
    """Predictions arrive as a file stream; each micro-batch is evaluated against the actuals in
    ``foreachBatch``, replacing the evaluation of the days it touches (replay-safe)."""
    import os
    from .streaming.hourly import online_eval_batch
    root = os.path.join(ensure_dir(spark), f"online-{uuid.uuid4().hex}")
    preds = predictions_fx_wide(spark, d).withColumn("day", F.to_date("date_hour"))
    preds.repartition("day").write.mode("overwrite").partitionBy("day").parquet(root + "/preds")
    stream = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", 5).parquet(root + "/preds")
    q = (stream.writeStream.foreachBatch(online_eval_batch(panel_hourly(spark, d), root + "/eval", "roll_30d"))
         .option("checkpointLocation", root + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return _r6(spark.read.parquet(root + "/eval"), MET)


def q_replace_slice(spark, d):
    from .sources.sinks import replace_slice
    old = evaluations_fx(spark, d)
    new = old.where((F.col("strategy") == "naive_2d") & (F.col("date") >= F.lit("2024-01-05").cast("date")) &
                    (F.col("date") < F.lit("2024-01-10").cast("date"))).withColumn("rmse", F.col("rmse") * 2)
    return _r6(replace_slice(old, new, "2024-01-05", "2024-01-15", "backtest"), MET)


def q_stream_hourly_panel(spark, d):
    from .streaming.hourly import hourly_panel_stream
    import os
    src = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    root = os.path.join(ensure_dir(spark), f"stream-{uuid.uuid4().hex}")
    q = (hourly_panel_stream(stream).writeStream.outputMode("append").format("parquet")
         .option("path", root + "/out").option("checkpointLocation", root + "/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(root + "/out")


ARRIVALS = 6


def q_stream_hourly_panel_closed(spark, d):
    """T1 over several micro-batches with out-of-order and repeated events, closed at the end: the hours emitted and those in state."""
    import os
    from .streaming.hourly import run_hourly_panel, unfinished_hours
    root = os.path.join(ensure_dir(spark), f"arrivals-{uuid.uuid4().hex}")
    events = spark.read.parquet(f"{d}/events.parquet")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo).total_seconds() / (ARRIVALS - 1)
    # An event arrives up to 90 minutes late, every 17th twice at once and every 19th again in the next part (later than the watermark).
    late = F.pmod(F.xxhash64("event_id"), F.lit(5400))
    part = F.floor((F.timestamp_diff("SECOND", F.lit(lo), F.col("ts")) + late) / F.lit(step)).cast("int")
    again = F.when(F.col("event_id") % 17 == 0, F.array(part, part)).when(
        F.col("event_id") % 19 == 0, F.array(part, part + 1)).otherwise(F.array(part))
    arrivals = cut_lineage(events.withColumn("_part", F.explode(again)))
    for k in range(ARRIVALS + 1):
        arrivals.where(F.col("_part") == k).drop("_part").repartition(4).write.mode("append").parquet(root + "/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(root + "/in")
    run_hourly_panel(stream, root + "/out", root + "/ckpt", id_col="event_id")
    return spark.read.parquet(root + "/out").unionByName(unfinished_hours(spark, root + "/ckpt"))


def q_swap_slice(spark, d):
    """S7 on storage: the evaluations as a versioned table, one slice of it swapped (twice, which is once)."""
    import os
    from .sources.versions import read_evaluations, swap_slice
    root = os.path.join(ensure_dir(spark), f"evaluations-{uuid.uuid4().hex}")
    old = evaluations_fx(spark, d)
    for kind in ("backtest", "online"):
        swap_slice(spark, root, old.where(F.col("eval_type") == kind), "2000-01-01", "2100-01-01", kind)
    new = old.where((F.col("strategy") == "naive_2d") & (F.col("date") >= F.lit("2024-01-05").cast("date")) &
                    (F.col("date") < F.lit("2024-01-10").cast("date"))).withColumn("rmse", F.col("rmse") * 2)
    for _ in range(2):
        swap_slice(spark, root, new, "2024-01-05", "2024-01-15", "backtest")
    return _r6(read_evaluations(spark, root), MET)


QUERIES = {
    "stream_hourly_panel_closed": q_stream_hourly_panel_closed,
    "swap_slice": q_swap_slice,
    "leakage_report": q_leakage_report,
    "leakage_future": q_leakage_future,
    "predict_page": q_predict_page,
    "predict_page_summary": q_predict_page_summary,
    "lookback_range": q_lookback_range,
    "backtest_metrics": q_backtest_metrics,
    "backtest_ridge": q_backtest_ridge,
    "backtest_ridge1": q_backtest_ridge1,
    "forecast_ridge1": q_forecast_ridge1,
    "grid_ridge1": q_grid_ridge1,
    "backtest_pooled": q_backtest_pooled,
    "model_fit_predict": q_model_fit_predict,
    "feature_importance": q_feature_importance,
    "stacking": q_stacking,
    "grid_search": q_grid_search,
    "tune_once": q_tune_once,
    "auto_select": q_auto_select,
    "forecast": q_forecast,
    "replace_slice": q_replace_slice,
    "feature_selection": q_feature_selection,
    "stream_online_eval": q_stream_online_eval,
    "stream_hourly_panel": q_stream_hourly_panel,
    "corr_target": q_corr_target,
    "corr_matrix": q_corr_matrix,
    "corr_topk": q_corr_topk,
    "corr_prune": q_corr_prune,
    "importance_cut": q_importance_cut,
    "standardize": q_standardize,
    "future_timeline": q_future_timeline,
    "lookback_exact": _future_query("exact"),
    "future_same_hour": _future_query("same_hour"),
    "future_daily_stats": _future_query("daily"),
    "future_changes": _future_query("change"),
    "future_features": q_future_features,
    "scan_time_slice": q_scan_time_slice,
    "scan_pruned": q_scan_pruned,
    "coerce_numeric": q_coerce_numeric,
    "clean_panel": q_clean_panel,
    "clip_values": q_clip_values,
    "between_slice": q_between_slice,
    "chrono_split": q_chrono_split,
    "impute_train_median": q_impute_train_median,
    "impute_zero": q_impute_zero,
    "join_actuals": q_join_actuals,
    "error_column": q_error_column,
    "anti_unevaluated": q_anti_unevaluated,
    "daily_metrics": q_daily_metrics,
    "strategy_metrics": q_strategy_metrics,
    "eval_train_test": q_eval_train_test,
    "evaluate_columns": q_evaluate_columns,
    "online_eval": q_online_eval,
    "leaderboard": q_leaderboard,
    "best_strategy": q_best_strategy,
    "best_strategy_global": q_best_strategy_global,
    "pred_best": q_pred_best,
    "panel_profile": q_panel_profile,
    "histogram50": q_histogram50,
    "feature_availability": q_feature_availability,
    "predictions_long": q_predictions_long,
    "predictions_wide": q_predictions_wide,
    "blend_mean": q_blend_mean,
    "blend_median": q_blend_median,
    "blend_weighted": q_blend_weighted,
    "time_folds": q_time_folds,
    "rolling_origin_folds": q_rolling_origin_folds,
    "eval_day_spine": q_eval_day_spine,
    "topk_preview": q_topk_preview,
    "panel_hourly": q_panel_hourly,
    "panel_daily": q_panel_daily,
    "panel_supply": q_panel_supply,
    "calendar_features": q_calendar_features,
    "cyclic_features": q_cyclic_features,
    "holiday_flags": q_holiday_flags,
    "nearest_holiday": q_nearest_holiday,
    "lag_features": _stat_query("lag"),
    "rolling_features": _stat_query("rolling"),
    "daily_lag_features": _stat_query("daily"),
    "change_features": _stat_query("change"),
    "key_hour_features": _stat_query("key_hour"),
    "time_mode_lags": q_time_mode_lags,
    "leakage_check": q_leakage_check,
    "leakage_check_d2": q_leakage_check_d2,
    "split_series_features": q_split_series_features,
    "all_features": q_all_features,
    "all_features_supply": q_all_features_supply,
    "daily_summary": q_daily_summary,
}

# The same operators on the panel whose series grow with the data.
ON_SUPPLY = ("daily_summary", "chrono_split", "impute_train_median", "panel_profile", "histogram50", "time_folds", "topk_preview")
QUERIES |= {f"{name}_supply": partial(QUERIES[name], panel=panel_supply) for name in ON_SUPPLY}
