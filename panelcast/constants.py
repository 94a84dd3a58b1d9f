"""Fixed values that results depend on.

Everything in this module is a fixed value that must stay exactly as written
for the features to be right: the default holiday calendar, the names of the
major holidays, the key hours, window lengths and the feature-name contract.
"""

from __future__ import annotations

# --- fixed values: default holiday calendar 2024-2026 (date, name) -------------------------
HOLIDAYS = [
    ("2024-01-01", "元旦"),
    ("2024-02-10", "春节"),
    ("2024-02-11", "春节"),
    ("2024-02-12", "春节"),
    ("2024-02-13", "春节"),
    ("2024-02-14", "春节"),
    ("2024-02-15", "春节"),
    ("2024-02-16", "春节"),
    ("2024-02-17", "春节"),
    ("2024-04-04", "清明节"),
    ("2024-04-05", "清明节"),
    ("2024-04-06", "清明节"),
    ("2024-05-01", "劳动节"),
    ("2024-05-02", "劳动节"),
    ("2024-05-03", "劳动节"),
    ("2024-05-04", "劳动节"),
    ("2024-05-05", "劳动节"),
    ("2024-06-10", "端午节"),
    ("2024-09-15", "中秋节"),
    ("2024-09-16", "中秋节"),
    ("2024-09-17", "中秋节"),
    ("2024-10-01", "国庆节"),
    ("2024-10-02", "国庆节"),
    ("2024-10-03", "国庆节"),
    ("2024-10-04", "国庆节"),
    ("2024-10-05", "国庆节"),
    ("2024-10-06", "国庆节"),
    ("2024-10-07", "国庆节"),
    ("2025-01-01", "元旦"),
    ("2025-01-28", "春节"),
    ("2025-01-29", "春节"),
    ("2025-01-30", "春节"),
    ("2025-01-31", "春节"),
    ("2025-02-01", "春节"),
    ("2025-02-02", "春节"),
    ("2025-02-03", "春节"),
    ("2025-04-04", "清明节"),
    ("2025-04-05", "清明节"),
    ("2025-04-06", "清明节"),
    ("2025-05-01", "劳动节"),
    ("2025-05-02", "劳动节"),
    ("2025-05-03", "劳动节"),
    ("2025-05-04", "劳动节"),
    ("2025-05-05", "劳动节"),
    ("2025-06-01", "端午节"),
    ("2025-10-01", "国庆节"),
    ("2025-10-02", "国庆节"),
    ("2025-10-03", "国庆节"),
    ("2025-10-04", "国庆节"),
    ("2025-10-05", "国庆节"),
    ("2025-10-06", "国庆节"),
    ("2025-10-07", "国庆节"),
    ("2026-01-01", "元旦"),
    ("2026-01-28", "春节"),
    ("2026-01-29", "春节"),
    ("2026-01-30", "春节"),
    ("2026-01-31", "春节"),
    ("2026-02-01", "春节"),
    ("2026-02-02", "春节"),
    ("2026-02-03", "春节"),
    ("2026-04-04", "清明节"),
    ("2026-04-05", "清明节"),
    ("2026-04-06", "清明节"),
    ("2026-05-01", "劳动节"),
    ("2026-05-02", "劳动节"),
    ("2026-05-03", "劳动节"),
    ("2026-05-04", "劳动节"),
    ("2026-05-05", "劳动节"),
    ("2026-06-20", "端午节"),
    ("2026-10-01", "国庆节"),
    ("2026-10-02", "国庆节"),
    ("2026-10-03", "国庆节"),
    ("2026-10-04", "国庆节"),
    ("2026-10-05", "国庆节"),
    ("2026-10-06", "国庆节"),
    ("2026-10-07", "国庆节"),
]

# --- fixed values: holiday names that count as major --------------------------------------
MAJOR_HOLIDAY_NAMES = ("春节", "国庆节")

# --- fixed values: distance cap for days_to_nearest_holiday --------------------------------
HOLIDAY_DISTANCE_CAP = 365

# --- fixed values: key hours that get their own same-hour 30-row mean ---------------------
KEY_HOURS = (8, 9, 10, 11, 12, 18, 19, 20, 21, 22)

# --- fixed values: window geometry (positional rows of an hourly panel) -------------------
LAG_2D = 48
LAG_7D = 168
ROLL_ROWS = 720          # rolling window length
ROLL_SHIFT = 24          # shift applied after the rolling window
DAILY_ROLL_ROWS = 7      # rows (not days) in the rolling day-mean
KEY_HOUR_ROWS = 30       # same-hour rows in the key-hour mean
FUTURE_LOOKBACK_DAYS = 31
FUTURE_GAP_DAYS = 1

# --- fixed values: calendar feature names (generated, never read from the source) ---------
TIME_FEATURES = (
    "year", "month", "dayofmonth", "dayofyear", "hour", "dayofweek", "week", "is_weekend",
    "hoursin", "hourcos", "dayofweeksin", "dayofweekcos", "weeksin", "weekcos",
    "monthsin", "monthcos", "dayofyearsin", "dayofyearcos", "cos_time", "sin_time",
    "season_cos", "season_sin", "weekofyear", "quarter", "season_num",
)

# --- fixed values: base feature list of the batch job (21 raw + 21 calendar) --------------
BASE_FEATURES = (
    "total_wind_solar_pre_avg", "solar_radiation_avg", "weekcos", "cloud_avg", "dayofyearcos",
    "dayofyearsin", "hourcos", "pre_avg", "dayofmonth", "week", "dayofyear", "hoursin",
    "monthsin", "tem_avg", "dayofweekcos", "weeksin", "pm10_avg", "wind_speed_avg",
    "is_weekend", "wind120_avg", "wind180_avg", "hum_avg", "heat_avg", "dir_avg",
    "pm2_5_avg", "wind10_avg", "wind100_avg", "sin_time", "cos_time", "season_cos",
    "season_sin", "monthcos", "month", "weekofyear", "quarter", "season_num",
    "load_pre_avg", "out_pre_avg", "non_market_pre_avg", "hydro_pre_avg", "power_pre_avg",
    "balance_pre_avg",
)

# --- fixed values: holiday feature names ---------------------------------------------------
HOLIDAY_FEATURES = (
    "is_holiday", "is_pre_holiday", "is_post_holiday", "days_to_nearest_holiday", "is_major_holiday",
)

# --- fixed values: statistical feature suffixes (prefixed with the target name) ----------
STAT_SUFFIXES = (
    "same_hour_2d_ago", "same_hour_7d_ago",
    "same_hour_30d_mean", "same_hour_30d_std", "same_hour_30d_min", "same_hour_30d_max",
    "daily_mean_2d_ago", "daily_mean_7d_ago", "daily_mean_7d_rolling",
    "hourly_change", "daily_change",
)

# --- fixed values: strategy -> prediction column, and the fallback strategy --------------
STRATEGY_TO_PRED_COL = {
    "RandomForest": "pred_randomforest",
    "XGBoost": "pred_xgboost",
    "LightGBM": "pred_lightgbm",
    "TwoStage_Stacking": "pred_two_stage_stacking",
}
DEFAULT_STRATEGY = "LightGBM"

# The same columns by the names that models and backtests use, so a strategy of either spelling is understood.
STRATEGY_TO_PRED_COL |= {
    "random_forest": "pred_randomforest",
    "xgboost": "pred_xgboost",
    "lightgbm": "pred_lightgbm",
    "stacking": "pred_two_stage_stacking",
}

# --- fixed values: model defaults -----------------------------------------------------------
MODEL_DEFAULTS = {
    "random_forest": {"n_estimators": 100, "max_depth": 10, "random_state": 42},
    "ridge": {"alpha": 1.0, "random_state": 42},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "random_state": 42},
    "lightgbm": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "random_state": 42},
}
# --- fixed values: search grids and bounds --------------------------------------------------
RIDGE_GRID_RANGE = (-3.0, 3.0, 10)          # log10 start, log10 stop, count
DEFAULT_GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15], "min_samples_leaf": [1, 2, 4]},
    "xgboost": {"n_estimators": [50, 100], "max_depth": [3, 6], "learning_rate": [0.01, 0.1]},
    "lightgbm": {"n_estimators": [50, 100], "max_depth": [3, 6], "learning_rate": [0.01, 0.1]},
}
SEARCH_BOUNDS = {
    "random_forest": {"n_estimators": (50, 300), "max_depth": (3, 15), "min_samples_split": (2, 20), "min_samples_leaf": (1, 10)},
    "xgboost": {"learning_rate": (0.01, 0.3), "max_depth": (3, 10), "n_estimators": (50, 300),
                "subsample": (0.6, 1.0), "colsample_bytree": (0.6, 1.0), "reg_alpha": (0, 1), "reg_lambda": (0, 1)},
    "lightgbm": {"learning_rate": (0.01, 0.3), "max_depth": (3, 10), "n_estimators": (50, 300), "num_leaves": (20, 100),
                 "subsample": (0.6, 1.0), "colsample_bytree": (0.6, 1.0), "reg_alpha": (0, 1), "reg_lambda": (0, 1)},
}
META_RIDGE_ALPHAS_RANGE = (-3.0, 3.0, 20)   # log10 start, log10 stop, count
SMAPE_SCALE = 100.0
BLEND_EPS = 1e-6
CLEAN_LOW, CLEAN_HIGH = 0.0, 10000.0
TRAIN_DAYS = 60
MIN_TRAIN_ROWS = 24
N_FOLDS = 3
TRAIN_RATIO = 0.8
HIST_BINS = 50

# Columns of the evaluation table and the wide predictions table.
EVAL_SCHEMA = "date DATE, strategy STRING, rmse DOUBLE, mape DOUBLE, r2 DOUBLE, eval_type STRING"
PRED_COLUMNS = ("pred_randomforest", "pred_xgboost", "pred_lightgbm", "pred_two_stage_stacking")


def stat_feature_names(target: str, key_hours=KEY_HOURS) -> list[str]:
    names = [f"{target}_{s}" for s in STAT_SUFFIXES]
    names += [f"{target}_hour{h}_30d_mean" for h in key_hours]
    return names


def all_feature_names(base=BASE_FEATURES, target: str = "price_day_ahead_avg") -> list[str]:
    """The 68-name feature contract: base + holiday + statistical + key-hour features."""
    return list(base) + list(HOLIDAY_FEATURES) + stat_feature_names(target)


def raw_features(base=BASE_FEATURES) -> list[str]:
    return [f for f in base if f not in set(TIME_FEATURES)]
