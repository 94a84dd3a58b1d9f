"""Rolling-origin backtest and forecast publishing (M5, M6, E5).

``operators.folds.eligible_origins`` finds the days that can be tested from
per-day row counts.  Strategies then run as:

* ``naive_*`` / ``roll_*`` — a feature column read on the test rows (no fit, no training rows);
* ``ridge`` — one closed-form ridge per ``(series, origin)`` from daily Gram sums
  (``plans.ridge``; every row is summed up once);
* ``random_forest`` / ``xgboost`` / ``lightgbm`` / ``stacking`` — histogram trees over
  all series of an origin's window; the fits of all origins, kinds and folds are one plan (``plans.forests``).

Ridge is fitted per series and the pooled strategies over all of them without a series feature, so their errors
compare the two ways of training as much as the models.

Predictions are long ``(series_key, origin, date_hour, strategy, pred)``;
metrics group by ``(series, origin, strategy)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_TRAIN_ROWS, N_FOLDS, STRATEGY_TO_PRED_COL, TRAIN_DAYS
from ..functions.exprs import join_null_safe
from ..operators.clean import chosen_column
from ..operators.folds import eligible_origins, origin_test_rows, rolling_origins
from ..operators.metrics import metrics
from ..session import cut_lineage
from .forests import FULL, TREE_KINDS, binned, fit_predict, tree_spec
from .ridge import rolling_ridge
from .stacking import BASE_KINDS, stack, with_folds

NAIVE_COLUMNS = {"naive_2d": "same_hour_2d_ago", "naive_7d": "same_hour_7d_ago", "roll_30d": "same_hour_30d_mean"}
POOLED = ("random_forest", "xgboost", "lightgbm", "stacking")


def backtest_predictions(features: DataFrame, start, end, strategies: Sequence[str], feature_cols: Sequence[str],
                         target: str = "y", prefix: str | None = None, key: str = "series_key",
                         time: str = "date_hour", train_days: int = TRAIN_DAYS,
                         min_train_rows: int = MIN_TRAIN_ROWS, model_params: Mapping | None = None) -> DataFrame:
    """Long test-day predictions ``(key, origin, time, strategy, pred, actual)`` for every strategy."""
    p = prefix or target
    origins = cut_lineage(eligible_origins(features, start, end, train_days, min_train_rows, key, time, target))
    test = origin_test_rows(features, origins, key, time)
    alpha = float((model_params or {}).get("ridge", {}).get("alpha", 1.0))
    unknown = set(strategies) - {*NAIVE_COLUMNS, *POOLED, "ridge"}
    if unknown:
        raise ValueError(f"unknown strategy {sorted(unknown)}")
    parts = []
    for s in strategies:
        if s in NAIVE_COLUMNS:
            parts.append(test.select(key, "origin", time, F.lit(s).alias("strategy"),
                                     F.col(f"{p}_{NAIVE_COLUMNS[s]}").cast("double").alias("pred")))
        elif s == "ridge":
            r = rolling_ridge(features.select(*_columns(key, time, target, feature_cols)), start, end, feature_cols, target, [alpha],
                              train_days, min_train_rows, key, time)
            parts.append(r.select(key, "origin", time, F.lit(s).alias("strategy"), "pred"))
    if pooled := [s for s in strategies if s in POOLED]:
        parts.append(_pooled(features, start, end, pooled, feature_cols, target, key, time, train_days, min_train_rows, model_params))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    act = test.select(key, "origin", time, F.col(target).alias("actual"))
    return join_null_safe(out, act, [key, "origin", time])


def _columns(key, time, target, feature_cols) -> list[str]:
    return list(dict.fromkeys([key, time, target, *feature_cols]))


def _pooled(rows: DataFrame, start, end, kinds: Sequence[str], feature_cols, target, key, time, train_days, min_train_rows,
            model_params) -> DataFrame:
    """``(key, origin, time, strategy, pred)`` of pooled strategies for every origin, fitted together (``plans.forests``).

    A training set is an origin's window over all series that can be tested that day.  ``rows`` may have ``_f`` (true: a
    future row, for testing only; the others then only train).
    """
    feature_cols = list(feature_cols)
    future = ["_f"] if "_f" in rows.columns else []
    packed = cut_lineage(binned(rows.select(*_columns(key, time, target, feature_cols), *future), feature_cols, [key, time], target))
    folds = rolling_origins(packed, start, end, train_days, min_train_rows, key, time, target)
    train, test = folds.where("role = 'train'").where(F.col(target).isNotNull()), folds.where("role = 'test'")
    if future:
        train, test = train.where("not _f"), test.where("_f")
    bases = [s for s in kinds if s != "stacking"]
    stacked = "stacking" in kinds
    variants = {s: [FULL] * (s in bases) + list(range(N_FOLDS)) * stacked for s in TREE_KINDS if s in bases or stacked}
    specs = {s: tree_spec(s, (model_params or {}).get(s)) for s in variants}
    preds = cut_lineage(fit_predict(with_folds(train, test, N_FOLDS, key, time, ["origin"]), specs, len(feature_cols), ["origin"],
                                    [key, time], target, variants))
    cols = [key, "origin", time, "strategy", "pred"]
    out = preds.where((F.col("variant") == FULL) & F.col("model").isin(bases)).withColumn("strategy", F.col("model")).select(*cols)
    if stacked:
        actual = train.select("origin", key, time, F.col(target).cast("double").alias("_y"))
        top = stack(preds.where(F.col("variant") != FULL), actual, BASE_KINDS, ["origin"], key, time)
        out = out.unionByName(top.withColumn("strategy", F.lit("stacking")).select(*cols))
    return out


def backtest(features: DataFrame, start, end, strategies: Sequence[str], feature_cols: Sequence[str],
             target: str = "y", **kw) -> DataFrame:
    """Evaluation rows ``(series_key, date, strategy, rmse, mape, r2, eval_type='backtest')`` (M5)."""
    key = kw.get("key", "series_key")
    preds = backtest_predictions(features, start, end, strategies, feature_cols, target, **kw)
    m = metrics(preds, [key, "origin", "strategy"])
    return m.select(key, F.col("origin").alias("date"), "strategy", "rmse", "mape", "r2",
                    F.lit("backtest").alias("eval_type"))


def forecast(history_features: DataFrame, future_features: DataFrame, strategies: Sequence[str],
             feature_cols: Sequence[str], target: str = "y", key: str = "series_key", time: str = "date_hour",
             train_days: int = TRAIN_DAYS, min_train_rows: int = MIN_TRAIN_ROWS,
             model_params: Mapping | None = None, best: DataFrame | None = None,
             default_strategy: str | None = None) -> DataFrame:
    """Forecast every future day from the ``train_days`` of history before it (M6).

    Future rows are stacked under the history with ``role='test'`` and the
    same origin fan-out as the backtest builds each day's training window
    (future days past the first see only history, never predictions).  The
    result is wide: one column per strategy (published names where there are any, else ``pred_<strategy>``),
    ``pred_best`` (per series from ``best``; a strategy that was not run is an error) and ``created_at``.
    """
    used = [f"{target}_{NAIVE_COLUMNS[s]}" for s in strategies if s in NAIVE_COLUMNS]
    cols = _columns(key, time, target, [*feature_cols, *used])
    hist = history_features.where(F.col(target).isNotNull())
    fut = future_features.withColumn(target, F.lit(None).cast("double"))
    both = hist.select(*cols).withColumn("_f", F.lit(False)).unionByName(
        fut.select(*cols).withColumn("_f", F.lit(True)))
    lo, hi = fut.agg(F.min(time), F.max(time)).first()
    import datetime as _dt
    start, end = lo.date(), hi.date() + _dt.timedelta(days=1)
    origins = cut_lineage(eligible_origins(both, start, end, train_days, min_train_rows, key, time, target))
    test = origin_test_rows(both.where("_f"), origins, key, time)
    alpha = float((model_params or {}).get("ridge", {}).get("alpha", 1.0))
    unknown = set(strategies) - {*NAIVE_COLUMNS, *POOLED, "ridge"}
    if unknown:
        raise ValueError(f"unknown strategy {sorted(unknown)}")
    parts = []
    for s in strategies:
        if s in NAIVE_COLUMNS:
            parts.append(test.select(key, time, F.lit(s).alias("strategy"),
                                     F.col(f"{target}_{NAIVE_COLUMNS[s]}").alias("pred")))
        elif s == "ridge":
            r = rolling_ridge(both, start, end, feature_cols, target, [alpha], train_days, min_train_rows, key, time, F.col("_f"))
            parts.append(r.select(key, time, F.lit(s).alias("strategy"), "pred"))
    if pooled := [s for s in strategies if s in POOLED]:
        parts.append(_pooled(both, start, end, pooled, feature_cols, target, key, time, train_days, min_train_rows, model_params)
                     .select(key, time, "strategy", "pred"))
    long = parts[0]
    for x in parts[1:]:
        long = long.unionByName(x)
    wide = long.groupBy(key, time).pivot("strategy", list(strategies)).agg(F.first("pred"))
    names = {s: STRATEGY_TO_PRED_COL.get(s, f"pred_{s}") for s in strategies}
    wide = wide.withColumnsRenamed(names)
    if best is not None:
        wide = join_null_safe(wide, best.select(key, F.col("strategy").alias("_b")), [key], "left")
    else:
        wide = wide.withColumn("_b", F.lit(None).cast("string"))
    wide = wide.withColumn("_b", F.coalesce("_b", F.lit(default_strategy or strategies[0])))
    expr = chosen_column("_b", {s: c for s, c in {**STRATEGY_TO_PRED_COL, **names}.items() if c in wide.columns})
    return wide.withColumn("pred_best", expr).drop("_b").withColumn("created_at", F.current_timestamp())
