"""The batch job: tune, backtest, forecast, online evaluation, evaluation by column, report.

Stages meet as tables of one run (``sources.versions.staged_run``): a stopped job goes on after its last finished stage, and
the tables of the run before stay published until the new run is complete.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_TRAIN_ROWS, STRATEGY_TO_PRED_COL, TRAIN_DAYS
from ..operators import metrics as M
from ..sources.versions import staged_run
from .backtest import backtest, forecast
from .tuning import chosen_params, tune_once

EVAL_COLUMNS = ("series_key", "date", "strategy", "rmse", "mape", "r2", "eval_type")


def check_windows(tuning, testing) -> None:
    """Days that chose the parameters may not judge them: overlapping windows are an error."""
    (a, b), (c, d) = ([dt.date.fromisoformat(str(x)[:10]) for x in w] for w in (tuning, testing))
    if not (a < b and c < d):
        raise ValueError("a window has to end after it begins")
    if a < d and c < b:
        raise ValueError(f"the tuning window {a} to {b} overlaps the backtest window {c} to {d}")


def batch_job(history: DataFrame, future: DataFrame, actuals: DataFrame, features: Sequence[str], root: str, run: str, *,
              tuning, testing, strategies: Sequence[str] = ("random_forest", "xgboost", "lightgbm", "stacking"), target: str = "y",
              tune: Mapping | None = None, train_days: int = TRAIN_DAYS, min_train_rows: int = MIN_TRAIN_ROWS) -> dict[str, DataFrame]:
    """All stages, written under ``root``; returns tuned, backtest, predictions, online, columns and report.

    ``history`` and ``future`` have the features; ``tuning`` and ``testing`` are windows (start, end) that may not overlap.
    ``actuals`` (key, time, target) score the predictions of the days they cover.  ``tune`` are options of ``tune_once``.
    """
    check_windows(tuning, testing)
    window = {"train_days": train_days, "min_train_rows": min_train_rows}
    own = {s: STRATEGY_TO_PRED_COL.get(s, f"pred_{s}") for s in strategies}

    def plan_of(done):
        tuned = done["tuned"]
        chosen = [r["name"] for r in tuned.where("item = 'feature' and chosen").orderBy(F.col("value").desc(), "name").collect()]
        return chosen or list(features), chosen_params(tuned)

    def backtested(done):
        columns, params = plan_of(done)
        return backtest(history, *testing, strategies, columns, target, model_params=params, **window).select(*EVAL_COLUMNS)

    def predicted(done):
        columns, params = plan_of(done)
        best = M.best_strategy(done["backtest"], by=["series_key"])
        return forecast(history, future, strategies, columns, target, model_params=params, best=best,
                        default_strategy=strategies[0], **window)

    def judged_online(done):
        nothing = done["backtest"].limit(0)
        return M.evaluate_online(done["predictions"], actuals, nothing, "pred_best", "pred_best", target=target).select(*EVAL_COLUMNS)

    def by_column(done):
        return M.evaluate_columns(done["predictions"], actuals, list(own.values()), target=target)

    def report(done):
        return M.leaderboard(done["backtest"].unionByName(done["online"]))

    spark = history.sparkSession
    return staged_run(spark, root, run, [
        ("tuned", lambda done: tune_once(history, *tuning, features, target, **(tune or {}))), ("backtest", backtested),
        ("predictions", predicted), ("online", judged_online), ("columns", by_column), ("report", report)])


