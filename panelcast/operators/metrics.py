"""Evaluation metrics and report aggregates.

Metrics are plain aggregates grouped by whatever identifies an evaluation
unit (series, day, strategy, split...).  R² takes its total sum of squares
from ``var_pop`` — Spark merges its partial moments with a stable parallel
formula — so one partially-aggregated pass serves all three metrics, with no
window over a group and without the cancellation of ``Σa² − n·mean²``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_STRATEGY, HIST_BINS, SMAPE_SCALE
from ..functions.exprs import join_null_safe, smape_term


def metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """RMSE, sMAPE (x100, stored as ``mape``) and R² per group over rows where both sides are non-NULL.

    Groups without a valid row are absent.  R² follows scikit-learn: NULL
    for fewer than 2 rows; when the actuals are constant, 1 if the fit is
    exact else 0.
    """
    by = list(by)
    a, p = F.col(actual), F.col(pred)
    d = df.where(a.isNotNull() & p.isNotNull())
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((a - p) * (a - p)).alias("_sse"),
        F.var_pop(a).alias("_vp"),
        F.avg(smape_term(a, p)).alias("_sm"),
    ).withColumn("_sst", F.col("_vp") * F.col("n"))
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("_sse") / F.col("_sst")))
    return g.select(*by, "n",
                    F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
                    (F.lit(SMAPE_SCALE) * F.col("_sm")).alias("mape"),
                    r2.alias("r2"))


def daily_metrics(df: DataFrame, by: Sequence[str] = ("series_key", "strategy"), actual: str = "actual",
                  pred: str = "pred", time: str = "date_hour") -> DataFrame:
    """Metrics per day (A5/E5): one row per (by..., date)."""
    return metrics(df.withColumn("date", F.to_date(time)), [*by, "date"], actual, pred)


def join_actuals(preds: DataFrame, actuals: DataFrame, key: str = "series_key", time: str = "date_hour",
                 target: str = "y") -> DataFrame:
    """Predictions ⋈ actuals on (series, time) (J1); the actual column is named ``actual``."""
    act = actuals.select(key, time, F.col(target).alias("actual"))
    return join_null_safe(preds, act, [key, time])


def unevaluated(preds: DataFrame, evaluations: DataFrame, eval_type: str = "online",
                key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """Prediction rows whose day has no evaluation of ``eval_type`` yet (J2, anti-join)."""
    done = evaluations.where(F.col("eval_type") == eval_type).select(key, F.col("date").alias("_d")).distinct()
    return join_null_safe(preds.withColumn("_d", F.to_date(time)), done, [key, "_d"], "left_anti").drop("_d")


def evaluate_online(preds: DataFrame, actuals: DataFrame, evaluations: DataFrame, pred_col: str = "pred",
                    strategy: str = "TwoStage_Stacking", key: str = "series_key", time: str = "date_hour",
                    target: str = "y") -> DataFrame:
    """Incremental online evaluation (E6): new days only, metrics per day, ready to append."""
    p = unevaluated(preds.select(key, time, F.col(pred_col).alias("pred")), evaluations, "online", key, time)
    m = daily_metrics(join_actuals(p, actuals, key, time, target), [key], time=time)
    return m.select(key, "date", F.lit(strategy).alias("strategy"), "rmse", "mape", "r2",
                    F.lit("online").alias("eval_type"))


def evaluate_columns(wide: DataFrame, actuals: DataFrame, columns: Sequence[str], start=None, end=None,
                     key: str = "series_key", time: str = "date_hour", target: str = "y") -> DataFrame:
    """Per prediction column metrics over ``[start, end)`` (A6): one unpivot, one aggregate."""
    w = wide
    if start is not None:
        w = w.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        w = w.where(F.col(time) < F.lit(end).cast("timestamp_ntz"))
    long = w.unpivot([key, time], list(columns), "column", "pred")
    return metrics(join_actuals(long, actuals, key, time, target), [key, "column"])


def leaderboard(ev: DataFrame) -> DataFrame:
    """``AVG(rmse), AVG(mape), AVG(r2), COUNT(*)`` by strategy and eval_type (A3)."""
    return (ev.groupBy("strategy", "eval_type")
            .agg(F.avg("rmse").alias("avg_rmse"), F.avg("mape").alias("avg_mape"), F.avg("r2").alias("avg_r2"),
                 F.count(F.lit(1)).alias("n_days"))
            .orderBy(F.col("eval_type").asc_nulls_last(), F.col("avg_rmse").asc_nulls_last()))


def best_strategy(ev: DataFrame, metric: str = "rmse", eval_type: str = "backtest", by: Sequence[str] = (),
                  default: str = DEFAULT_STRATEGY) -> DataFrame:
    """Strategy with the lowest mean ``metric`` (A4), per ``by`` group; NULL means last, ties by name.

    Without ``by`` the result is one row, holding ``default`` when there is
    no evaluation of that type.
    """
    by = list(by)
    g = (ev.where(F.col("eval_type") == eval_type).groupBy(*by, "strategy")
         .agg(F.avg(metric).alias("avg_metric")).withColumn("_p", F.lit(0)))
    if not by:
        # The default competes as a last-priority candidate, so an empty table still yields it.
        g = g.unionByName(ev.sparkSession.range(1).select(
            F.lit(default).alias("strategy"), F.lit(None).cast("double").alias("avg_metric"), F.lit(1).alias("_p")))
    order = F.struct(F.col("_p"), F.col("avg_metric").isNull(), F.col("avg_metric"), F.col("strategy"))
    best = g.groupBy(*by).agg(F.min_by(F.struct("strategy", "avg_metric"), order).alias("_b"))
    return best.select(*by, F.col("_b.strategy").alias("strategy"), F.col("_b.avg_metric").alias("avg_metric"))


def profile(df: DataFrame, key: str = "series_key", time: str = "date_hour", target: str = "y") -> DataFrame:
    """Row count, time range and mean target per series (A2)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_ts"),
                               F.max(time).alias("last_ts"), F.avg(target).alias("mean_y"))


def daily_summary(df: DataFrame, value: str = "pred", key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """Daily mean / min / max of a value (A1)."""
    return (df.groupBy(key, F.to_date(time).alias("day"))
            .agg(F.avg(value).alias("mean_v"), F.min(value).alias("min_v"), F.max(value).alias("max_v")))


def histogram(df: DataFrame, value: str, bins: int = HIST_BINS, key: str = "series_key") -> DataFrame:
    """Equal-width histogram per series (A9): bucket 1..bins, the maximum falls in the last bucket.

    Bounds come from a per-series aggregate joined back on the key (a hot
    series is split by AQE's skew-join handling); the count is an ordinary
    partial aggregate.
    """
    v = F.col(value)
    d = df.where(v.isNotNull())
    bounds = d.groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    d = join_null_safe(d, bounds, [key])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))) + 1))
    d = d.withColumns({"bucket": b.cast("int"), "_w": width})
    return (d.groupBy(key, "bucket", "_lo", "_w").agg(F.count(F.lit(1)).alias("n"))
            .select(key, "bucket", (F.col("_lo") + (F.col("bucket") - 1) * F.col("_w")).alias("lo_edge"),
                    (F.col("_lo") + F.col("bucket") * F.col("_w")).alias("hi_edge"), "n"))


def feature_availability(df: DataFrame, features: Sequence[str], key: str = "series_key",
                         time: str = "date_hour") -> DataFrame:
    """Per series and day, whether each feature has at least one non-NULL value (A10)."""
    aggs = [(F.max(F.col(f).isNotNull()) if f in df.columns else F.lit(False)).alias(f) for f in features]
    return df.groupBy(key, F.to_date(time).alias("date")).agg(*aggs)


def eval_rows(m: DataFrame, strategy_col: str = "strategy", eval_type: str = "backtest") -> DataFrame:
    """Shape a metrics frame as evaluation-table rows (A5 schema + series_key)."""
    return m.select("series_key", "date", F.col(strategy_col).alias("strategy"), "rmse", "mape", "r2",
                    F.lit(eval_type).alias("eval_type"))


__all__ = ["metrics", "daily_metrics", "join_actuals", "unevaluated", "evaluate_online", "evaluate_columns",
           "leaderboard", "best_strategy", "profile", "daily_summary", "histogram", "feature_availability",
           "eval_rows"]
