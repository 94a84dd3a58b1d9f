"""Panels derived from the driver's tables (FIXTURES.md §C).

Targets are built in integer cents so that every engine sums them exactly:
``cents = floor(100*x + 0.5)`` per input row, ``y_cents`` per panel row, and
``y = y_cents / 100``.  Window statistics computed on ``y_cents`` are exact
sums divided once, which is what lets the SQL oracle match bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import hour_start
from ..functions.exprs import ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c) -> F.Column:
    return F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.col("y_cents") / F.lit(100.0))


def panel_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (series_key=event_type, hour) with mean value (2 dp), counts and mean ``$.k``."""
    ev = table(spark, sf_dir, "events")
    g = (ev.select(F.col("event_type").alias("series_key"), hour_start(F.col("ts")).alias("date_hour"),
                   cents(F.col("value")).alias("c"), "user_id",
                   F.get_json_object("props", "$.k").try_cast("double").alias("k"))
         .groupBy("series_key", "date_hour")
         .agg(F.floor(ratio(F.sum("c"), F.count("c")) + F.lit(0.5)).cast("bigint").alias("y_cents"),
              F.count(F.lit(1)).alias("n_events"),
              F.count_distinct("user_id").alias("n_users"),
              ratio(F.sum("k"), F.count("k")).alias("k_avg")))
    return _finish(g)


def _shift_28y(ts):
    # 28 years keeps the weekday and leap years (1901-2099); moves 1995-2001 onto the 2024-2026 calendar.
    return F.add_months(F.to_date(ts), 336).cast("timestamp_ntz")


def panel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> (series_key=o_orderpriority, day + 28 years) with mean total price."""
    o = table(spark, sf_dir, "orders")
    g = (o.select(F.col("o_orderpriority").alias("series_key"), _shift_28y(F.col("o_orderdate")).alias("date_hour"),
                  cents(F.col("o_totalprice")).alias("c"))
         .groupBy("series_key", "date_hour")
         .agg(F.floor(ratio(F.sum("c"), F.count("c")) + F.lit(0.5)).cast("bigint").alias("y_cents"),
              F.count(F.lit(1)).alias("n_orders")))
    return _finish(g)


def panel_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> (series_key=supplier, ship day + 28 years) with daily gross in cents.

    The number of series grows with the data (suppliers scale with the scale
    factor), so this is the panel used to measure scale-out.
    """
    li = table(spark, sf_dir, "lineitem")
    g = (li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("series_key"),
                   _shift_28y(F.col("l_shipdate")).alias("date_hour"),
                   cents(F.col("l_extendedprice")).alias("c"), "l_quantity",
                   cents(F.col("l_discount")).alias("d"))
         .groupBy("series_key", "date_hour")
         .agg(F.sum("c").alias("y_cents"),
              F.count(F.lit(1)).alias("n_lines"),
              F.sum("l_quantity").alias("qty"),
              ratio(F.sum("d"), F.count("d")).alias("disc_avg")))
    return _finish(g)


def _naive_cents(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_key").orderBy("date_hour")
    roll = w.rowsBetween(-743, -24)
    return panel.select(
        "series_key", "date_hour", "y",
        F.lag("y_cents", 48).over(w).alias("naive_2d"),
        F.lag("y_cents", 168).over(w).alias("naive_7d"),
        F.floor(ratio(F.sum("y_cents").over(roll), F.count("y_cents").over(roll)) + F.lit(0.5))
        .cast("bigint").alias("roll_30d"))


FX_STRATEGIES = ("naive_2d", "naive_7d", "roll_30d")
FX_ONLINE_FROM = "2024-01-20"


def predictions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in strategies on the hourly panel, long form ``(series_key, date_hour, strategy, pred)``.

    ``naive_2d`` = value 48 rows back, ``naive_7d`` = 168 rows back,
    ``roll_30d`` = the rolling 720-row mean shifted by 24, rounded to cents.
    """
    wide = _naive_cents(panel_hourly(spark, sf_dir))
    long = wide.unpivot(["series_key", "date_hour"], list(FX_STRATEGIES), "strategy", "pred_cents")
    return long.select("series_key", "date_hour", "strategy", (F.col("pred_cents") / F.lit(100.0)).alias("pred"))


def predictions_fx_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _naive_cents(panel_hourly(spark, sf_dir))
    return wide.select("series_key", "date_hour", *[(F.col(s) / F.lit(100.0)).alias(s) for s in FX_STRATEGIES])


def evaluations_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics of ``predictions_fx`` as evaluation rows; days from 2024-01-20 are 'online'."""
    from ..operators.metrics import daily_metrics, join_actuals
    p = join_actuals(predictions_fx(spark, sf_dir), panel_hourly(spark, sf_dir))
    m = daily_metrics(p, ["series_key", "strategy"])
    return m.select("series_key", "date", "strategy", "rmse", "mape", "r2",
                    F.when(F.col("date") >= F.lit(FX_ONLINE_FROM).cast("date"), "online")
                    .otherwise("backtest").alias("eval_type"))


PANELS = {"hourly": panel_hourly, "daily": panel_daily, "supply": panel_supply}
