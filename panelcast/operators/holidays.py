"""Holiday features.

The holiday calendar is a small dimension table ``(date, name, is_major)``.
Instead of joining every panel date against every holiday, each holiday is
exploded over ``[-cap, +cap]`` days once; an aggregate per date gives the
flags and the nearest-holiday distance.  That table has at most
``n_holidays * (2*cap+1)`` rows before the aggregate and one row per
calendar day after it — a size bound that depends on the calendar only,
never on the panel — so it is broadcast into the panel join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HOLIDAY_DISTANCE_CAP, HOLIDAYS, MAJOR_HOLIDAY_NAMES


def holiday_table(spark: SparkSession, holidays=HOLIDAYS, major_names=MAJOR_HOLIDAY_NAMES) -> DataFrame:
    """The calendar as ``(date DATE, name STRING, is_major BOOLEAN)``."""
    df = spark.createDataFrame(list(holidays), "d string, name string")
    return df.select(F.to_date("d").alias("date"), "name",
                     F.col("name").isin(list(major_names)).alias("is_major"))


def holiday_features_by_date(holidays: DataFrame, cap: int = HOLIDAY_DISTANCE_CAP) -> DataFrame:
    """One row per date within ``cap`` days of a holiday with the five holiday features.

    ``is_pre_holiday``: the next day is a holiday; ``is_post_holiday``: the
    previous day is one.  Flags overlap inside a run of holidays by design.
    """
    ex = holidays.select("date", "is_major", F.explode(F.sequence(F.lit(-cap), F.lit(cap))).alias("k"))
    ex = ex.select(F.date_add("date", F.col("k")).alias("date"), "k", "is_major")
    return (ex.groupBy("date").agg(
        F.max((F.col("k") == 0).cast("int")).alias("is_holiday"),
        F.max((F.col("k") == -1).cast("int")).alias("is_pre_holiday"),
        F.max((F.col("k") == 1).cast("int")).alias("is_post_holiday"),
        F.least(F.lit(cap), F.min(F.abs("k"))).cast("int").alias("days_to_nearest_holiday"),
        F.max(((F.col("k") == 0) & F.col("is_major")).cast("int")).alias("is_major_holiday"),
    ))


_DEFAULT_CACHE: dict = {}


def _default_by_date(spark: SparkSession, cap: int) -> DataFrame:
    """The default calendar's per-date table (about 2.5k rows), built once per session and cached."""
    k = (spark.sparkContext.applicationId, cap)
    if k not in _DEFAULT_CACHE:
        _DEFAULT_CACHE[k] = holiday_features_by_date(holiday_table(spark), cap).cache()
    return _DEFAULT_CACHE[k]


def add_holidays(df: DataFrame, holidays: DataFrame | None = None, time_col: str = "date_hour",
                 cap: int = HOLIDAY_DISTANCE_CAP) -> DataFrame:
    """Add ``is_holiday, is_pre_holiday, is_post_holiday, days_to_nearest_holiday, is_major_holiday``.

    The default calendar is broadcast (its size is fixed); how a caller's table is joined is left to the optimizer.
    """
    if holidays is None:
        by_date = F.broadcast(_default_by_date(df.sparkSession, cap))
    else:
        by_date = holiday_features_by_date(holidays, cap)
    by_date = by_date.withColumnRenamed("date", "_hdate")
    out = df.withColumn("_hdate", F.to_date(F.col(time_col))).join(by_date, "_hdate", "left")
    return out.withColumns({
        "is_holiday": F.coalesce("is_holiday", F.lit(0)),
        "is_pre_holiday": F.coalesce("is_pre_holiday", F.lit(0)),
        "is_post_holiday": F.coalesce("is_post_holiday", F.lit(0)),
        "days_to_nearest_holiday": F.coalesce("days_to_nearest_holiday", F.lit(cap)),
        "is_major_holiday": F.coalesce("is_major_holiday", F.lit(0)),
    }).drop("_hdate")
