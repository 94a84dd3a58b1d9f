"""Calendar column expressions (F1-F8).

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen.  Time columns are ``TIMESTAMP_NTZ`` (wall clock, no zone).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def hour_start(ts: Column) -> Column:
    """Truncate a timestamp to the hour as TIMESTAMP_NTZ, independent of the session zone."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def season_num(month: Column) -> Column:
    """1 = Mar-May, 2 = Jun-Aug, 3 = Sep-Nov, 4 = Dec-Feb."""
    return (F.when(month.between(3, 5), 1).when(month.between(6, 8), 2)
            .when(month.between(9, 11), 3).otherwise(4))


def cyclic(x: Column, period: float, fn=F.sin) -> Column:
    """``fn(2*pi*x/period)``, evaluated in this order for bit parity with numpy."""
    return fn(F.lit(TWO_PI) * x.cast("double") / F.lit(float(period)))


def add_calendar(df: DataFrame, time_col: str = "date_hour") -> DataFrame:
    """Add the 25 calendar features (F1-F6) in one projection."""
    ts = F.col(time_col)
    base = {
        "year": F.year(ts),
        "month": F.month(ts),
        "dayofmonth": F.dayofmonth(ts),
        "dayofyear": F.dayofyear(ts),
        "hour": F.hour(ts),
        "dayofweek": F.weekday(ts),          # Monday = 0
        "week": F.weekofyear(ts),            # ISO week
        "weekofyear": F.weekofyear(ts),
        "quarter": F.quarter(ts),
    }
    base = {k: v.cast("int") for k, v in base.items()}
    base["is_weekend"] = (base["dayofweek"] >= 5).cast("int")
    base["season_num"] = season_num(base["month"]).cast("int")
    df = df.withColumns(base)
    month, hour, dow, week, doy = (F.col(c) for c in ("month", "hour", "dayofweek", "week", "dayofyear"))
    s = F.col("season_num") - 1
    return df.withColumns({
        "season_sin": cyclic(s, 4, F.sin),
        "season_cos": cyclic(s, 4, F.cos),
        "hoursin": cyclic(hour, 24, F.sin),
        "hourcos": cyclic(hour, 24, F.cos),
        "dayofweeksin": cyclic(dow, 7, F.sin),
        "dayofweekcos": cyclic(dow, 7, F.cos),
        "weeksin": cyclic(week, 52, F.sin),
        "weekcos": cyclic(week, 52, F.cos),
        "monthsin": cyclic(month, 12, F.sin),
        "monthcos": cyclic(month, 12, F.cos),
        "dayofyearsin": cyclic(doy, 365.25, F.sin),
        "dayofyearcos": cyclic(doy, 365.25, F.cos),
        "sin_time": cyclic(hour, 24, F.sin),
        "cos_time": cyclic(hour, 24, F.cos),
    })
