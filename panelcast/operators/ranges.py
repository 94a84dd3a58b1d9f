"""Range joins as equi-joins on buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe

DAY = 24 * 3600


def _micros(c: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz"))


def lookback_join(left: DataFrame, right: DataFrame, at: str, of: str, low: int, high: int, keys: Sequence[str]) -> DataFrame:
    """Pairs of rows with equal ``keys`` (null meets null) where ``of`` lies in ``[at - high, at - low)``; the bounds are seconds.

    Time is cut into buckets as long as the interval.  A right row lies in one bucket, the interval of a left row in two at
    most, so this is an equi-join on the keys and the bucket (which Spark can split where a key is hot), every pair comes
    once, and a residual predicate trims the ends.  Rows without a time or date join nothing.  ``right`` may share no column
    name with ``left`` but the keys.
    """
    width = (high - low) * 1_000_000
    if width <= 0:
        raise ValueError("the interval has to end after it begins")
    first, last = _micros(F.col(at)) - F.lit(high * 1_000_000), _micros(F.col(at)) - F.lit(low * 1_000_000 + 1)
    bucket = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    l = left.withColumns({"_first": first, "_last": last}).where(F.col(at).isNotNull())
    l = l.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_first")), bucket(F.col("_last")))))
    r = right.withColumn("_at", _micros(F.col(of))).where(F.col(of).isNotNull())
    r = r.withColumn("_bucket", bucket(F.col("_at")))
    out = join_null_safe(l, r, [*keys, "_bucket"])
    return out.where(F.col("_at").between(F.col("_first"), F.col("_last"))).drop("_first", "_last", "_bucket", "_at")


def lookback_range(future: DataFrame, history: DataFrame, target: str = "y", low_days: int = 1, high_days: int = 31,
                   key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """``(key, time, n, total, least, most)`` of the history in ``[t - high_days, t - low_days)`` for each future row.

    Rows without history in the interval come with n = 0; history without a target does not count.
    """
    h = history.where(F.col(target).isNotNull()).select(key, F.col(time).alias("_u"), F.col(target).alias("_y"))
    keys = future.select(key, time).distinct()
    found = lookback_join(keys, h, time, "_u", low_days * DAY, high_days * DAY, [key]).groupBy(key, time).agg(
        F.count("_y").alias("n"), F.sum("_y").alias("total"), F.min("_y").alias("least"), F.max("_y").alias("most"))
    return join_null_safe(keys, found, [key, time], "left").withColumn("n", F.coalesce("n", F.lit(0)))
