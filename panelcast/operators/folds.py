"""Time ordering, splits and folds.

``series_row_number`` gives every row its 1-based position within its
series without a window over a whole series: rows are counted per
``(series, day)``, a running sum over that small day table gives each day's
offset, and only the rows of one day are ranked together.  A single huge
series therefore still spreads over many tasks.  Joins on the series key are
null-safe: a NULL key is a series of its own.  Rows without a time come last in
their series; they belong to no day, so rolling origins do not use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_TRAIN_ROWS, N_FOLDS, TRAIN_DAYS, TRAIN_RATIO
from ..functions.exprs import join_null_safe


def series_row_number(df: DataFrame, key="series_key", time: str = "date_hour",
                      rn: str = "_rn", n: str = "_n") -> DataFrame:
    """Add the 1-based time rank ``rn`` and the group size ``n`` (time unique per group).

    ``key`` is a column name or a list of them (e.g. series and origin).
    """
    keys = [key] if isinstance(key, str) else list(key)
    d = df.withColumn("_day", F.to_date(time))
    days = d.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_cnt"))
    wd = Window.partitionBy(*keys).orderBy(F.col("_day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_cnt").over(wd), F.lit(0)).alias("_off"),
                       F.sum("_cnt").over(Window.partitionBy(*keys)).alias(n))
    local = Window.partitionBy(*keys, "_day").orderBy(time)
    out = join_null_safe(d, days, [*keys, "_day"]).withColumn(rn, F.col("_off") + F.row_number().over(local))
    return out.drop("_day", "_off")


def chrono_split(df: DataFrame, ratio: float = TRAIN_RATIO, key="series_key",
                 time: str = "date_hour") -> DataFrame:
    """Label rows ``split = 'train'`` for the first ``floor(n*ratio)`` rows of each series, else ``'test'``.

    ``key`` may be a list (e.g. series and strategy for long predictions).
    """
    d = series_row_number(df, key, time)
    cut = F.floor(F.col("_n") * F.lit(float(ratio)))
    return d.withColumn("split", F.when(F.col("_rn") <= cut, "train").otherwise("test")).drop("_rn", "_n")


def time_folds(df: DataFrame, k: int = N_FOLDS, key: str = "series_key", time: str = "date_hour",
               group_cols=()) -> DataFrame:
    """Expanding-window folds (M8, ``TimeSeriesSplit(k)``).

    ``test_size = n // (k+1)``; fold ``i`` (0-based) validates rows
    ``[n - (k-i)*test_size, +test_size)`` and trains on every earlier row.
    Adds ``fold`` (the fold a row validates, NULL for the never-validated
    head), ``rn`` (1-based position), ``n_rows`` and ``test_size``; the
    training rows of fold ``i`` are ``rn <= n_rows - (k-i)*test_size``.  ``group_cols`` number rows
    per (series, group), e.g. per backtest origin.
    """
    keys = [key, *group_cols]
    d = series_row_number(df, keys, time, rn="rn", n="_n")
    ts = F.floor(F.col("_n") / F.lit(k + 1))
    first_val = F.col("_n") - F.lit(k) * ts          # 0-based index of the first validated row
    idx = F.col("rn") - 1
    fold = F.when((ts > 0) & (idx >= first_val), F.floor((idx - first_val) / ts))
    return d.withColumns({"fold": fold.cast("int"), "test_size": ts.cast("int")}).withColumnRenamed("_n", "n_rows")


def fold_train_rows(i: int, k: int = N_FOLDS) -> F.Column:
    """Predicate for the training rows of fold ``i`` on a ``time_folds`` frame (expanding window)."""
    return (F.col("rn") <= F.col("n_rows") - F.lit(k - i) * F.col("test_size")) & (F.col("test_size") > 0)


def eval_day_spine(spark, start, end) -> DataFrame:
    """One row per day in ``[start, end)``."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)),
                                                      F.date_sub(F.to_date(F.lit(end)), 1))).alias("origin"))


def eligible_origins(df: DataFrame, start, end, train_days: int = TRAIN_DAYS, min_train_rows: int = MIN_TRAIN_ROWS,
                     key: str = "series_key", time: str = "date_hour", target: str = "y") -> DataFrame:
    """``(key, origin)``: the days of ``[start, end)`` with rows to test and at least ``min_train_rows`` rows with a
    target in the ``train_days`` before.  Counted per day first, then summed over the days of the window."""
    s, e = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    t = F.col(time)
    d = df.where((t >= F.date_sub(s, train_days).cast("timestamp_ntz")) & (t < e.cast("timestamp_ntz")))
    days = d.groupBy(key, F.to_date(time).alias("origin")).agg(F.count(target).alias("_valid"))
    days = days.withColumn("_no", F.datediff("origin", s))
    before = Window.partitionBy(key).orderBy("_no").rangeBetween(-train_days, -1)
    return days.withColumn("_ntr", F.sum("_valid").over(before)).where(
        (F.col("origin") >= s) & (F.col("_ntr") >= min_train_rows)).select(key, "origin")


def rolling_origins(df: DataFrame, start, end, train_days: int = TRAIN_DAYS,
                    min_train_rows: int = MIN_TRAIN_ROWS, key: str = "series_key", time: str = "date_hour",
                    target: str = "y") -> DataFrame:
    """Rolling-origin folds (J3): every eval day D in ``[start, end)`` gets the rows of
    ``[D - train_days, D)`` as ``role='train'`` and the rows of day D as ``role='test'``.

    Written as an explode instead of a theta join: each row is emitted to the
    origins it can serve (its own day for testing, the next ``train_days``
    days for training) — a fixed fan-out of ``train_days + 1`` — and a range
    predicate keeps the origins inside ``[start, end)``.  The input is
    pre-filtered to ``[start - train_days, end)`` so rows that serve no origin
    are never read.  Origins are kept only when they have test rows and at
    least ``min_train_rows`` training rows with a target (``eligible_origins``).
    Only per-series fits need these copies; naive strategies and pooled fits
    work on ``origin_test_rows`` and time slices.
    """
    s = F.to_date(F.lit(start))
    e = F.to_date(F.lit(end))
    t = F.col(time)
    d = df.where((t >= F.date_sub(s, train_days).cast("timestamp_ntz")) & (t < e.cast("timestamp_ntz")))
    d = d.withColumn("_day", F.to_date(time))
    offs = F.explode(F.sequence(F.lit(0), F.lit(train_days))).alias("_k")
    ex = d.select("*", offs).withColumns({
        "origin": F.date_add("_day", F.col("_k")),
        "role": F.when(F.col("_k") == 0, "test").otherwise("train")})
    ex = ex.where((F.col("origin") >= s) & (F.col("origin") < e))
    ok = eligible_origins(df, start, end, train_days, min_train_rows, key, time, target)
    return join_null_safe(ex, ok, [key, "origin"], "left_semi").drop("_day", "_k")


def origin_test_rows(df: DataFrame, origins: DataFrame, key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """The rows of each eligible origin's own day, with ``origin``; every row comes once."""
    return join_null_safe(df.withColumn("origin", F.to_date(time)), origins, [key, "origin"], "left_semi")
