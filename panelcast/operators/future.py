"""Features for future timestamps from history.

For a future time ``t`` (whole hours) the lookback is the history in
``[t - 31 days, t - 1 day)``.  Instead of a range join of every future row
against the history (O(future x history)), everything is equi-joins with a
bounded fan-out:

* history is pre-filtered to the only range any future row can see and
  reduced to one row per ``(series, day)`` holding a <=24-entry array of
  hourly ``(sum, count, last position)``;
* each future row emits its 31 candidate days (``t``'s day minus 1..31) and
  joins that day table — the first and last candidate day are cut at
  ``t``'s hour;
* same-hour statistics join the history rows at ``t``'s hour on the 31
  candidate days (at most 31 rows per future row) and aggregate;
* the exact 2- and 7-day lookbacks are same-hour rows on candidate days 2
  and 7 and come out of the same aggregate;
* the "n-th last row" changes use history positions from
  ``series_row_number`` and one equi-join on ``(series, position)``.

Future days beyond the first see a shrinking history, as defined: nothing
is predicted recursively.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FUTURE_GAP_DAYS, FUTURE_LOOKBACK_DAYS, KEY_HOURS
from ..functions.calendar import add_calendar
from ..functions.exprs import join_null_safe, ratio
from ..session import cut_lineage
from .folds import series_row_number
from .holidays import add_holidays
from .ranges import DAY, lookback_join


def future_timeline(df: DataFrame, days: int, key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """``days*24`` hourly stamps per series starting one hour after its last time."""
    last = df.groupBy(key).agg(F.max(time).alias("_mx"))
    seq = F.sequence(F.col("_mx") + F.expr("interval 1 hour"),
                     F.col("_mx") + F.expr(f"interval {int(days) * 24} hours"), F.expr("interval 1 hour"))
    return last.select(key, F.explode(seq).alias(time))


def add_future_stats(future: DataFrame, history: DataFrame, target: str = "y", *, key: str = "series_key",
                     time: str = "date_hour", prefix: str | None = None, key_hours=KEY_HOURS,
                     divisor: float | None = None, lookback_days: int = FUTURE_LOOKBACK_DAYS,
                     gap_days: int = FUTURE_GAP_DAYS) -> DataFrame:
    """Add the 11 statistical features and key-hour means to ``future`` from ``history``.

    ``history`` rows with a NULL target are ignored (both reference paths
    drop or clean them before this step).  ``(series, time)`` is unique in
    both frames.
    """
    p = prefix or target
    sc = (lambda c: c / F.lit(float(divisor))) if divisor else (lambda c: c)
    fut_keys = future.select(key, F.col(time).alias("_t")).distinct()
    bounds = fut_keys.groupBy(key).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    h = (join_null_safe(history.where(F.col(target).isNotNull()).select(key, F.col(time).alias("_u"), F.col(target).alias("_y")),
                        bounds, [key])
         .where((F.col("_u") >= F.col("_lo") - F.expr(f"interval {lookback_days} days")) &
                (F.col("_u") < F.col("_hi") - F.expr(f"interval {gap_days} days")))
         .select(key, "_u", "_y"))
    h = series_row_number(h, key, "_u", rn="_pos", n="_npos").drop("_npos")
    h = h.withColumns({"_day": F.to_date("_u"), "_hr": F.hour("_u")})
    # Both inputs feed four joins each.  They are small by construction (the future rows; the history
    # inside the lookback of some future row), so materialise them once in the checkpoint folder
    # instead of re-deriving them from their sources on every branch.
    fut_keys = cut_lineage(fut_keys)
    h = cut_lineage(h)

    asked = fut_keys.select(key, "_t", F.to_date("_t").alias("_d"), F.hour("_t").alias("_th"))

    # Same-hour rows inside the lookback (J5).  J4: the rows exactly 2 and 7 days back are
    # among them, so the same aggregate picks them up.
    at = lambda days: F.max(F.when(F.col("_u") == F.col("_t") - F.expr(f"interval {days} days"), F.col("_y")))
    sh = (lookback_join(asked, h.select(key, F.col("_hr").alias("_th"), "_u", "_y"), "_t", "_u", gap_days * DAY,
                        lookback_days * DAY, [key, "_th"])
          .groupBy(key, "_t").agg(ratio(F.sum("_y"), F.count("_y")).alias("_shm"),
                                  F.stddev_samp("_y").alias("_shs"), F.min("_y").alias("_shmin"),
                                  F.max("_y").alias("_shmax"), at(2).alias("_e2"), at(7).alias("_e7")))

    # Per (series, day) hourly array, cut at t's hour on the first and last candidate day.
    days = (h.groupBy(key, "_day", "_hr").agg(F.sum("_y").alias("s"), F.count("_y").alias("c"),
                                                F.max("_pos").alias("m"))
            .groupBy(key, "_day").agg(F.collect_list(F.struct(F.col("_hr").alias("hr"), "s", "c", "m")).alias("_a")))
    cj = lookback_join(asked, days, "_d", "_day", (gap_days - 1) * DAY, lookback_days * DAY, [key]).withColumn(
        "_k", F.datediff("_d", "_day"))
    keep = F.filter("_a", lambda x: F.when(F.col("_k") == gap_days, x["hr"] < F.col("_th"))
                    .when(F.col("_k") == lookback_days, x["hr"] >= F.col("_th")).otherwise(F.lit(True)))
    cj = cj.withColumn("_a", keep)
    cj = cj.select(key, "_t", "_k",
                   F.aggregate("_a", F.lit(0).cast("long"), lambda acc, x: acc + x["c"]).alias("_c"),
                   F.aggregate("_a", F.lit(0).cast(h.schema["_y"].dataType), lambda acc, x: acc + x["s"]).alias("_s"),
                   F.array_max(F.transform("_a", lambda x: x["m"])).alias("_m")).where(F.col("_c") > 0)
    dstat = (cj.groupBy(key, "_t")
             .agg(F.sort_array(F.collect_list(F.struct("_k", ratio(F.col("_s"), F.col("_c")).alias("mean")))).alias("_d"),
                  F.sum("_c").alias("_n"), F.max("_m").alias("_idx")))
    nd = F.size("_d")
    last7 = F.slice("_d", 1, 7)
    dstat = dstat.select(
        key, "_t", "_n", "_idx",
        F.when(nd > 1, F.col("_d")[1]["mean"]).alias("_dm2"),
        F.when(nd >= 7, F.col("_d")[6]["mean"]).alias("_dm7"),
        F.when(nd > 1, F.aggregate(last7, F.lit(0.0), lambda acc, x: acc + x["mean"]) / F.size(last7)).alias("_dmr"))

    # Rows at positions idx, idx-1, idx-24 when the lookback holds more than 24 rows.
    need = dstat.where(F.col("_n") > 24).select(
        key, "_t", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("_idx").alias("pos")),
                                     F.struct(F.lit(1).alias("o"), (F.col("_idx") - 1).alias("pos")),
                                     F.struct(F.lit(24).alias("o"), (F.col("_idx") - 24).alias("pos")))).alias("_q"))
    need = need.select(key, "_t", F.col("_q.o").alias("_o"), F.col("_q.pos").alias("_pos"))
    ch = (join_null_safe(need, h.select(key, "_pos", "_y"), [key, "_pos"])
          .groupBy(key, "_t").agg(F.max(F.when(F.col("_o") == 0, F.col("_y"))).alias("_y0"),
                                  F.max(F.when(F.col("_o") == 1, F.col("_y"))).alias("_y1"),
                                  F.max(F.when(F.col("_o") == 24, F.col("_y"))).alias("_y24")))

    out = fut_keys
    for part in (sh, dstat, ch):
        out = join_null_safe(out, part, [key, "_t"], "left")
    hr = F.hour("_t")
    cols = {
        f"{p}_same_hour_2d_ago": sc(F.col("_e2")),
        f"{p}_same_hour_7d_ago": sc(F.col("_e7")),
        f"{p}_same_hour_30d_mean": sc(F.col("_shm")),
        f"{p}_same_hour_30d_std": sc(F.col("_shs")),
        f"{p}_same_hour_30d_min": sc(F.col("_shmin")),
        f"{p}_same_hour_30d_max": sc(F.col("_shmax")),
        f"{p}_daily_mean_2d_ago": sc(F.col("_dm2")),
        f"{p}_daily_mean_7d_ago": sc(F.col("_dm7")),
        f"{p}_daily_mean_7d_rolling": sc(F.col("_dmr")),
        f"{p}_hourly_change": sc(F.col("_y0") - F.col("_y1")),
        f"{p}_daily_change": sc(F.col("_y0") - F.col("_y24")),
    }
    for kh in key_hours:
        cols[f"{p}_hour{kh}_30d_mean"] = F.when(hr == kh, sc(F.col("_shm")))
    out = out.select(key, "_t", *[v.alias(k) for k, v in cols.items()])
    return join_null_safe(future, out.withColumnRenamed("_t", time), [key, time], "left")


def build_future_features(future: DataFrame, history: DataFrame, target: str = "y", *,
                          holidays: DataFrame | None = None, key: str = "series_key", time: str = "date_hour",
                          **kw) -> DataFrame:
    """Calendar + holidays + history statistics for future rows."""
    f = add_holidays(add_calendar(future, time), holidays, time)
    return add_future_stats(f, history, target, key=key, time=time, **kw)
