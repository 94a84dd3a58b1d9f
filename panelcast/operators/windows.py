"""History window features.

All windows are partitioned by ``series_key`` and ordered by time, so a
panel of many series is one hash exchange on the key; the day-mean and the
key-hour windows partition by ``(key, day)`` / ``(key, hour)``, which the
key-hash partitioning already satisfies, so they add a sort, not a shuffle.

``mode='rows'`` shifts by positional rows exactly like the reference (shifts
drift when hours are missing); ``mode='time'`` first densifies each series to
a regular grid so that row offsets are time offsets, then drops the filler
rows again.

``divisor`` supports integer-unit targets (e.g. cents): sums stay exact
integers and every statistic is divided once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (DAILY_ROLL_ROWS, KEY_HOUR_ROWS, KEY_HOURS, LAG_2D, LAG_7D, ROLL_ROWS,
                         ROLL_SHIFT)
from ..functions.calendar import add_calendar
from ..functions.exprs import join_null_safe, ratio
from .holidays import add_holidays


SLOT_RUN = 4096


def _mean(c: Column, w) -> Column:
    return ratio(F.sum(c).over(w), F.count(c).over(w))


def densify(df: DataFrame, key: str = "series_key", time: str = "date_hour", step: str = "1 hour") -> DataFrame:
    """Regular grid per series between its first and last slot; filler rows get ``_filler = true``.

    A slot is a step of the grid that starts at the epoch (for hours: the truncated hour).  A row keeps its own
    time and stands in the slot that contains it, so stamps off the grid stay; two rows in one slot raise an
    error, since row offsets would no longer be time offsets.  Rows without a time are kept after the others.
    Slots are numbered in runs of ``SLOT_RUN``, so no array grows with a series' span.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    size = F.timestamp_diff("MICROSECOND", epoch, epoch + F.expr(f"interval {step}"))
    rows = df.withColumn("_slot", F.floor(F.timestamp_diff("MICROSECOND", epoch, F.col(time)) / size))
    span = rows.groupBy(key).agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi")).where("_lo is not null")
    runs = span.select(key, "_lo", "_hi", F.explode(F.sequence(
        F.floor(F.col("_lo") / SLOT_RUN), F.floor(F.col("_hi") / SLOT_RUN))).alias("_run"))
    grid = runs.select(key, "_lo", "_hi", F.explode(F.sequence(
        F.col("_run") * SLOT_RUN, F.col("_run") * SLOT_RUN + (SLOT_RUN - 1))).alias("_slot"))
    grid = grid.where(F.col("_slot").between(F.col("_lo"), F.col("_hi"))).select(key, "_slot")
    taken = rows.where("_slot is not null").withColumn("_in_slot", F.count(F.lit(1)).over(Window.partitionBy(key, "_slot")))
    taken = taken.withColumn("_filler", F.when(F.col("_in_slot") > 1, F.raise_error(F.lit(
        "two rows of a series in one step of the grid")).cast("boolean")).otherwise(F.lit(False))).drop("_in_slot")
    start = F.timestamp_add("MICROSECOND", F.col("_slot") * size, epoch)
    out = join_null_safe(grid, taken, [key, "_slot"], "left").withColumns({
        time: F.coalesce(F.col(time), start), "_filler": F.coalesce("_filler", F.lit(True))}).drop("_slot")
    return out.unionByName(rows.where("_slot is null").drop("_slot").withColumn("_filler", F.lit(False)))


def add_history_stats(df: DataFrame, target: str = "y", *, key: str = "series_key", time: str = "date_hour",
                      prefix: str | None = None, mode: str = "rows", key_hours=KEY_HOURS,
                      min_lag: int = ROLL_SHIFT, divisor: float | None = None, step: str = "1 hour",
                      algorithm: str = "prefix", split_rows: int | None = None) -> DataFrame:
    """Add the 11 statistical features and the key-hour means.

    ``min_lag`` is the shift applied after the rolling windows: 24 reproduces
    the reference (uses day D-1 data), 48 gives the documented "D-2 or
    earlier" rule.

    ``algorithm='prefix'`` (default) computes every rolling statistic in O(1)
    per row by the van Herk / Gil-Werman decomposition (blocks as long as the
    window: a window is a suffix of one block plus a prefix of the next):
    running count, sum, variance, min and max of both parts, merged.
    ``algorithm='frame'`` uses plain sliding ROWS frames, which Spark
    re-aggregates row by row (O(window) per row); it is kept as the
    reference formulation for tests.

    ``split_rows`` handles hot series: positions (``series_row_number``) are
    cut into blocks of ``split_rows`` rows and the last ``H`` rows of each
    block are copied into the next one as a halo (``H`` = the longest
    positional lookback, ``ROLL_ROWS + min_lag``).  All windows then run per
    ``(series, block)`` and the halo copies are dropped, so a series holding
    a third of the data spreads over ``rows / split_rows`` tasks.  Day means
    become a ``(series, day)`` aggregate joined back and the same-hour means
    get their own blocking per ``(series, hour)``; every feature is exact.
    """
    if split_rows:
        return _split_history_stats(df, target, key=key, time=time, prefix=prefix, mode=mode,
                                    key_hours=key_hours, min_lag=min_lag, divisor=divisor, step=step,
                                    split_rows=int(split_rows))
    if mode not in ("rows", "time"):
        raise ValueError("mode must be 'rows' or 'time'")
    if algorithm not in ("prefix", "frame"):
        raise ValueError("algorithm must be 'prefix' or 'frame'")
    p = prefix or target
    base = densify(df, key, time, step) if mode == "time" else df
    y = F.col(target)
    scale = (lambda c: c / F.lit(float(divisor))) if divisor else (lambda c: c)

    w0 = Window.partitionBy(key).orderBy(F.col(time).asc_nulls_last())
    lo, hi = ROLL_ROWS + min_lag - 1, min_lag          # frame = rows [i - lo, i - hi]
    ks = key_hour_shift(min_lag)
    day = Window.partitionBy(key, F.to_date(time))
    hour_part = Window.partitionBy(key, "_hr").orderBy(F.col(time).asc_nulls_last())

    # One hash exchange on the key serves every window spec below: (key), (key, day),
    # (key, hour) and (key, block) are all clustered by key, so later windows only re-sort.
    out = base.repartition(key).withColumns({"_dm": _mean(y, day), "_hr": F.hour(time)})
    if algorithm == "prefix":
        # Positions and 720-row blocks; ordering the lag window by (block, position) -- the same order as
        # time within a series -- lets it reuse the block windows' sort.
        out = out.withColumn("_rn", F.row_number().over(w0))
        out = out.withColumn("_vb", F.floor((F.col("_rn") - 1) / F.lit(ROLL_ROWS)))
        w = Window.partitionBy(key).orderBy("_vb", "_rn")
    else:
        w = w0
    roll = w.rowsBetween(-lo, -hi)
    cols = {
        f"{p}_same_hour_2d_ago": scale(F.lag(y, LAG_2D).over(w)),
        f"{p}_same_hour_7d_ago": scale(F.lag(y, LAG_7D).over(w)),
        f"{p}_daily_mean_2d_ago": scale(F.lag("_dm", LAG_2D).over(w)),
        f"{p}_daily_mean_7d_ago": scale(F.lag("_dm", LAG_7D).over(w)),
        f"{p}_daily_mean_7d_rolling": scale(_mean(F.col("_dm"), w.rowsBetween(-(DAILY_ROLL_ROWS + min_lag - 1), -min_lag))),
        f"{p}_hourly_change": scale(F.lag(y, min_lag).over(w) - F.lag(y, min_lag + 1).over(w)),
        f"{p}_daily_change": scale(F.lag(y, min_lag).over(w) - F.lag(y, min_lag + 24).over(w)),
    }
    names = {k: f"{p}_same_hour_30d_{k}" for k in ("mean", "std", "min", "max")}
    if algorithm == "frame":
        stats = {"mean": _mean(y, roll), "std": F.stddev_samp(y).over(roll),
                 "min": F.min(y).over(roll), "max": F.max(y).over(roll)}
        km = _mean(y, hour_part.rowsBetween(-(KEY_HOUR_ROWS + ks - 1), -ks))
    else:
        out = _block_helpers(out, y, [key], F.col("_rn"))
        stats = _rolling_exprs(w, lo, hi)
        out = out.withColumns(_hour_prefix(y, hour_part))
        km = _key_hour_mean(hour_part, ks)
    cols.update({names[k]: scale(v) for k, v in stats.items()})
    km = scale(km)
    out = out.withColumns(cols)
    if key_hours:
        out = out.withColumns({f"{p}_hour{h}_30d_mean": F.when(F.col("_hr") == h, km) for h in key_hours})
    out = out.drop(*[c for c in out.columns if c.startswith("_") and c not in base.columns])
    if mode == "time":
        out = out.where(~F.col("_filler")).drop("_filler")
    return out


def key_hour_shift(min_lag: int) -> int:
    """Same-hour rows skipped before the key-hour window: 1 (the previous day) for the reference's
    24-hour shift, 2 for the 48-hour "D-2 or earlier" rule."""
    return max(1, min_lag // 24)


def _block_helpers(df: DataFrame, y: Column, part: list, order: Column) -> DataFrame:
    """Per-row helpers for O(1) rolling statistics over windows of ``ROLL_ROWS`` positions.

    Positions (``_rn``) are cut into blocks of exactly the window length, so a
    window is a suffix of one block plus a prefix of the next.  Per block:
    running count, sum, variance, min and max from its start up to each row and
    from each row to its end.  A window uses the part of a block that lies in
    it and nothing else, so no later data enters a feature, and a value that
    left the window leaves no rounding behind.
    """
    if "_vb" not in df.columns:
        df = df.withColumn("_vb", F.floor((F.col("_rn") - 1) / F.lit(ROLL_ROWS)))
    bp = [*part, "_vb"]
    up = Window.partitionBy(*bp).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    dn = Window.partitionBy(*bp).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = {}
    for name, w in (("p", up), ("s", dn)):
        parts |= {f"_{name}c": F.count(y).over(w), f"_{name}t": F.sum(y).over(w), f"_{name}v": F.var_pop(y).over(w),
                  f"_b{name}min": F.min(y).over(w), f"_b{name}max": F.max(y).over(w)}
    return df.withColumns(parts)


def _rolling_exprs(w, lo: int, hi: int) -> dict:
    """Mean, sample std, min and max over rows ``[i-lo, i-hi]`` from ``_block_helpers`` columns."""
    lag = lambda c, k: F.lag(c, k).over(w)
    vb_a, vb_b = lag("_vb", lo), lag("_vb", hi)
    same = vb_a.isNull() | (vb_a == vb_b)           # the window is the prefix of one block
    c_a = F.when(same, F.lit(0)).otherwise(F.coalesce(lag("_sc", lo), F.lit(0)))
    t_a = F.when(c_a > 0, lag("_st", lo))
    c_b = F.coalesce(lag("_pc", hi), F.lit(0))
    t_b = F.when(c_b > 0, lag("_pt", hi))
    zero = F.lit(0.0)
    n = c_a + c_b
    total = F.when(t_a.isNull(), t_b).when(t_b.isNull(), t_a).otherwise(t_a + t_b)
    # Squared deviations of both parts, and what the distance of their means adds (parallel variance).
    apart = F.when((c_a > 0) & (c_b > 0), ratio(t_b, c_b) - ratio(t_a, c_a))
    squares = (F.coalesce(lag("_sv", lo) * c_a, zero) + F.coalesce(lag("_pv", hi) * c_b, zero)
               + F.coalesce(apart * apart * (c_a * c_b).cast("double") / n, zero))
    return {
        "mean": F.when(n > 0, ratio(total, n)),
        "std": F.when(n >= 2, F.sqrt(squares / (n - F.lit(1)))),
        "min": F.least(F.when(~same, lag("_bsmin", lo)), lag("_bpmin", hi)),
        "max": F.greatest(F.when(~same, lag("_bsmax", lo)), lag("_bpmax", hi)),
    }


def _hour_prefix(y: Column, hour_part) -> dict:
    present = F.when(y.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    run = hour_part.rowsBetween(Window.unboundedPreceding, 0)
    return {"_hs": F.sum(y).over(run), "_hc": F.sum(present).over(run)}


def _key_hour_mean(hour_part, ks: int) -> Column:
    """Mean of same-hour rows ``[j-(30+ks-1), j-ks]`` from running sums (O(1) per row)."""
    far = KEY_HOUR_ROWS + ks
    hc = F.lag("_hc", ks).over(hour_part) - F.coalesce(F.lag("_hc", far).over(hour_part), F.lit(0))
    hs = F.lag("_hs", ks).over(hour_part) - F.coalesce(F.lag("_hs", far).over(hour_part), F.lit(0))
    return F.when(hc > 0, hs / hc)


def _halo_blocks(df: DataFrame, keys, time: str, block: int, halo: int) -> DataFrame:
    """Assign rows to position blocks of ``block`` rows; the last ``halo`` rows of a block are also
    emitted (flagged ``_halo``) into the next block."""
    from .folds import series_row_number
    if halo > block:
        raise ValueError(f"split_rows must be at least the lookback ({halo} rows)")
    d = series_row_number(df, keys, time, rn="_pos", n="_npos").drop("_npos")
    b = F.floor((F.col("_pos") - 1) / F.lit(block))
    tail = (F.col("_pos") - 1) - b * F.lit(block) >= F.lit(block - halo)
    targets = F.when(tail, F.array(F.struct(b.alias("blk"), F.lit(False).alias("halo")),
                                   F.struct((b + 1).alias("blk"), F.lit(True).alias("halo"))))\
        .otherwise(F.array(F.struct(b.alias("blk"), F.lit(False).alias("halo"))))
    d = d.withColumn("_t", F.explode(targets))
    return d.withColumns({"_sblk": F.col("_t.blk"), "_halo": F.col("_t.halo")}).drop("_t")


def _split_history_stats(df: DataFrame, target: str, *, key, time, prefix, mode, key_hours, min_lag, divisor,
                         step, split_rows) -> DataFrame:
    p = prefix or target
    base = densify(df, key, time, step) if mode == "time" else df
    y = F.col(target)
    scale = (lambda c: c / F.lit(float(divisor))) if divisor else (lambda c: c)
    lo, hi = ROLL_ROWS + min_lag - 1, min_lag
    halo = max(lo + 1, LAG_7D, min_lag + 24, DAILY_ROLL_ROWS + min_lag - 1)

    # Day means: an aggregate per (series, day), joined back.
    dm = base.groupBy(key, F.to_date(time).alias("_day")).agg(ratio(F.sum(y), F.count(y)).alias("_dm"))
    rows = join_null_safe(base.withColumn("_day", F.to_date(time)), dm, [key, "_day"], "left").drop("_day")

    # Main blocked pass: windows per (series, block) over positions with a halo.
    blk = _halo_blocks(rows, key, time, split_rows, halo)
    w = Window.partitionBy(key, "_sblk").orderBy("_pos")
    blk = _block_helpers(blk.withColumn("_rn", F.col("_pos")), y, [key, "_sblk"], F.col("_pos"))
    stats = _rolling_exprs(w, lo, hi)
    out = blk.withColumns({
        f"{p}_same_hour_2d_ago": scale(F.lag(y, LAG_2D).over(w)),
        f"{p}_same_hour_7d_ago": scale(F.lag(y, LAG_7D).over(w)),
        f"{p}_same_hour_30d_mean": scale(stats["mean"]),
        f"{p}_same_hour_30d_std": scale(stats["std"]),
        f"{p}_same_hour_30d_min": scale(stats["min"]),
        f"{p}_same_hour_30d_max": scale(stats["max"]),
        f"{p}_daily_mean_2d_ago": scale(F.lag("_dm", LAG_2D).over(w)),
        f"{p}_daily_mean_7d_ago": scale(F.lag("_dm", LAG_7D).over(w)),
        f"{p}_daily_mean_7d_rolling": scale(_mean(F.col("_dm"), w.rowsBetween(-(DAILY_ROLL_ROWS + min_lag - 1), -min_lag))),
        f"{p}_hourly_change": scale(F.lag(y, min_lag).over(w) - F.lag(y, min_lag + 1).over(w)),
        f"{p}_daily_change": scale(F.lag(y, min_lag).over(w) - F.lag(y, min_lag + 24).over(w)),
    }).where(~F.col("_halo"))

    if key_hours:
        # Same-hour means: their own positions per (series, hour), blocked with a (30 + shift)-row halo.
        ks = key_hour_shift(min_lag)
        hb = _halo_blocks(base.select(key, time, target).withColumn("_hr", F.hour(time)), [key, "_hr"], time,
                          split_rows, KEY_HOUR_ROWS + ks)
        hw = Window.partitionBy(key, "_hr", "_sblk").orderBy("_pos")
        hb = hb.withColumns(_hour_prefix(y, hw))
        km = hb.select(key, time, "_halo", "_hr", scale(_key_hour_mean(hw, ks)).alias("_km")).where(~F.col("_halo"))
        km = km.select(key, time, *[F.when(F.col("_hr") == h, F.col("_km")).alias(f"{p}_hour{h}_30d_mean")
                                    for h in key_hours])
        out = join_null_safe(out, km, [key, time], "left")
    out = out.drop(*[c for c in out.columns if c.startswith("_") and c not in base.columns])
    if mode == "time":
        out = out.where(~F.col("_filler")).drop("_filler")
    return out


def add_all_features(df: DataFrame, target: str = "y", *, key: str = "series_key", time: str = "date_hour",
                     holidays: DataFrame | None = None, **kw) -> DataFrame:
    """Calendar -> holidays -> history statistics."""
    out = add_calendar(df, time)
    out = add_holidays(out, holidays, time)
    return add_history_stats(out, target, key=key, time=time, **kw)


def leakage_check(df: DataFrame, cutoff, target: str = "y", *, key: str = "series_key", time: str = "date_hour",
                  features=None, gap_days: int = 1, **kw) -> DataFrame:
    """Report features of day ``cutoff`` that change when the target is hidden from ``cutoff - gap_days`` on.

    Builds the history statistics twice — on the panel as is and with the
    target nulled from ``cutoff - gap_days`` — and compares the rows of day
    ``cutoff``.  Output ``(feature, n_rows, n_changed)``; with ``min_lag=24``
    the rolling and change features use day D-1 (as the reference does),
    with ``min_lag=48`` nothing changes for ``gap_days=1``.
    """
    day = F.lit(cutoff).cast("date")
    hide = F.to_date(time) >= F.date_sub(day, gap_days)
    masked = df.withColumn(target, F.when(hide, F.lit(None).cast(df.schema[target].dataType)).otherwise(F.col(target)))
    a = add_history_stats(df, target, key=key, time=time, **kw)
    b = add_history_stats(masked, target, key=key, time=time, **kw)
    feats = features or [c for c in a.columns if c not in df.columns]
    on_day = F.to_date(time) == day
    hidden = b.where(on_day).select(key, time, *[F.col(f).alias(f"_h_{f}") for f in feats])
    j = join_null_safe(a.where(on_day).select(key, time, *feats), hidden, [key, time])
    diff = [F.sum((~F.col(f).eqNullSafe(F.col(f"_h_{f}"))).cast("int")).alias(f) for f in feats]
    return j.agg(F.count(F.lit(1)).alias("_n"), *diff).unpivot(["_n"], feats, "feature", "n_changed") \
        .withColumnRenamed("_n", "n_rows").select("feature", "n_rows", "n_changed")
