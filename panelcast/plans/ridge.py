"""Ridge for every series and origin day from daily Gram sums (M2, M5; no training row is copied).

The training window of an origin is the sum of its days, so the days are summed up once:

1. rows are dealt by (series, day) and become, for each day, one Gram matrix of (1, features, missing flags, target) and the
   values of the features that are missing somewhere;
2. per series, a window of days is the end of one block of ``train_days`` days and the beginning of the next (sums from both
   sides of each block: no differences, so nothing cancels), and each origin takes one k x k solve.  A series comes to a
   task as its days, at most a calendar's worth, however many rows it has;
3. test rows meet the coefficients of their (series, day) and are predicted by a plain expression.

Training medians: a missing value counts as the window's median.  Filled values are x + m * median with x = 0 where the flag
m is set, so the filled Gram matrix follows from the sums of x x', x m' and m m' and the medians, which enter as numbers.
Medians are exact (the window's values are at hand) and taken only where the window or its test day misses something.
Scaling uses the window's own mean and population deviation.  Features are shifted and scaled by their overall mean and
deviation beforehand, which changes no result and keeps the sums well conditioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_TRAIN_ROWS, TRAIN_DAYS
from ..functions.exprs import join_null_safe

EPOCH = np.datetime64("1970-01-01")


def _scales(rows: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Overall mean and deviation of each feature, and which of them are missing somewhere (three numbers a feature)."""
    aggs = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features)
            for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count))]
    r = rows.agg(F.count(F.lit(1)).alias("all"), *aggs).first()
    shift = np.array([r[f"m{i}"] or 0.0 for i in range(len(features))])
    scale = np.array([r[f"s{i}"] or 1.0 for i in range(len(features))])
    scale[scale <= 1e-12 * (1 + np.abs(shift))] = 1.0
    return shift, scale, [i for i in range(len(features)) if r[f"n{i}"] < r["all"]]


def window_sums(days: np.ndarray, values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``values`` (one row a day, days ascending) over the ``width`` days from each of ``first``.

    A window is the tail of one block of ``width`` days and the head of the next one.
    """
    block = np.floor_divide(days, width)
    ends = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(days))
    head, tail = values.copy(), values.copy()
    for a, b in zip(ends[:-1], ends[1:]):
        head[a:b] = np.cumsum(values[a:b], axis=0)
        tail[a:b] = np.cumsum(values[a:b][::-1], axis=0)[::-1]
    out = np.zeros((len(first), values.shape[1]))
    for k, d in enumerate(first.tolist()):
        own = d // width
        a = int(np.searchsorted(days, d))                                  # first day of the window
        if a < len(days) and block[a] == own:
            out[k] += tail[a]
        b = int(np.searchsorted(days, d + width)) - 1                       # last day before its end
        if b >= 0 and block[b] == own + 1:
            out[k] += head[b]
    return out


def solve(gram: np.ndarray, fill: np.ndarray, prone: Sequence[int], k: int, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from the Gram matrix of (1, x, flags of ``prone``, y) and the values that fill gaps."""
    p = len(prone)
    # Filled features are a linear map of (1, x, flags): x_j + fill_j * flag_j.
    lift = np.zeros((k + 2, k + p + 2))
    lift[0, 0] = lift[-1, -1] = 1.0
    lift[np.arange(1, k + 1), np.arange(1, k + 1)] = 1.0
    for i, j in enumerate(prone):
        lift[1 + j, 1 + k + i] = fill[j]
    s = lift @ gram @ lift.T
    n = s[0, 0]
    mean = s[0] / n
    centred = s / n - np.outer(mean, mean)
    var = np.diag(centred)[1:-1].copy()
    var[var <= 1e-14 * (1 + mean[1:-1] ** 2)] = 1.0                          # a constant feature
    sd = np.sqrt(var)
    z = n * centred[1:-1, 1:-1] / np.outer(sd, sd)
    w = np.linalg.solve(z + alpha * np.eye(k), n * centred[1:-1, -1] / sd) / sd
    return float(mean[-1] - w @ mean[1:-1]), w


def _daily_sums(rows: DataFrame, features: Sequence[str], target: str, key: str, time: str, shift, scale, prone) -> DataFrame:
    """(key, day, n, gram, missing, values): a row for each series and day, or a few where a day met more than one batch.

    ``gram`` and ``values`` (the values of the features that can be missing, for the medians) are of training rows, those
    with a target; ``missing`` counts gaps in all rows of the day.
    """
    k = len(features)
    day = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).alias("day")
    d = rows.where(F.col(time).isNotNull()).select(
        F.col(key).alias("key"), day, F.col(target).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    kind = d.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            code = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            days = batch.column(1).to_numpy()
            new = np.append(True, (code[1:] != code[:-1]) | (days[1:] != days[:-1]))
            starts = np.flatnonzero(new)
            y = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([batch.column(names.index(f"x{i}")).to_numpy(zero_copy_only=False).astype(float) for i in range(k)])
            x = (x - shift) / scale
            gap = np.isnan(x)
            learn = ~np.isnan(y)
            wide = np.column_stack([np.ones(len(y)), np.where(gap, 0.0, x), gap[:, prone], np.where(learn, y, 0.0)]) * learn[:, None]
            run_of = np.cumsum(new) - 1
            grams = np.zeros((len(starts), wide.shape[1] ** 2))
            for a in range(0, len(y), 4096):                               # outer products of some rows at a time
                part = (wide[a:a + 4096, :, None] * wide[a:a + 4096, None, :]).reshape(-1, wide.shape[1] ** 2)
                at = run_of[a:a + 4096]
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                grams[at[begin]] += np.add.reduceat(part, begin, axis=0)
            missing = np.add.reduceat(gap[:, prone].astype(np.int64), starts, axis=0) if prone else np.zeros((len(starts), 0), np.int64)
            values = [[x[a:b, j][learn[a:b] & ~gap[a:b, j]].tolist() for j in prone]
                      for a, b in zip(starts, np.append(starts[1:], len(y)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(starts)), pa.array(days[starts]), pa.array(np.add.reduceat(learn.astype(np.int64), starts)),
                 pa.array(grams.tolist(), pa.list_(pa.float64())), pa.array(missing.tolist(), pa.list_(pa.int64())),
                 pa.array(values, pa.list_(pa.list_(pa.float64())))], ["key", "day", "n", "gram", "missing", "values"])

    return d.repartition("key", "day").sortWithinPartitions("key", "day").mapInArrow(
        run, f"key {kind}, day int, n bigint, gram array<double>, missing array<bigint>, values array<array<double>>")


def rolling_ridge(rows: DataFrame, start, end, features: Sequence[str], target: str = "y", alphas: Sequence[float] = (1.0,),
                  train_days: int = TRAIN_DAYS, min_train_rows: int = MIN_TRAIN_ROWS, key: str = "series_key",
                  time: str = "date_hour", asked: Column | None = None) -> DataFrame:
    """``(key, origin, time, alpha, pred)`` of every row of every day in ``[start, end)`` whose ``train_days`` days before hold
    at least ``min_train_rows`` rows with a target.  Rows without a target are predicted, never learnt from; ``asked`` names the
    rows to predict (default: all)."""
    features = list(features)
    k = len(features)
    t, s, e = F.col(time), F.to_date(F.lit(start)), F.to_date(F.lit(end))
    rows = rows.where((t >= F.date_sub(s, train_days).cast("timestamp_ntz")) & (t < e.cast("timestamp_ntz")))
    shift, scale, prone = _scales(rows, features)
    sums = _daily_sums(rows, features, target, key, time, shift, scale, prone)
    kind = sums.schema["key"].dataType.simpleString()
    size = k + len(prone) + 2
    low = int((np.datetime64(str(start)[:10]) - EPOCH).astype(int))
    need = max(1, min_train_rows)
    alphas = [float(a) for a in alphas]

    def solve_series(table):
        table = table.sort_by("day").combine_chunks()
        days = table.column("day").to_numpy()
        first = np.flatnonzero(np.append(True, days[1:] != days[:-1]))
        unique = days[first].astype(np.int64)
        gram = np.add.reduceat(np.array(table.column("gram").to_pylist(), float).reshape(len(days), size * size), first, axis=0)
        n = np.add.reduceat(table.column("n").to_numpy(), first)
        missing = np.add.reduceat(np.array(table.column("missing").to_pylist(), float).reshape(len(days), len(prone)), first, axis=0)
        values = table.column("values").to_pylist()
        ask = np.flatnonzero(unique >= low)
        both = window_sums(unique, np.column_stack([n, missing, gram]), unique[ask] - train_days, train_days)
        out = []
        for row, i in zip(both, ask.tolist()):
            if row[0] < need:
                continue
            fill = np.zeros(k)
            a, b = np.searchsorted(days, [unique[i] - train_days, unique[i]])
            for q, j in enumerate(prone):
                if row[1 + q] or missing[i, q]:
                    there = np.array([x for v in values[a:b] for x in v[q]])
                    # A feature without any training value counts as 0, as given.
                    fill[j] = np.median(there) if len(there) else -shift[j] / scale[j]
            for alpha in alphas:
                base, w = solve(row[1 + len(prone):].reshape(size, size), fill, prone, k, alpha)
                out.append((int(unique[i]), alpha, base, w.tolist(), fill.tolist()))
        name = table.column("key").slice(0, 1).to_pylist() * len(out)
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(name, table.schema.field("key").type), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()),
                         pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.float64())), pa.array(cols[4], pa.list_(pa.float64()))],
                        names=["key", "day", "alpha", "base", "w", "fill"])

    fits = sums.groupBy("key").applyInArrow(
        solve_series, f"key {kind}, day int, alpha double, base double, w array<double>, fill array<double>")
    test = rows.where(t >= s.cast("timestamp_ntz")).where(F.lit(True) if asked is None else asked).withColumns({"origin": F.to_date(time), "_day": F.datediff(
        F.to_date(time), F.lit("1970-01-01").cast("date"))}).select(
        key, "origin", time, "_day", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    out = join_null_safe(test, fits.select(F.col("key").alias(key), F.col("day").alias("_day"), "alpha", "base", "w", "fill"), [key, "_day"])
    pred = F.col("base")
    for i in range(k):
        x = (F.col(f"_x{i}") - F.lit(float(shift[i]))) / F.lit(float(scale[i]))
        pred = pred + F.col("w")[i] * F.coalesce(x, F.col("fill")[i])
    return out.select(key, "origin", time, "alpha", pred.alias("pred"))
