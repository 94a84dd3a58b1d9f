"""Wide <-> long predictions (R2, R3) and blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BLEND_EPS
from ..functions.exprs import join_null_safe

MAX_STRATEGIES = 1000


def to_long(wide: DataFrame, columns: Sequence[str], ids: Sequence[str] = ("series_key", "date_hour"),
            name: str = "strategy", value: str = "pred") -> DataFrame:
    """Wide prediction columns -> ``(ids..., strategy, pred)``."""
    return wide.unpivot(list(ids), list(columns), name, value)


def to_wide(long: DataFrame, values: Sequence[str], ids: Sequence[str] = ("series_key", "date_hour"),
            name: str = "strategy", value: str = "pred", prefix: str = "") -> DataFrame:
    """Long predictions -> one column per strategy (R2/R3); the value list is given, so no extra pass."""
    w = long.groupBy(*ids).pivot(name, list(values)).agg(F.first(value))
    return w.withColumnsRenamed({v: f"{prefix}{v}" for v in values}) if prefix else w


def blend(long: DataFrame, how: str = "mean", weights: DataFrame | None = None,
          ids: Sequence[str] = ("series_key", "date_hour"), name: str = "strategy", value: str = "pred",
          out: str = "pred") -> DataFrame:
    """Blend member predictions per row key (M13 mean, M14 inverse-RMSE weighted, M15 median).

    ``weights`` for ``'weighted'`` is ``(strategy, rmse)`` or
    ``(series_key, strategy, rmse)``; weight = 1/(rmse+1e-6), normalised over
    the members present in the row.  The median group is one row's members,
    so its size is the member count.
    """
    ids = list(ids)
    if how == "mean":
        return long.groupBy(*ids).agg(F.avg(value).alias(out))
    if how == "median":
        return long.groupBy(*ids).agg(F.median(value).alias(out))
    if how == "weighted":
        if weights is None:
            raise ValueError("weighted blend needs a metric table")
        wcols = [c for c in weights.columns if c in ("series_key", name)]
        wt = weights.select(*wcols, (F.lit(1.0) / (F.col("rmse") + F.lit(BLEND_EPS))).alias("_w"))
        if "series_key" not in wcols:
            # One weight per strategy, a handful of rows: a shuffle on that key would put all predictions in a few
            # partitions.  A table that is not that small is joined as the optimizer sees fit.
            if wt.limit(MAX_STRATEGIES + 1).count() <= MAX_STRATEGIES:
                wt = F.broadcast(wt)
        j = join_null_safe(long.where(F.col(value).isNotNull()), wt, wcols)
        return j.groupBy(*ids).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(out))
    raise ValueError(f"unknown blend {how!r}")
