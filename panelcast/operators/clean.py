"""Projections, filters, cleaning and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLEAN_HIGH, CLEAN_LOW, DEFAULT_STRATEGY, STRATEGY_TO_PRED_COL
from ..functions.exprs import clip
from ..functions.exprs import join_null_safe
from .stats import exact_median


def clean_panel(df: DataFrame, target: str = "y", lo: float = CLEAN_LOW, hi: float = CLEAN_HIGH) -> DataFrame:
    """Drop NULL targets and keep ``lo <= y < hi``."""
    y = F.col(target)
    return df.where(y.isNotNull() & (y >= F.lit(lo)) & (y < F.lit(hi)))


def clip_columns(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Clip each column into ``(lo, hi)`` (either may be None); NULL stays NULL (P5)."""
    return df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def between_slice(df: DataFrame, a, b, time_col: str = "date_hour") -> DataFrame:
    """Closed display range ``a <= t <= b``."""
    t = F.col(time_col)
    return df.where(t.between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))


def error_column(df: DataFrame, actual: str = "actual", pred: str = "pred", name: str = "error") -> DataFrame:
    """``actual - predicted`` (P10)."""
    return df.withColumn(name, F.col(actual) - F.col(pred))


def impute_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Predict-time fill with 0."""
    return df.fillna(0.0, subset=list(cols))


def impute_train_median(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                        by: Sequence[str] = ("series_key",)) -> list[DataFrame]:
    """Fill NULLs with medians computed on ``train`` only, per ``by`` group.

    Medians are exact and interpolated (pandas ``median``) and computed
    without collecting a group (``stats.exact_median``).  A column that is
    NULL everywhere in a group stays NULL.
    """
    by = list(by)
    med = exact_median(train, by, cols, suffix="__med")
    if not by:
        # One row of fitted medians: held on the driver and applied as literals.
        row = med.first()
        fill = {c: (row[c + "__med"] if row is not None else None) for c in cols}
        return [df.withColumns({c: F.coalesce(F.col(c), F.lit(fill[c]).cast("double")) for c in cols})
                for df in [train, *others]]
    out = []
    for df in [train, *others]:
        j = join_null_safe(df, med, by, "left")
        j = j.withColumns({c: F.coalesce(F.col(c), F.col(c + "__med")) for c in cols})
        out.append(j.drop(*[c + "__med" for c in cols]))
    return out


def pred_best(preds: DataFrame, best: DataFrame, key: str = "series_key",
              mapping: Mapping[str, str] = STRATEGY_TO_PRED_COL, default: str = DEFAULT_STRATEGY,
              name: str = "pred_best") -> DataFrame:
    """Pick, per series, the prediction column of its best strategy.

    ``best`` has one row per series ``(key, strategy)``; series without one
    use ``default``; a strategy without a column is an error.  The choice is a CASE over the known columns, so the
    wide rows never leave their partition except for the join on the key.
    """
    b = best.select(key, F.col("strategy").alias("_best"))
    j = join_null_safe(preds, b, [key], "left").withColumn("_best", F.coalesce("_best", F.lit(default)))
    return j.withColumn(name, chosen_column("_best", {s: c for s, c in mapping.items() if c in preds.columns})).drop("_best")


def chosen_column(strategy: str, columns: Mapping[str, str]):
    """The column that stands for the row's strategy; an unknown strategy raises an error."""
    unknown = F.raise_error(F.concat(F.lit("no prediction column for strategy "), F.col(strategy))).cast("double")
    expr = unknown
    for name, column in columns.items():
        expr = F.when(F.col(strategy) == name, F.col(column).cast("double")).otherwise(expr)
    return expr
