"""Leakage report of any feature builder, for many cut-off days in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe


def history_builder(build: Callable[..., DataFrame], target: str = "y", **options) -> Callable[[DataFrame, str, str], DataFrame]:
    """A builder that derives features of all rows from the rows themselves (``add_history_stats`` and the like, W18)."""
    return lambda rows, key, time: build(rows, target, key=key, time=time, **options)


def future_builder(build: Callable[..., DataFrame], target: str = "y", **options) -> Callable[[DataFrame, str, str], DataFrame]:
    """A builder that derives features of the cut-off day's rows from the days before it (``add_future_stats`` and the like, W17)."""
    def run(rows: DataFrame, key: str, time: str) -> DataFrame:
        on_day = F.to_date(time) == F.col(f"{key}.cutoff")
        return build(rows.where(on_day).drop(target), rows.where(~on_day), target, key=key, time=time, **options)
    return run


def leakage_report(df: DataFrame, builder: Callable[[DataFrame, str, str], DataFrame], cutoffs: Sequence, target: str = "y", *,
                   gap_days: int = 1, lookback_days: int | None = None, tolerance: float = 1e-9, key: str = "series_key",
                   time: str = "date_hour") -> DataFrame:
    """``(cutoff, feature, n_rows, n_changed)``: features of each cut-off day that change (floating-point ones by more than
    ``tolerance``, relatively) when the target is hidden from ``gap_days`` days before it on.

    Every cut-off day gets two copies of the rows up to it (from ``lookback_days`` before on, if given: enough for builders that
    look back by time; by position they may need all), one with the target hidden.  Series, cut-off and copy together are the
    series key of one frame, so ``builder(rows, key, time)`` runs once, whatever the number of cut-off days, and no series key
    is too special for it (a struct; NULL series included).
    """
    days = F.explode(F.array(*[F.lit(str(c)).cast("date") for c in cutoffs]))
    copies = df.withColumn("_cutoff", days).withColumn("_hidden", F.explode(F.array(F.lit(False), F.lit(True))))
    day = F.to_date(time)
    copies = copies.where(day <= F.col("_cutoff"))
    if lookback_days is not None:
        copies = copies.where(day >= F.date_sub("_cutoff", lookback_days))
    hide = F.col("_hidden") & (day >= F.date_sub("_cutoff", gap_days))
    whole = F.struct(F.col(key).alias("series"), F.col("_cutoff").alias("cutoff"), F.col("_hidden").alias("hidden"))
    rows = copies.withColumns({target: F.when(~hide, F.col(target)), key: whole}).drop("_cutoff", "_hidden")
    built = builder(rows, key, time)
    features = [c for c in built.columns if c not in df.columns]
    built = built.where(day == F.col(f"{key}.cutoff")).select(
        F.col(f"{key}.series").alias("_s"), F.col(f"{key}.cutoff").alias("cutoff"), F.col(f"{key}.hidden").alias("_hidden"),
        F.col(time).alias("_t"), *features)
    hidden = built.where("_hidden").select("_s", "cutoff", "_t", *[F.col(f).alias(f"_h_{f}") for f in features])
    both = join_null_safe(built.where("not _hidden"), hidden, ["_s", "cutoff", "_t"])
    numbers = {f.name for f in built.schema.fields if f.dataType.typeName() in ("double", "float")}

    def differs(f: str):
        a, b = F.col(f), F.col(f"_h_{f}")
        same = a.eqNullSafe(b)
        if f in numbers:                                     # sums of the same numbers in another order
            same = same | F.coalesce(F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(False))
        return ~same
    changed = [F.sum(differs(f).cast("int")).alias(f) for f in features]
    return both.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n_rows"), *changed).unpivot(
        ["cutoff", "n_rows"], features, "feature", "n_changed").select("cutoff", "feature", "n_rows", "n_changed")
