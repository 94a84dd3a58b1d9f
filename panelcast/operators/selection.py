"""Feature selection and scaling.

Correlations are pairwise complete (rows where both sides are non-NULL),
computed as ``covar_pop / (stddev_pop * stddev_pop)`` with a guarded
division, so a constant column gives NULL instead of an ANSI error.  All
statistics are partial sums: one pass over the data, no row per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe, ratio, round_half_up
from ..session import cut_lineage

def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation matrix as long rows ``(a, b, corr)`` for every pair a < b in list order (A8), pairwise complete.

    One pass: every task multiplies its Arrow batches column by column (four k x k products: counts, sums, squares and
    cross products over the rows in which both columns are present) and returns one row per pair, however many rows it
    read; the rows are summed.  Columns are shifted by their means first, so the moments do not cancel.
    """
    cols = list(cols)
    data = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))
    row = data.agg(*[F.avg(f"c{i}") for i in range(len(cols))]).first()
    shift = np.array([0.0 if m is None else m for m in row])          # one number per column
    first, second = np.triu_indices(len(cols), 1)
    names = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]

    def moments(batches):
        total = None
        for batch in batches:
            values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols))]).astype(float)
            there = ~np.isnan(values)
            x = np.where(there, values - shift, 0.0)
            m = there.astype(float)
            part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            n, s, q, c = total
            out = [first, second, *(z.astype(float) for z in (n[first, second], s[first, second], s[second, first],
                                                              q[first, second], q[second, first], c[first, second]))]
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in out], names)

    sums = data.mapInArrow(moments, "i bigint, j bigint, " + ", ".join(f"{z} double" for z in names[2:]))
    g = sums.groupBy("i", "j").agg(*[F.sum(z).alias(z) for z in names[2:]])
    n = F.col("n")

    def spread(z, zz):
        """n times the variance; what rounding leaves of a constant column counts as 0."""
        rest = F.col(zz) - ratio(F.col(z) * F.col(z), n)
        return F.when(rest > F.col(zz) * 1e-12, rest).otherwise(F.lit(0.0))

    label = F.array(*[F.lit(c) for c in cols])
    return g.where("n > 0").select(
        F.element_at(label, (F.col("i") + 1).cast("int")).alias("a"), F.element_at(label, (F.col("j") + 1).cast("int")).alias("b"),
        ratio(F.col("xy") - ratio(F.col("x") * F.col("y"), n), F.sqrt(spread("x", "xx") * spread("y", "yy"))).alias("corr"))


def target_correlation(df: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each feature with the target (A7): ``(by..., feature, corr)``.

    The features are unpivoted next to the target and one grouped aggregate
    (3 moments) runs per feature name; map-side partial aggregation keeps the
    shuffle at one row per (group, feature) and partition.
    """
    by = list(by)
    d = df.select(*by, F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double") for f in features])
    lng = d.unpivot([*by, "_y"], list(features), "feature", "_x").where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    g = lng.groupBy(*by, "feature").agg(F.covar_pop("_x", "_y").alias("_c"), F.stddev_pop("_x").alias("_sx"),
                                        F.stddev_pop("_y").alias("_sy"))
    return g.select(*by, "feature", ratio(F.col("_c"), F.col("_sx") * F.col("_sy")).alias("corr"))


TIE_DIGITS = 12


def rank_by_correlation(corr: DataFrame, keep: float = 0.5) -> DataFrame:
    """Rank features by |corr| (desc, NULL last, then name) and flag the top ``floor(k*keep)`` (O3).

    |corr| is compared at ``TIE_DIGITS`` decimals so that equal columns (e.g.
    ``week`` and ``weekofyear``) tie exactly and the name decides, whatever
    order the engine summed in.  The input has one row per feature, so the
    un-partitioned ranking window runs over at most that many rows.
    """
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), F.col("feature").asc())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    out = corr.select("feature", round_half_up(F.abs("corr"), TIE_DIGITS).alias("abs_corr"))
    out = out.withColumns({"rank": F.row_number().over(w), "_k": n})
    return out.withColumn("top", F.col("rank") <= F.floor(F.col("_k") * F.lit(float(keep)))).drop("_k")


def prune_correlated(df: DataFrame, target: str, features: Sequence[str], keep: float = 0.5,
                     limit: float = 0.95) -> DataFrame:
    """Correlation-based selection (M9): ``(feature, rank, abs_corr, dropped)`` for the top features.

    For every pair of kept features with |corr| > ``limit`` the one with the
    lower |target corr| is dropped (on a tie, the earlier-ranked one); drops
    are not chained.  The feature list (at most ``len(features)`` names) is
    the only thing brought to the driver, to build the pair aggregate.
    """
    # Several passes follow (ranking, the name list, the pair aggregates): cut the lineage once on the
    # projected columns, in the session's checkpoint folder.
    df = cut_lineage(df.select(target, *features))
    ranked = rank_by_correlation(target_correlation(df, target, features), keep)
    top = ranked.where("top").select("feature", "rank", "abs_corr")
    names = [r["feature"] for r in top.orderBy("rank").collect()]
    if len(names) < 2:
        return top.withColumn("dropped", F.lit(False))
    pairs = correlation_pairs(df, names).where(F.abs("corr") > F.lit(limit))
    ra = top.select(F.col("feature").alias("a"), F.col("rank").alias("ra"), F.col("abs_corr").alias("ca"))
    rb = top.select(F.col("feature").alias("b"), F.col("rank").alias("rb"), F.col("abs_corr").alias("cb"))
    p = pairs.join(ra, "a").join(rb, "b")
    # (early, late) by rank; the later one goes if it is weaker, else the earlier one goes.
    early = F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b"))
    late = F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a"))
    c_early = F.when(F.col("ra") < F.col("rb"), F.col("ca")).otherwise(F.col("cb"))
    c_late = F.when(F.col("ra") < F.col("rb"), F.col("cb")).otherwise(F.col("ca"))
    drops = p.select(F.when(c_late < c_early, late).otherwise(early).alias("feature")).distinct()
    return top.join(drops.withColumn("dropped", F.lit(True)), "feature", "left").fillna({"dropped": False})


def importance_cut(imp: DataFrame, threshold="median") -> DataFrame:
    """Model-based selection rule (M7) on ``(model, feature, importance)``.

    Importances are normalised to sum 1 per model, averaged over models,
    and features strictly above the median (or mean, or a number) are kept.
    Output ``(feature, importance, selected)``.  The threshold window spans
    the combined table, one row per feature.
    """
    tot = imp.groupBy("model").agg(F.sum("importance").alias("_tot"))
    norm = imp.join(tot, "model").select("feature", "model", ratio(F.col("importance"), F.col("_tot")).alias("_n"))
    comb = norm.groupBy("feature").agg(F.avg("_n").alias("importance"))
    if threshold == "median":
        th = F.median("importance").over(Window.partitionBy())
    elif threshold == "mean":
        th = F.avg("importance").over(Window.partitionBy())
    else:
        th = F.lit(float(threshold))
    return comb.withColumn("selected", F.col("importance") > th)


def average_importance(imp: DataFrame) -> DataFrame:
    """Mean raw importance over models per feature, sorted descending."""
    return imp.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(
        F.col("importance").desc(), "feature")


def fit_standardizer(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per-column mean and population std (ddof=0) on the training rows, NULLs skipped (M1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd")]
    return train.groupBy(*by).agg(*aggs)


def apply_standardizer(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(x - mean) / std``; a zero std scales by 1 (a constant column becomes 0).

    Without ``by`` the fitted statistics are one row of ``2 * len(cols)``
    numbers, held on the driver like any fitted scaler and applied as
    literals; with ``by`` they are joined on the group key.
    """
    by = list(by)
    if by:
        j = join_null_safe(df, stats, by)
        mu = {c: F.col(f"{c}__mu") for c in cols}
        sd = {c: F.col(f"{c}__sd") for c in cols}
    else:
        row = stats.first()
        j = df
        mu = {c: F.lit(row[f"{c}__mu"]).cast("double") for c in cols}
        sd = {c: F.lit(row[f"{c}__sd"]).cast("double") for c in cols}
    out = j.withColumns({c: (F.col(c) - mu[c]) / F.when(sd[c] == 0, F.lit(1.0)).otherwise(sd[c]) for c in cols})
    return out.drop(*[f"{c}__{s}" for c in cols for s in ("mu", "sd")]) if by else out
