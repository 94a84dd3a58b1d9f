"""Distributed exact order statistics.

``exact_median`` returns the interpolated median (pandas / SQL ``median``)
per group and column without gathering a group into one task:

1. the columns are unpivoted to ``(group, column, value)`` rows, and one aggregate gives
   their count and two approximate quantiles that bracket the middle ranks
   (``percentile_approx`` guarantees a rank error of at most ``n / accuracy``);
2. a second aggregate counts the rows of each *distinct* value inside the bracket, and all rows below it.
   Ties collapse before the shuffle, so a column of zeros and ones leaves two rows per group;
3. running counts over those few rows pick the middle one or two values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe
from ..session import cut_lineage

ACCURACY = 100_000


def exact_median(df: DataFrame, group_cols: Sequence[str], value_cols: Sequence[str],
                 accuracy: int = ACCURACY, suffix: str = "") -> DataFrame:
    """One row per group with the exact median of each value column (NULLs ignored).

    Without group columns there is always one row.  A column without values in a group has the median NULL.
    """
    groups, cols = list(group_cols), list(value_cols)
    base = cut_lineage(df.select(*groups, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)]))
    long = base.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(f"_c{i}").alias("_v")) for i in range(len(cols))])).alias("_x"))
    long = long.select(*groups, "_x._i", "_x._v").where(F.col("_v").isNotNull())
    keys = [*groups, "_i"]

    eps = 3.0 / accuracy
    span = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(
        "_v", [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)], accuracy).alias("_q"))
    rows = join_null_safe(long, span, keys).where(F.col("_v") <= F.col("_q")[1])
    inside = F.when(F.col("_v") >= F.col("_q")[0], F.col("_v"))          # NULL: below the bracket
    counts = rows.groupBy(*keys, "_n", inside.alias("_m")).agg(F.count(F.lit(1)).alias("_c"))

    upward = Window.partitionBy(*keys).orderBy(F.col("_m").asc_nulls_first())
    counts = counts.withColumn("_to", F.sum("_c").over(upward.rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank):
        hit = F.max(F.when((F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("_m")))
        return F.coalesce(hit, F.raise_error(F.lit("the bracket misses the middle ranks")).cast("double"))

    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    middle = counts.groupBy(*keys).agg(at(low).alias("_a"), at(high).alias("_b"))
    middle = middle.withColumn("_med", F.col("_a") + (F.col("_b") - F.col("_a")) / F.lit(2.0))
    wide = [F.max(F.when(F.col("_i") == i, F.col("_med"))).alias(c + suffix) for i, c in enumerate(cols)]
    if not groups:
        return middle.agg(*wide)
    # Every group has a row, also one whose columns are NULL throughout.
    out = base.select(*groups).distinct()
    return join_null_safe(out, middle.groupBy(*groups).agg(*wide), groups, "left")
