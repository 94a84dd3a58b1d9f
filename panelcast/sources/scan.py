"""Panel scans.

A *panel* is a DataFrame ``(series_key, date_hour, <target>, <features>...)``
with ``date_hour`` as ``TIMESTAMP_NTZ`` and one row per series and time.
The scan is lazy: the time slice and the column list reach the reader, so
parquet min/max statistics (or a JDBC ``WHERE``) prune the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import to_double


def read_source(spark: SparkSession, source, fmt: str = "parquet", options: Mapping | None = None) -> DataFrame:
    """A DataFrame, a catalog table name, or a path/JDBC source with reader options."""
    if isinstance(source, DataFrame):
        return source
    options = dict(options or {})
    if fmt == "table":
        return spark.read.table(source)
    if fmt == "jdbc":
        # Partitioned JDBC read: caller passes url/dbtable (or query) and, for
        # parallel reads, partitionColumn/lowerBound/upperBound/numPartitions.
        return spark.read.format("jdbc").options(**options).load()
    return spark.read.format(fmt).options(**options).load(source)


def to_ntz(c):
    """Strip a zone by keeping the wall clock (S3); NTZ input passes through."""
    return c.cast("timestamp_ntz")


def time_slice(df: DataFrame, start=None, end=None, time_col: str = "date_hour") -> DataFrame:
    """Half-open slice ``start <= t < end``; each bound optional.

    The bounds (wall clock) take the column's type, so the column itself is compared and the filter reaches the reader.
    """
    t = F.col(time_col)
    kind = df.schema[time_col].dataType.simpleString()
    bound = lambda x: F.lit(x).cast("timestamp_ntz").cast(kind if kind == "timestamp" else "timestamp_ntz")
    if start is not None:
        df = df.where(t >= bound(start))
    if end is not None:
        df = df.where(t < bound(end))
    return df


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``try_cast(c as double)`` for every listed column that exists (P3); absent ones are ignored."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_double(F.col(c)) for c in present}) if present else df


def add_missing(df: DataFrame, columns: Iterable[str], dtype: str = "double") -> DataFrame:
    """Add absent columns as typed NULLs so train and test frames share a schema."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(dtype) for c in missing}) if missing else df


def scan_panel(spark: SparkSession, source, *, key: str | None = "series_key", time: str = "date_hour",
               target: str | None = "y", features: Iterable[str] = (), start=None, end=None,
               fmt: str = "parquet", options: Mapping | None = None, coerce: bool = True) -> DataFrame:
    """Column-pruned, time-sliced panel scan.

    The filter is applied on the raw time column before any projection so it
    is pushed into the reader; only ``key, time, target, features`` are read.
    A source without a key column becomes a single series ``'all'``.
    """
    raw = read_source(spark, source, fmt, options)
    raw = time_slice(raw, start, end, time)
    raw = raw.withColumn(time, to_ntz(F.col(time)))
    feats = list(features)
    cols = [F.col(key).cast("string").alias("series_key") if key and key in raw.columns
            else F.lit("all").alias("series_key"),
            F.col(time).alias("date_hour")]
    if target:
        cols.append(F.col(target))
    cols += [F.col(c) for c in feats if c in raw.columns]
    out = raw.select(*cols)
    if coerce:
        out = coerce_numeric(out, ([target] if target else []) + feats)
    return add_missing(out, feats)
