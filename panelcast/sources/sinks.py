"""Sinks and table maintenance.

Tables are parquet datasets (path or catalog table).  The evaluation table is
partitioned by ``(eval_type, date)`` so that replacing a backtest slice only
rewrites the partitions of that slice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EVAL_SCHEMA
from ..session import cut_lineage

#: Errors that mean "there is no such source"; any other error is raised.
MISSING = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    """A catalog table, or a dataset at a path (a folder that holds files).  Errors are raised."""
    if "/" not in name_or_path:
        return spark.catalog.tableExists(name_or_path)
    fs, at = _file_system(spark, name_or_path)
    return fs.exists(at) and len(fs.listStatus(at)) > 0


def create_evaluation_table(spark: SparkSession, name: str) -> None:
    """Create the evaluation table if missing, fixed schema, partitioned by (eval_type, date)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({EVAL_SCHEMA}, series_key STRING) USING parquet "
              "PARTITIONED BY (eval_type, date)")


def append(df: DataFrame, path: str, partition_by=()) -> None:
    """Append a result frame."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite(df: DataFrame, path: str, partition_by=()) -> None:
    """Drop and rebuild."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def replace_slice(old: DataFrame, new: DataFrame, start, end, eval_type: str = "backtest") -> DataFrame:
    """S7 as a DataFrame: rows of ``eval_type`` with ``start <= date < end`` go, all rows of ``new`` come.

    Stale days of the slice disappear even when the re-run yields fewer days; rows without a date or type stay.
    """
    return old.where(~_in_slice(start, end, eval_type)).unionByName(new, allowMissingColumns=True)


def _in_slice(start, end, eval_type: str):
    d = F.col("date")
    return F.coalesce((F.col("eval_type") == eval_type) & (d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")),
                      F.lit(False))


def replace_slice_table(spark: SparkSession, path: str, new: DataFrame, start, end,
                        eval_type: str = "backtest") -> None:
    """S7 on storage, partition by partition; the rest of the table is neither read nor written.

    ``new`` is staged in the checkpoint folder.  Its rows inside the slice overwrite their ``(eval_type, date)``
    partitions, days of the slice that it lacks are removed, and its rows outside the slice are appended.  A crash
    on the way leaves the other partitions as they were, and running again completes the replacement.
    """
    staged = cut_lineage(new)
    inside = _in_slice(start, end, eval_type)
    days = {r["date"] for r in staged.where(inside).select("date").distinct().collect()}  # at most the days of the slice
    staged.where(inside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("eval_type", "date").parquet(path)
    fs, at = _file_system(spark, f"{path}/eval_type={eval_type}")
    if fs.exists(at):
        first, last = (str(spark.sql(f"SELECT DATE '{x}' AS d").first()["d"]) for x in (start, end))
        for status in fs.listStatus(at):
            day = status.getPath().getName().removeprefix("date=")
            if first <= day < last and day not in {str(d) for d in days}:
                fs.delete(status.getPath(), True)
    outside = staged.where(~inside)
    if outside.take(1):
        append(outside, path, ("eval_type", "date"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def with_fallback(primary: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """``fallback`` when the primary source is None, empty or not there.  Other errors are raised."""
    if primary is None:
        return fallback
    try:
        return fallback if primary.isEmpty() else primary
    except AnalysisException as error:
        if (error.getCondition() or "").split(".")[0] in MISSING:
            return fallback
        raise
