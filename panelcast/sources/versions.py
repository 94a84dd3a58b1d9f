"""Tables that change in one step (S7 on storage, published runs).

Data is written under a folder of its own first; then one small pointer file is replaced by a rename.  Readers follow the
pointer, so they see the table before or after a change, never a mixture, and a job that stops half way changes nothing.
One writer at a time; files that no version names any more stay until they are cleared by age.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EVAL_SCHEMA
from ..functions.exprs import join_null_safe
from ..session import cut_lineage
from .sinks import _file_system, _in_slice

POINTER = "_CURRENT"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Makes ``version`` the current one: the pointer is written beside the old one and renamed over it."""
    beside = f"{root}/{POINTER}-{uuid.uuid4().hex}"
    _write_text(spark, beside, version)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(beside), hadoop.Path(f"{root}/{POINTER}")
    over = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    qualified = _file_system(spark, beside)[0].makeQualified(source)
    hadoop.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(
        qualified, _file_system(spark, beside)[0].makeQualified(target), over)


def pointed(spark: SparkSession, root: str) -> str | None:
    """The current version, None before the first."""
    return _read_text(spark, f"{root}/{POINTER}")


def _partitions(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder of each partition (``eval_type=../date=..``) in the current version: one entry for a day and type."""
    version = pointed(spark, root)
    return {} if version is None else json.loads(_read_text(spark, f"{root}/manifests/{version}"))


def read_evaluations(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a versioned evaluation table."""
    folders = sorted(_partitions(spark, root).values())
    columns = [*(c.split()[0] for c in EVAL_SCHEMA.split(", ")), "series_key"]
    schema = f"{EVAL_SCHEMA}, series_key STRING"
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, version STRING").option("basePath", f"{root}/data").parquet(*folders).select(*columns)


def swap_slice(spark: SparkSession, root: str, new: DataFrame, start, end, eval_type: str = "backtest",
               keys=("series_key", "strategy")) -> str:
    """The slice ``[start, end)`` of ``eval_type`` becomes the rows that ``new`` has in it, in one step.

    Rows of ``new`` outside the slice replace the rows of the same day, type and ``keys``; so running twice is running once.
    Only the partitions of the slice and those of such rows are written.  Returns the new version.
    """
    old = _partitions(spark, root)
    version = uuid.uuid4().hex
    staged = cut_lineage(new)
    inside = _in_slice(start, end, eval_type)
    others = staged.where(~inside)
    rows = staged
    if others.take(1):
        days = others.select("eval_type", "date").distinct()
        kept = join_null_safe(read_evaluations(spark, root).where(~inside), days, ["eval_type", "date"], "left_semi")
        kept = join_null_safe(kept, others.select("eval_type", "date", *keys).distinct(), ["eval_type", "date", *keys], "left_anti")
        rows = staged.unionByName(kept, allowMissingColumns=True)
    folder = f"{root}/data/version={version}"
    rows.write.partitionBy("eval_type", "date").parquet(folder)
    fs, at = _file_system(spark, folder)
    new_parts = {}
    for kind in (s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()):
        for status in fs.listStatus(_file_system(spark, f"{folder}/{kind}")[1]):
            name = f"{kind}/{status.getPath().getName()}"
            new_parts[name] = f"{folder}/{name}"
    first, last = (str(spark.sql(f"SELECT DATE '{x}' AS d").first()["d"]) for x in (start, end))

    def replaced(name: str) -> bool:
        kind, day = (p.split("=", 1)[1] for p in name.split("/"))
        return kind == eval_type and first <= day < last
    manifest = {n: f for n, f in old.items() if not replaced(n)} | new_parts
    _write_text(spark, f"{root}/manifests/{version}", json.dumps(manifest))
    point_to(spark, root, version)
    return version


def staged_run(spark: SparkSession, root: str, run: str, stages) -> dict[str, DataFrame]:
    """Runs stages ``(name, function of the results so far)`` and publishes the run when all are written.

    Each result is written under the run's id; a stage counts as done when its files were committed.  Running again with
    the same id goes on after the last stage that is done.  Until the last step readers see the run published before.
    """
    done: dict[str, DataFrame] = {}
    for name, stage in stages:
        path = f"{root}/runs/{run}/{name}"
        fs, mark = _file_system(spark, f"{path}/_SUCCESS")
        if not fs.exists(mark):
            result = stage(done)
            result.write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
    point_to(spark, root, run)
    return done


def published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A result of the published run."""
    run = pointed(spark, root)
    return None if run is None else spark.read.parquet(f"{root}/runs/{run}/{name}")
