"""Sinks (S4-S10) round trips and idempotent streaming online evaluation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.sources import sinks
from panelcast.streaming.hourly import online_eval_batch

EVAL_DDL = ("series_key string, date date, strategy string, rmse double, mape double, r2 double, "
            "eval_type string")


def test_append_overwrite_exists_csv(spark, tmp_path):
    path = str(tmp_path / "ev")
    assert not sinks.table_exists(spark, path)
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), "s", 1.0, 2.0, 0.5, "backtest")], EVAL_DDL)
    sinks.append(df, path, ("eval_type", "date"))
    sinks.append(df, path, ("eval_type", "date"))
    assert sinks.table_exists(spark, path) and spark.read.parquet(path).count() == 2
    sinks.overwrite(df, path, ("eval_type", "date"))
    assert spark.read.parquet(path).count() == 1
    csv = str(tmp_path / "csv")
    sinks.export_csv(df, csv)
    back = spark.read.option("header", True).csv(csv)
    assert back.columns == df.columns and back.count() == 1


def test_replace_slice_table_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "ev")
    old = spark.createDataFrame([("a", dt.date(2024, 1, d), "s", 1.0, 1.0, 1.0, "backtest") for d in range(1, 8)],
                                EVAL_DDL)
    sinks.overwrite(old, path, ("eval_type", "date"))
    new = old.where(F.col("date").between(dt.date(2024, 1, 2), dt.date(2024, 1, 3))).withColumn("rmse", F.lit(5.0))
    sinks.replace_slice_table(spark, path, new, "2024-01-02", "2024-01-06")
    once = sorted((r["date"], r["rmse"]) for r in spark.read.parquet(path).collect())
    sinks.replace_slice_table(spark, path, new, "2024-01-02", "2024-01-06")
    twice = sorted((r["date"], r["rmse"]) for r in spark.read.parquet(path).collect())
    assert once == twice
    assert [d.day for d, _ in once] == [1, 2, 3, 6, 7]


def test_fallback_source(spark):
    empty = spark.createDataFrame([], "x int")
    other = spark.createDataFrame([(1,)], "x int")
    assert sinks.with_fallback(empty, other).count() == 1
    assert sinks.with_fallback(None, other).count() == 1


def test_replace_slice_keeps_all_new_rows(spark, tmp_path):
    row = lambda d, kind, rmse: ("a", d and dt.date(2024, 1, d), "s", rmse, 1.0, 1.0, kind)
    old = spark.createDataFrame([row(1, "backtest", 1.0), row(3, "backtest", 1.0), row(None, "backtest", 1.0), row(3, "online", 1.0)], EVAL_DDL)
    new = spark.createDataFrame([row(3, "backtest", 2.0), row(9, "backtest", 2.0), row(3, "online", 2.0)], EVAL_DDL)
    kept = sinks.replace_slice(old, new, "2024-01-02", "2024-01-06")
    assert sorted((r["rmse"] for r in kept.collect())) == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]
    path = str(tmp_path / "ev")
    sinks.overwrite(old, path, ("eval_type", "date"))
    sinks.replace_slice_table(spark, path, new, "2024-01-02", "2024-01-06")
    assert sorted((r["rmse"] for r in spark.read.parquet(path).collect())) == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]


def test_a_failing_read_raises_and_leaves_the_table(spark, tmp_path):
    path = tmp_path / "broken"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"no parquet")
    assert sinks.table_exists(spark, str(path))
    with pytest.raises(Exception):
        sinks.with_fallback(spark.read.parquet(str(path)), spark.range(1)).collect()
    good = str(tmp_path / "ev")
    old = spark.createDataFrame([("a", dt.date(2024, 1, d), "s", 1.0, 1.0, 1.0, "backtest") for d in range(1, 8)], EVAL_DDL)
    sinks.overwrite(old, good, ("eval_type", "date"))
    bad = old.withColumn("rmse", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        sinks.replace_slice_table(spark, good, bad, "2024-01-02", "2024-01-06")
    assert spark.read.parquet(good).count() == 7


def test_missing_source_falls_back(spark, tmp_path):
    other = spark.createDataFrame([(1,)], "x int")
    fs = spark.read.schema("x int").parquet
    try:
        primary = fs(str(tmp_path / "nothing"))
    except Exception:
        primary = None
    assert sinks.with_fallback(primary, other).count() == 1


def test_create_evaluation_table(spark):
    spark.sql("DROP TABLE IF EXISTS ev_created")
    assert not sinks.table_exists(spark, "ev_created")
    sinks.create_evaluation_table(spark, "ev_created")
    sinks.create_evaluation_table(spark, "ev_created")
    assert sinks.table_exists(spark, "ev_created")
    assert {"date", "strategy", "rmse", "mape", "r2", "eval_type", "series_key"} == set(spark.table("ev_created").columns)
    spark.sql("DROP TABLE ev_created")


def test_online_eval_replay_and_split_days(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), float(h)) for h in range(48)]
    actuals = spark.createDataFrame(rows, "series_key string, date_hour timestamp_ntz, y double")
    preds = actuals.withColumn("pred", F.col("y") + F.when(F.hour("date_hour") < 10, 1.0).otherwise(3.0)).drop("y")
    fn = online_eval_batch(actuals, str(tmp_path / "ev"))
    early = F.hour("date_hour") < 10
    fn(preds.where(early), 0)
    fn(preds.where(~early), 1)       # the rest of both days
    fn(preds.where(~early), 1)       # a replay
    ev = spark.read.parquet(str(tmp_path / "ev")).collect()
    assert len(ev) == 2 and {r["eval_type"] for r in ev} == {"online"}
    whole = ((10 * 1.0 + 14 * 9.0) / 24) ** 0.5
    assert all(abs(r["rmse"] - whole) < 1e-9 for r in ev)
