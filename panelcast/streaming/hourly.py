"""Streaming jobs.

T1 builds the hourly panel from a stream of raw events with a watermark and
tumbling one-hour windows (append mode: a window is emitted once the
watermark passes its end).  Out-of-order events count up to the watermark, repeated
events once, later ones are dropped and counted (``late_rows``).  At the end of the input the windows that the
watermark has not passed are read from the query's state (``unfinished_hours``), so emitted and
unfinished hours together are the panel of all events.
T2 evaluates new predictions incrementally in ``foreachBatch``: predictions are kept by day, and a micro-batch
reads and replaces the days it touches and no others, so a day that arrives in parts is scored on all of them,
replaying a batch changes nothing, and the cost of a batch does not grow with the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import hour_start
from ..operators.metrics import evaluate_online
from ..session import cut_lineage
from ..sources.sinks import table_exists
from ..sources.testdata import cents


def hourly_panel_stream(events: DataFrame, watermark: str = "2 hours", key: str = "event_type",
                        ts: str = "ts", value: str = "value", id_col: str | None = None) -> DataFrame:
    """Streaming ``(series_key, date_hour, y_cents, y, n_events)`` per event type and hour.

    Watermarks need a zoned ``TIMESTAMP``: the NTZ wall clock is mapped to
    the instant with the same UTC wall clock through microseconds since the
    epoch (independent of the session time zone), and the output hour is the
    NTZ hour itself, grouped alongside the window.  With ``id_col`` an event that arrives again within the
    watermark counts once.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    e = events.withColumns({"_ts": F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts))),
                            "_h": hour_start(F.col(ts))}).withWatermark("_ts", watermark)
    if id_col:
        e = e.dropDuplicatesWithinWatermark([id_col])
    agg = e.groupBy(F.col(key).alias("series_key"), F.window("_ts", "1 hour"), "_h").agg(
        F.sum(cents(F.col(value))).alias("_s"), F.count(F.col(value)).alias("_c"), F.count(F.lit(1)).alias("n_events"))
    return _hours(agg.withColumn("date_hour", F.col("_h")))


def _hours(sums: DataFrame) -> DataFrame:
    y_cents = F.floor(F.col("_s").cast("double") / F.col("_c").cast("double") + F.lit(0.5)).cast("bigint")
    return sums.select("series_key", "date_hour", y_cents.alias("y_cents"), (y_cents / F.lit(100.0)).alias("y"), "n_events")


def run_hourly_panel(events: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs ``hourly_panel_stream`` over all input there is, appends the finished hours to ``path`` and returns the ended query."""
    query = (hourly_panel_stream(events, **options).writeStream.outputMode("append").format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def unfinished_hours(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The hours that a stopped ``hourly_panel_stream`` query holds in its state: those the watermark has not passed.

    They are read by Spark's state reader and change nothing: when the query goes on, it will emit these hours itself.
    """
    operators = spark.read.format("state-metadata").option("path", checkpoint).load()
    found = operators.where("operatorName = 'stateStoreSave'").select("operatorId").first()   # the aggregation; a row an operator
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", int(found["operatorId"])).load()
    sums = F.col("value").cast("struct<_s:bigint,_c:bigint,n_events:bigint>")
    key = state.schema["key"].dataType.names[0]
    return _hours(state.select(F.col("key")[key].alias("series_key"), F.col("key._h").alias("date_hour"), sums.alias("v")).select(
        "series_key", "date_hour", "v.*"))


def late_rows(query: StreamingQuery) -> DataFrame:
    """``(batch, operator, n_late)``: rows that came after the watermark, by micro-batch (as far as the query's progress goes back).

    Where repeated events are dropped, that operator sees the events one by one; the aggregation sees partial sums.
    """
    rows = [(p["batchId"], o["operatorName"], o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"]]
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "batch bigint, operator string, n_late bigint")


def online_eval_batch(actuals: DataFrame, eval_path: str, pred_col: str = "pred",
                      strategy: str = "TwoStage_Stacking", store: str | None = None, key: str = "series_key",
                      time: str = "date_hour"):
    """A ``foreachBatch`` function: scores every day that a batch touches on all its predictions so far.

    Predictions are kept under ``store`` (default: next to the evaluations), a folder per day, the latest batch winning where a
    stamp was predicted twice.  A batch reads and rewrites its days there, then their ``date`` partitions of the
    evaluations; a replay, also after a crash in between, writes the same again.
    """
    store = store or eval_path.rstrip("/") + "_predictions"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut_lineage(batch.select(key, time, F.col(pred_col).cast("double").alias("pred"), F.lit(batch_id).cast("bigint").alias("batch"),
                                       F.to_date(time).alias("day")).where(F.col("day").isNotNull()))
        days = sorted(r["day"] for r in new.select("day").distinct().collect())       # the days of one micro-batch
        if not days:
            return
        folders = [f for f in (f"{store}/day={d}" for d in days) if table_exists(spark, f)]
        rows = new
        if folders:
            kept = spark.read.schema(new.schema).option("basePath", store).parquet(*folders)
            rows = new.unionByName(kept)
        last = F.max_by(F.struct("pred", "batch"), F.struct("batch", "pred")).alias("last")
        latest = cut_lineage(rows.groupBy(key, time, "day").agg(last).select(key, time, "last.pred", "last.batch", "day"))
        latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(store)
        within = F.to_date(time).between(F.lit(days[0]), F.lit(days[-1]))
        nothing = spark.createDataFrame([], f"{key} string, date date, eval_type string")
        scored = evaluate_online(latest, actuals.where(within), nothing, "pred", strategy, key, time)
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(eval_path)
    return run
