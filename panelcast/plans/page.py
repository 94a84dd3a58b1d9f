"""Page forecast: a fitted model, kept with its fill policy, predicts future rows in another session."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import join_null_safe
from ..operators.metrics import daily_summary, feature_availability
from ..sources.scan import coerce_numeric
from ..sources.versions import _read_text, _write_text
from .models import FittedModel


def save_model(model: FittedModel, path: str, impute: str = "train_median") -> None:
    """The pipeline, the features, the training medians and scales, and the policy for gaps (``train_median`` or ``zero``)."""
    model.fill_values(impute)
    spark = model.scaler.sparkSession
    model.model.write().overwrite().save(f"{path}/pipeline")
    row = model.scaler.first().asDict()                                  # two numbers a feature
    _write_text(spark, f"{path}/model.json", json.dumps(
        {"kind": model.kind, "features": model.features, "fill": model.fill, "scaler": row, "impute": impute}))


def load_model(spark: SparkSession, path: str) -> tuple[FittedModel, str]:
    """The model and its policy for gaps."""
    text = _read_text(spark, f"{path}/model.json")
    if text is None:
        raise ValueError(f"there is no model at {path}")
    m = json.loads(text)
    names = list(m["scaler"])
    scaler = spark.createDataFrame([tuple(m["scaler"][n] for n in names)], ", ".join(f"`{n}` double" for n in names))
    return FittedModel(m["kind"], m["features"], PipelineModel.load(f"{path}/pipeline"), m["fill"], scaler), m["impute"]


def predict_page(spark: SparkSession, path: str, future: DataFrame, key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """``(key, time, predicted_price, day, hour)`` of future rows by the model kept at ``path``.

    Features are coerced to numbers (absent ones count as gaps), gaps are filled by the model's policy, predictions below 0
    become 0.
    """
    model, impute = load_model(spark, path)
    rows = future
    for c in model.features:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    pred = model.predict(coerce_numeric(rows, model.features), impute=impute).select(key, time, F.col("pred"))
    price = F.when(F.col("pred") < 0, F.lit(0.0)).otherwise(F.col("pred"))
    return pred.select(key, time, price.alias("predicted_price"), F.to_date(time).alias("day"), F.hour(time).alias("hour"))


def page_summary(pred: DataFrame, future: DataFrame, features: Sequence[str], key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """By series and day: mean, least and greatest prediction (A1) and the number of features that have a value (A10)."""
    there = feature_availability(future, features, key, time)
    n = sum((F.col(c).cast("int") for c in features), F.lit(0))
    days = daily_summary(pred, "predicted_price", key, time)
    return join_null_safe(days, there.select(key, F.col("date").alias("day"), n.cast("bigint").alias("n_features")), [key, "day"])
