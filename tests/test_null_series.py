"""A NULL series is a series like any other: it gets the answers that it would get under a name."""

import datetime as dt
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelcast.operators import metrics as M
from panelcast.operators.clean import impute_train_median, pred_best
from panelcast.operators.folds import chrono_split, rolling_origins, time_folds
from panelcast.operators.future import build_future_features, future_timeline
from panelcast.operators.reshape import blend
from panelcast.operators.selection import apply_standardizer, fit_standardizer
from panelcast.operators.windows import add_history_stats, leakage_check
from panelcast.plans.backtest import backtest_predictions, forecast

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def panel(spark, name):
    rng = random.Random(2)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(rng.randrange(1, 90)), rng.random(), rng.choice([None, 1.0, 2.5]))
            for s in ("a", "NULL") for h in range(24 * 11)]
    rows = [(name if s == "NULL" else s, *r) for s, *r in rows]
    return spark.createDataFrame(rows, "series_key string, date_hour timestamp_ntz, y double, f double, g double").repartition(3)


def predictions(df):
    return df.select("series_key", "date_hour", F.explode(F.array(F.lit("p"), F.lit("q"))).alias("strategy"), "y", "f").select(
        "series_key", "date_hour", "strategy", (F.col("y") + F.when(F.col("strategy") == "p", F.col("f")).otherwise(2.0)).alias("pred"))


def split(df):
    return df.where("date_hour < '2024-01-10'"), df.where("date_hour >= '2024-01-10'")


def weights(df):
    return predictions(df).groupBy("series_key", "strategy").agg(F.lit(2.0).alias("rmse")).withColumn(
        "rmse", F.when(F.col("strategy") == "p", F.col("rmse")).otherwise(5.0))


def done(df):
    return df.select("series_key", F.to_date("date_hour").alias("date")).where("date < '2024-01-08'").distinct().withColumn("eval_type", F.lit("online"))


OPERATORS = {
    "join_actuals": lambda d: M.join_actuals(predictions(d), d),
    "unevaluated": lambda d: M.unevaluated(predictions(d), done(d)),
    "evaluate_online": lambda d: M.evaluate_online(predictions(d).where("strategy = 'p'"), d, done(d)),
    "evaluate_columns": lambda d: M.evaluate_columns(d.withColumn("p", F.col("y") + 1), d, ["p"]),
    "histogram": lambda d: M.histogram(d, "y", 10),
    "profile": lambda d: M.profile(d),
    "best_strategy": lambda d: pred_best(
        d.select("series_key", "date_hour", F.lit(1.0).alias("pred_xgboost"), F.lit(2.0).alias("pred_lightgbm")),
        d.select("series_key").distinct().withColumn("strategy", F.lit("LightGBM")), default="XGBoost"),
    "blend_weighted": lambda d: blend(predictions(d), "weighted", weights(d)),
    "standardize": lambda d: apply_standardizer(d, fit_standardizer(d, ["f"], ["series_key"]), ["f"], ["series_key"]),
    "impute": lambda d: impute_train_median(split(d)[0], [split(d)[1]], ["g"])[1],
    "chrono_split": lambda d: chrono_split(d),
    "time_folds": lambda d: time_folds(d),
    "rolling_origins": lambda d: rolling_origins(d, "2024-01-09", "2024-01-12", 3),
    "history": lambda d: add_history_stats(d, "y"),
    "future_timeline": lambda d: future_timeline(d, 1),
    "future_features": lambda d: build_future_features(split(d)[1].select("series_key", "date_hour"), split(d)[0], "y"),
    "backtest": lambda d: backtest_predictions(add_history_stats(d, "y"), "2024-01-09", "2024-01-12", ["naive_2d", "ridge"], ["f", "g"], "y"),
    "forecast": lambda d: forecast(*split(d), ["ridge"], ["f", "g"], "y",
                                   best=d.select("series_key").distinct().withColumn("strategy", F.lit("ridge"))).drop("created_at"),
}


def rows_of(df):
    cols = sorted(df.columns)
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple("NULL" if c == "series_key" and r[c] in (None, "x") else show(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_series_like_a_named_one(spark, name):
    null, named = (rows_of(OPERATORS[name](panel(spark, s))) for s in (None, "x"))
    assert null and null == named
    assert any("NULL" in r for r in null)


def test_leakage_check_counts_the_null_series(spark):
    null, named = (rows_of(leakage_check(panel(spark, s), "2024-01-10", "y")) for s in (None, "x"))
    assert null == named and all(48 in r for r in null)


@pytest.mark.parametrize("missing", ["ahocorasick", "public_tokenizers", "panelcast.llm", "corpus_pipeline"])
def test_entry_imports_without_the_training_data_part(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None\n"
            "import __spark_entry__ as e\n"
            "q = e.queries(); assert 'all_features' in q and len(q) > 80 and not any(k.startswith('op') for k in q)\n"
            "assert set(e.oracle_sql()) <= set(q) and callable(e.entry)")
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, timeout=120)
