"""Model fitting as Spark jobs.

Two execution styles, chosen by the size of a training set:

* **pooled MLlib fits** — one distributed estimator over a (possibly huge)
  training frame: random forest, two gradient-boosting presets and ridge
  (``LinearRegression`` with the normal-equation solver);
* **per-group closed-form ridge** — many small training sets (one per series
  and backtest origin, at most ``train_days * 24`` rows each) solved with
  numpy inside ``applyInPandas``; Spark shuffles and schedules the groups.

Scaling follows the reference: population (ddof=0) standardisation fitted on
the training rows only.  Missing feature values are filled with the training
median before fitting (MLlib vectors cannot hold NULL).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MODEL_DEFAULTS
from ..operators.selection import apply_standardizer, fit_standardizer
from ..operators.stats import exact_median
from ..session import cut_lineage

MAX_DEPTH = 30  # of an MLlib tree; also stands for "no limit"
MODEL_KINDS = ("random_forest", "ridge", "xgboost", "lightgbm")

# Parameters without an MLlib counterpart: accepted names, rejected values.
UNSUPPORTED = ("min_samples_split", "reg_alpha", "reg_lambda", "num_leaves")


def _merged(kind: str, params: Mapping | None) -> dict:
    if kind not in MODEL_DEFAULTS:
        raise ValueError(f"no model of kind {kind!r}; known: {sorted(MODEL_DEFAULTS)}")
    p = dict(MODEL_DEFAULTS[kind])
    p.update(params or {})
    bad = [k for k in UNSUPPORTED if k in p]
    if bad:
        raise ValueError(f"parameters without an MLlib counterpart: {bad}")
    return p


def make_estimator(kind: str, params: Mapping | None = None, features_col: str = "features",
                   label_col: str = "label", prediction_col: str = "pred"):
    """MLlib estimator for a reference model name (M2)."""
    p = _merged(kind, params)
    seed = int(p.get("random_state", 42))
    common = dict(featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col)
    if kind == "random_forest":
        depth = int(p.get("max_depth") or MAX_DEPTH)
        if depth > MAX_DEPTH:
            raise ValueError(f"max_depth is {MAX_DEPTH} at most")
        return RandomForestRegressor(numTrees=int(p["n_estimators"]), maxDepth=depth,
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                     featureSubsetStrategy="all", seed=seed, **common)
    if kind in ("xgboost", "lightgbm"):
        extra = {"minInstancesPerNode": int(p.get("min_samples_leaf", 20 if kind == "lightgbm" else 1))}
        if "subsample" in p:
            extra["subsamplingRate"] = float(p["subsample"])
        if "colsample_bytree" in p:
            extra["featureSubsetStrategy"] = str(float(p["colsample_bytree"]))
        return GBTRegressor(maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
                            stepSize=float(p["learning_rate"]), seed=seed, **extra, **common)
    # ridge: the penalty is set at fit time (it depends on the label spread and row count).
    return LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, **common)


class FittedModel:
    """A fitted pipeline plus the training statistics needed to apply it."""

    def __init__(self, kind, features, model: PipelineModel, fill: Mapping, scaler: DataFrame):
        self.kind, self.features, self.model = kind, list(features), model
        self.fill, self.scaler = dict(fill), scaler

    def fill_values(self, impute: str = "train_median") -> dict:
        """What gaps are filled with at predict time (P7: the training medians, P8: zero)."""
        if impute not in ("train_median", "zero"):
            raise ValueError(f"gaps are filled by 'train_median' or 'zero', not {impute!r}")
        return self.fill if impute == "train_median" else dict.fromkeys(self.features, 0.0)

    def prepare(self, df: DataFrame, impute: str = "train_median") -> DataFrame:
        filled = _filled(df, self.fill_values(impute))
        return apply_standardizer(filled, self.scaler, self.features).fillna(0.0, subset=self.features)

    def predict(self, df: DataFrame, out: str = "pred", impute: str = "train_median") -> DataFrame:
        return self.model.transform(self.prepare(df, impute)).drop("features").withColumnRenamed("pred", out)

    def importances(self) -> DataFrame:
        """Feature importances sorted descending (M3): tree importances or |coefficient|."""
        last = self.model.stages[-1]
        vals = (last.featureImportances.toArray() if hasattr(last, "featureImportances")
                else np.abs(last.coefficients.toArray()))
        spark = self.scaler.sparkSession
        pdf = pd.DataFrame({"feature": self.features, "importance": vals.astype(float)})
        return spark.createDataFrame(pdf).orderBy(F.col("importance").desc(), F.col("feature"))


def _filled(df: DataFrame, fill: Mapping) -> DataFrame:
    """NULLs filled with the training medians (two or three dozen numbers, held as literals)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in fill.items()})


def fit_model(train: DataFrame, kind: str, features: Sequence[str], target: str = "y",
              params: Mapping | None = None) -> FittedModel:
    """Fit one model on a training frame (M1 + M2): median fill, ddof=0 scaling, MLlib estimator."""
    features = list(features)
    tr = train.where(F.col(target).isNotNull())
    fill = exact_median(tr, [], features).first().asDict()
    filled = _filled(tr, fill)
    scaler = cut_lineage(fit_standardizer(filled, features))     # one row, read by every later use
    # A column with no training value at all has no median: it scales to the constant 0.
    prepared = apply_standardizer(filled, scaler, features).fillna(0.0, subset=features)
    est = make_estimator(kind, params)
    if kind == "ridge":
        # sklearn Ridge(alpha) on scaled X == MLlib normal equations with regParam = alpha * std_pop(y) / n.
        st = prepared.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("sy")).first()
        alpha = float(_merged(kind, params).get("alpha", 1.0))
        est = est.setRegParam(alpha * float(st["sy"] or 0.0) / max(int(st["n"]), 1))
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    label = prepared.withColumn("label", F.col(target).cast("double"))
    model = Pipeline(stages=[asm, est]).fit(label)
    return FittedModel(kind, features, model, fill, scaler)


# ------------------------------------------------------------------ per-group closed-form ridge
def ridge_solve(X: np.ndarray, y: np.ndarray, alpha: float):
    """Ridge with intercept on ddof=0-standardised X: returns (mu, sd, w, y_mean)."""
    med = np.zeros(X.shape[1])
    some = ~np.isnan(X).all(axis=0) if len(X) else np.zeros(X.shape[1], bool)   # a column without values is filled with 0
    med[some] = np.nanmedian(X[:, some], axis=0) if some.any() else 0.0
    Xf = np.where(np.isnan(X), med, X)
    mu = Xf.mean(axis=0)
    sd = Xf.std(axis=0)
    sd[sd == 0] = 1.0
    Z = (Xf - mu) / sd
    ym = y.mean()
    k = Z.shape[1]
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(k), Z.T @ (y - ym))
    return med, mu, sd, w, ym


def ridge_predict(X: np.ndarray, med, mu, sd, w, ym) -> np.ndarray:
    Xf = np.where(np.isnan(X), med, X)
    return ((Xf - mu) / sd) @ w + ym


def ridge_by_group(df: DataFrame, group_cols: Sequence[str], features: Sequence[str], target: str = "y",
                   role_col: str = "role", time: str = "date_hour", alpha: float = 1.0,
                   min_train_rows: int = 1, clip_low: float | None = None) -> DataFrame:
    """Fit one ridge per group on ``role='train'`` rows and predict its ``role='test'`` rows.

    Output ``(group_cols..., time, pred)``.  Each group is one training set
    (e.g. a series and a backtest origin), bounded by construction.
    """
    group_cols, features = list(group_cols), list(features)
    schema_fields = [f for f in df.schema.fields if f.name in group_cols]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema_fields)
    ddl += f", {time} timestamp_ntz, pred double"

    def fit_predict(pdf: pd.DataFrame) -> pd.DataFrame:
        tr = pdf[(pdf[role_col] == "train") & pdf[target].notna()]
        te = pdf[pdf[role_col] == "test"]
        if len(tr) < min_train_rows or te.empty:
            return pd.DataFrame(columns=[*group_cols, time, "pred"])
        X = tr[features].to_numpy(dtype=float)
        params = ridge_solve(X, tr[target].to_numpy(dtype=float), alpha)
        pred = ridge_predict(te[features].to_numpy(dtype=float), *params)
        if clip_low is not None:
            pred = np.maximum(pred, clip_low)
        out = te[[*group_cols, time]].copy()
        out["pred"] = pred
        return out

    cols = [*group_cols, time, role_col, target, *features]
    return df.select(*[F.col(c).cast("double") if c in features or c == target else F.col(c) for c in cols]) \
        .groupBy(*group_cols).applyInPandas(fit_predict, ddl)
