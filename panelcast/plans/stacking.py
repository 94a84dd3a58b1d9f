"""Two-stage stacking (M4, M8).

Stage 1: for each base model and each expanding time fold (``TimeSeriesSplit``
semantics from ``operators.folds.time_folds``) fit on the fold's training
rows, predict its validation rows (out-of-fold) and the test rows; test
predictions are averaged over the folds.  All fits of all training sets
are one plan (``plans.forests``).
Stage 2: a ridge meta model per series on the out-of-fold matrix, its
penalty chosen from 20 log-spaced values 1e-3..1e3 by 3 contiguous folds
(R²), applied to the averaged test predictions and clipped at 0.

``oof_mode='drop'`` (default) trains the meta model only on rows that were
validated; ``'zero'`` keeps the never-validated head with out-of-fold 0 like
the reference.  The meta fit runs per series in ``applyInPandas``; its input
is one training window (bounded).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import META_RIDGE_ALPHAS_RANGE, N_FOLDS
from ..functions.exprs import join_null_safe
from ..operators.folds import time_folds
from ..session import cut_lineage
from .forests import binned, fit_predict, tree_spec

BASE_KINDS = ("random_forest", "xgboost", "lightgbm")


def _ridge_fit(X, y, alpha):
    xm, ym = X.mean(axis=0), y.mean()
    Xc = X - xm
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ (y - ym))
    return w, ym - xm @ w


def _r2(y, p):
    sst = ((y - y.mean()) ** 2).sum()
    sse = ((y - p) ** 2).sum()
    if sst == 0:
        return 1.0 if sse == 0 else 0.0
    return 1.0 - sse / sst


def ridge_cv_alpha(X: np.ndarray, y: np.ndarray, alphas: np.ndarray, cv: int = 3) -> float:
    """Penalty with the best mean R² over ``cv`` contiguous folds (KFold without shuffling)."""
    n = len(y)
    if n < cv * 2:
        raise ValueError(f"choosing the penalty needs at least {cv * 2} validated rows, there are {n}")
    edges = [n // cv * i + min(i, n % cv) for i in range(cv + 1)]
    best, best_a = -np.inf, float(alphas[0])
    for a in alphas:
        scores = []
        for i in range(cv):
            te = np.arange(edges[i], edges[i + 1])
            tr = np.setdiff1d(np.arange(n), te)
            w, b = _ridge_fit(X[tr], y[tr], a)
            scores.append(_r2(y[te], X[te] @ w + b))
        if np.mean(scores) > best:
            best, best_a = float(np.mean(scores)), float(a)
    return best_a


def with_folds(train: DataFrame, test: DataFrame, k: int, key: str, time: str, by: Sequence[str]) -> DataFrame:
    """Training rows (``role='train'``) with the fold they validate, -1 before the first, and the test rows (``role='test'``)."""
    tr = time_folds(train, k, key, time, group_cols=by)
    fold = F.when(F.col("test_size") > 0, F.coalesce("fold", F.lit(-1)))
    tr = tr.withColumns({"fold": fold, "role": F.lit("train")}).drop("rn", "n_rows", "test_size")
    return tr.unionByName(test.withColumns({"fold": F.lit(None).cast("int"), "role": F.lit("test")}))


def stack(preds: DataFrame, actual: DataFrame, kinds: Sequence[str], by: Sequence[str], key: str, time: str,
          oof_mode: str = "drop") -> DataFrame:
    """Stacked predictions ``(by..., key, time, pred)`` from the fold models' predictions (``forests.fit_predict``).

    ``actual`` has ``by``, key, time and ``_y`` of the training rows.  The meta model of a training set and series is fitted in
    one task: a row per hour of one training window.
    """
    ids, kinds = [*by, key, time], list(kinds)
    # One row per (training set, series, hour): validated rows were predicted by one fold model, test rows by all.
    wide = preds.groupBy(*ids, "role").pivot("model", kinds).agg(F.avg("pred"))
    found = wide.where("role = 'train'").drop("role")
    if oof_mode == "zero":
        meta_tr = join_null_safe(actual, found, ids, "left").fillna(0.0, subset=kinds)
    else:
        meta_tr = join_null_safe(actual, found, ids)
    both = meta_tr.select(*ids, "_y", *kinds, F.lit("train").alias("_role")).unionByName(
        wide.where("role = 'test'").select(*ids, F.lit(None).cast("double").alias("_y"), *kinds, F.lit("test").alias("_role")))
    lo, hi, num = META_RIDGE_ALPHAS_RANGE
    alphas = np.logspace(lo, hi, int(num))

    def meta(pdf: pd.DataFrame) -> pd.DataFrame:
        trn = pdf[pdf["_role"] == "train"].sort_values(time)
        te = pdf[pdf["_role"] == "test"]
        if trn.empty or te.empty:
            return pd.DataFrame(columns=[*ids, "pred"])
        X, y = trn[kinds].to_numpy(float), trn["_y"].to_numpy(float)
        w, b = _ridge_fit(X, y, ridge_cv_alpha(X, y, alphas))
        out = te[ids].copy()
        out["pred"] = np.maximum(te[kinds].to_numpy(float) @ w + b, 0.0)
        return out

    schema = ", ".join(f"`{c}` {t}" for c, t in both.dtypes if c in ids) + ", pred double"
    return both.groupBy(*by, key).applyInPandas(meta, schema)


def stack_predict(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], target: str = "y",
                  kinds: Sequence[str] = BASE_KINDS, k: int = N_FOLDS, key: str = "series_key",
                  time: str = "date_hour", model_params: Mapping | None = None, oof_mode: str = "drop") -> DataFrame:
    """Stacked predictions ``(key, time, pred)`` for the test rows of one training frame."""
    cols = list(dict.fromkeys([key, time, target, *feature_cols]))
    tr = train.where(F.col(target).isNotNull()).select(*cols)
    if target not in test.columns:
        test = test.withColumn(target, F.lit(None).cast("double"))
    both = tr.withColumn("_set", F.lit(0)).unionByName(test.select(*cols).withColumn("_set", F.lit(1)))
    rows = cut_lineage(binned(both, feature_cols, [key, time], target))
    tr = rows.where("_set = 0").withColumn("_set", F.lit(0))
    folds = with_folds(tr, rows.where("_set = 1").withColumn("_set", F.lit(0)), k, key, time, ["_set"])
    specs = {kind: tree_spec(kind, (model_params or {}).get(kind)) for kind in kinds}
    preds = fit_predict(folds, specs, len(feature_cols), ["_set"], [key, time], target, {kind: range(k) for kind in kinds})
    actual = tr.select("_set", key, time, F.col(target).cast("double").alias("_y"))
    return stack(cut_lineage(preds), actual, kinds, ["_set"], key, time, oof_mode).drop("_set")
