"""Hyper-parameter search, model selection and single-model evaluation.

The points of a search over models of trees are one plan over shared, binned folds (``plans.forests``).  Single fits and
ridge are distributed MLlib jobs; candidates are submitted from a small thread pool so independent jobs overlap on the
cluster.  Folds are expanding time folds (never ``CrossValidator``'s k-fold, which would train on the future).
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_GRIDS, N_FOLDS, RIDGE_GRID_RANGE, SEARCH_BOUNDS, TRAIN_RATIO
from ..functions.exprs import join_null_safe
from ..operators.folds import chrono_split, fold_train_rows, time_folds
from ..session import cut_lineage
from ..operators.metrics import metrics
from ..operators.reshape import blend
from ..operators.stats import exact_median
from ..operators.selection import importance_cut, prune_correlated
from .forests import TREE_KINDS, binned, fit_predict, fold_errors, forest_importances, tree_spec
from .models import MODEL_KINDS, fit_model
from .stacking import with_folds

INT_PARAMS = {"n_estimators", "max_depth", "min_samples_leaf", "min_samples_split"}
#: Steps of the neighbourhood grid; 1 for the others.
STEPS = {"n_estimators": 20, "min_samples_split": 2}
#: Search parameters that trees grown level by level do not have; a search lists them instead of using them.
WITHOUT_COUNTERPART = ("num_leaves",)
#: Rows up to which MLlib grows the unlimited forest of the selection: the driver holds its nodes, some rows x trees of them.
FOREST_ROWS = 1 << 12
DEFAULT_GRIDS = DEFAULT_GRIDS | {"ridge": {"alpha": list(np.logspace(*RIDGE_GRID_RANGE[:2], RIDGE_GRID_RANGE[2]))}}


def folded(df: DataFrame, target: str = "y", k: int = N_FOLDS, key: str = "series_key", time: str = "date_hour") -> DataFrame:
    """Rows with a target and their fold, materialised: every point of a search reads the same folds."""
    return cut_lineage(time_folds(df.where(F.col(target).isNotNull()), k, key, time))


def fold_rmse(f: DataFrame, kind: str, params: Mapping, features: Sequence[str], target: str = "y",
              k: int = N_FOLDS) -> float:
    """Mean validation RMSE over ``k`` expanding time folds of a ``folded`` frame (fits see only earlier rows)."""
    scores = []
    for i in range(k):
        tr = f.where(fold_train_rows(i, k))
        va = f.where(F.col("fold") == i)
        m = fit_model(tr, kind, features, target, params)
        r = metrics(m.predict(va).withColumn("_g", F.lit(1)), ["_g"], target, "pred").first()
        if r is None:
            raise ValueError(f"fold {i} has no row to validate on; use fewer folds or more rows")
        scores.append(float(r["rmse"]))
    return float(np.mean(scores))


def grid_search(df: DataFrame, kind: str, features: Sequence[str], grid: Mapping | None = None, target: str = "y",
                k: int = N_FOLDS, parallelism: int = 2, base_params: Mapping | None = None) -> DataFrame:
    """Score every grid point with time folds (M10); rows ``(model, params, rmse)`` sorted by RMSE."""
    points = points_of(grid or DEFAULT_GRIDS[kind])
    if kind in TREE_KINDS:
        full = [{**(base_params or {}), **p} for p in points]
        scores = tree_scores(binned_folds(df, features, target, k), {str(i): (kind, p) for i, p in enumerate(full)}, len(features), target, k)
        rows = [(kind, json.dumps(p, sort_keys=True, default=float), scores[str(i)]) for i, p in enumerate(full)]
        return df.sparkSession.createDataFrame(rows, "model string, params string, rmse double").orderBy(
            F.col("rmse").asc_nulls_last(), "params")
    folds = df if "n_rows" in df.columns and "fold" in df.columns else folded(df, target, k)

    def score(p):
        full = {**(base_params or {}), **p}
        return kind, json.dumps(full, sort_keys=True, default=float), fold_rmse(folds, kind, full, features, target, k)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rows = list(ex.map(score, points))
    return df.sparkSession.createDataFrame(rows, "model string, params string, rmse double").orderBy(
        F.col("rmse").asc_nulls_last(), "params")


def random_points(kind: str, n: int, seed: int = 42) -> list[dict]:
    """Seeded random sample of the search bounds (stands in for the guided search)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p = {}
        for name, (lo, hi) in SEARCH_BOUNDS[kind].items():
            v = rng.uniform(lo, hi)
            if name not in WITHOUT_COUNTERPART:
                p[name] = int(v) if name in INT_PARAMS else float(v)
        out.append(p)
    return out


def neighbourhood(kind: str, best: Mapping) -> dict:
    """One step around a point in each whole-numbered parameter, clipped to the bounds (forest: 20 trees, 2 rows to split)."""
    grid = {}
    for name, (lo, hi) in SEARCH_BOUNDS[kind].items():
        if name in best:
            v, step = best[name], STEPS.get(name, 1)
            grid[name] = sorted({max(int(lo), int(v) - step), int(v), min(int(hi), int(v) + step)}) if name in INT_PARAMS else [v]
    return grid


def points_of(grid: Mapping) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]


def binned_folds(df: DataFrame, features: Sequence[str], target: str = "y", k: int = N_FOLDS, key: str = "series_key",
                 time: str = "date_hour") -> DataFrame:
    """Rows with a target, binned once and with their folds: every point of a search reads this table."""
    rows = binned(df.where(F.col(target).isNotNull()).select(*dict.fromkeys([key, time, target, *features])), features, [key, time], target)
    return cut_lineage(with_folds(rows, rows.limit(0), k, key, time, []).withColumn("_set", F.lit(0)))


def tree_scores(folds: DataFrame, points: Mapping[str, tuple[str, Mapping]], n_features: int, target: str = "y", k: int = N_FOLDS,
                key: str = "series_key", time: str = "date_hour") -> dict[str, float]:
    """Mean validation RMSE of every named point (kind, params); all points and folds are fitted in one plan."""
    specs = {name: tree_spec(kind, params) for name, (kind, params) in points.items()}
    errors = fold_errors(folds, specs, n_features, target, k)
    if errors is None:      # a training set beyond one task
        preds = fit_predict(folds, specs, n_features, ["_set"], [key, time], target, {name: range(k) for name in specs})
        rows = join_null_safe(preds, folds.select(key, time, F.col(target).cast("double").alias("_y")), [key, time])
        errors = rows.groupBy("model", "variant").agg(F.avg((F.col("pred") - F.col("_y")) ** 2).alias("error"))
    rmse = errors.withColumn("rmse", F.sqrt("error"))
    found: dict = {}
    for r in rmse.orderBy("model", "variant").collect():                                     # one row a point and fold
        found.setdefault(r["model"], []).append(r["rmse"])
    if any(len(found.get(name, ())) < k for name in points):
        raise ValueError("a fold has no row to learn from or to validate on; use fewer folds or more rows")
    return {name: math.fsum(found[name]) / k for name in points}


def feature_selection_pipeline(df: DataFrame, features: Sequence[str], target: str = "y", keep: float = 0.5,
                               limit: float = 0.95, threshold="median", params: Mapping | None = None,
                               seed: int = 42) -> DataFrame:
    """Two-stage selection (M9 then M7): correlation pruning, then the random-forest + boosting
    importance cut.  Output ``(feature, importance, selected)`` for the stage-1 survivors."""
    pr = prune_correlated(df, target, features, keep, limit)
    stage1 = [r["feature"] for r in pr.where(~F.col("dropped")).orderBy("rank").collect()]
    imps = []
    for kind in ("random_forest", "xgboost"):
        # An unlimited forest and the boosting library's own step and depth, not the page's defaults.
        own = {"max_depth": None} if kind == "random_forest" else {"max_depth": 6, "learning_rate": 0.3}
        p = {"n_estimators": 100, "random_state": seed, **own, **((params or {}).get(kind) or {})}
        found = large_forest_importances(df, stage1, target, p) if kind == "random_forest" else None
        if found is None:
            found = fit_model(df, kind, stage1, target, p).importances()
        imps.append(found.withColumn("model", F.lit(kind)))
    return importance_cut(imps[0].unionByName(imps[1]), threshold)


def large_forest_importances(df: DataFrame, features: Sequence[str], target: str, params: Mapping) -> DataFrame | None:
    """(feature, importance) of a forest on more than FOREST_ROWS rows, its trees dealt to tasks (``plans.forests``); None if there are fewer.

    Gaps are filled with the median as in ``fit_model``.  The trees' draws come from hashes of whole rows.
    """
    whole = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).alias("_row")
    rows = df.where(F.col(target).isNotNull()).select(whole, target, *features)
    if rows.count() <= FOREST_ROWS:
        return None
    fill = exact_median(rows, [], features).first().asDict()
    filled = cut_lineage(rows.select("_row", target, *[
        F.coalesce(F.col(c).cast("double"), F.lit(fill[c]).cast("double"), F.lit(0.0)).alias(c) for c in features]))
    return forest_importances(cut_lineage(binned(filled, features, ["_row"], target)), tree_spec("random_forest", params), features, target)


def halving(folds: DataFrame, points: Mapping[str, tuple[str, dict]], n_features: int, shares: Sequence[float], target: str = "y",
            k: int = N_FOLDS, key: str = "series_key", time: str = "date_hour") -> list[tuple[int, str, str, dict, int, float]]:
    """Successive halving: (round, name, kind, params, trees, rmse) of every fit.

    Round i gives each point that is left ``shares[i]`` of its trees; then the better half of each kind stays (ties by name).
    The budget follows from the points and shares: points x (share + share / 2 + ...) of full fits.
    """
    out, left = [], dict(points)
    for i, share in enumerate(shares):
        tries = {name: (kind, {**p, "n_estimators": max(1, math.ceil(share * p["n_estimators"]))}) for name, (kind, p) in left.items()}
        scores = tree_scores(folds, tries, n_features, target, k, key, time)
        out += [(i, name, *left[name], tries[name][1]["n_estimators"], scores[name]) for name in left]
        for kind in {kind for kind, _ in left.values()}:
            own = sorted((n for n in left if left[n][0] == kind), key=lambda n: (scores[n], n))
            for name in own[math.ceil(len(own) / 2):] if i < len(shares) - 1 else ():
                del left[name]
    return out


def tune_once(df: DataFrame, start, end, features: Sequence[str], target: str = "y", kinds: Sequence[str] = TREE_KINDS,
              n_points: int = 8, shares: Sequence[float] = (0.25, 0.5, 1.0), seed: int = 42, k: int = N_FOLDS,
              key: str = "series_key", time: str = "date_hour", select: bool = True) -> DataFrame:
    """One tuning job over ``[start, end)`` (M11) as one table (item, model, round, name, value, chosen).

    * ``feature``: the two-stage selection (``select=False``: all features stay), value = importance;
    * ``search``: ``n_points`` seeded random points a model, by successive halving over shared, pre-binned folds;
    * ``grid``: for the forest, one step around its best point in depth, rows to split and rows in a leaf (halving again), then in
      the number of trees;
    * ``without_counterpart``: search parameters that these models do not have.

    ``name`` holds the feature or the parameters (JSON), ``value`` the mean validation RMSE, ``chosen`` marks the features kept and the
    best parameters of each model.  The same input and seed give the same table.
    """
    w = df.where((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz"))
                 & F.col(target).isNotNull())
    rows, selected = [], list(features)
    if select:
        cut = feature_selection_pipeline(w, features, target, seed=seed).orderBy(F.col("importance").desc(), "feature").collect()
        selected = [r["feature"] for r in cut if r["selected"]]
        rows += [("feature", None, None, r["feature"], float(r["importance"]), bool(r["selected"])) for r in cut]
    folds = binned_folds(w, selected, target, k, key, time)
    base = {"random_state": seed}
    name = lambda p: json.dumps(p, sort_keys=True, default=float)
    points = {f"{kind} {i:03d}": (kind, {**p, **base}) for kind in kinds for i, p in enumerate(random_points(kind, n_points, seed))}
    fits = [("search", f) for f in halving(folds, points, len(selected), shares, target, k, key, time)]

    def best_of(kind):
        full = [(f[5], name(f[3])) for _, f in fits if f[2] == kind and f[4] == f[3]["n_estimators"]]
        return min(full)[1]

    if "random_forest" in kinds:
        for varied in (("max_depth", "min_samples_split", "min_samples_leaf"), ("n_estimators",)):
            best = json.loads(best_of("random_forest"))
            grid = {n: v if n in varied else [best[n]] for n, v in neighbourhood("random_forest", best).items()}
            near = {f"grid {i:03d}": ("random_forest", {**p, **base}) for i, p in enumerate(points_of(grid))}
            fits += [("grid", f) for f in halving(folds, near, len(selected), shares if len(varied) > 1 else (1.0,), target, k, key, time)]
    winners = {(kind, best_of(kind)) for kind in kinds}
    taken = set()
    for item, (i, _, kind, p, trees, rmse) in fits:
        won = trees == p["n_estimators"] and (kind, name(p)) in winners and (kind, name(p)) not in taken
        taken |= {(kind, name(p))} if won else set()
        rows.append((item, kind, i, name(p), rmse, won))
    rows += [("without_counterpart", kind, None, n, None, False) for kind in kinds for n in SEARCH_BOUNDS[kind] if n in WITHOUT_COUNTERPART]
    return df.sparkSession.createDataFrame(rows, "item string, model string, round int, name string, value double, chosen boolean")


def chosen_params(tuned: DataFrame) -> dict[str, dict]:
    """The best parameters of each model of a ``tune_once`` table."""
    return {r["model"]: json.loads(r["name"]) for r in tuned.where("chosen and model is not null").collect()}


def train_eval(df: DataFrame, kind: str, features: Sequence[str], target: str = "y", params: Mapping | None = None,
               ratio: float = TRAIN_RATIO, key: str = "series_key", time: str = "date_hour"):
    """Single-model train/evaluate on a chronological split (M17): metrics by split, model, predictions."""
    sp = chrono_split(df.where(F.col(target).isNotNull()), ratio, key, time)
    tr = sp.where(F.col("split") == "train")
    m = fit_model(tr, kind, features, target, params)
    pred = m.predict(sp)
    return metrics(pred, ["split"], target, "pred"), m, pred


def auto_select(df: DataFrame, features: Sequence[str], target: str = "y", kinds: Sequence[str] = MODEL_KINDS,
                ratio: float = TRAIN_RATIO, key: str = "series_key", time: str = "date_hour",
                params: Mapping | None = None, parallelism: int = 2):
    """Fit every model type, add simple and inverse-RMSE blends, rank by test RMSE.

    Returns ``(leaderboard DataFrame (candidate, split, n, rmse, mape, r2), best candidate name)``.
    A model type that fails keeps a row in the leaderboard: no metrics, and the error as its ``split``.
    """
    sp = chrono_split(df.where(F.col(target).isNotNull()), ratio, key, time)
    tr = sp.where(F.col("split") == "train")

    def one(kind):
        try:
            m = fit_model(tr, kind, features, target, (params or {}).get(kind))
            return kind, m.predict(sp).select(key, time, "split", target, F.lit(kind).alias("strategy"), "pred")
        except Exception as error:  # noqa: BLE001 - a failing candidate does not stop the others; it is reported
            return kind, f"failed: {type(error).__name__}: {error}"[:300]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        done = list(ex.map(one, kinds))
    failed = [(k, p) for k, p in done if isinstance(p, str)]
    fitted = [(k, p) for k, p in done if not isinstance(p, str)]
    if not fitted:
        raise ValueError(f"no model type could be fitted: {failed}")
    long = fitted[0][1]
    for _, p in fitted[1:]:
        long = long.unionByName(p)
    per_model = metrics(long, ["strategy", "split"], target, "pred")
    test_rmse = per_model.where(F.col("split") == "test").select("strategy", "rmse")
    ids = [key, time, "split", target]
    simple = blend(long, "mean", ids=ids).withColumn("strategy", F.lit("ensemble_simpleavg"))
    weighted = blend(long, "weighted", weights=test_rmse, ids=ids).withColumn("strategy", F.lit("ensemble_weighted"))
    blends = simple.unionByName(weighted)
    board = per_model.unionByName(metrics(blends, ["strategy", "split"], target, "pred"))
    board = board.withColumnRenamed("strategy", "candidate")
    if failed:
        board = board.unionByName(df.sparkSession.createDataFrame(failed, "candidate string, split string"),
                                  allowMissingColumns=True)
    best = board.where(F.col("split") == "test").orderBy(F.col("rmse").asc_nulls_last(), "candidate").first()
    return board, (best["candidate"] if best else None)
