"""Tuning, versioned tables and the batch job."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.plans import batch, forests, tuning
from panelcast.plans.batch import batch_job
from panelcast.plans.tuning import chosen_params, grid_search, tune_once
from panelcast.sources.versions import pointed, published, read_evaluations, staged_run, swap_slice

from .test_many_models import FEATURES, panel

SCHEMA = "series_key string, date date, strategy string, rmse double, mape double, r2 double, eval_type string"


# --- tuning ------------------------------------------------------------------------------------------------------------

def test_tune_once_finds_a_planted_point_and_repeats(spark, monkeypatch):
    good = {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.3}
    bad = [{"n_estimators": 12, "max_depth": 3, "learning_rate": 0.001 * (i + 1)} for i in range(3)]
    monkeypatch.setattr(tuning, "random_points", lambda kind, n, seed: [*bad[:2], dict(good), bad[2]])
    df = panel(spark, days=8)
    run = lambda d: tune_once(d, "2024-01-01", "2024-01-08", FEATURES, "y", ["xgboost"], select=False, shares=(0.5, 1.0))
    rows = run(df).collect()
    won = [json.loads(r["name"]) for r in rows if r["chosen"]]
    assert won == [{**good, "random_state": 42}] and chosen_params(run(df)) == {"xgboost": won[0]}
    search = [r for r in rows if r["item"] == "search"]
    assert [r["round"] for r in search] == [0] * 4 + [1] * 2        # halved
    assert rows == run(df.repartition(7)).collect()
    assert all(r["value"] > 0 for r in search)


def test_tune_once_of_all_kinds_with_the_forest_grid(spark, monkeypatch):
    monkeypatch.setattr(tuning, "SEARCH_BOUNDS", {k: {**v, "n_estimators": (3, 6), "max_depth": (2, 4)} for k, v in tuning.SEARCH_BOUNDS.items()})
    df = panel(spark, days=7)
    out = tune_once(df, "2024-01-01", "2024-01-07", FEATURES, "y", n_points=2, select=False, shares=(1.0,))
    rows = out.collect()
    assert {r["item"] for r in rows} == {"search", "grid", "without_counterpart"}
    assert [r["name"] for r in rows if r["item"] == "without_counterpart"] == ["num_leaves"]
    params = chosen_params(out)
    assert set(params) == {"random_forest", "xgboost", "lightgbm"}
    forest = [r for r in rows if r["model"] == "random_forest"]
    assert min(forest, key=lambda r: (r["value"], r["name"]))["value"] == next(r["value"] for r in forest if r["chosen"])
    assert {json.loads(r["name"])["n_estimators"] for r in forest if r["item"] == "grid"} >= {3, 6}


def test_grid_search_of_trees_is_one_plan(spark):
    df = panel(spark, days=7)
    out = grid_search(df, "xgboost", FEATURES, {"max_depth": [1, 3], "learning_rate": [0.01, 0.3]}, base_params={"n_estimators": 8}).collect()
    assert len(out) == 4 and json.loads(out[0]["params"])["learning_rate"] == 0.3
    assert [r["rmse"] for r in out] == sorted(r["rmse"] for r in out)
    with pytest.raises(ValueError):
        grid_search(df.limit(2), "xgboost", FEATURES, {"max_depth": [1]}, base_params={"n_estimators": 2})


def test_points_of_a_search_share_their_trees():
    rng = np.random.default_rng(5)
    bins = np.column_stack([rng.integers(0, 20, 300), rng.integers(0, 5, 300)]).astype(np.uint8)
    y, rid = (1000 * bins[:, 0].astype(np.int64) * (bins[:, 1] + 1) + rng.integers(-900, 900, 300)), rng.integers(0, 1 << 60, 300)
    forest = [{"n_estimators": n, "max_depth": d, "min_samples_split": s} for n in (2, 5) for d in (1, 3, 6) for s in (2, 25)]
    for kind, points in (("random_forest", forest), ("xgboost", [{"n_estimators": n, "max_depth": 3, "subsample": 0.7} for n in (1, 4)])):
        specs = {str(i): forests.tree_spec(kind, p) for i, p in enumerate(points)}
        assert len({forests.shared_trees(s) for s in specs.values()}) == 1
        found = forests.predictions_shared(specs, bins[:200], y[:200], rid[:200], bins[200:])
        for name, spec in specs.items():
            alone = forests.fit_trees(spec, bins[:200], y[:200], rid[:200]).predict(spec, bins[200:])
            assert (found[name] == alone).all()


def test_scores_of_a_search_equal_those_of_one_fit_a_point(spark, monkeypatch):
    folds = tuning.binned_folds(panel(spark, days=6), FEATURES, "y")
    points = {f"{kind} {d}": (kind, {"n_estimators": 3, "max_depth": d}) for kind in ("random_forest", "xgboost") for d in (2, 4)}
    scores = tuning.tree_scores(folds, points, len(FEATURES), "y")
    assert scores == tuning.tree_scores(folds.repartition(5), points, len(FEATURES), "y")
    monkeypatch.setattr(tuning, "fold_errors", lambda *a: None)
    assert scores == pytest.approx(tuning.tree_scores(folds, points, len(FEATURES), "y"), rel=1e-12)


def test_selection_of_many_rows_grows_its_forest_in_tasks(spark, monkeypatch):
    def small_only(df, kind, *rest):
        assert kind != "random_forest"
        return fit_model(df, "xgboost", *rest[:2], {"n_estimators": 2, "max_depth": 2})

    fit_model = tuning.fit_model
    monkeypatch.setattr(tuning, "fit_model", small_only)
    monkeypatch.setattr(tuning, "FOREST_ROWS", 100)
    df = panel(spark, days=6)
    p = {"n_estimators": 9, "max_depth": None, "random_state": 42}
    found = {r["feature"]: r["importance"] for r in tuning.large_forest_importances(df, FEATURES, "y", p).collect()}
    assert sum(found.values()) == pytest.approx(1) and max(found, key=found.get) == "c"
    assert found == {r["feature"]: r["importance"] for r in tuning.large_forest_importances(df.repartition(7), FEATURES, "y", p).collect()}
    cut = tuning.feature_selection_pipeline(df, FEATURES, "y", keep=1.0).collect()
    assert {r["feature"] for r in cut if r["selected"]} >= {"c"}
    monkeypatch.setattr(tuning, "FOREST_ROWS", 10_000)
    assert tuning.large_forest_importances(df, FEATURES, "y", p) is None


# --- versions ----------------------------------------------------------------------------------------------------------

def evaluations(spark, days, rmse, eval_type="backtest", strategy="naive", series="s"):
    rows = [(series, dt.date(2024, 1, d), strategy, rmse, 1.0, None, eval_type) for d in days]
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted((str(r["series_key"]), str(r["date"]), r["strategy"], r["eval_type"], r["rmse"]) for r in df.collect())


def test_swap_slice_replaces_and_repeats(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    assert read_evaluations(spark, root).collect() == []
    swap_slice(spark, root, evaluations(spark, [1, 2, 3, 9], 1.0), "2024-01-01", "2024-01-10")
    swap_slice(spark, root, evaluations(spark, [4], 5.0, "online"), "2024-01-04", "2024-01-05", "online")
    before = read_evaluations(spark, root)
    new = evaluations(spark, [2], 2.0).unionByName(evaluations(spark, [20], 3.0)).unionByName(
        evaluations(spark, [9], 4.0, series=None))                    # two rows outside the slice
    for _ in range(3):                                                # twice is once
        swap_slice(spark, root, new, "2024-01-01", "2024-01-05")
        assert content(read_evaluations(spark, root)) == sorted([
            ("s", "2024-01-02", "naive", "backtest", 2.0), ("s", "2024-01-04", "naive", "online", 5.0), ("s", "2024-01-09", "naive", "backtest", 1.0),
            ("None", "2024-01-09", "naive", "backtest", 4.0), ("s", "2024-01-20", "naive", "backtest", 3.0)])
    # A reader that began before the swap still sees the old version whole.
    assert [x[-1] for x in content(before)] == [1.0, 1.0, 1.0, 5.0, 1.0] and before.count() == 5


def test_swap_slice_that_stops_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    from panelcast.sources import versions
    root = f"file://{tmp_path}/table"
    swap_slice(spark, root, evaluations(spark, [1, 2], 1.0), "2024-01-01", "2024-01-03")
    was = content(read_evaluations(spark, root)), pointed(spark, root)
    monkeypatch.setattr(versions, "point_to", lambda *a: (_ for _ in ()).throw(InterruptedError()))
    with pytest.raises(InterruptedError):
        swap_slice(spark, root, evaluations(spark, [1], 9.0), "2024-01-01", "2024-01-03")
    assert (content(read_evaluations(spark, root)), pointed(spark, root)) == was


def test_staged_run_resumes_and_publishes_at_the_end(spark, tmp_path):
    root, ran = f"file://{tmp_path}/runs", []

    def stage(name, value, fail=False):
        def make(done):
            ran.append(name)
            if fail:
                raise InterruptedError
            return spark.range(value).withColumn("before", F.lit(len(done)))
        return name, make
    staged_run(spark, root, "one", [stage("a", 2), stage("b", 3)])
    assert published(spark, root, "b").count() == 3
    with pytest.raises(InterruptedError):
        staged_run(spark, root, "two", [stage("a", 5), stage("b", 6, fail=True)])
    assert pointed(spark, root) == "one" and published(spark, root, "b").count() == 3
    staged_run(spark, root, "two", [stage("a", 50), stage("b", 6)])
    assert ran == ["a", "b", "a", "b", "b"]                           # the finished stage is not run again
    assert published(spark, root, "a").count() == 5 and published(spark, root, "b").first()["before"] == 1


# --- batch job ---------------------------------------------------------------------------------------------------------

def job(spark, root, run):
    df = panel(spark, days=10)
    cut = "2024-01-09"
    return batch_job(df.where(F.col("date_hour") < cut), df.where(F.col("date_hour") >= cut).drop("y"),
                     df.select("series_key", "date_hour", "y"), FEATURES, root, run, tuning=("2024-01-01", "2024-01-06"),
                     testing=("2024-01-06", cut), strategies=("xgboost", "ridge"), train_days=5,
                     tune={"kinds": ["xgboost"], "n_points": 2, "select": False, "shares": (1.0,)})


def test_batch_job_end_to_end_and_after_a_crash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tuning, "SEARCH_BOUNDS", {"xgboost": {"n_estimators": (4, 8), "max_depth": (2, 4), "learning_rate": (0.2, 0.4)}})
    root = f"file://{tmp_path}/job"
    done = job(spark, root, "r1")
    assert set(done) == {"tuned", "backtest", "predictions", "online", "columns", "report"}
    assert {r["eval_type"] for r in done["report"].collect()} == {"backtest", "online"}
    assert done["backtest"].count() == 3 * 3 * 2 and done["online"].count() == 3 * 2      # series x days (x strategies)
    assert {r["column"] for r in done["columns"].collect()} == {"pred_xgboost", "pred_ridge"}
    monkeypatch.setattr(batch, "forecast", lambda *a, **k: (_ for _ in ()).throw(InterruptedError()))
    with pytest.raises(InterruptedError):
        job(spark, root, "r2")
    assert pointed(spark, root) == "r1" and published(spark, root, "report").count() == done["report"].count()


def test_overlapping_windows_raise(spark):
    for tune, test in ((("2024-01-01", "2024-01-10"), ("2024-01-09", "2024-01-12")), (("2024-01-05", "2024-01-04"), ("2024-01-06", "2024-01-07"))):
        with pytest.raises(ValueError):
            batch.check_windows(tune, test)
    batch.check_windows(("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-07"))


# --- streams -----------------------------------------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double"


def test_stream_with_late_and_repeated_events_closes_to_the_batch_panel(spark, tmp_path):
    from panelcast.streaming.hourly import late_rows, run_hourly_panel, unfinished_hours
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    parts = [[(1, at(0.1), "a", 2.0), (2, at(0.5), None, 4.0), (1, at(0.1), "a", 2.0)],        # a repeated event
             [(3, at(5.0), "a", 1.0), (4, at(3.9), "a", 3.0)],                                   # out of order, in time
             [(6, at(5.5), "a", 5.0)],
             [(5, at(0.2), "a", 99.0), (2, at(0.5), None, 4.0)],                                 # both too late
             [(7, at(9.0), None, 7.0)]]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run_hourly_panel(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), id_col="event_id")
    emitted = spark.read.parquet(str(tmp_path / "out"))
    rest = unfinished_hours(spark, str(tmp_path / "ckpt"))
    show = lambda df: sorted((str(r["series_key"]), r["date_hour"].hour, r["y"], r["n_events"]) for r in df.collect())
    assert show(emitted) == [("None", 0, 4.0, 1), ("a", 0, 2.0, 1), ("a", 3, 3.0, 1), ("a", 5, 3.0, 2)]
    assert show(rest) == [("None", 9, 7.0, 1)]
    late = late_rows(query)
    assert late.where("operator like 'dedupe%'").agg(F.sum("n_late")).first()[0] == 2


def test_online_eval_cost_does_not_grow_with_history(spark, tmp_path):
    from panelcast.streaming.hourly import online_eval_batch
    t0 = dt.datetime(2024, 1, 1)
    actuals = spark.createDataFrame([("a", t0 + dt.timedelta(hours=h), float(h)) for h in range(24 * 6)],
                                    "series_key string, date_hour timestamp_ntz, y double")
    day = lambda d, by: actuals.where(F.dayofmonth("date_hour") == d).withColumn("pred", F.col("y") + by).drop("y")
    run = online_eval_batch(actuals, str(tmp_path / "ev"))
    for d in range(1, 6):
        run(day(d, 1.0), d)
    store = tmp_path / "ev_predictions"
    files = {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in store.iterdir() if d.is_dir()}
    assert len(files) == 5
    run(day(5, 2.0), 6)                                               # predicted again: the later batch wins
    run(day(5, 1.0), 5)                                               # an old batch replayed: the later one still wins
    after = {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in store.iterdir() if d.is_dir()}
    assert {n for n in files if files[n] != after[n]} == {"day=2024-01-05"}            # other days are not touched
    assert sorted((r["date"].day, round(r["rmse"], 9)) for r in spark.read.parquet(str(tmp_path / "ev")).collect()) == [
        (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 2.0)]
    run(day(9, 1.0).limit(0), 7)                                      # an empty batch
