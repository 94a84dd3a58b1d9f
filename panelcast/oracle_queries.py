"""DuckDB SQL for every registered query that SQL can express (same keys as ``registry.QUERIES``)."""

from __future__ import annotations

import json

from .oracle import (PANELS, calendar_cols, div, cyclic_cols, holiday_cols, holiday_cte, r, select_list, stat_cols,
                     with_day_mean, with_panels)
from .constants import KEY_HOURS, N_FOLDS
from .plans.tuning import DEFAULT_GRIDS
from .registry import ALL_FEATS, CAL_INT, CYC_DIGITS, FUTURE_FROM, LEAK_DAYS, ON_SUPPLY, PAIR_COLS, SCALE_COLS, STAT

KEYS = "series_key, date_hour, y"


def _calendar_src(panel: str) -> str:
    cols = calendar_cols()
    return f"(SELECT *, {select_list(cols)} FROM {panel})"


def _stats_sql(group: str) -> str:
    cols = stat_cols()
    wanted = {k: cols[k] for k in STAT[group]}
    return with_panels("panel_hourly") + f"SELECT {KEYS},\n  {select_list(wanted)}\nFROM {with_day_mean('panel_hourly')} p"


def _all_features_sql(panel: str, extra: str, groups, cyclic: bool) -> str:
    hol = holiday_cols()
    st = stat_cols()
    cal = calendar_cols()
    cyc_cols = cyclic_cols(CYC_DIGITS)
    inner = f"(SELECT *, {select_list(cal)}, {select_list(hol)} FROM {panel})"
    sel = [f"{KEYS}, {extra}", ", ".join(CAL_INT)]
    if cyclic:
        sel.append(select_list(cyc_cols))
    sel.append(", ".join(hol))
    sel.append(select_list({k: st[k] for g in groups for k in STAT[g]}))
    return (with_panels(panel, extra=holiday_cte()) +
            f"SELECT {', '.join(sel)}\nFROM {with_day_mean(inner)} p")


def _time_mode_sql() -> str:
    st = stat_cols()
    wanted = {k: st[k] for g in ("lag", "change") for k in STAT[g]}
    dense = """dense AS (
  SELECT s.series_key, g.date_hour, p.y, p.y_cents, p.series_key IS NOT NULL AS present
  FROM (SELECT series_key, min(date_hour) AS lo, max(date_hour) AS hi FROM panel_hourly GROUP BY 1) s,
       LATERAL (SELECT unnest(generate_series(s.lo, s.hi, INTERVAL 1 HOUR)) AS date_hour) g
  LEFT JOIN panel_hourly p ON p.series_key = s.series_key AND p.date_hour = g.date_hour)"""
    return (with_panels("panel_hourly", extra=dense) +
            f"SELECT {KEYS}, {', '.join(wanted)} FROM (SELECT series_key, date_hour, y, present, "
            f"{select_list(wanted)} FROM dense) x WHERE present")


def _fx_cte() -> str:
    w = "(PARTITION BY series_key ORDER BY date_hour)"
    roll = "(PARTITION BY series_key ORDER BY date_hour ROWS BETWEEN 743 PRECEDING AND 24 PRECEDING)"
    return f"""fxw AS (
  SELECT series_key, date_hour, y,
         {div('lag(y_cents, 48) OVER ' + w, '100')} AS naive_2d,
         {div('lag(y_cents, 168) OVER ' + w, '100')} AS naive_7d,
         {div(f"CAST(floor({div(f'sum(y_cents) OVER {roll}', f'count(y_cents) OVER {roll}')} + 0.5) AS BIGINT)", '100')} AS roll_30d
  FROM panel_hourly),
fx AS (
  SELECT series_key, date_hour, 'naive_2d' AS strategy, naive_2d AS pred FROM fxw UNION ALL
  SELECT series_key, date_hour, 'naive_7d', naive_7d FROM fxw UNION ALL
  SELECT series_key, date_hour, 'roll_30d', roll_30d FROM fxw),
joined AS (
  SELECT f.series_key, f.date_hour, f.strategy, f.pred, p.y AS actual
  FROM fx f JOIN panel_hourly p ON f.series_key = p.series_key AND f.date_hour = p.date_hour)"""


def metric_sql(src: str, by: str, digits: int = 6) -> str:
    """RMSE / sMAPE / R² per group, rows with both sides non-NULL."""
    sm = "CASE WHEN (abs(actual) + abs(pred)) / 2.0 = 0 THEN 0.0 ELSE abs(actual - pred) / ((abs(actual) + abs(pred)) / 2.0) END"
    return f"""SELECT {by}, n,
  {r('sqrt(sse / n)', digits)} AS rmse,
  {r('100.0 * sm', digits)} AS mape,
  {r('CASE WHEN n < 2 THEN NULL WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sse / sst END', digits)} AS r2
FROM (SELECT {by}, count(*) AS n, sum((actual - pred) * (actual - pred)) AS sse,
             var_pop(actual) * count(*) AS sst, avg({sm}) AS sm
      FROM {src} WHERE actual IS NOT NULL AND pred IS NOT NULL GROUP BY {by}) m"""


def _evals_cte() -> str:
    src = "(SELECT *, CAST(date_hour AS DATE) AS date FROM joined)"
    return (f"ev0 AS ({metric_sql(src, 'series_key, strategy, date', 17)}),\n"
            "ev AS (SELECT series_key, date, strategy, rmse, mape, r2, "
            "CASE WHEN date >= DATE '2024-01-20' THEN 'online' ELSE 'backtest' END AS eval_type FROM ev0)")


def fx(extra: str = "", evals: bool = False) -> str:
    parts = [_fx_cte()] + ([_evals_cte()] if evals else []) + ([extra] if extra else [])
    return with_panels("panel_hourly", extra=",\n".join(parts))


SPLIT = ("CASE WHEN row_number() OVER (PARTITION BY series_key ORDER BY date_hour) <= "
         "floor(count(*) OVER (PARTITION BY series_key) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END")


def _lag_split_cte() -> str:
    st = stat_cols()
    return (f"lagged AS (SELECT {KEYS}, {st['y_same_hour_2d_ago']} AS y_same_hour_2d_ago, "
            f"{st['y_same_hour_7d_ago']} AS y_same_hour_7d_ago FROM panel_hourly),\n"
            f"split AS (SELECT *, {SPLIT} AS split FROM lagged)")


def _weighted_blend() -> str:
    sm = metric_sql("joined", "series_key, strategy", 17)
    return fx(extra=f"sm AS ({sm})") + """SELECT f.series_key, f.date_hour,
  """ + r("sum(w * pred) / sum(w)", 6) + """ AS pred
FROM (SELECT f.*, 1.0 / (s.rmse + CAST('1e-06' AS DOUBLE)) AS w FROM fx f JOIN sm s
      ON f.series_key = s.series_key AND f.strategy = s.strategy WHERE f.pred IS NOT NULL) f
GROUP BY 1, 2"""


def _future_ctes() -> str:
    return f"""hist AS (SELECT series_key, date_hour AS u, y_cents AS yc FROM panel_hourly
  WHERE date_hour < TIMESTAMP '2024-01-24' AND y_cents IS NOT NULL),
fut AS (SELECT * FROM panel_hourly WHERE date_hour >= TIMESTAMP '2024-01-24'),
lb AS (SELECT f.series_key, f.date_hour AS t, h.u, h.yc FROM fut f JOIN hist h ON h.series_key = f.series_key
  AND h.u >= f.date_hour - INTERVAL 31 DAY AND h.u < f.date_hour - INTERVAL 1 DAY),
sh AS (SELECT series_key, t, {div('sum(yc)', 'count(yc)')} AS m, stddev_samp(yc) AS s, min(yc) AS mn, max(yc) AS mx
  FROM lb WHERE hour(u) = hour(t) GROUP BY 1, 2),
dd AS (SELECT series_key, t, CAST(u AS DATE) AS d, {div('sum(yc)', 'count(yc)')} AS m FROM lb GROUP BY 1, 2, 3),
dr AS (SELECT *, row_number() OVER (PARTITION BY series_key, t ORDER BY d DESC) AS rk,
  count(*) OVER (PARTITION BY series_key, t) AS nd FROM dd),
ds AS (SELECT series_key, t, max(CASE WHEN rk = 2 AND nd > 1 THEN m END) AS dm2, max(CASE WHEN rk = 7 THEN m END) AS dm7,
  CASE WHEN max(nd) > 1 THEN avg(CASE WHEN rk <= 7 THEN m END) END AS dmr FROM dr GROUP BY 1, 2),
lr AS (SELECT *, row_number() OVER (PARTITION BY series_key, t ORDER BY u DESC) AS rk,
  count(*) OVER (PARTITION BY series_key, t) AS n FROM lb),
cg AS (SELECT series_key, t, max(CASE WHEN rk = 1 THEN yc END) - max(CASE WHEN rk = 2 THEN yc END) AS hc,
  max(CASE WHEN rk = 1 THEN yc END) - max(CASE WHEN rk = 25 THEN yc END) AS dc FROM lr WHERE n > 24 GROUP BY 1, 2),
ff AS (SELECT f.*, {div('h2.yc', '100')} AS y_same_hour_2d_ago, {div('h7.yc', '100')} AS y_same_hour_7d_ago,
  {div('sh.m', '100')} AS y_same_hour_30d_mean, {r(div('sh.s', '100'), 3)} AS y_same_hour_30d_std,
  {div('sh.mn', '100')} AS y_same_hour_30d_min, {div('sh.mx', '100')} AS y_same_hour_30d_max,
  {div('ds.dm2', '100')} AS y_daily_mean_2d_ago, {div('ds.dm7', '100')} AS y_daily_mean_7d_ago,
  {r(div('ds.dmr', '100'), 3)} AS y_daily_mean_7d_rolling,
  {div('cg.hc', '100')} AS y_hourly_change, {div('cg.dc', '100')} AS y_daily_change,
  {', '.join(f"CASE WHEN hour(f.date_hour) = {h} THEN {div('sh.m', '100')} END AS y_hour{h}_30d_mean" for h in KEY_HOURS)}
  FROM fut f
  LEFT JOIN hist h2 ON h2.series_key = f.series_key AND h2.u = f.date_hour - INTERVAL 2 DAY
  LEFT JOIN hist h7 ON h7.series_key = f.series_key AND h7.u = f.date_hour - INTERVAL 7 DAY
  LEFT JOIN sh ON sh.series_key = f.series_key AND sh.t = f.date_hour
  LEFT JOIN ds ON ds.series_key = f.series_key AND ds.t = f.date_hour
  LEFT JOIN cg ON cg.series_key = f.series_key AND cg.t = f.date_hour)"""


def _future_sql(cols) -> str:
    return with_panels("panel_hourly", extra=_future_ctes()) + f"SELECT series_key, date_hour, {', '.join(cols)} FROM ff"


def _future_all_sql() -> str:
    cal = calendar_cols()
    hol = holiday_cols()
    inner = f"(SELECT *, {select_list(cal)}, {select_list(hol)} FROM ff)"
    allstat = [c for g in STAT.values() for c in g]
    return (with_panels("panel_hourly", extra=_future_ctes() + ",\n" + holiday_cte()) +
            f"SELECT series_key, date_hour, n_events, n_users, k_avg, {', '.join(CAL_INT)}, "
            f"{select_list(cyclic_cols(CYC_DIGITS))}, {', '.join(hol)}, {', '.join(allstat)} FROM {inner} x")


def _af_body() -> str:
    """The ``all_features`` statement as a CTE named ``af``."""
    body = SQL_BASE["all_features"]
    head, select = body.split("\nSELECT ", 1)
    return head + ",\naf AS (SELECT " + select + ")\n"


def _corr(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return f"covar_pop({x}, {y}) / NULLIF(stddev_pop({x}) * stddev_pop({y}), 0)"


def _tc_cte() -> str:
    parts = " UNION ALL\n  ".join(f"SELECT '{f}' AS feature, {_corr(f, 'y')} AS corr FROM af" for f in ALL_FEATS)
    return f"tc AS (\n  {parts})"


def _rank_ctes() -> str:
    return (_tc_cte() + ",\nrk AS (SELECT feature, " + r("abs(corr)", 12) + " AS abs_corr, CAST(row_number() OVER (ORDER BY "
            + r("abs(corr)", 12) + " DESC NULLS LAST, feature) AS INTEGER) AS rank, count(*) OVER () AS k FROM tc)")


def _corr_prune_sql() -> str:
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in ALL_FEATS)
    on = ", ".join(ALL_FEATS)
    return (_af_body().replace("\n)\n", "\n)\n", 1).rstrip("\n") + ",\n" + _rank_ctes() + f""",
top AS (SELECT feature, rank, abs_corr FROM rk WHERE rank <= floor(k * CAST(0.5 AS DOUBLE))),
lng AS (UNPIVOT (SELECT row_number() OVER () AS rid, {cols} FROM af) ON {on} INTO NAME feature VALUE v),
pc AS (SELECT a.feature AS a, b.feature AS b, covar_pop(a.v, b.v) / NULLIF(stddev_pop(a.v) * stddev_pop(b.v), 0) AS corr
  FROM lng a JOIN lng b ON a.rid = b.rid AND a.feature < b.feature
  WHERE a.feature IN (SELECT feature FROM top) AND b.feature IN (SELECT feature FROM top) GROUP BY 1, 2),
pr AS (SELECT CASE WHEN ta.rank < tb.rank THEN a ELSE b END AS early, CASE WHEN ta.rank < tb.rank THEN b ELSE a END AS late,
  CASE WHEN ta.rank < tb.rank THEN ta.abs_corr ELSE tb.abs_corr END AS ce,
  CASE WHEN ta.rank < tb.rank THEN tb.abs_corr ELSE ta.abs_corr END AS cl
  FROM pc JOIN top ta ON ta.feature = pc.a JOIN top tb ON tb.feature = pc.b WHERE abs(pc.corr) > 0.95),
drops AS (SELECT DISTINCT CASE WHEN cl < ce THEN late ELSE early END AS feature FROM pr)
SELECT t.feature, t.rank, {r('t.abs_corr', 9)} AS abs_corr, t.feature IN (SELECT feature FROM drops) AS dropped FROM top t""")


def _importance_sql() -> str:
    cov = " UNION ALL\n  ".join(
        f"SELECT 'abs_cov' AS model, '{f}' AS feature, abs(covar_pop(CASE WHEN {f} IS NOT NULL AND y IS NOT NULL THEN {f} END, "
        f"CASE WHEN {f} IS NOT NULL AND y IS NOT NULL THEN y END)) AS importance FROM af" for f in ALL_FEATS)
    return (_af_body().rstrip("\n") + ",\n" + _tc_cte() + f""",
imp AS (SELECT 'abs_corr' AS model, feature, abs(corr) AS importance FROM tc UNION ALL
  {cov}),
nrm AS (SELECT i.feature, i.importance / NULLIF(t.tot, 0) AS n FROM imp i
  JOIN (SELECT model, sum(importance) AS tot FROM imp GROUP BY 1) t ON i.model = t.model),
comb AS (SELECT feature, avg(n) AS importance FROM nrm GROUP BY 1)
SELECT feature, {r('importance', 9)} AS importance, importance > (SELECT median(importance) FROM comb) AS selected FROM comb""")


def _standardize_sql() -> str:
    st = stat_cols()
    base = (f"base AS (SELECT {KEYS}, n_events, n_users, k_avg, {st['y_same_hour_2d_ago']} AS y_same_hour_2d_ago, "
            f"{st['y_same_hour_7d_ago']} AS y_same_hour_7d_ago, CAST(isodow(date_hour) - 1 >= 5 AS INTEGER) AS is_weekend "
            "FROM panel_hourly),\n"
            f"sp AS (SELECT *, {SPLIT} AS split FROM base)")
    cols = []
    for c in SCALE_COLS:
        mu = f"avg({c}) FILTER (WHERE split = 'train') OVER ()"
        sd = f"stddev_pop({c}) FILTER (WHERE split = 'train') OVER ()"
        cols.append(f"{r(f'({c} - {mu}) / (CASE WHEN {sd} = 0 THEN 1.0 ELSE {sd} END)', 9)} AS {c}")
    return with_panels("panel_hourly", extra=base) + f"SELECT {KEYS}, split, {', '.join(cols)} FROM sp"


SQL_BASE = {
    "future_timeline": with_panels("panel_hourly") + """SELECT series_key,
  unnest(generate_series(mx + INTERVAL 1 HOUR, mx + INTERVAL 168 HOUR, INTERVAL 1 HOUR)) AS date_hour
FROM (SELECT series_key, max(date_hour) AS mx FROM panel_hourly GROUP BY 1) m""",
    "lookback_exact": _future_sql(["y_same_hour_2d_ago", "y_same_hour_7d_ago"]),
    "future_same_hour": _future_sql(STAT["rolling"] + STAT["key_hour"]),
    "future_daily_stats": _future_sql(STAT["daily"]),
    "future_changes": _future_sql(STAT["change"]),
    "future_features": _future_all_sql(),
    "panel_hourly": with_panels("panel_hourly") + "SELECT * FROM panel_hourly",
    "panel_daily": with_panels("panel_daily") + "SELECT * FROM panel_daily",
    "panel_supply": with_panels("panel_supply") + "SELECT * FROM panel_supply",
    "calendar_features": with_panels("panel_daily") +
        f"SELECT {KEYS}, {', '.join(CAL_INT)} FROM {_calendar_src('panel_daily')} c",
    "cyclic_features": with_panels("panel_hourly") +
        f"SELECT {KEYS}, {select_list(cyclic_cols(CYC_DIGITS))} FROM {_calendar_src('panel_hourly')} c",
    "holiday_flags": with_panels("panel_daily", extra=holiday_cte()) +
        f"SELECT {KEYS}, " + select_list({k: v for k, v in holiday_cols().items() if k != 'days_to_nearest_holiday'})
        + " FROM panel_daily",
    "nearest_holiday": with_panels("panel_daily", extra=holiday_cte()) +
        f"SELECT {KEYS}, {holiday_cols()['days_to_nearest_holiday']} AS days_to_nearest_holiday FROM panel_daily",
    "lag_features": _stats_sql("lag"),
    "rolling_features": _stats_sql("rolling"),
    "daily_lag_features": _stats_sql("daily"),
    "change_features": _stats_sql("change"),
    "key_hour_features": _stats_sql("key_hour"),
    "time_mode_lags": _time_mode_sql(),
    "all_features": _all_features_sql("panel_hourly", "n_events, n_users, k_avg",
                                      ("lag", "rolling", "daily", "change", "key_hour"), True),
    "all_features_supply": _all_features_sql("panel_supply", "n_lines, qty, disc_avg",
                                             ("lag", "rolling", "daily", "change", "key_hour"), True),
    "scan_time_slice": "SELECT event_type AS series_key, ts AS date_hour, TRY_CAST(value AS DOUBLE) AS value, "
        "TRY_CAST(user_id AS DOUBLE) AS user_id FROM events "
        "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'",
    "scan_pruned": "SELECT CAST(l_suppkey AS VARCHAR) AS series_key, l_shipdate AS date_hour, "
        "TRY_CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, TRY_CAST(l_quantity AS DOUBLE) AS l_quantity, "
        "TRY_CAST(l_discount AS DOUBLE) AS l_discount, CAST(NULL AS DOUBLE) AS tem_avg FROM lineitem "
        "WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'",
    "coerce_numeric": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_text, "
        "TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_text, TRY_CAST(event_type AS DOUBLE) AS type_text "
        "FROM events",
    "clean_panel": with_panels("panel_supply") +
        "SELECT * FROM panel_supply WHERE y IS NOT NULL AND y >= 0.0 AND y < 10000.0",
    "clip_values": with_panels("panel_hourly") +
        "SELECT series_key, date_hour, CASE WHEN y < 5.0 THEN 5.0 WHEN y > 100.0 THEN 100.0 ELSE y END AS y, "
        "CASE WHEN n_users > 3 THEN 3 ELSE n_users END AS n_users FROM panel_hourly",
    "between_slice": with_panels("panel_hourly") +
        "SELECT * FROM panel_hourly WHERE date_hour BETWEEN TIMESTAMP '2024-01-10 06:00:00' "
        "AND TIMESTAMP '2024-01-12 18:00:00'",
    "chrono_split": with_panels("panel_hourly") + f"SELECT {KEYS}, {SPLIT} AS split FROM panel_hourly",
    "impute_train_median": with_panels("panel_hourly", extra=_lag_split_cte()) +
        f"""SELECT {KEYS}, split,
  coalesce(y_same_hour_2d_ago, median(y_same_hour_2d_ago) FILTER (WHERE split = 'train') OVER (PARTITION BY series_key)) AS y_same_hour_2d_ago,
  coalesce(y_same_hour_7d_ago, median(y_same_hour_7d_ago) FILTER (WHERE split = 'train') OVER (PARTITION BY series_key)) AS y_same_hour_7d_ago
FROM split""",
    "impute_zero": with_panels("panel_hourly", extra=_lag_split_cte()) +
        f"SELECT {KEYS}, split, coalesce(y_same_hour_2d_ago, 0.0) AS y_same_hour_2d_ago, "
        "coalesce(y_same_hour_7d_ago, 0.0) AS y_same_hour_7d_ago FROM split",
    "join_actuals": fx() + "SELECT * FROM joined",
    "error_column": fx() + "SELECT *, actual - pred AS error FROM joined",
    "anti_unevaluated": fx(evals=True) +
        "SELECT f.* FROM fx f WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.eval_type = 'online' "
        "AND ev.series_key = f.series_key AND ev.date = CAST(f.date_hour AS DATE))",
    "daily_metrics": fx() + metric_sql("(SELECT *, CAST(date_hour AS DATE) AS date FROM joined)",
                                       "series_key, strategy, date"),
    "strategy_metrics": fx() + metric_sql("joined", "series_key, strategy"),
    "eval_train_test": fx(extra=f"js AS (SELECT *, {SPLIT.replace('series_key', 'series_key, strategy')} AS split FROM joined)")
        + metric_sql("js", "series_key, strategy, split"),
    "evaluate_columns": fx() + metric_sql(
        "(SELECT series_key, date_hour, strategy AS \"column\", pred, actual FROM joined "
        "WHERE date_hour >= TIMESTAMP '2024-01-10' AND date_hour < TIMESTAMP '2024-01-25')",
        "series_key, \"column\""),
    "online_eval": fx(evals=True) + "SELECT series_key, date, 'TwoStage_Stacking' AS strategy, rmse, mape, r2, "
        "'online' AS eval_type FROM (" + metric_sql(
            "(SELECT j.*, CAST(j.date_hour AS DATE) AS date FROM joined j WHERE j.strategy = 'roll_30d' AND NOT EXISTS "
            "(SELECT 1 FROM ev WHERE ev.eval_type = 'online' AND ev.series_key = j.series_key "
            "AND ev.date = CAST(j.date_hour AS DATE)))", "series_key, date") + ") m",
    "leaderboard": fx(evals=True) + f"SELECT strategy, eval_type, {r('avg(rmse)', 6)} AS avg_rmse, "
        f"{r('avg(mape)', 6)} AS avg_mape, {r('avg(r2)', 6)} AS avg_r2, count(*) AS n_days "
        "FROM ev GROUP BY 1, 2 ORDER BY eval_type, avg_rmse",
    "best_strategy": fx(evals=True) + f"""SELECT series_key, strategy, {r('avg_metric', 6)} AS avg_metric FROM (
  SELECT series_key, strategy, avg_metric, row_number() OVER (PARTITION BY series_key
    ORDER BY avg_metric ASC NULLS LAST, strategy) AS rk
  FROM (SELECT series_key, strategy, avg(rmse) AS avg_metric FROM ev WHERE eval_type = 'backtest' GROUP BY 1, 2) g) b
WHERE rk = 1""",
    "best_strategy_global": fx(evals=True) + f"""SELECT coalesce(max(strategy), 'LightGBM') AS strategy,
  {r('max(avg_metric)', 6)} AS avg_metric FROM (
  SELECT strategy, avg(mape) AS avg_metric FROM ev WHERE eval_type = 'backtest' GROUP BY 1
  ORDER BY avg_metric ASC NULLS LAST, strategy LIMIT 1) b""",
    "pred_best": fx(evals=True) + """SELECT w.series_key, w.date_hour, w.naive_2d, w.naive_7d, w.roll_30d,
  CASE coalesce(b.strategy, 'roll_30d') WHEN 'naive_2d' THEN w.naive_2d WHEN 'naive_7d' THEN w.naive_7d
       WHEN 'roll_30d' THEN w.roll_30d ELSE w.roll_30d END AS pred_best
FROM fxw w LEFT JOIN (
  SELECT series_key, strategy FROM (
    SELECT series_key, strategy, row_number() OVER (PARTITION BY series_key
      ORDER BY avg_metric ASC NULLS LAST, strategy) AS rk
    FROM (SELECT series_key, strategy, avg(rmse) AS avg_metric FROM ev WHERE eval_type = 'backtest' GROUP BY 1, 2) g) x
  WHERE rk = 1) b ON w.series_key = b.series_key""",
    "panel_profile": with_panels("panel_hourly") +
        f"SELECT series_key, count(*) AS n_rows, min(date_hour) AS first_ts, max(date_hour) AS last_ts, "
        f"{r('avg(y)', 6)} AS mean_y FROM panel_hourly GROUP BY 1",
    "histogram50": with_panels("panel_hourly") + """SELECT series_key, bucket, lo + (bucket - 1) * w AS lo_edge,
  lo + bucket * w AS hi_edge, count(*) AS n FROM (
  SELECT p.series_key, b.lo, (b.hi - b.lo) / CAST(50 AS DOUBLE) AS w,
         CAST(CASE WHEN b.hi = b.lo THEN 1 ELSE least(50, floor((p.y - b.lo) / (b.hi - b.lo) * CAST(50 AS DOUBLE)) + 1) END AS INTEGER) AS bucket
  FROM panel_hourly p JOIN (SELECT series_key, min(y) AS lo, max(y) AS hi FROM panel_hourly WHERE y IS NOT NULL GROUP BY 1) b
    ON p.series_key = b.series_key WHERE p.y IS NOT NULL) h
GROUP BY series_key, bucket, lo, w""",
    "feature_availability": with_panels("panel_hourly") + f"""SELECT series_key, CAST(date_hour AS DATE) AS date,
  bool_or(y_same_hour_7d_ago IS NOT NULL) AS y_same_hour_7d_ago, bool_or(y_hour8_30d_mean IS NOT NULL) AS y_hour8_30d_mean,
  bool_or(k_avg IS NOT NULL) AS k_avg, false AS tem_avg
FROM (SELECT series_key, date_hour, k_avg, {stat_cols()['y_same_hour_7d_ago']} AS y_same_hour_7d_ago,
             {stat_cols()['y_hour8_30d_mean']} AS y_hour8_30d_mean FROM panel_hourly) f GROUP BY 1, 2""",
    "predictions_long": fx() + "SELECT series_key, date_hour, strategy, pred FROM fx",
    "predictions_wide": fx() + "SELECT series_key, date_hour, naive_2d, naive_7d, roll_30d FROM fxw",
    "blend_mean": fx() + f"SELECT series_key, date_hour, {r('avg(pred)', 6)} AS pred FROM fx GROUP BY 1, 2",
    "blend_median": fx() + "SELECT series_key, date_hour, median(pred) AS pred FROM fx GROUP BY 1, 2",
    "blend_weighted": _weighted_blend(),
    "time_folds": with_panels("panel_hourly") + f"""SELECT {KEYS}, rn,
  CAST(CASE WHEN ts > 0 AND rn - 1 >= n - 3 * ts THEN floor((rn - 1 - (n - 3 * ts)) / ts) END AS INTEGER) AS fold,
  CAST(ts AS INTEGER) AS test_size
FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date_hour) AS rn,
             count(*) OVER (PARTITION BY series_key) AS n,
             count(*) OVER (PARTITION BY series_key) // 4 AS ts FROM panel_hourly) x""",
    "rolling_origin_folds": with_panels("panel_hourly", extra="""days AS (
  SELECT unnest(generate_series(min(CAST(date_hour AS DATE)), max(CAST(date_hour AS DATE)), INTERVAL 1 DAY))::DATE AS origin
  FROM panel_hourly),
ex AS (
  SELECT p.series_key, p.date_hour, p.y, p.y_cents, d.origin,
         CASE WHEN CAST(p.date_hour AS DATE) = d.origin THEN 'test' ELSE 'train' END AS role
  FROM panel_hourly p JOIN days d
    ON p.date_hour >= CAST(d.origin - INTERVAL 60 DAY AS TIMESTAMP) AND p.date_hour < CAST(d.origin + INTERVAL 1 DAY AS TIMESTAMP)),
ok AS (
  SELECT series_key, origin FROM ex GROUP BY 1, 2
  HAVING sum(CASE WHEN role = 'train' AND y IS NOT NULL THEN 1 ELSE 0 END) >= 24
     AND sum(CASE WHEN role = 'test' THEN 1 ELSE 0 END) > 0)""") +
        f"SELECT ex.series_key, ex.date_hour, ex.y, ex.origin, ex.role FROM ex "
        "JOIN ok ON ex.series_key = ok.series_key AND ex.origin = ok.origin",
    "eval_day_spine": with_panels("panel_hourly") +
        "SELECT unnest(generate_series(min(CAST(date_hour AS DATE)), max(CAST(date_hour AS DATE)), "
        "INTERVAL 1 DAY))::DATE AS origin FROM panel_hourly",
    "topk_preview": with_panels("panel_hourly") + f"""SELECT {KEYS}, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY y DESC, date_hour ASC) AS INTEGER) AS rank
  FROM panel_hourly) t WHERE rank <= 10""",
    "daily_summary": with_panels("panel_hourly") +
        f"SELECT series_key, CAST(date_hour AS DATE) AS day, {r('avg(y)', 6)} AS mean_y, min(y) AS min_y, "
        "max(y) AS max_y FROM panel_hourly GROUP BY 1, 2",
}

SQL = dict(SQL_BASE)
SQL.update({
    "corr_target": _af_body() + f"SELECT feature, {r('corr', 9)} AS corr FROM (\n  " +
        " UNION ALL\n  ".join(f"SELECT '{f}' AS feature, {_corr(f, 'y')} AS corr FROM af" for f in ALL_FEATS) + ") t",
    "corr_matrix": _af_body() + "SELECT * FROM (\n  " + " UNION ALL\n  ".join(
        f"SELECT '{PAIR_COLS[i]}' AS a, '{PAIR_COLS[j]}' AS b, {r(_corr(PAIR_COLS[i], PAIR_COLS[j]), 9)} AS corr FROM af"
        for i in range(len(PAIR_COLS)) for j in range(i + 1, len(PAIR_COLS))) + ") t",
    "corr_topk": _af_body().rstrip("\n") + ",\n" + _rank_ctes() +
        f"\nSELECT feature, {r('abs_corr', 9)} AS abs_corr, rank, true AS top FROM rk WHERE rank <= floor(k * CAST(0.5 AS DOUBLE))",
    "corr_prune": _corr_prune_sql(),
    "importance_cut": _importance_sql(),
    "standardize": _standardize_sql(),
})


def _backtest_sql() -> str:
    st = stat_cols()
    f = (f"f AS (SELECT series_key, date_hour, y, {st['y_same_hour_2d_ago']} AS naive_2d, "
         f"{st['y_same_hour_7d_ago']} AS naive_7d, {st['y_same_hour_30d_mean']} AS roll_30d FROM panel_hourly),\n"
         "days AS (SELECT unnest(generate_series(min(CAST(date_hour AS DATE)), max(CAST(date_hour AS DATE)), "
         "INTERVAL 1 DAY))::DATE AS origin FROM panel_hourly),\n"
         "ok AS (SELECT p.series_key, d.origin FROM panel_hourly p JOIN days d ON p.date_hour >= "
         "CAST(d.origin - INTERVAL 60 DAY AS TIMESTAMP) AND p.date_hour < CAST(d.origin AS TIMESTAMP) "
         "WHERE p.y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 24),\n"
         "t AS (SELECT f.*, CAST(f.date_hour AS DATE) AS origin FROM f JOIN ok ON ok.series_key = f.series_key "
         "AND ok.origin = CAST(f.date_hour AS DATE)),\n"
         "lp AS (SELECT series_key, origin, 'naive_2d' AS strategy, naive_2d AS pred, y AS actual FROM t UNION ALL "
         "SELECT series_key, origin, 'naive_7d', naive_7d, y FROM t UNION ALL "
         "SELECT series_key, origin, 'roll_30d', roll_30d, y FROM t)")
    return (with_panels("panel_hourly", extra=f) + "SELECT series_key, origin AS date, strategy, rmse, mape, r2, "
            "'backtest' AS eval_type FROM (" + metric_sql("lp", "series_key, origin, strategy") + ") m")


SQL["backtest_metrics"] = _backtest_sql()

# Ridge with one feature x: with z = (x - mean) / deviation over the training rows, the coefficient is sum(z y') / (sum(z z) + alpha).
RIDGE1_FIT = ("count(*) AS n, avg(CAST(n_events AS DOUBLE)) AS xm, avg(y) AS ym, stddev_pop(CAST(n_events AS DOUBLE)) AS sx, "
              "covar_pop(y, CAST(n_events AS DOUBLE)) AS c")


def _ridge1(alpha: str) -> str:
    return f"ym + CASE WHEN sx = 0 THEN 0.0 ELSE (n_events - xm) / sx * (n * c / sx) / (n + {alpha}) END"


def _rolling_ridge1(source: str, asked: str) -> str:
    return f"""f AS (
  SELECT d.series_key, d.origin, {RIDGE1_FIT}
  FROM (SELECT DISTINCT series_key, CAST(date_hour AS DATE) AS origin FROM {asked}) d JOIN {source} p
    ON p.series_key = d.series_key AND p.date_hour >= CAST(d.origin - INTERVAL 60 DAY AS TIMESTAMP)
   AND p.date_hour < CAST(d.origin AS TIMESTAMP) AND p.y IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= 24),
lp AS (
  SELECT t.series_key, f.origin, t.date_hour, 'ridge' AS strategy, {r(_ridge1("1.0"), 6)} AS pred, t.y AS actual
  FROM {asked} t JOIN f ON f.series_key = t.series_key AND f.origin = CAST(t.date_hour AS DATE))"""


SQL["backtest_ridge1"] = with_panels("panel_hourly", extra=_rolling_ridge1("panel_hourly", "panel_hourly")) + (
    "SELECT series_key, origin AS date, strategy, n, rmse, mape, r2 FROM (" + metric_sql("lp", "series_key, origin, strategy") + ") m")
SQL["forecast_ridge1"] = with_panels("panel_hourly", extra=f"""h AS (SELECT * FROM panel_hourly WHERE date_hour < TIMESTAMP '{FUTURE_FROM}'),
a AS (SELECT * FROM panel_hourly WHERE date_hour >= TIMESTAMP '{FUTURE_FROM}'),
""" + _rolling_ridge1("h", "a")) + "SELECT series_key, date_hour, pred AS pred_ridge, pred AS pred_best FROM lp"


def _grid_ridge1_sql(k: int = N_FOLDS) -> str:
    points = ", ".join(f"('{json.dumps({'alpha': float(a)})}', CAST('{float(a)!r}' AS DOUBLE))" for a in DEFAULT_GRIDS["ridge"]["alpha"])
    return with_panels("panel_hourly", extra=f"""x AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date_hour) AS rn, count(*) OVER (PARTITION BY series_key) AS m,
         count(*) OVER (PARTITION BY series_key) // {k + 1} AS ts
  FROM panel_hourly WHERE y IS NOT NULL),
g AS (SELECT params, alpha, CAST(i AS BIGINT) AS i FROM (VALUES {points}) v(params, alpha), range({k}) AS q(i)),
f AS (SELECT i, {RIDGE1_FIT} FROM x, range({k}) AS q(i) WHERE ts > 0 AND rn <= m - ({k} - i) * ts GROUP BY i),
s AS (
  SELECT params, g.i, sqrt(avg((y - ({_ridge1("alpha")})) * (y - ({_ridge1("alpha")})))) AS rmse
  FROM g JOIN f ON f.i = g.i JOIN x ON x.ts > 0 AND x.rn > m - ({k} - g.i) * ts AND x.rn <= m - ({k} - g.i - 1) * ts
  GROUP BY 1, 2)
""") + f"SELECT 'ridge' AS model, params, {r('avg(rmse)', 6)} AS rmse FROM s GROUP BY params"


SQL["grid_ridge1"] = _grid_ridge1_sql()
SQL["replace_slice"] = fx(evals=True) + """SELECT series_key, date, strategy, """ + r("rmse", 6) + " AS rmse, " + \
    r("mape", 6) + " AS mape, " + r("r2", 6) + """ AS r2, eval_type FROM (
  SELECT * FROM ev WHERE NOT (eval_type = 'backtest' AND date >= DATE '2024-01-05' AND date < DATE '2024-01-15')
  UNION ALL
  SELECT series_key, date, strategy, rmse * 2, mape, r2, eval_type FROM ev
  WHERE strategy = 'naive_2d' AND date >= DATE '2024-01-05' AND date < DATE '2024-01-10' AND eval_type = 'backtest') u"""
SQL["lookback_range"] = with_panels("panel_hourly") + f"""SELECT f.series_key, f.date_hour, count(h.y_cents) AS n,
  CAST(sum(h.y_cents) AS BIGINT) AS total, min(h.y_cents) AS least, max(h.y_cents) AS most
FROM (SELECT series_key, date_hour FROM panel_hourly WHERE date_hour >= TIMESTAMP '{FUTURE_FROM}') f
LEFT JOIN (SELECT * FROM panel_hourly WHERE date_hour < TIMESTAMP '{FUTURE_FROM}') h
  ON h.series_key = f.series_key AND h.date_hour >= f.date_hour - INTERVAL 31 DAY AND h.date_hour < f.date_hour - INTERVAL 1 DAY
GROUP BY 1, 2"""


def _page_sql() -> str:
    """Ridge of one feature with training gaps at the median, predicted with gaps at 0 and clipped at 0."""
    x = stat_cols()["y_same_hour_2d_ago"]
    return with_panels("panel_hourly", extra=f"""h0 AS (SELECT * FROM panel_hourly WHERE date_hour < TIMESTAMP '{FUTURE_FROM}'),
h AS (SELECT y, date_hour, {x} AS x FROM h0),
m AS (SELECT median(x) AS med FROM h WHERE y IS NOT NULL),
f AS (SELECT count(*) AS n, avg(coalesce(x, med)) AS xm, avg(y) AS ym, stddev_pop(coalesce(x, med)) AS sx,
             covar_pop(y, coalesce(x, med)) AS c FROM h, m WHERE y IS NOT NULL),
a AS (
  SELECT p.series_key, p.date_hour, p.k_avg, s.y AS x, w.y AS x7
  FROM (SELECT * FROM panel_hourly WHERE date_hour >= TIMESTAMP '{FUTURE_FROM}') p
  LEFT JOIN h0 s ON s.series_key = p.series_key AND s.date_hour = p.date_hour - INTERVAL 2 DAY
  LEFT JOIN h0 w ON w.series_key = p.series_key AND w.date_hour = p.date_hour - INTERVAL 7 DAY),
pg AS (
  SELECT series_key, date_hour, x, x7, k_avg, CAST(date_hour AS DATE) AS day, CAST(hour(date_hour) AS INTEGER) AS hour,
         {r("greatest(0.0, ym + CASE WHEN sx = 0 THEN 0.0 ELSE (coalesce(x, 0.0) - xm) / sx * (n * c / sx) / (n + 1.0) END)", 6)} AS predicted_price
  FROM a, f)""")


SQL["predict_page"] = _page_sql() + "SELECT series_key, date_hour, predicted_price, day, hour FROM pg"
SQL["predict_page_summary"] = _page_sql() + f"""SELECT series_key, day, {r("avg(predicted_price)", 6)} AS mean_v,
  min(predicted_price) AS min_v, max(predicted_price) AS max_v,
  CAST(max(CASE WHEN x IS NOT NULL THEN 1 ELSE 0 END) + max(CASE WHEN x7 IS NOT NULL THEN 1 ELSE 0 END)
       + max(CASE WHEN k_avg IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_features
FROM pg GROUP BY 1, 2"""
SQL["swap_slice"] = SQL["replace_slice"]
SQL["stream_hourly_panel_closed"] = with_panels("panel_hourly") + "SELECT series_key, date_hour, y_cents, y, n_events FROM panel_hourly"
SQL["stream_hourly_panel"] = with_panels("panel_hourly") + """SELECT series_key, date_hour, y_cents, y, n_events
FROM panel_hourly WHERE date_hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""
SQL["split_series_features"] = with_panels("panel_daily") + "SELECT series_key, date_hour, y,\n  " + select_list(
    {k: v for k, v in stat_cols().items()}) + f"\nFROM {with_day_mean('panel_daily')} p"
SQL["stream_online_eval"] = fx() + "SELECT series_key, date, 'TwoStage_Stacking' AS strategy, rmse, mape, r2, " \
    "'online' AS eval_type FROM (" + metric_sql(
        "(SELECT *, CAST(date_hour AS DATE) AS date FROM joined WHERE strategy = 'roll_30d')", "series_key, date") + ") m"


def _leakage_sql(min_lag: int, cutoff: str = "2024-01-20") -> str:
    """Both feature builds, the second with the target hidden from the day before ``cutoff`` on."""
    cols = stat_cols(min_lag=min_lag, std_digits=9, daily_digits=9)
    build = lambda src: f"SELECT {KEYS}, {select_list(cols)} FROM {with_day_mean(src)}"
    one = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n_rows, "
        f"CAST(sum(CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN 1 ELSE 0 END) AS BIGINT) AS n_changed "
        f"FROM a JOIN b ON a.series_key = b.series_key AND a.date_hour = b.date_hour "
        f"WHERE CAST(a.date_hour AS DATE) = DATE '{cutoff}'" for c in cols)
    return with_panels("panel_hourly", extra=f"""m AS (
  SELECT * REPLACE (CASE WHEN CAST(date_hour AS DATE) >= DATE '{cutoff}' - 1 THEN NULL ELSE y_cents END AS y_cents)
  FROM panel_hourly),
a AS ({build("panel_hourly")}),
b AS ({build("m")})""") + one


SQL["leakage_check"] = _leakage_sql(24)


def _leakage_report_sql() -> str:
    """Two copies of the panel for every cut-off day, one with the target hidden; the windows run within a copy."""
    key = "series_key, cutoff, hidden"
    cols = stat_cols(key=key, std_digits=9, daily_digits=9)
    days = ", ".join(f"(DATE '{day}')" for day in LEAK_DAYS)
    one = " UNION ALL ".join(
        f"SELECT a.cutoff, '{c}' AS feature, count(*) AS n_rows, "
        f"CAST(sum(CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN 1 ELSE 0 END) AS BIGINT) AS n_changed "
        f"FROM b0 a JOIN b0 b ON NOT a.hidden AND b.hidden AND a.cutoff = b.cutoff AND a.series_key = b.series_key "
        f"AND a.date_hour = b.date_hour GROUP BY 1" for c in cols)
    return with_panels("panel_hourly", extra=f"""m AS (
  SELECT p.* REPLACE (CASE WHEN hidden AND CAST(date_hour AS DATE) >= cutoff - 1 THEN NULL ELSE y_cents END AS y_cents), cutoff, hidden
  FROM panel_hourly p, (VALUES {days}) c(cutoff), (VALUES (false), (true)) h(hidden)
  WHERE CAST(date_hour AS DATE) <= cutoff),
b0 AS MATERIALIZED (
  SELECT * FROM (SELECT {key}, date_hour, {select_list(cols)} FROM {with_day_mean("m", key=key)}) x
  WHERE CAST(date_hour AS DATE) = cutoff)""") + one


SQL["leakage_report"] = _leakage_report_sql()
SQL["leakage_check_d2"] = _leakage_sql(48)

SQL |= {f"{name}_supply": SQL[name].replace(PANELS["panel_hourly"], PANELS["panel_supply"]).replace("panel_hourly", "panel_supply")
        for name in ON_SUPPLY}
