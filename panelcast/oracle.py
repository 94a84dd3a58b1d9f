"""DuckDB oracle SQL for the registered queries.

Independent, plain-SQL statements of the same semantics, run by the driver
on the same parquet tables (views ``events orders lineitem ...``).  Shared
pieces (panels, calendar, holiday calendar) are CTE builders.  Arithmetic is
written as the same IEEE steps the Spark side uses (explicit double
division, ``floor(x*10^d+0.5)/10^d`` rounding) so results match exactly.
"""

from __future__ import annotations

from .constants import (HOLIDAY_DISTANCE_CAP, HOLIDAYS, KEY_HOURS, MAJOR_HOLIDAY_NAMES)

TWO_PI = "CAST('6.283185307179586' AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"({dbl(a)} / {dbl(b)})"


def r(x: str, d: int) -> str:
    """Half-up rounding with the exact IEEE steps of ``functions.exprs.round_half_up``."""
    return f"(floor(({x}) * {dbl(10 ** d)} + 0.5) / {dbl(10 ** d)})"


def cents(x: str) -> str:
    return f"CAST(floor({x} * 100.0 + 0.5) AS BIGINT)"


# ----------------------------------------------------------------------------------- panels
PANEL_HOURLY = f"""panel_hourly AS (
  SELECT series_key, date_hour, y_cents, n_events, n_users, k_avg, {div('y_cents', '100')} AS y FROM (
    SELECT event_type AS series_key, date_trunc('hour', ts) AS date_hour,
           CAST(floor({div('sum(c)', 'count(c)')} + 0.5) AS BIGINT) AS y_cents,
           count(*) AS n_events, count(DISTINCT user_id) AS n_users,
           {div('sum(k)', 'count(k)')} AS k_avg
    FROM (SELECT event_type, ts, user_id, {cents('value')} AS c,
                 TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) e
    GROUP BY 1, 2) g)"""

PANEL_DAILY = f"""panel_daily AS (
  SELECT series_key, date_hour, y_cents, n_orders, {div('y_cents', '100')} AS y FROM (
    SELECT o_orderpriority AS series_key,
           CAST(CAST(o_orderdate AS DATE) + INTERVAL 28 YEAR AS TIMESTAMP) AS date_hour,
           CAST(floor({div('sum(c)', 'count(c)')} + 0.5) AS BIGINT) AS y_cents,
           count(*) AS n_orders
    FROM (SELECT o_orderpriority, o_orderdate, {cents('o_totalprice')} AS c FROM orders) o
    GROUP BY 1, 2) g)"""

PANEL_SUPPLY = f"""panel_supply AS (
  SELECT series_key, date_hour, y_cents, n_lines, qty, disc_avg, {div('y_cents', '100')} AS y FROM (
    SELECT 's' || CAST(l_suppkey AS VARCHAR) AS series_key,
           CAST(CAST(l_shipdate AS DATE) + INTERVAL 28 YEAR AS TIMESTAMP) AS date_hour,
           CAST(sum(c) AS BIGINT) AS y_cents, count(*) AS n_lines, sum(l_quantity) AS qty,
           {div('sum(d)', 'count(d)')} AS disc_avg
    FROM (SELECT l_suppkey, l_shipdate, l_quantity, {cents('l_extendedprice')} AS c,
                 {cents('l_discount')} AS d FROM lineitem) l
    GROUP BY 1, 2) g)"""

PANELS = {"panel_hourly": PANEL_HOURLY, "panel_daily": PANEL_DAILY, "panel_supply": PANEL_SUPPLY}


def with_panels(*names: str, extra: str = "") -> str:
    ctes = [PANELS[n] for n in names] + ([extra] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------------- calendar
def calendar_cols(ts: str = "date_hour") -> dict[str, str]:
    dow = f"(isodow({ts}) - 1)"
    return {
        "year": f"CAST(year({ts}) AS INTEGER)",
        "month": f"CAST(month({ts}) AS INTEGER)",
        "dayofmonth": f"CAST(day({ts}) AS INTEGER)",
        "dayofyear": f"CAST(dayofyear({ts}) AS INTEGER)",
        "hour": f"CAST(hour({ts}) AS INTEGER)",
        "dayofweek": f"CAST({dow} AS INTEGER)",
        "week": f"CAST(weekofyear({ts}) AS INTEGER)",
        "weekofyear": f"CAST(weekofyear({ts}) AS INTEGER)",
        "quarter": f"CAST(quarter({ts}) AS INTEGER)",
        "is_weekend": f"CAST({dow} >= 5 AS INTEGER)",
        "season_num": f"CAST(CASE WHEN month({ts}) BETWEEN 3 AND 5 THEN 1 WHEN month({ts}) BETWEEN 6 AND 8 THEN 2 "
                      f"WHEN month({ts}) BETWEEN 9 AND 11 THEN 3 ELSE 4 END AS INTEGER)",
    }


def cyc(fn: str, x: str, period: float) -> str:
    return f"{fn}({TWO_PI} * CAST({x} AS DOUBLE) / CAST('{float(period)!r}' AS DOUBLE))"


CYCLIC = {
    "season_sin": ("sin", "season_num - 1", 4), "season_cos": ("cos", "season_num - 1", 4),
    "hoursin": ("sin", "hour", 24), "hourcos": ("cos", "hour", 24),
    "dayofweeksin": ("sin", "dayofweek", 7), "dayofweekcos": ("cos", "dayofweek", 7),
    "weeksin": ("sin", "week", 52), "weekcos": ("cos", "week", 52),
    "monthsin": ("sin", "month", 12), "monthcos": ("cos", "month", 12),
    "dayofyearsin": ("sin", "dayofyear", 365.25), "dayofyearcos": ("cos", "dayofyear", 365.25),
    "sin_time": ("sin", "hour", 24), "cos_time": ("cos", "hour", 24),
}


def cyclic_cols(digits: int = 9) -> dict[str, str]:
    return {k: r(cyc(fn, x, p), digits) for k, (fn, x, p) in CYCLIC.items()}


# ---------------------------------------------------------------------------------- holidays
def holiday_cte() -> str:
    rows = ",\n    ".join(f"('{d}', '{n}')" for d, n in HOLIDAYS)
    majors = ", ".join(f"'{n}'" for n in MAJOR_HOLIDAY_NAMES)
    return (f"hol AS (SELECT CAST(d AS DATE) AS date, name, name IN ({majors}) AS is_major FROM (VALUES\n    {rows}\n"
            f"  ) t(d, name))")


def holiday_cols(day: str = "CAST(date_hour AS DATE)", cap: int = HOLIDAY_DISTANCE_CAP) -> dict[str, str]:
    return {
        "is_holiday": f"CAST(EXISTS (SELECT 1 FROM hol WHERE hol.date = {day}) AS INTEGER)",
        "is_pre_holiday": f"CAST(EXISTS (SELECT 1 FROM hol WHERE hol.date = {day} + 1) AS INTEGER)",
        "is_post_holiday": f"CAST(EXISTS (SELECT 1 FROM hol WHERE hol.date = {day} - 1) AS INTEGER)",
        "days_to_nearest_holiday":
            f"CAST(least({cap}, coalesce((SELECT min(abs({day} - hol.date)) FROM hol), {cap})) AS INTEGER)",
        "is_major_holiday": f"CAST(EXISTS (SELECT 1 FROM hol WHERE hol.date = {day} AND hol.is_major) AS INTEGER)",
    }


# ------------------------------------------------------------------------------ history stats
def stat_cols(p: str = "y", t: str = "y_cents", key: str = "series_key", time: str = "date_hour",
              min_lag: int = 24, key_hours=KEY_HOURS, std_digits: int = 3, daily_digits: int = 3) -> dict[str, str]:
    w = f"(PARTITION BY {key} ORDER BY {time})"
    roll = f"(PARTITION BY {key} ORDER BY {time} ROWS BETWEEN {720 + min_lag - 1} PRECEDING AND {min_lag} PRECEDING)"
    droll = f"(PARTITION BY {key} ORDER BY {time} ROWS BETWEEN {7 + min_lag - 1} PRECEDING AND {min_lag} PRECEDING)"
    skip = max(1, min_lag // 24)
    hw = (f"(PARTITION BY {key}, hour({time}) ORDER BY {time} "
          f"ROWS BETWEEN {30 + skip - 1} PRECEDING AND {skip} PRECEDING)")
    s = lambda x: div(x, "100")
    cols = {
        f"{p}_same_hour_2d_ago": s(f"lag({t}, 48) OVER {w}"),
        f"{p}_same_hour_7d_ago": s(f"lag({t}, 168) OVER {w}"),
        f"{p}_same_hour_30d_mean": s(div(f"sum({t}) OVER {roll}", f"count({t}) OVER {roll}")),
        f"{p}_same_hour_30d_std": r(s(f"stddev_samp({t}) OVER {roll}"), std_digits),
        f"{p}_same_hour_30d_min": s(f"min({t}) OVER {roll}"),
        f"{p}_same_hour_30d_max": s(f"max({t}) OVER {roll}"),
        f"{p}_daily_mean_2d_ago": s(f"lag(_dm, 48) OVER {w}"),
        f"{p}_daily_mean_7d_ago": s(f"lag(_dm, 168) OVER {w}"),
        f"{p}_daily_mean_7d_rolling": r(s(div(f"sum(_dm) OVER {droll}", f"count(_dm) OVER {droll}")), daily_digits),
        f"{p}_hourly_change": s(f"lag({t}, {min_lag}) OVER {w} - lag({t}, {min_lag + 1}) OVER {w}"),
        f"{p}_daily_change": s(f"lag({t}, {min_lag}) OVER {w} - lag({t}, {min_lag + 24}) OVER {w}"),
    }
    km = s(div(f"sum({t}) OVER {hw}", f"count({t}) OVER {hw}"))
    for h in key_hours:
        cols[f"{p}_hour{h}_30d_mean"] = f"CASE WHEN hour({time}) = {h} THEN {km} END"
    return cols


def with_day_mean(src: str, t: str = "y_cents", key: str = "series_key", time: str = "date_hour") -> str:
    return (f"(SELECT *, {div(f'sum({t}) OVER (PARTITION BY {key}, CAST({time} AS DATE))', f'count({t}) OVER (PARTITION BY {key}, CAST({time} AS DATE))')} AS _dm "
            f"FROM {src})")


def select_list(cols: dict[str, str]) -> str:
    return ",\n  ".join(f"{v} AS {k}" for k, v in cols.items())
