"""Daily demand forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltrail.models import changepoints as C, forecast as M
from voltrail.operators import reports as R, tables as T
from voltrail.operators.joins import unknown_station_sample, unknown_stations
from voltrail.plans.registry import once, query
from voltrail.plans.reporting import SERIES
from voltrail.schema import STATION
from voltrail.session import scratch_path
from voltrail.sources import sinks as OUT
from voltrail.sources.mapping import requests, sessions


def customer_daily(spark, sf_dir):
    """Daily table with one series per customer: short and long histories side by side."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        f"concat('Station_', o_custkey) AS {STATION}", "to_date(o_orderdate) AS session_date"
    ).groupBy(STATION, "session_date").agg(F.count(F.lit(1)).alias("total_sessions"))


def station_days(spark, sf_dir):
    return R.station_series(R.daily_agg(sessions(spark, sf_dir)))


def fit_sql(series: str, prefix: str) -> dict[str, str]:
    """Checking SQL of the fit over the series table of this name."""
    p = prefix
    effects = ", ".join(
        f"coalesce(max(CASE WHEN weekday = {i} THEN effect END), 0e0) AS {name}" for i, name in enumerate(M.EFFECTS))
    return {
        f"{p}x": "SELECT *, CAST(ds - first_day AS DOUBLE) AS x, CAST(isodow(ds) - 1 AS INT) AS weekday FROM (SELECT "
                 f"charging_station_id, ds, y, min(ds) OVER (PARTITION BY charging_station_id) AS first_day FROM {series})",
        f"{p}line": "SELECT charging_station_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, "
                    f"count(*) AS train_rows, max(ds) AS last_day FROM {p}x GROUP BY 1 HAVING train_rows >= 2",
        f"{p}effect": f"SELECT charging_station_id, weekday, sum(y - (intercept + slope * x)) / (count(*) + 3) AS effect "
                      f"FROM {p}x JOIN {p}line USING (charging_station_id) GROUP BY 1, 2",
        f"{p}fitted": f"SELECT *, intercept + slope * x + effect AS yhat FROM {p}x JOIN {p}line USING "
                      f"(charging_station_id) JOIN {p}effect USING (charging_station_id, weekday)",
        f"{p}coef": "SELECT charging_station_id, count(*) AS train_rows, min(first_day) AS first_day, max(last_day) "
                    "AS last_day, max(slope) AS slope, max(intercept) AS intercept, "
                    f"coalesce(stddev_samp(y - yhat), 0e0) AS sigma, {effects} FROM {p}fitted GROUP BY 1",
    }


def future_sql(prefix: str, horizon: str, ci: float, source: str | None = None) -> str:
    """Future days with bands; ``source`` may hold a horizon of its own per row."""
    z = repr(M.band_width(ci)) + "e0"
    choose = "CASE isodow(ds) " + " ".join(f"WHEN {i + 1} THEN {n}" for i, n in enumerate(M.EFFECTS)) + " END"
    return (
        f"SELECT *, yhat - sigma * {z} AS yhat_lower, yhat + sigma * {z} AS yhat_upper FROM (SELECT *, intercept + slope "
        f"* (ds - first_day) + {choose} AS yhat FROM (SELECT *, last_day + CAST(unnest(generate_series(1, {horizon})) AS "
        f"INT) AS ds FROM {source or prefix + 'coef'}))"
    )


STATION_FIT = {**SERIES, **fit_sql("series", "st_")}
STATION_FIT["st_future"] = future_sql("st_", "30", 80)

COEFFICIENTS = ["slope", "intercept", "sigma", *M.EFFECTS]


@query("forecast_fit", f"SELECT charging_station_id, train_rows, first_day, last_day, {', '.join(COEFFICIENTS)} "
       "FROM st_coef", COEFFICIENTS, extra=STATION_FIT)
def _(spark, sf_dir):
    return M.fit(station_days(spark, sf_dir)).select(STATION, "train_rows", "first_day", "last_day", *COEFFICIENTS)


BANDS = ("yhat", "yhat_lower", "yhat_upper")
Z80 = repr(M.band_width(80)) + "e0"


@query("forecast_30d", "SELECT charging_station_id, ds, yhat, yhat - sigma * " + Z80 + " AS yhat_lower, yhat + sigma * "
       + Z80 + " AS yhat_upper FROM st_fitted JOIN (SELECT charging_station_id, sigma FROM st_coef) USING "
       "(charging_station_id) UNION ALL SELECT charging_station_id, ds, yhat, yhat_lower, yhat_upper FROM st_future",
       BANDS, extra=STATION_FIT)
def _(spark, sf_dir):
    return M.forecast(station_days(spark, sf_dir), 30)


@query("forecast_interval", " UNION ALL ".join(
    f"SELECT {ci} AS ci, charging_station_id, ds, yhat_lower, yhat_upper FROM ({future_sql('st_', '7', ci)})"
    for ci in (80, 95, 99)), BANDS[1:], extra=STATION_FIT)
def _(spark, sf_dir):
    coefficients = station_coefficients(spark, sf_dir)
    parts = [M.future(coefficients, 7, ci=ci).select(
        F.lit(ci).alias("ci"), STATION, "ds", "yhat_lower", "yhat_upper") for ci in (80, 95, 99)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


STATION_FIT["st_metrics"] = (
    "SELECT charging_station_id, count(*) AS train_rows, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) "
    "AS rmse, avg(abs(y - yhat) / nullif(abs(y), 0)) AS mape FROM st_fitted GROUP BY 1")


@query("forecast_metrics", "SELECT * FROM st_metrics", ("mae", "rmse", "mape"), extra=STATION_FIT)
def _(spark, sf_dir):
    return M.metrics(station_days(spark, sf_dir))


@query("forecast_leaderboard", "SELECT charging_station_id, train_rows, mae, rmse, mape FROM st_metrics",
       ("mae", "rmse", "mape"), extra=STATION_FIT)
def _(spark, sf_dir):
    return M.leaderboard(M.metrics(station_days(spark, sf_dir)))


@query("forecast_leaderboard_summary", "SELECT count(*) AS stations_trained, quantile_cont(mae, 5e-1) AS median_mae, "
       "quantile_cont(rmse, 5e-1) AS median_rmse FROM st_metrics", ("median_mae", "median_rmse"), extra=STATION_FIT)
def _(spark, sf_dir):
    return M.leaderboard_summary(M.metrics(station_days(spark, sf_dir)))


HOLDOUT = {**SERIES, **{
    "split": "SELECT *, place <= CASE WHEN n >= 14 THEN least(7, n // 3) ELSE 0 END AS is_test FROM (SELECT *, CAST(ds - "
             "min(ds) OVER (PARTITION BY charging_station_id) AS DOUBLE) AS x, isodow(ds) AS weekday, count(*) OVER "
             "(PARTITION BY charging_station_id) AS n, row_number() OVER (PARTITION BY charging_station_id ORDER BY ds "
             "DESC) AS place FROM customer_series)",
    "customer_series": "SELECT concat('Station_', o_custkey) AS charging_station_id, CAST(o_orderdate AS DATE) AS ds, "
                       "count(*) AS y FROM orders GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY charging_station_id) >= 2",
    "train_line": "SELECT charging_station_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM split "
                  "WHERE NOT is_test GROUP BY 1",
    "train_effect": "SELECT charging_station_id, weekday, sum(y - (intercept + slope * x)) / (count(*) + 3) AS effect FROM "
                    "split JOIN train_line USING (charging_station_id) WHERE NOT is_test GROUP BY 1, 2",
    "scored": "SELECT split.*, intercept + slope * x + coalesce(effect, 0e0) AS yhat, CASE WHEN is_test THEN y END AS t "
              "FROM split JOIN train_line USING (charging_station_id) LEFT JOIN train_effect USING "
              "(charging_station_id, weekday)",
}}


# Customers' series have 2 to 20 and more days, so the 14-day rule is met by some of them only.
@query("forecast_holdout", "SELECT charging_station_id, count(*) AS history_days, count(t) AS test_days, "
       "avg(abs(t - yhat)) AS mae, sqrt(avg((t - yhat) * (t - yhat))) AS rmse, "
       "1 - sum((t - yhat) * (t - yhat)) / nullif(var_pop(t) * count(t), 0) AS r2 FROM scored GROUP BY 1",
       ("mae", "rmse", "r2"), extra=HOLDOUT)
def _(spark, sf_dir):
    return M.holdout(R.station_series(customer_daily(spark, sf_dir)))


def naive_sql(series: str, horizon: int, z: str) -> str:
    return (
        "SELECT charging_station_id, last_day + CAST(unnest(generate_series(1, " + str(horizon) + ")) AS INT) AS ds, yhat, "
        f"CASE WHEN yhat - {z} * std IS NOT NULL THEN greatest(0e0, yhat - {z} * std) END AS yhat_lower, "
        f"yhat + {z} * std AS yhat_upper FROM (SELECT charging_station_id, max(ds) AS last_day, "
        "round_even(CASE WHEN count(*) FILTER (WHERE place <= 14) >= 7 THEN avg(y) FILTER (WHERE place <= 14) END, 1) "
        "AS yhat, coalesce(CASE WHEN count(*) FILTER (WHERE place <= 14) >= 7 THEN stddev_samp(y) FILTER (WHERE place "
        "<= 14) END, stddev_samp(y)) AS std FROM (SELECT *, row_number() OVER (PARTITION BY charging_station_id ORDER "
        f"BY ds DESC) AS place FROM {series}) GROUP BY 1)"
    )


@query("naive_forecast", f"SELECT * FROM ({naive_sql('series', 21, '196e-2')})", BANDS, extra=SERIES)
def _(spark, sf_dir):
    return M.naive(station_days(spark, sf_dir), 21)


AUTO = {**HOLDOUT, **fit_sql("long_series", "cu_"), **{
    "long_series": "SELECT * FROM customer_series QUALIFY count(*) OVER (PARTITION BY charging_station_id) >= 10",
    "short_series": "SELECT * FROM customer_series QUALIFY count(*) OVER (PARTITION BY charging_station_id) < 10",
}}
AUTO["auto_forecast"] = (
    'SELECT charging_station_id, ds AS "Date", yhat AS "Predicted", yhat_lower AS "Lower", yhat_upper AS "Upper", '
    f"'{M.MODEL_NAME}' AS model FROM ({future_sql('cu_', '21', 95)}) UNION ALL SELECT charging_station_id, ds, yhat, "
    f"yhat_lower, yhat_upper, '{M.BASELINE_NAME}' FROM ({naive_sql('short_series', 21, '196e-2')})")


@query("forecast_auto", "SELECT * FROM auto_forecast", ("Predicted", "Lower", "Upper"), extra=AUTO)
def _(spark, sf_dir):
    return M.auto(R.station_series(customer_daily(spark, sf_dir)), 21)


@query("forecast_summary", "SELECT charging_station_id, strftime(arg_min(\"Date\", (-round(\"Predicted\", 6), \"Date\")), "
       "'%b %d') AS peak_day, avg(\"Predicted\") AS avg_daily, sum(\"Predicted\") AS total_period FROM auto_forecast "
       "WHERE \"Predicted\" IS NOT NULL GROUP BY 1", ("avg_daily", "total_period"), extra=AUTO)
def _(spark, sf_dir):
    return M.summary(M.auto(R.station_series(customer_daily(spark, sf_dir)), 21))


def station_coefficients(spark, sf_dir):
    """The fitted coefficients as a stored table, which is what serving reads."""
    path = once(spark, sf_dir, "coefficients", lambda: OUT.save_coefficients(
        M.fit(station_days(spark, sf_dir)), scratch_path(spark, "coefficients"), "trend_weekly"))
    return OUT.load_coefficients(spark, path)


@query("save_model", f"SELECT charging_station_id, 'trend_weekly' AS model_type, {', '.join(COEFFICIENTS)} FROM st_coef",
       COEFFICIENTS, extra=STATION_FIT)
def _(spark, sf_dir):
    return station_coefficients(spark, sf_dir).select(STATION, "model_type", *COEFFICIENTS)


SERVE = {**STATION_FIT, "asked": "SELECT * FROM requests JOIN st_coef USING (charging_station_id)"}


@query("forecast_serve", "SELECT request_id, charging_station_id, strftime(ds, '%Y-%m-%d') AS date, "
       "greatest(0e0, round_even(round(yhat, 6), 1)) AS sessions FROM (" + future_sql("st_", "days", 80, "asked") + ")",
       ("sessions",), extra=SERVE)
def _(spark, sf_dir):
    return M.serve(requests(spark, sf_dir), station_coefficients(spark, sf_dir))


@query("unknown_stations", "SELECT request_id, charging_station_id FROM requests ANTI JOIN sessions USING "
       "(charging_station_id)")
def _(spark, sf_dir):
    asked = requests(spark, sf_dir).select("request_id", STATION)
    return unknown_stations(asked, sessions(spark, sf_dir))


@query("unknown_station_sample", "SELECT DISTINCT charging_station_id, (SELECT string_agg(charging_station_id, ', ' ORDER BY "
       "charging_station_id) FROM (SELECT DISTINCT charging_station_id FROM sessions ORDER BY 1 LIMIT 5)) AS "
       "available_sample FROM requests ANTI JOIN sessions USING (charging_station_id)")
def _(spark, sf_dir):
    return unknown_station_sample(requests(spark, sf_dir), sessions(spark, sf_dir))


@query("per_group_model")
def _(spark, sf_dir):
    return M.per_group_model(station_days(spark, sf_dir))


@query("per_group_forecast", "SELECT charging_station_id, last_day + CAST(unnest(generate_series(1, 14)) AS INT) AS ds, true AS is_number FROM "
       "st_coef", extra=STATION_FIT)
def _(spark, sf_dir):
    """The richer model's forecast: a number for every station and day ahead (the numbers are tested against least squares)."""
    rows = M.per_group_forecast(station_days(spark, sf_dir), 14)
    return rows.select(STATION, "ds", (F.col("yhat").isNotNull() & ~F.isnan("yhat")).alias("is_number"))


SCOPE_STATION = "Station_1"
SCOPES = {
    "top_of_all": "SELECT charging_station_id FROM sessions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50",
    "scope_days": "SELECT 'all' AS charging_station_id, session_date AS ds, CAST(sum(total_sessions) AS BIGINT) AS y FROM daily GROUP BY 1, 2 "
                  "UNION ALL SELECT 'top 50', session_date, CAST(sum(total_sessions) AS BIGINT) FROM daily WHERE charging_station_id IN "
                  "(SELECT charging_station_id FROM top_of_all) GROUP BY 1, 2 UNION ALL SELECT charging_station_id, session_date, total_sessions "
                  f"FROM daily WHERE charging_station_id = '{SCOPE_STATION}'",
    "long_scopes": "SELECT * FROM scope_days QUALIFY count(*) OVER (PARTITION BY charging_station_id) >= 10",
    "short_scopes": "SELECT * FROM scope_days QUALIFY count(*) OVER (PARTITION BY charging_station_id) BETWEEN 2 AND 9",
    **fit_sql("long_scopes", "sc_"),
}


@query("forecast_scope", 'SELECT charging_station_id, ds AS "Date", yhat AS "Predicted", yhat_lower AS "Lower", yhat_upper AS "Upper", '
       f"'{M.MODEL_NAME}' AS model FROM ({future_sql('sc_', '30', 95)}) UNION ALL SELECT charging_station_id, ds, yhat, "
       f"yhat_lower, yhat_upper, '{M.BASELINE_NAME}' FROM ({naive_sql('short_scopes', 30, '196e-2')})", ("Predicted", "Lower", "Upper"), extra=SCOPES)
def _(spark, sf_dir):
    """The forecast of a scope: all stations, the 50 with most sessions, and one station."""
    df = sessions(spark, sf_dir)
    daily = R.daily_agg(df)
    series = R.scope_series(daily, "all").unionByName(R.scope_series(daily, "top 50", top=R.top_scope(df))) \
        .unionByName(R.scope_series(daily, SCOPE_STATION, station=SCOPE_STATION))
    return M.auto(series, 30)


@query("forecast_report", "SELECT charging_station_id, printf('| %s | %d | %.2f | %.2f | %s |', charging_station_id, "
       "train_rows, mae, rmse, CASE WHEN mape IS NULL THEN 'n/a' ELSE printf('%.3f', mape) END) AS line FROM st_metrics",
       extra=STATION_FIT)
def _(spark, sf_dir):
    return T.forecast_table(M.metrics(station_days(spark, sf_dir)))


# --- trend with bends -----------------------------------------------------------------------------

def diagonal_sql(start: str) -> str:
    """Elimination of the systems of a table (station, i, j, v), without pivoting."""
    return (
        f"WITH RECURSIVE r AS (SELECT charging_station_id, 0 AS k, i, j, v FROM {start} UNION ALL "
        "SELECT a.charging_station_id, a.k + 1, a.i, a.j, CASE WHEN a.i = a.k THEN a.v ELSE a.v - p.v * f.v / d.v END FROM r a "
        "JOIN r p ON p.charging_station_id = a.charging_station_id AND p.i = a.k AND p.j = a.j "
        "JOIN r f ON f.charging_station_id = a.charging_station_id AND f.i = a.i AND f.j = a.k "
        "JOIN r d ON d.charging_station_id = a.charging_station_id AND d.i = a.k AND d.j = a.k "
        f"WHERE a.k < {C.SIZE}) SELECT n.charging_station_id, n.i, n.j - {C.SIZE} AS side, n.v / d.v AS v FROM r n JOIN r d ON "
        f"d.charging_station_id = n.charging_station_id AND d.k = n.k AND d.i = n.i AND d.j = n.i WHERE n.k = {C.SIZE} AND n.j >= {C.SIZE}"
    )


def left_over_sql(solved: str) -> str:
    return (
        f"SELECT charging_station_id, CASE WHEN sum((y - yhat) * (y - yhat)) > sum(y * y) * {C.EXACT!r} THEN sum((y - yhat) * (y - yhat)) "
        f"ELSE 0e0 END AS squares, count(*) AS train_rows, sum(y * y) AS yy FROM (SELECT charging_station_id, ds, any_value(y) AS y, "
        f"sum(b.v * s.v) AS yhat FROM bend_basis b JOIN {solved} s USING (charging_station_id, i) WHERE s.side = 0 GROUP BY 1, 2) GROUP BY 1"
    )


def _list(values) -> str:
    return "[" + ", ".join(values) + "]"


LAST_KNOT = 1 + C.CHANGES
SHRUNK = f"CASE WHEN i <> j OR i < 2 THEN 0e0 WHEN i <= {LAST_KNOT} THEN %s ELSE {M.WEEKDAY_SHRINKAGE}e0 END"
BENT = {**SERIES, **{
    "bend_days": "SELECT *, CAST(ds - first_day AS DOUBLE) / CAST(last_day - first_day AS DOUBLE) AS x, isodow(ds) - 1 AS weekday FROM "
                 "(SELECT charging_station_id, ds, CAST(y AS DOUBLE) AS y, min(ds) OVER (PARTITION BY charging_station_id) AS first_day, "
                 "max(ds) OVER (PARTITION BY charging_station_id) AS last_day FROM series) WHERE first_day < last_day",
    "bend_basis": f"SELECT charging_station_id, ds, y, unnest(generate_series(0, {C.SIZE - 1})) AS i, unnest(" + _list(
        ["1e0"] + [f"greatest(x - CAST({k!r} AS DOUBLE), 0e0)" for k in C.KNOTS]
        + [f"CASE WHEN weekday = {w} THEN 1e0 ELSE 0e0 END" for w in range(7)]) + ") AS v FROM bend_days",
    "bend_normal": "SELECT charging_station_id, a.i, b.i AS j, sum(a.v * b.v) AS v FROM bend_basis a JOIN bend_basis b USING "
                   f"(charging_station_id, ds) GROUP BY 1, 2, 3 UNION ALL SELECT charging_station_id, i, {C.SIZE}, sum(v * y) FROM bend_basis "
                   "GROUP BY 1, 2",
    "bend_start1": f"SELECT charging_station_id, i, j, v + {SHRUNK % repr(C.FIRST_PENALTY)} AS v FROM bend_normal UNION ALL "
                   f"SELECT charging_station_id, i, {C.SIZE} + side, CASE WHEN i = side + 1 THEN 1e0 ELSE 0e0 END FROM (SELECT DISTINCT "
                   f"charging_station_id, i FROM bend_normal), generate_series(1, {C.CHANGES}) AS g(side)",
    "bend_first": diagonal_sql("bend_start1"),
    "bend_squares1": left_over_sql("bend_first"),
    "bend_noise": f"SELECT *, squares / greatest(train_rows - {2 + C.CHANGES}, 1) AS noise FROM bend_squares1",
    "bend_real": f"SELECT charging_station_id, noise, CASE WHEN real > yy / train_rows * {C.EXACT!r} THEN real ELSE 0e0 END AS bend_variance FROM "
                 "(SELECT charging_station_id, any_value(noise) AS noise, any_value(yy) AS yy, any_value(train_rows) AS train_rows, "
                 "(sum(CASE WHEN side = 0 THEN v * v ELSE 0e0 END) - any_value(noise) * sum(CASE WHEN side > 0 THEN v ELSE 0e0 END)) / "
                 f"{C.CHANGES} AS real FROM bend_first JOIN bend_noise USING (charging_station_id) WHERE i BETWEEN 2 AND {LAST_KNOT} AND "
                 "(side = 0 OR side = i - 1) GROUP BY 1)",
    "bend_shrink": "SELECT *, CASE WHEN bend_variance > 0 THEN greatest({0!r}, least({1!r}, noise / bend_variance)) ELSE {1!r} END AS "
                   "bend_penalty FROM bend_real".format(*C.PENALTY_RANGE),
    "bend_start2": f"SELECT charging_station_id, i, j, v + {SHRUNK % 'bend_penalty'} AS v FROM bend_normal JOIN bend_shrink USING "
                   f"(charging_station_id) UNION ALL SELECT charging_station_id, i, {C.SIZE} + side, "
                   f"CASE WHEN side = 1 THEN {_list(map(repr, C.LAST_LEVEL))}[i + 1] ELSE {_list(map(repr, C.LAST_SLOPE))}[i + 1] END FROM "
                   "(SELECT DISTINCT charging_station_id, i FROM bend_normal), generate_series(1, 2) AS g(side)",
    "bend_second": diagonal_sql("bend_start2"),
    "bend_squares2": left_over_sql("bend_second"),
    "bend_fit": "SELECT charging_station_id, any_value(train_rows) AS train_rows, any_value(first_day) AS first_day, any_value(last_day) AS "
                "last_day, any_value(bend_penalty) AS bend_penalty, any_value(bend_variance) AS bend_variance, "
                "sqrt(any_value(squares) / greatest(any_value(train_rows) - 2, 1)) AS sigma, "
                + ", ".join(f"max(CASE WHEN side = 0 AND i = {i} THEN v END) AS {name}" for i, name in enumerate(C.PARAMETERS))
                + ", " + ", ".join(
                    f"sum(CASE WHEN side = {side} THEN v * CAST({_list(map(repr, weights))}[i + 1] AS DOUBLE) END) AS {name}"
                    for name, side, weights in (("level_spread", 1, C.LAST_LEVEL), ("level_slope_spread", 2, C.LAST_LEVEL),
                                                ("slope_spread", 2, C.LAST_SLOPE)))
                + " FROM bend_second JOIN bend_squares2 USING (charging_station_id) JOIN bend_shrink USING (charging_station_id) JOIN "
                "(SELECT DISTINCT charging_station_id, first_day, last_day FROM bend_days) USING (charging_station_id) GROUP BY 1",
    "bend_ahead": "SELECT *, CAST(ds - first_day AS DOUBLE) / CAST(last_day - first_day AS DOUBLE) AS x, CAST(ds - last_day AS DOUBLE) / "
                  "CAST(last_day - first_day AS DOUBLE) AS ahead FROM (SELECT *, last_day + CAST(unnest(generate_series(1, 30)) AS INT) AS ds "
                  "FROM bend_fit)",
}}
FITTED = ["bend_penalty", "bend_variance", "sigma", *C.PARAMETERS, "level_spread", "level_slope_spread", "slope_spread"]


@query("changepoint_fit", f"SELECT charging_station_id, train_rows, first_day, last_day, {', '.join(FITTED)} FROM bend_fit", FITTED, extra=BENT)
def _(spark, sf_dir):
    return C.fit(station_days(spark, sf_dir)).select(STATION, "train_rows", "first_day", "last_day", *FITTED)


@query("changepoint_forecast", "SELECT charging_station_id, ds, yhat, yhat - half AS yhat_lower, yhat + half AS yhat_upper FROM (SELECT "
       "charging_station_id, ds, intercept + slope * x + "
       + " + ".join(f"{c} * greatest(x - CAST({k!r} AS DOUBLE), 0e0)" for c, k in zip(C.BENDS, C.KNOTS[1:]))
       + " + CASE isodow(ds) " + " ".join(f"WHEN {i + 1} THEN {n}" for i, n in enumerate(M.EFFECTS)) + " END AS yhat, "
       "sqrt(sigma * sigma * (1 + level_spread + 2 * ahead * level_slope_spread + ahead * ahead * slope_spread) + bend_variance * "
       f"CAST({C.CHANGES / C.RANGE!r} AS DOUBLE) * power(ahead + CAST({1 - C.RANGE!r} AS DOUBLE), 3) / 3) * {Z80} AS half FROM bend_ahead)",
       BANDS, extra=BENT)
def _(spark, sf_dir):
    """Thirty days after each series by the bent trend, with bands that widen."""
    return C.future(C.fit(station_days(spark, sf_dir)), 30)
