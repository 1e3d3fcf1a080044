"""Station history windows, scalar features and the full feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltrail.functions import scalar as S
from voltrail.operators import reports as R, windows as W
from voltrail.operators.cleaning import restore_order
from voltrail.operators.features import engineer_features
from voltrail.operators.joins import attach_cluster
from voltrail.plans.registry import once, query
from voltrail.plans.reporting import SERIES
from voltrail.schema import (
    CATEGORICAL_FEATURES, ENERGY, MINUTES, NUMERIC_FEATURES, ROW_ID, START, STATION,
)
from voltrail.session import cut_lineage
from voltrail.sources.mapping import (
    DECIMAL_SESSIONS, HOT_SESSIONS, columns_sql, decimal_sessions, hot_sessions, long_sessions, requests, rule_labels, sessions,
)

NEEDED = [ROW_ID, STATION, START, MINUTES, "temperature_degc"]

IN_ORDER = "PARTITION BY charging_station_id ORDER BY charging_start_time, row_id"


def _range(days: int) -> str:
    return (f"PARTITION BY charging_station_id ORDER BY charging_start_time RANGE BETWEEN INTERVAL {days} DAY "
            "PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING")


def history_sql(source: str) -> str:
    """The six history columns by sliding frames."""
    return (
        "SELECT *, CASE WHEN n7 > 0 THEN m7 / 10080 ELSE 0e0 END AS station_utilization_ratio_7d, "
        "coalesce(nullif(CASE WHEN n7 > 0 THEN m7 / n7 END, 0e0), past_mean) AS station_avg_duration_7d, "
        "coalesce(temperature_degc - t30, 0e0) AS temperature_station_anomaly, "
        "CAST(n7 AS DOUBLE) AS station_session_load_7d FROM (SELECT *, "
        f"date_diff('microsecond', lag(charging_start_time) OVER ({IN_ORDER}), charging_start_time) / 6e7 "
        "AS minutes_since_prev_session, "
        f"lag(charging_duration_minutes) OVER ({IN_ORDER}) AS prev_session_duration, "
        f"count(*) OVER ({_range(7)}) AS n7, sum(charging_duration_minutes) OVER ({_range(7)}) AS m7, "
        f"avg(temperature_degc) OVER ({_range(30)}) AS t30, "
        f"avg(charging_duration_minutes) OVER ({IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
        f"AS past_mean FROM {source})"
    )


HISTORY = {"history": history_sql("sessions"), "long_history": history_sql("long_sessions")}


def decimal_history_sql(source: str) -> str:
    """The sums in exact decimals, as the minutes have two places."""
    exact = "CAST(charging_duration_minutes AS DECIMAL(18, 2))"
    return (
        "SELECT row_id, charging_station_id, CASE WHEN n7 > 0 THEN m7 / 10080 ELSE 0e0 END AS station_utilization_ratio_7d, "
        "coalesce(nullif(CASE WHEN n7 > 0 THEN m7 / n7 END, 0e0), past_m / nullif(past_n, 0)) AS station_avg_duration_7d, "
        "coalesce(temperature_degc - t30, 0e0) AS temperature_station_anomaly FROM (SELECT *, "
        f"count(*) OVER ({_range(7)}) AS n7, CAST(sum({exact}) OVER ({_range(7)}) AS DOUBLE) AS m7, "
        f"CAST(sum(CAST(temperature_degc AS DECIMAL(18, 2))) OVER ({_range(30)}) AS DOUBLE) / "
        f"nullif(count(temperature_degc) OVER ({_range(30)}), 0) AS t30, "
        f"count(*) OVER ({IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_n, "
        f"CAST(sum({exact}) OVER ({IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS past_m "
        f"FROM {source})"
    )


def _register_window(name: str, column: str, table: str = "history", source=sessions, previous: bool = False) -> None:
    @query(name, f"SELECT row_id, charging_station_id, {column} FROM {table}", (column,), extra=HISTORY)
    def _(spark, sf_dir):
        df = source(spark, sf_dir).select(*NEEDED)
        done = W.previous_session(df) if previous else W.station_context(df)
        return done.select(ROW_ID, STATION, column)


_register_window("minutes_since_prev", "minutes_since_prev_session", previous=True)
_register_window("prev_duration", "prev_session_duration", previous=True)
_register_window("load_7d", "station_session_load_7d")
_register_window("utilization_7d", "station_utilization_ratio_7d")
_register_window("avg_duration_7d", "station_avg_duration_7d")
_register_window("temperature_anomaly", "temperature_station_anomaly")

CONTEXT = ["minutes_since_prev_session", "prev_session_duration", "station_session_load_7d",
           "station_avg_duration_7d", "station_utilization_ratio_7d", "temperature_station_anomaly"]


EXACT_COLUMNS = ["station_utilization_ratio_7d", "station_avg_duration_7d", "temperature_station_anomaly"]
DECIMALS = {"decimal_sessions": f"SELECT {columns_sql(DECIMAL_SESSIONS)} FROM orders",
            "hot_sessions": f"SELECT {columns_sql(HOT_SESSIONS)} FROM events"}
#: Events in a slice of the next two queries, so that stations and instants span slices in small tables too.
SMALL_SLICE = 5000


@query("history_decimals", decimal_history_sql("decimal_sessions"), EXACT_COLUMNS, extra=DECIMALS)
def _(spark, sf_dir):
    """Two-decimal minutes, and half-years of zero minutes."""
    return W.station_context(decimal_sessions(spark, sf_dir), slice_rows=SMALL_SLICE).select(ROW_ID, STATION, *EXACT_COLUMNS)


@query("history_hot_station", decimal_history_sql("hot_sessions"), EXACT_COLUMNS, extra=DECIMALS)
def _(spark, sf_dir):
    """A station with a third of all sessions, a third of those at one instant."""
    return W.station_context(hot_sessions(spark, sf_dir), slice_rows=SMALL_SLICE).select(ROW_ID, STATION, *EXACT_COLUMNS)


@query("recombine_groups", f"SELECT row_id, charging_station_id, {', '.join(CONTEXT)} FROM long_history",
       CONTEXT, extra=HISTORY)
def _(spark, sf_dir):
    """All history columns on sessions with tied times; the station groups come back as one table."""
    return W.station_context(long_sessions(spark, sf_dir).select(*NEEDED)).select(ROW_ID, STATION, *CONTEXT)


@query("restore_order", f"SELECT row_id, minutes_since_prev_session FROM history", ("minutes_since_prev_session",),
       extra=HISTORY)
def _(spark, sf_dir):
    done = W.previous_session(sessions(spark, sf_dir).select(*NEEDED))
    return restore_order(done).select(ROW_ID, "minutes_since_prev_session")


@query("rolling14", "SELECT charging_station_id, ds, CASE WHEN count(y) OVER w >= 7 THEN avg(y) OVER w END AS rolling_mean, "
       "coalesce(CASE WHEN count(y) OVER w >= 7 THEN stddev_samp(y) OVER w END, stddev_samp(y) OVER "
       "(PARTITION BY charging_station_id)) AS rolling_std FROM series WINDOW w AS (PARTITION BY charging_station_id "
       "ORDER BY ds ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)", ("rolling_mean", "rolling_std"), extra=SERIES)
def _(spark, sf_dir):
    series = R.station_series(R.daily_agg(sessions(spark, sf_dir)))
    return W.rolling14(series, [STATION]).select(STATION, "ds", "rolling_mean", "rolling_std")


@query("holdout_split", "SELECT charging_station_id, ds, CAST(place <= CASE WHEN n >= 14 THEN least(7, n // 3) ELSE 0 END "
       "AS INT) AS is_test FROM (SELECT *, count(*) OVER (PARTITION BY charging_station_id) AS n, row_number() OVER "
       "(PARTITION BY charging_station_id ORDER BY ds DESC) AS place FROM series)", extra=SERIES)
def _(spark, sf_dir):
    series = R.station_series(R.daily_agg(sessions(spark, sf_dir)))
    return W.holdout_split(series, [STATION]).select(STATION, "ds", "is_test")


@query("min_history", "SELECT concat('Station_', o_custkey) AS charging_station_id, count(DISTINCT "
       "CAST(o_orderdate AS DATE)) AS history_days FROM orders GROUP BY 1 HAVING history_days >= 2")
def _(spark, sf_dir):
    from voltrail.plans.forecasting import customer_daily
    series = R.station_series(customer_daily(spark, sf_dir))
    return series.groupBy(STATION).agg(F.count(F.lit(1)).alias("history_days"))


# --- scalar functions -----------------------------------------------------------------------------

def _clip_sql(value: str, low: str, high: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN greatest({low}, least({high}, {value})) END"


CAPACITY_RATIO = ("CASE WHEN battery_capacity_kwh IS NULL OR battery_capacity_kwh = 0 THEN 0e0 "
                  "ELSE energy_consumed_kwh / battery_capacity_kwh END")
SCALARS = {
    "soc_delta": ("soc_delta_pct", lambda: S.soc_delta("state_of_charge_start_pct", "state_of_charge_end_pct"),
                  "state_of_charge_end_pct - state_of_charge_start_pct", True),
    "is_weekend": ("is_weekend", lambda: S.is_weekend("day_of_week"),
                   "CAST(day_of_week IN ('Saturday', 'Sunday') AS INT)", False),
    "session_month": ("session_month", lambda: F.month(START), "CAST(month(charging_start_time) AS INT)", False),
    "temperature_band": (
        "temperature_band", lambda: S.temperature_band("temperature_degc"),
        "CASE WHEN temperature_degc <= 0 THEN 'freezing' WHEN temperature_degc <= 10 THEN 'cold' WHEN temperature_degc "
        "<= 20 THEN 'mild' WHEN temperature_degc <= 30 THEN 'warm' WHEN temperature_degc > 30 THEN 'hot' "
        "ELSE 'unknown' END", False),
    "start_hour_bin": (
        "start_hour_bin", lambda: S.start_hour_bin("start_hour"),
        "CASE WHEN start_hour <= 6 THEN 'overnight' WHEN start_hour <= 12 THEN 'morning' WHEN start_hour <= 18 "
        "THEN 'afternoon' WHEN start_hour <= 24 THEN 'evening' ELSE 'unknown' END", False),
    "energy_to_capacity": ("energy_to_capacity_ratio", lambda: S.energy_to_capacity(ENERGY, "battery_capacity_kwh"),
                           f"greatest(0e0, least(5e0, {CAPACITY_RATIO}))", True),
    "weather_stress": ("weather_stress_index", lambda: S.weather_stress("temperature_degc"),
                       "abs(temperature_degc - 22)", True),
    "humidity_proxy": ("humidity_proxy", lambda: S.humidity_proxy("temperature_degc"),
                       _clip_sql("(100 - abs(temperature_degc - 20) * 3)", "0e0", "100e0"), True),
    "hour_block": ("hour_block", lambda: S.hour_block("start_hour"), "CAST(start_hour // 4 * 4 AS INT)", False),
    "clip_round": ("served_minutes", lambda: S.served_duration(MINUTES),
                   "round_even(" + _clip_sql("charging_duration_minutes", "5e0", "240e0") + ", 1)", True),
    "date_text": ("date_text", lambda: F.concat_ws(" / ", S.iso_date(START), S.short_date(START)),
                  "concat(strftime(charging_start_time, '%Y-%m-%d'), ' / ', strftime(charging_start_time, '%b %d'))",
                  False),
    "energy_needed": ("energy_needed_kwh", lambda: S.energy_needed("state_of_charge_start_pct", "state_of_charge_end_pct",
                                                           "battery_capacity_kwh"),
                      "(state_of_charge_end_pct - state_of_charge_start_pct) / 100 * battery_capacity_kwh", True),
    "safe_divide": ("km_per_degree", lambda: S.safe_divide("distance_driven_since_last_charge_km", "vehicle_age_years", 0.0),
                    "CASE WHEN vehicle_age_years IS NULL OR vehicle_age_years = 0 THEN 0e0 ELSE "
                    "distance_driven_since_last_charge_km / vehicle_age_years END", True),
    "null_to_default": ("charging_rate_kw", lambda: F.coalesce("charging_rate_kw", F.lit(0.0)),
                        "coalesce(charging_rate_kw, 0e0)", True),
}


def _register_scalar(name: str, column: str, expression, sql: str, is_double: bool) -> None:
    @query(name, f"SELECT row_id, {sql} AS {column} FROM sessions", (column,) if is_double else ())
    def _(spark, sf_dir):
        return sessions(spark, sf_dir).select(ROW_ID, expression().alias(column))


for _name, _spec in SCALARS.items():
    _register_scalar(_name, *_spec)


@query("request_bounds", "SELECT request_id, days BETWEEN 1 AND 25 AS forecast_ok, energy_kwh > 0 AND start_hour BETWEEN 0 "
       "AND 23 AND weekday BETWEEN 0 AND 6 AS duration_ok FROM (SELECT request_id, days, energy_kwh - 20 AS energy_kwh, "
       "start_hour, weekday FROM requests)")
def _(spark, sf_dir):
    # Days are scaled so that a sixth of the requests asks for more than 365.
    asked = requests(spark, sf_dir).withColumn("days", F.when(F.col("days") <= 25, F.col("days")).otherwise(400))
    return asked.select(
        "request_id",
        S.valid_forecast_request("days").alias("forecast_ok"),
        S.valid_duration_request(F.col("energy_kwh") - 20, "start_hour", "weekday").alias("duration_ok"),
    )


# --- feature table --------------------------------------------------------------------------------

def _feature_sql() -> dict[str, str]:
    derived = ", ".join(f"{spec[2]} AS {spec[0]}" for n, spec in SCALARS.items() if n in (
        "soc_delta", "is_weekend", "session_month", "temperature_band", "start_hour_bin", "energy_to_capacity",
        "weather_stress", "humidity_proxy"))
    return {**HISTORY, "features": (
        f"SELECT history.*, {derived}, coalesce(CAST(cluster AS VARCHAR), 'unknown') AS station_cluster_label "
        "FROM history LEFT JOIN labels USING (charging_station_id)")}


FEATURES = _feature_sql()
FEATURE_COLUMNS = [c for c in NUMERIC_FEATURES + CATEGORICAL_FEATURES]
NOT_DOUBLE = {"start_hour", "is_weekend", "session_month"}


def stored_labels(spark, sf_dir):
    """Station labels from the rule, stored as the segment table is."""
    return once(spark, sf_dir, "labels", lambda: cut_lineage(rule_labels(sessions(spark, sf_dir))))


def labelled_features(spark, sf_dir):
    return engineer_features(sessions(spark, sf_dir), stored_labels(spark, sf_dir))


@query("engineer_features", f"SELECT row_id, {', '.join(FEATURE_COLUMNS)}, charging_duration_minutes FROM features",
       [c for c in NUMERIC_FEATURES if c not in NOT_DOUBLE] + [MINUTES], extra=FEATURES)
def _(spark, sf_dir):
    return labelled_features(spark, sf_dir).select(ROW_ID, *FEATURE_COLUMNS, MINUTES)


@query("attach_cluster", "SELECT row_id, charging_station_id, coalesce(CAST(cluster AS VARCHAR), 'unknown') AS "
       "station_cluster_label FROM sessions LEFT JOIN labels USING (charging_station_id)")
def _(spark, sf_dir):
    return attach_cluster(sessions(spark, sf_dir).select(ROW_ID, STATION), stored_labels(spark, sf_dir))
