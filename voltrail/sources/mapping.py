"""Session tables derived from the driver's ``events``, ``orders`` and ``customer`` tables.

The expressions are plain SQL that reads the same in Spark and in the checking engine; only the weekday
name differs. Durations and temperatures are exact binary fractions, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltrail.operators.cleaning import prepare_dataset
from voltrail.session import pin_calendar

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

EVENT_SESSIONS = {
    "row_id": "event_id",
    "user_id": "concat('User_', user_id)",
    "vehicle_model": "CASE event_id % 5 WHEN 0 THEN 'Model A' WHEN 1 THEN 'Model B' WHEN 2 THEN 'Model C' "
                     "WHEN 3 THEN 'Model D' ELSE 'Model E' END",
    "battery_capacity_kwh": "CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE 50e0 + event_id % 51 END",
    "charging_station_id": f"concat('Station_', {K})",
    "charging_station_location": f"CASE {K} % 5 WHEN 0 THEN 'City A' WHEN 1 THEN 'City B' WHEN 2 THEN 'City C' "
                                 "WHEN 3 THEN 'City D' ELSE 'City E' END",
    "charging_start_time": "ts",
    "energy_consumed_kwh": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE value END",
    "charging_duration_hours": "CASE WHEN event_id % 103 = 0 THEN NULL "
                               "ELSE 125e-3 + ((event_id * 7919) % 4500) / 1024e0 END",
    "charging_rate_kw": "CASE WHEN event_id % 20 = 0 THEN NULL ELSE 15e-1 + (event_id * 13) % 48 END",
    "charging_cost_usd": "value * 5e-1",
    "state_of_charge_start_pct": "5e0 + event_id % 60",
    "state_of_charge_end_pct": "25e0 + event_id % 60 + event_id % 21",
    "distance_driven_since_last_charge_km": "CASE WHEN event_id % 21 = 0 THEN NULL "
                                            "ELSE 2e0 + (event_id * 17) % 300 END",
    "temperature_degc": "CASE WHEN event_id % 211 = 0 THEN NULL ELSE ((event_id * 31) % 100) / 2e0 - 10e0 END",
    "vehicle_age_years": "CAST(event_id % 9 AS DOUBLE)",
    "time_of_day": "CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning' "
                   "WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END",
    "day_of_week": "{weekday_name}(ts)",
    "charger_type": f"CASE (event_id + {K}) % 3 WHEN 0 THEN 'Level 1' WHEN 1 THEN 'Level 2' "
                    "ELSE 'DC Fast Charger' END",
    "user_type": "CASE event_id % 3 WHEN 0 THEN 'Commuter' WHEN 1 THEN 'Casual' ELSE 'Long-distance' END",
}

ORDER_SESSIONS = {
    "row_id": "o_orderkey",
    "user_id": "concat('User_', o_custkey)",
    "charging_station_id": "concat('Station_', o_custkey % 100)",
    "charging_start_time": "o_orderdate",
    "energy_consumed_kwh": "o_totalprice / 1000e0",
    "charging_duration_minutes": "6e0 + o_orderkey % 400",
    "temperature_degc": "((o_orderkey * 31) % 100) / 2e0 - 10e0",
}

# Minutes and temperatures that are no binary fractions; no minutes in the second half of a year.
DECIMAL_SESSIONS = {
    "row_id": "o_orderkey",
    "charging_station_id": "concat('Station_', o_custkey % 20)",
    "charging_start_time": "o_orderdate",
    "charging_duration_minutes": "CASE WHEN month(o_orderdate) > 6 THEN 0e0 ELSE (1 + o_orderkey % 23999) / 100e0 END",
    "temperature_degc": "((o_orderkey * 31) % 1000) / 10e0 - 20e0",
}

# One station has a third of all sessions, and a third of those start at one instant.
HOT_SESSIONS = {
    "row_id": "event_id",
    "charging_station_id": f"CASE WHEN event_id % 3 = 0 THEN 'Station_hot' ELSE concat('Station_', {K}) END",
    "charging_start_time": "CASE WHEN event_id % 9 = 0 THEN CAST('2024-01-15 12:00:00' AS {timestamp}) ELSE ts END",
    "charging_duration_minutes": "(1 + (event_id * 7919) % 23999) / 100e0",
    "temperature_degc": "((event_id * 31) % 1000) / 10e0 - 20e0",
}

REQUESTS = {
    "request_id": "c_custkey",
    "charging_station_id": "concat('Station_', c_custkey % 120)",
    "days": "CAST(1 + c_custkey % 30 AS INT)",
    "start_hour": "CAST(c_custkey % 24 AS INT)",
    "weekday": "CAST(c_custkey % 7 AS INT)",
    "day_of_week": "CASE c_custkey % 7 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' "
                   "WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END",
    "energy_kwh": "5e0 + c_custkey % 115",
    "charger_type": "CASE c_custkey % 3 WHEN 0 THEN 'Level 1' WHEN 1 THEN 'Level 2' ELSE 'DC Fast Charger' END",
}

# Station labels from a rule (checkable in SQL); stations 90..99 have none.
LABEL_NUMBER = "CAST(regexp_extract(charging_station_id, '([0-9]+)', 1) AS INT)"
LABEL_RULE = f"CAST({LABEL_NUMBER} % 4 AS INT)"
LABEL_FILTER = f"{LABEL_NUMBER} < 90"


def columns_sql(mapping: dict[str, str], weekday_name: str = "dayname") -> str:
    return ", ".join(f"{e.replace('{weekday_name}', weekday_name).replace('{timestamp}', 'TIMESTAMP')} AS {c}"
                     for c, e in mapping.items())


def _mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    full_name = {"{weekday_name}(ts)": "date_format(ts, 'EEEE')"}
    return df.selectExpr(*[f"{full_name.get(e, e).replace('{timestamp}', 'TIMESTAMP_NTZ')} AS {c}" for c, e in mapping.items()])


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_calendar(spark)
    return _mapped(spark.read.parquet(f"{sf_dir}/events.parquet"), EVENT_SESSIONS)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned sessions: coerced, filtered and with the derived time fields."""
    return prepare_dataset(raw_sessions(spark, sf_dir))


def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions over several years at day-level times, so that ties occur."""
    pin_calendar(spark)
    return _mapped(spark.read.parquet(f"{sf_dir}/orders.parquet"), ORDER_SESSIONS)


def decimal_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_calendar(spark)
    return _mapped(spark.read.parquet(f"{sf_dir}/orders.parquet"), DECIMAL_SESSIONS)


def hot_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_calendar(spark)
    return _mapped(spark.read.parquet(f"{sf_dir}/events.parquet"), HOT_SESSIONS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark.read.parquet(f"{sf_dir}/customer.parquet"), REQUESTS)


def rule_labels(df: DataFrame) -> DataFrame:
    stations = df.select("charging_station_id").distinct()
    return stations.filter(LABEL_FILTER).selectExpr("charging_station_id", f"{LABEL_RULE} AS cluster")
