"""Column names and types of the session tables."""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "charging_station_id"
START = "charging_start_time"
MINUTES = "charging_duration_minutes"
ENERGY = "energy_consumed_kwh"
ROW_ID = "row_id"

# They must equal the source data's headers, categories and feature names.
TIME_COLUMNS = ["charging_start_time", "charging_end_time"]

NUMERIC_COLUMNS = [
    "battery_capacity_kwh",
    "energy_consumed_kwh",
    "charging_duration_hours",
    "charging_rate_kw",
    "charging_cost_usd",
    "state_of_charge_start_pct",
    "state_of_charge_end_pct",
    "distance_driven_since_last_charge_km",
    "temperature_degc",
    "vehicle_age_years",
]

TEXT_COLUMNS = [
    "user_id",
    "vehicle_model",
    "charging_station_id",
    "charging_station_location",
    "time_of_day",
    "day_of_week",
    "charger_type",
    "user_type",
]

REQUIRED_COLUMNS = ["energy_consumed_kwh", "charging_duration_hours"]

# Columns of the station list.
STATION_MASTER_COLUMNS = [
    "charging_station_id",
    "charging_station_location",
    "charger_type",
    "charging_rate_kw",
]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKEND_DAYS = ["Saturday", "Sunday"]

# Feature names of the duration models.
BASE_NUMERIC_FEATURES = [
    "battery_capacity_kwh",
    "energy_consumed_kwh",
    "charging_rate_kw",
    "charging_cost_usd",
    "state_of_charge_start_pct",
    "state_of_charge_end_pct",
    "distance_driven_since_last_charge_km",
    "temperature_degc",
    "vehicle_age_years",
    "start_hour",
]
DERIVED_NUMERIC_FEATURES = [
    "soc_delta_pct",
    "is_weekend",
    "session_month",
    "minutes_since_prev_session",
    "prev_session_duration",
    "station_session_load_7d",
    "station_avg_duration_7d",
    "station_utilization_ratio_7d",
    "energy_to_capacity_ratio",
    "temperature_station_anomaly",
    "weather_stress_index",
    "humidity_proxy",
]
BASE_CATEGORICAL_FEATURES = [
    "vehicle_model",
    "charging_station_location",
    "charging_station_id",
    "time_of_day",
    "day_of_week",
    "charger_type",
    "user_type",
]
DERIVED_CATEGORICAL_FEATURES = ["temperature_band", "start_hour_bin", "station_cluster_label"]
NUMERIC_FEATURES = BASE_NUMERIC_FEATURES + DERIVED_NUMERIC_FEATURES
CATEGORICAL_FEATURES = BASE_CATEGORICAL_FEATURES + DERIVED_CATEGORICAL_FEATURES

# Feature names of the segments.
SEGMENT_FEATURES = [
    "session_count",
    "unique_users",
    "avg_energy_kwh",
    "avg_duration_min",
    "avg_cost_usd",
    "avg_distance_km",
    "avg_temperature_c",
    "dc_fast_ratio",
    "commuter_ratio",
]

# Numeric columns of a cleaned table, in report order.
CLEAN_NUMERIC_COLUMNS = NUMERIC_COLUMNS + ["start_hour", MINUTES]

DAILY_SCHEMA = T.StructType([
    T.StructField("charging_station_id", T.StringType()),
    T.StructField("session_date", T.DateType()),
    T.StructField("total_sessions", T.LongType()),
    T.StructField("total_energy_kwh", T.DoubleType()),
    T.StructField("avg_duration_minutes", T.DoubleType()),
])


def text_schema(headers: list[str]) -> T.StructType:
    """Every column as text, so that a bad number reaches the coercion step and not the reader."""
    return T.StructType([T.StructField(h, T.StringType()) for h in headers])


# Headers of the raw file, in title case with units.
RAW_HEADERS = [
    "User ID",
    "Vehicle Model",
    "Battery Capacity (kWh)",
    "Charging Station ID",
    "Charging Station Location",
    "Charging Start Time",
    "Charging End Time",
    "Energy Consumed (kWh)",
    "Charging Duration (hours)",
    "Charging Rate (kW)",
    "Charging Cost (USD)",
    "Time of Day",
    "Day of Week",
    "State of Charge (Start %)",
    "State of Charge (End %)",
    "Distance Driven (since last charge) (km)",
    "Temperature (°C)",
    "Vehicle Age (years)",
    "Charger Type",
    "User Type",
]
