"""Demand, duration and trend reports, KPI rows, extracts and top-k lists.

Every report is one aggregation with map-side partial results, so a hot station or hour costs one
partial row per task. Keys that are null are dropped in the extracts and kept in the four SQL reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.functions.quantiles import exact_quantiles
from voltrail.functions.scalar import iso_date, safe_divide, share_of
from voltrail.operators.joins import keep_members
from voltrail.schema import ENERGY, MINUTES, SEGMENT_FEATURES, START, STATION, STATION_MASTER_COLUMNS, WEEKDAYS

DATE = "session_date"


# --- the four SQL reports -------------------------------------------------------------------------

def hourly_demand(df: DataFrame) -> DataFrame:
    return df.groupBy("start_hour").agg(F.count(F.lit(1)).alias("total_sessions")).orderBy("start_hour")


def station_demand(df: DataFrame) -> DataFrame:
    counts = df.groupBy(STATION).agg(F.count(F.lit(1)).alias("sessions"))
    return counts.orderBy(F.desc("sessions"), STATION)


def avg_charging_duration(df: DataFrame) -> DataFrame:
    means = df.groupBy(STATION).agg(F.avg(MINUTES).alias("avg_duration_minutes"))
    return means.orderBy(F.desc("avg_duration_minutes"), STATION)


def monthly_trends(df: DataFrame) -> DataFrame:
    keys = [F.date_format(START, "yyyy").alias("year"), F.date_format(START, "MM").alias("month")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions")).orderBy("year", "month")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


# --- extracts -------------------------------------------------------------------------------------

def station_master(df: DataFrame) -> DataFrame:
    """Distinct station metadata. The per-session rate is part of it, so a station can have many rows."""
    available = [c for c in STATION_MASTER_COLUMNS if c in df.columns]
    return df.select(*available).distinct().orderBy(*available)


def _demand_measures() -> list:
    return [
        F.count("user_id").alias("total_sessions"),
        F.sum(ENERGY).alias("total_energy_kwh"),
        F.avg(MINUTES).alias("avg_duration_minutes"),
    ]


def daily_agg(df: DataFrame) -> DataFrame:
    if START not in df.columns:
        raise ValueError(f"{START} column missing; cannot create daily aggregate")
    dated = df.withColumn(DATE, F.to_date(START))
    return dated.filter(F.col(STATION).isNotNull() & F.col(DATE).isNotNull()).groupBy(STATION, DATE).agg(
        *_demand_measures()
    )


def hourly_agg(df: DataFrame) -> DataFrame:
    if "start_hour" not in df.columns:
        raise ValueError("start_hour column missing; cannot create hourly aggregate")
    keyed = df.filter(F.col(STATION).isNotNull() & F.col("start_hour").isNotNull())
    return keyed.groupBy(STATION, "start_hour").agg(*_demand_measures())


# --- KPI rows -------------------------------------------------------------------------------------

def kpi_analytics(df: DataFrame) -> DataFrame:
    # The peak hour is a count of 24 groups. As ``mode`` beside the distinct count it would be
    # aggregated per station in sorted order.
    return df.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.bround(F.sum(ENERGY), 2).alias("total_energy_kwh"),
        F.bround(F.avg(MINUTES), 2).alias("avg_session_duration_minutes"),
        iso_date(F.min(START)).alias("first_date"),
        iso_date(F.max(START)).alias("last_date"),
    ).withColumns({"total_stations": _distinct(df, STATION), "peak_hour": peak_hour(df).select("start_hour").scalar()})


def _distinct(df: DataFrame, column: str) -> Column:
    """Number of values of a column, by an aggregate of its own: no row is expanded for it, and no mean travels with it."""
    return df.select(column).groupBy(column).agg(F.lit(1)).agg(F.count(column).alias("n")).scalar()


def kpi_dashboard(df: DataFrame) -> DataFrame:
    totals = df.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg(MINUTES).alias("avg_duration_minutes"),
        (F.sum(ENERGY) / 1000).alias("total_energy_mwh"),
        F.avg("charging_cost_usd").alias("avg_cost_usd"),
    )
    return totals.withColumns({"total_stations": _distinct(df, STATION), "total_users": _distinct(df, "user_id")}).select(
        "total_sessions", "total_stations", "total_users", "avg_duration_minutes", "total_energy_mwh", "avg_cost_usd")


def kpi_ratios(df: DataFrame) -> DataFrame:
    totals = row_count(df).withColumns({"stations": _distinct(df, STATION), "users": _distinct(df, "user_id")})
    return totals.select(
        safe_divide(F.col("row_count"), F.col("stations"), None).alias("sessions_per_station"),
        safe_divide(F.col("users"), F.col("stations"), None).alias("users_per_station"),
    )


def _quantile_row(df: DataFrame, column: str, named: dict[str, float], **options) -> DataFrame:
    long = exact_quantiles(df, [column], list(named.values()), **options)
    return long.agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in named.items()])


def duration_stats(df: DataFrame) -> DataFrame:
    ends = df.agg(F.min(MINUTES).alias("min_minutes"), F.max(MINUTES).alias("max_minutes"))
    ranks = _quantile_row(df, MINUTES, {"median_minutes": 0.5, "p90_minutes": 0.9})
    return ends.withColumns({c: ranks.select(c).scalar() for c in ranks.columns})


def energy_stats(df: DataFrame) -> DataFrame:
    totals = df.agg(F.avg(ENERGY).alias("mean_kwh"), F.sum(ENERGY).alias("total_kwh"))
    return totals.withColumn("median_kwh", _quantile_row(df, ENERGY, {"median_kwh": 0.5}).scalar())


# --- distributions --------------------------------------------------------------------------------

def daily_sessions(df: DataFrame) -> DataFrame:
    days = df.groupBy(F.to_date(START).alias(DATE)).agg(F.count(F.lit(1)).alias("sessions"))
    return days.filter(F.col(DATE).isNotNull()).orderBy(DATE)


def hourly_distribution(df: DataFrame) -> DataFrame:
    hour = F.col("start_hour") if "start_hour" in df.columns else F.hour(START)
    counts = df.groupBy(hour.alias("start_hour")).agg(F.count(F.lit(1)).alias("sessions"))
    return counts.filter(F.col("start_hour").isNotNull()).orderBy("start_hour")


def peak_hour(df: DataFrame) -> DataFrame:
    return hourly_distribution(df).orderBy(F.desc("sessions"), "start_hour").limit(1)


def _weekday_number(name: str = "day_of_week"):
    return F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col(name))


def dow_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("day_of_week").agg(F.count(F.lit(1)).alias("sessions"))
    return counts.filter(F.col("day_of_week").isin(WEEKDAYS)).orderBy(_weekday_number())


def hour_dow_heatmap(df: DataFrame) -> DataFrame:
    cells = df.filter(F.col("start_hour").isNotNull()).groupBy("start_hour").pivot("day_of_week", WEEKDAYS)
    return cells.agg(F.count(F.lit(1))).na.fill(0).orderBy("start_hour")


def station_stats(df: DataFrame) -> DataFrame:
    return df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(
        F.count("user_id").alias("sessions"),
        F.bround(F.avg(MINUTES), 2).alias("avg_duration_min"),
        F.bround(F.sum(ENERGY), 2).alias("total_energy_kwh"),
    ).orderBy(STATION)


# --- top-k ----------------------------------------------------------------------------------------

def top_energy_stations(df: DataFrame, n: int = 10) -> DataFrame:
    totals = df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(F.sum(ENERGY).alias("total_energy_kwh"))
    return totals.orderBy(F.desc("total_energy_kwh"), STATION).limit(n)


def top_session_stations(df: DataFrame, n: int = 10) -> DataFrame:
    counts = df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(F.count(F.lit(1)).alias("sessions"))
    return counts.orderBy(F.desc("sessions"), STATION).limit(n)


def top_scope(df: DataFrame, n: int = 50) -> DataFrame:
    return top_session_stations(df, n).select(STATION)


# --- station features -----------------------------------------------------------------------------

def _station_measures(df: DataFrame) -> DataFrame:
    return df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.avg(ENERGY).alias("avg_energy_kwh"),
        F.avg(MINUTES).alias("avg_duration_min"),
        F.avg("charging_cost_usd").alias("avg_cost_usd"),
        F.avg("distance_driven_since_last_charge_km").alias("avg_distance_km"),
        F.avg("temperature_degc").alias("avg_temperature_c"),
        *_shares(),
    )


def _shares() -> list:
    return [
        share_of("charger_type", "DC Fast Charger").alias("dc_fast_ratio"),
        share_of("user_type", "Commuter").alias("commuter_ratio"),
    ]


def _station_users(df: DataFrame) -> DataFrame:
    return df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(F.countDistinct("user_id").alias("unique_users"))


def station_features(df: DataFrame) -> DataFrame:
    """Nine features per station; a station whose values are all null gets 0.

    The distinct users are counted apart from the means: in one aggregate every (station, user) pair
    would carry all the sums through the shuffle, and users are close to unique. Apart, the means shuffle
    one row per station and task, and the users two columns.
    """
    features = _station_measures(df).join(_station_users(df), STATION).na.fill(0.0)
    return features.select(STATION, *SEGMENT_FEATURES)


def station_features_joined(df: DataFrame) -> DataFrame:
    """The same table with the two shares from an aggregate of their own, joined one-to-one."""
    shares = df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(*_shares())
    measures = _station_measures(df).drop("dc_fast_ratio", "commuter_ratio")
    joined = measures.join(_station_users(df), STATION).join(shares, STATION, "inner").na.fill(0.0)
    return joined.select(STATION, *SEGMENT_FEATURES)


# --- daily series ---------------------------------------------------------------------------------

def scoped_series(daily: DataFrame, top: DataFrame | None = None, station: str | None = None) -> DataFrame:
    """Sessions per day over one station, the top stations (``top_scope``), or all."""
    scoped = daily
    if station is not None:
        scoped = scoped.filter(F.col(STATION) == station)
    if top is not None:
        scoped = keep_members(scoped, top, top_n=True)
    return scoped.groupBy(F.col(DATE).alias("ds")).agg(F.sum("total_sessions").alias("y")).orderBy("ds")


def scope_series(daily: DataFrame, name: str, top: DataFrame | None = None, station: str | None = None, min_days: int = 2) -> DataFrame:
    """``scoped_series`` as one series with ``name`` as its key, in the shape the forecasts read."""
    total = scoped_series(daily.filter(F.col(DATE).isNotNull()), top, station)
    # a scope has one row for each day of the calendar
    days = F.count(F.lit(1)).over(Window.partitionBy(STATION))
    return total.select(F.lit(name).alias(STATION), "ds", "y").withColumn("_days", days).filter(F.col("_days") >= min_days).drop("_days")


def station_series(daily: DataFrame, min_days: int = 2) -> DataFrame:
    """(station, ds, y) of every station with at least ``min_days`` days.

    The window is over the daily table: a station has at most one row per calendar day.
    """
    days = F.count(F.lit(1)).over(Window.partitionBy(STATION))
    return (
        daily.filter(F.col(STATION).isNotNull())
        .select(STATION, F.col(DATE).alias("ds"), F.col("total_sessions").alias("y"))
        .withColumn("_days", days)
        .filter(F.col("_days") >= min_days)
        .drop("_days")
    )


def station_series_filter(daily: DataFrame, station: str) -> DataFrame:
    """One station's rows; an unknown station is an error."""
    rows = daily.filter(F.col(STATION) == station)
    if rows.isEmpty():
        raise ValueError(f"No records found for station_id={station}")
    return rows


def history_span(series: DataFrame) -> DataFrame:
    return series.agg(
        F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count(F.lit(1)).alias("history_days")
    )


def series_inspect(daily: DataFrame) -> DataFrame:
    """Column list, types, station count and date span of a daily table, as one row."""
    has_station, has_date = STATION in daily.columns, DATE in daily.columns
    no_date = F.lit(None).cast("date")
    return daily.agg(
        (F.countDistinct(STATION) if has_station else F.lit(0).cast("bigint")).alias("station_count"),
        (F.min(DATE) if has_date else no_date).alias("first_date"),
        (F.max(DATE) if has_date else no_date).alias("last_date"),
    ).select(
        F.lit(", ".join(daily.columns)).alias("columns"),
        F.lit(", ".join(t for _, t in daily.dtypes)).alias("types"),
        "station_count",
        "first_date",
        "last_date",
    )
