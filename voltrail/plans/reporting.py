"""Sources, sinks, cleaning steps, reports, KPI rows, distributions and top-k lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from voltrail.operators import cleaning as C, joins as J, reports as R
from voltrail.plans.registry import once, query
from voltrail.schema import ENERGY, MINUTES, RAW_HEADERS, ROW_ID, START, STATION
from voltrail.session import scratch_path
from voltrail.sources import readers as IN, sinks as OUT
from voltrail.sources.mapping import long_sessions, raw_sessions, sessions
from voltrail.sources.refresh import refresh_daily

HEADER_OF = {C.standard_name(h): h for h in RAW_HEADERS} | {"row_id": "Row ID"}


def with_raw_headers(df):
    return df.toDF(*[HEADER_OF[c] for c in df.columns])


def raw_csv(spark, sf_dir):
    """The raw sessions as a CSV file with title-case headers, written once."""
    def build():
        raw = with_raw_headers(raw_sessions(spark, sf_dir))
        return OUT.write_csv(raw, scratch_path(spark, "raw-csv")), raw.columns
    return once(spark, sf_dir, "raw_csv", build)


TYPED = ("battery_capacity_kwh", "energy_consumed_kwh", "charging_duration_hours", "charging_rate_kw",
         "charging_cost_usd", "temperature_degc")
TEXT = "row_id, user_id, vehicle_model, charging_station_id, time_of_day, charger_type, user_type"


# --- sources and sinks ----------------------------------------------------------------------------

@query("load_raw", f"SELECT {TEXT}, {', '.join(TYPED)} FROM raw_sessions", TYPED)
def _(spark, sf_dir):
    path, headers = raw_csv(spark, sf_dir)
    raw = IN.load_raw(spark, path, headers).transform(C.standardize_columns)
    return raw.select(
        F.col("row_id").cast("bigint"), *TEXT.split(", ")[1:], *[F.col(c).cast("double").alias(c) for c in TYPED]
    )


@query("load_dataset", "SELECT row_id, charging_station_id, charging_start_time, charger_type FROM raw_sessions")
def _(spark, sf_dir):
    df = IN.load_dataset(spark, *raw_csv(spark, sf_dir))
    return df.select(F.col("row_id").cast("bigint"), STATION, "charging_start_time", "charger_type")


@query("read_daily", "SELECT charging_station_id, session_date, total_sessions, total_energy_kwh, "
       "avg_duration_minutes FROM daily", ("total_energy_kwh", "avg_duration_minutes"))
def _(spark, sf_dir):
    path = OUT.write_csv(R.daily_agg(sessions(spark, sf_dir)), scratch_path(spark, "daily-csv"))
    return IN.read_daily(spark, path)


@query("read_pruned", "SELECT charging_station_id, cluster AS station_cluster_label FROM labels")
def _(spark, sf_dir):
    from voltrail.sources.mapping import rule_labels
    path = OUT.write_parquet(rule_labels(sessions(spark, sf_dir)).withColumn("extra", F.lit(1)),
                             scratch_path(spark, "labels"))
    return IN.read_pruned(spark.read.parquet(path), {STATION: STATION, "cluster": "station_cluster_label"})


@query("write_csv", "SELECT row_id, user_id, charging_station_id, charging_start_time, energy_consumed_kwh, "
       "start_hour, day_of_week, charging_duration_minutes FROM sessions", (ENERGY, MINUTES))
def _(spark, sf_dir):
    names = ["row_id", "user_id", STATION, "charging_start_time", ENERGY, "start_hour", "day_of_week", MINUTES]
    df = sessions(spark, sf_dir).select(*names)
    path = OUT.write_csv(df, scratch_path(spark, "sessions-csv"))
    return spark.read.schema(df.schema).options(**IN.CSV).csv(path)


@query("station_master", "SELECT DISTINCT charging_station_id, charging_station_location, charger_type, "
       "charging_rate_kw FROM sessions")
def _(spark, sf_dir):
    return R.station_master(sessions(spark, sf_dir))


@query("register_table", "SELECT charger_type, count(*) AS sessions FROM sessions GROUP BY 1")
def _(spark, sf_dir):
    OUT.register_table(sessions(spark, sf_dir), "ev_sessions")
    return spark.sql("SELECT charger_type, count(*) AS sessions FROM ev_sessions GROUP BY charger_type")


BUCKETS = 16


@query("bucketed_tables", "SELECT charging_station_id, coalesce(CAST(cluster AS VARCHAR), 'unknown') AS station_cluster_label, count(*) AS sessions, "
       "sum(energy_consumed_kwh) AS total_energy_kwh FROM sessions LEFT JOIN labels USING (charging_station_id) GROUP BY 1, 2", ("total_energy_kwh",))
def _(spark, sf_dir):
    """Sessions and station labels as tables bucketed by station: labels joined and sessions counted without an exchange."""
    from voltrail.plans.history import stored_labels
    left = OUT.register_table(sessions(spark, sf_dir), "sessions_by_station", buckets=BUCKETS, sort_by=[START],
                              path=scratch_path(spark, "sessions-by-station"))
    right = OUT.register_table(stored_labels(spark, sf_dir), "labels_by_station", buckets=BUCKETS, path=scratch_path(spark, "labels-by-station"))
    return J.label_totals(left, right)


@query("refresh_daily", "SELECT charging_station_id, session_date, total_sessions, total_energy_kwh, avg_duration_minutes FROM daily",
       ("total_energy_kwh", "avg_duration_minutes"))
def _(spark, sf_dir):
    """A part of the sessions is stored and aggregated, the others arrive, and only the days they touch are refreshed."""
    df = sessions(spark, sf_dir).withColumn("session_date", F.to_date(START)).filter("session_date IS NOT NULL")
    arrived, folder = (F.dayofmonth("session_date") % 2 == 0) | (F.col(ROW_ID) % 2 == 0), scratch_path(spark, "by-day")
    OUT.write_parquet(df.filter(arrived), f"{folder}/sessions", partition_by="session_date")
    refresh_daily(spark, f"{folder}/sessions", f"{folder}/daily")
    df.filter(~arrived).write.mode("append").partitionBy("session_date").parquet(f"{folder}/sessions")
    return refresh_daily(spark, f"{folder}/sessions", f"{folder}/daily")


@query("row_count", "SELECT count(*) AS row_count FROM sessions")
def _(spark, sf_dir):
    return R.row_count(sessions(spark, sf_dir))


@query("daily_or_rebuild", "SELECT 'rebuilt' AS branch, charging_station_id, session_date, total_sessions FROM daily UNION ALL "
       "SELECT 'stored', charging_station_id, session_date, total_sessions + 1 FROM daily")
def _(spark, sf_dir):
    """Both branches: at a fresh path nothing is stored; the stored table is told apart by one session more a day."""
    df = sessions(spark, sf_dir)
    rebuilt = IN.daily_or_rebuild(spark, scratch_path(spark, "absent"), df)
    path = OUT.write_parquet(R.daily_agg(df).withColumn("total_sessions", F.col("total_sessions") + 1), scratch_path(spark, "daily"))
    kept = IN.daily_or_rebuild(spark, path, df)
    return rebuilt.select(F.lit("rebuilt").alias("branch"), "*").unionByName(kept.select(F.lit("stored").alias("branch"), "*"))


EXTRACTS = {
    "hourly": "SELECT charging_station_id, start_hour, count(user_id) AS total_sessions, sum(energy_consumed_kwh) AS total_energy_kwh, "
              "avg(charging_duration_minutes) AS avg_duration_minutes FROM sessions GROUP BY 1, 2",
}
EXTRACT_NUMBERS = ("first_number", "second_number")


@query("export_all", "SELECT 'sessions_cleaned' AS extract, charging_station_id, CAST(row_id AS VARCHAR) AS place, energy_consumed_kwh AS "
       "first_number, charging_duration_minutes AS second_number FROM sessions "
       "UNION ALL SELECT 'station_master', charging_station_id, concat(charging_station_location, ' / ', charger_type), charging_rate_kw, NULL FROM "
       "(SELECT DISTINCT charging_station_id, charging_station_location, charger_type, charging_rate_kw FROM sessions) "
       "UNION ALL SELECT 'daily_agg', charging_station_id, concat(CAST(session_date AS VARCHAR), ' / ', total_sessions), total_energy_kwh, "
       "avg_duration_minutes FROM daily "
       "UNION ALL SELECT 'hourly_agg', charging_station_id, concat(start_hour, ' / ', total_sessions), total_energy_kwh, avg_duration_minutes "
       "FROM hourly", EXTRACT_NUMBERS, extra=EXTRACTS)
def _(spark, sf_dir):
    """The contents of all four extracts, read back."""
    paths = OUT.export_all(sessions(spark, sf_dir), scratch_path(spark, "extracts"))
    with_count = lambda c: F.concat_ws(" / ", F.col(c).cast("string"), "total_sessions")
    shown = {
        "sessions_cleaned": (F.col("row_id").cast("string"), F.col(ENERGY), F.col(MINUTES)),
        "station_master": (F.concat_ws(" / ", "charging_station_location", "charger_type"), F.col("charging_rate_kw"), F.lit(None).cast("double")),
        "daily_agg": (with_count("session_date"), F.col("total_energy_kwh"), F.col("avg_duration_minutes")),
        "hourly_agg": (with_count("start_hour"), F.col("total_energy_kwh"), F.col("avg_duration_minutes")),
    }
    parts = [
        spark.read.parquet(paths[name]).select(
            F.lit(name).alias("extract"), STATION, place.alias("place"),
            *[v.cast("double").alias(n) for n, v in zip(EXTRACT_NUMBERS, values)])
        for name, (place, *values) in shown.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- projections, filters, cleaning ---------------------------------------------------------------

@query("standardize_columns", "SELECT row_id, state_of_charge_end_pct, temperature_degc, "
       "distance_driven_since_last_charge_km FROM raw_sessions")
def _(spark, sf_dir):
    df = C.standardize_columns(with_raw_headers(raw_sessions(spark, sf_dir)))
    return df.select("row_id", "state_of_charge_end_pct", "temperature_degc", "distance_driven_since_last_charge_km")


@query("parse_times", "SELECT row_id, charging_start_time FROM raw_sessions")
def _(spark, sf_dir):
    text = raw_sessions(spark, sf_dir).select("row_id", F.col("charging_start_time").cast("string"))
    return C.parse_times(text)


@query("coerce_numeric", "SELECT row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE battery_capacity_kwh END "
       "AS battery_capacity_kwh, temperature_degc FROM raw_sessions")
def _(spark, sf_dir):
    capacity = F.when(F.col("row_id") % 7 == 0, "n.a. ").otherwise(F.col("battery_capacity_kwh").cast("string"))
    text = raw_sessions(spark, sf_dir).select(
        "row_id", capacity.alias("battery_capacity_kwh"), F.col("temperature_degc").cast("string")
    )
    return C.coerce_numeric(text)


@query("time_features", "SELECT row_id, CAST(hour(charging_start_time) AS INT) AS start_hour, "
       "dayname(charging_start_time) AS day_of_week, charging_duration_hours * 60 AS charging_duration_minutes "
       "FROM raw_sessions", (MINUTES,))
def _(spark, sf_dir):
    df = raw_sessions(spark, sf_dir).select("row_id", "charging_start_time", "charging_duration_hours")
    return C.time_features(df).select("row_id", "start_hour", "day_of_week", MINUTES)


@query("drop_required", "SELECT row_id, energy_consumed_kwh, charging_duration_hours FROM raw_sessions "
       "WHERE energy_consumed_kwh IS NOT NULL AND charging_duration_hours IS NOT NULL",
       (ENERGY, "charging_duration_hours"))
def _(spark, sf_dir):
    return C.drop_required(raw_sessions(spark, sf_dir)).select("row_id", ENERGY, "charging_duration_hours")


@query("prepare_dataset", "SELECT * FROM sessions", (
    "battery_capacity_kwh", ENERGY, "charging_duration_hours", "charging_rate_kw", "charging_cost_usd",
    "state_of_charge_start_pct", "state_of_charge_end_pct", "distance_driven_since_last_charge_km",
    "temperature_degc", "vehicle_age_years", MINUTES))
def _(spark, sf_dir):
    return C.prepare_dataset(raw_sessions(spark, sf_dir))


@query("date_range_filter", "SELECT row_id, charging_station_id, charging_start_time FROM long_sessions "
       "WHERE CAST(charging_start_time AS DATE) BETWEEN DATE '1996-03-05' AND DATE '1997-08-20'")
def _(spark, sf_dir):
    df = long_sessions(spark, sf_dir).select("row_id", STATION, "charging_start_time")
    return C.date_range_filter(df, dt.date(1996, 3, 5), dt.date(1997, 8, 20))


CHOSEN = ["Station_3", "Station_14", "Station_15", "Station_92"]
CHOSEN_SQL = ", ".join(f"'{s}'" for s in CHOSEN)


@query("station_filter", f"SELECT row_id, charging_station_id FROM sessions WHERE charging_station_id IN ({CHOSEN_SQL})")
def _(spark, sf_dir):
    return C.station_filter(sessions(spark, sf_dir), CHOSEN).select("row_id", STATION)


@query("station_series_filter", "SELECT session_date, total_sessions FROM daily WHERE charging_station_id = 'Station_7'")
def _(spark, sf_dir):
    return R.station_series_filter(R.daily_agg(sessions(spark, sf_dir)), "Station_7").select(
        "session_date", "total_sessions"
    )


@query("session_date", "SELECT row_id, CAST(charging_start_time AS DATE) AS session_date FROM sessions")
def _(spark, sf_dir):
    return sessions(spark, sf_dir).select("row_id", C.session_date().alias("session_date"))


@query("sample_head", "SELECT row_id, charging_station_id, energy_consumed_kwh FROM sessions ORDER BY row_id LIMIT 20")
def _(spark, sf_dir):
    return C.sample_head(sessions(spark, sf_dir).select("row_id", STATION, ENERGY), 20)


@query("require_columns", "SELECT energy_consumed_kwh, start_hour, charger_type, charging_duration_minutes FROM sessions",
       (ENERGY, MINUTES))
def _(spark, sf_dir):
    return C.require_columns(sessions(spark, sf_dir), [ENERGY, "start_hour", "charger_type"], MINUTES)


SERIES = {
    "series": "SELECT charging_station_id, session_date AS ds, total_sessions AS y FROM daily "
              "QUALIFY count(*) OVER (PARTITION BY charging_station_id) >= 2",
}


@query("rename_series", "SELECT charging_station_id, ds, y FROM series", extra=SERIES)
def _(spark, sf_dir):
    return R.station_series(R.daily_agg(sessions(spark, sf_dir)))


@query("export_filtered", "SELECT row_id, charging_station_id, charging_start_time FROM sessions "
       f"WHERE charging_station_id IN ({CHOSEN_SQL}) "
       "AND CAST(charging_start_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(spark, sf_dir):
    chosen = C.station_filter(
        C.date_range_filter(sessions(spark, sf_dir), dt.date(2024, 1, 5), dt.date(2024, 1, 20)), CHOSEN
    ).select("row_id", STATION, "charging_start_time")
    path = OUT.write_csv(chosen, scratch_path(spark, "filtered-csv"))
    return spark.read.schema(chosen.schema).csv(path, header=True)


# --- reports --------------------------------------------------------------------------------------

@query("hourly_demand", "SELECT start_hour, count(*) AS total_sessions FROM sessions GROUP BY 1")
def _(spark, sf_dir):
    return R.hourly_demand(sessions(spark, sf_dir))


@query("station_demand", "SELECT charging_station_id, count(*) AS sessions FROM sessions GROUP BY 1")
def _(spark, sf_dir):
    return R.station_demand(sessions(spark, sf_dir))


@query("avg_charging_duration", "SELECT charging_station_id, avg(charging_duration_minutes) AS avg_duration_minutes "
       "FROM sessions GROUP BY 1", ("avg_duration_minutes",))
def _(spark, sf_dir):
    return R.avg_charging_duration(sessions(spark, sf_dir))


@query("monthly_trends", "SELECT strftime(charging_start_time, '%Y') AS year, strftime(charging_start_time, '%m') "
       "AS month, count(*) AS sessions FROM long_sessions GROUP BY 1, 2")
def _(spark, sf_dir):
    return R.monthly_trends(long_sessions(spark, sf_dir))


@query("daily_agg", "SELECT * FROM daily", ("total_energy_kwh", "avg_duration_minutes"))
def _(spark, sf_dir):
    return R.daily_agg(sessions(spark, sf_dir))


HOURLY = "SELECT charging_station_id, start_hour, count(user_id) AS total_sessions, " \
         "sum(energy_consumed_kwh) AS total_energy_kwh, avg(charging_duration_minutes) AS avg_duration_minutes " \
         "FROM sessions GROUP BY 1, 2"


@query("hourly_agg", HOURLY, ("total_energy_kwh", "avg_duration_minutes"))
def _(spark, sf_dir):
    return R.hourly_agg(sessions(spark, sf_dir))


@query("kpi_analytics", "SELECT count(*) AS total_sessions, round_even(sum(energy_consumed_kwh), 2) AS total_energy_kwh, "
       "round_even(avg(charging_duration_minutes), 2) AS avg_session_duration_minutes, "
       "(SELECT start_hour FROM sessions GROUP BY start_hour ORDER BY count(*) DESC, start_hour LIMIT 1) AS peak_hour, "
       "count(DISTINCT charging_station_id) AS total_stations, "
       "strftime(min(charging_start_time), '%Y-%m-%d') AS first_date, "
       "strftime(max(charging_start_time), '%Y-%m-%d') AS last_date FROM sessions",
       ("total_energy_kwh", "avg_session_duration_minutes"))
def _(spark, sf_dir):
    return R.kpi_analytics(sessions(spark, sf_dir))


@query("kpi_dashboard", "SELECT count(*) AS total_sessions, count(DISTINCT charging_station_id) AS total_stations, "
       "count(DISTINCT user_id) AS total_users, avg(charging_duration_minutes) AS avg_duration_minutes, "
       "sum(energy_consumed_kwh) / 1000 AS total_energy_mwh, avg(charging_cost_usd) AS avg_cost_usd FROM sessions",
       ("avg_duration_minutes", "total_energy_mwh", "avg_cost_usd"))
def _(spark, sf_dir):
    return R.kpi_dashboard(sessions(spark, sf_dir))


@query("kpi_ratios", "SELECT CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT charging_station_id), 0) AS "
       "sessions_per_station, CAST(count(DISTINCT user_id) AS DOUBLE) / nullif(count(DISTINCT charging_station_id), 0) "
       "AS users_per_station FROM sessions", ("sessions_per_station", "users_per_station"))
def _(spark, sf_dir):
    return R.kpi_ratios(sessions(spark, sf_dir))


@query("duration_stats", "SELECT min(charging_duration_minutes) AS min_minutes, max(charging_duration_minutes) AS "
       "max_minutes, quantile_cont(charging_duration_minutes, 5e-1) AS median_minutes, "
       "quantile_cont(charging_duration_minutes, 9e-1) AS p90_minutes FROM sessions",
       ("min_minutes", "max_minutes", "median_minutes", "p90_minutes"))
def _(spark, sf_dir):
    return R.duration_stats(sessions(spark, sf_dir))


@query("energy_stats", "SELECT avg(energy_consumed_kwh) AS mean_kwh, sum(energy_consumed_kwh) AS total_kwh, "
       "quantile_cont(energy_consumed_kwh, 5e-1) AS median_kwh FROM sessions", ("mean_kwh", "total_kwh", "median_kwh"))
def _(spark, sf_dir):
    return R.energy_stats(sessions(spark, sf_dir))


@query("daily_sessions", "SELECT CAST(charging_start_time AS DATE) AS session_date, count(*) AS sessions "
       "FROM sessions GROUP BY 1")
def _(spark, sf_dir):
    return R.daily_sessions(sessions(spark, sf_dir))


@query("hourly_distribution", "SELECT CAST(hour(charging_start_time) AS INT) AS start_hour, count(*) AS sessions "
       "FROM raw_sessions GROUP BY 1")
def _(spark, sf_dir):
    return R.hourly_distribution(raw_sessions(spark, sf_dir))


@query("dow_distribution", "SELECT day_of_week, count(*) AS sessions FROM sessions GROUP BY 1")
def _(spark, sf_dir):
    return R.dow_distribution(sessions(spark, sf_dir))


DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query("hour_dow_heatmap", "SELECT start_hour, " + ", ".join(
    f"count(*) FILTER (WHERE day_of_week = '{d}') AS {d}" for d in DAYS) + " FROM sessions GROUP BY 1")
def _(spark, sf_dir):
    return R.hour_dow_heatmap(sessions(spark, sf_dir))


@query("station_stats", "SELECT charging_station_id, count(user_id) AS sessions, "
       "round_even(avg(charging_duration_minutes), 2) AS avg_duration_min, "
       "round_even(sum(energy_consumed_kwh), 2) AS total_energy_kwh FROM sessions GROUP BY 1",
       ("avg_duration_min", "total_energy_kwh"))
def _(spark, sf_dir):
    return R.station_stats(sessions(spark, sf_dir))


@query("peak_hour", "SELECT start_hour, count(*) AS sessions FROM sessions GROUP BY 1 "
       "ORDER BY sessions DESC, start_hour LIMIT 1")
def _(spark, sf_dir):
    return R.peak_hour(sessions(spark, sf_dir))


@query("series_inspect", "SELECT 'charging_station_id, session_date, total_sessions, total_energy_kwh, "
       "avg_duration_minutes' AS columns, 'string, date, bigint, double, double' AS types, "
       "count(DISTINCT charging_station_id) AS station_count, min(session_date) AS first_date, "
       "max(session_date) AS last_date FROM daily")
def _(spark, sf_dir):
    return R.series_inspect(R.daily_agg(sessions(spark, sf_dir)))


STATION_FEATURES = (
    "SELECT charging_station_id, count(*) AS session_count, count(DISTINCT user_id) AS unique_users, "
    "coalesce(avg(energy_consumed_kwh), 0e0) AS avg_energy_kwh, "
    "coalesce(avg(charging_duration_minutes), 0e0) AS avg_duration_min, "
    "coalesce(avg(charging_cost_usd), 0e0) AS avg_cost_usd, "
    "coalesce(avg(distance_driven_since_last_charge_km), 0e0) AS avg_distance_km, "
    "coalesce(avg(temperature_degc), 0e0) AS avg_temperature_c, "
    "avg(CASE WHEN charger_type = 'DC Fast Charger' THEN 1e0 ELSE 0e0 END) AS dc_fast_ratio, "
    "avg(CASE WHEN user_type = 'Commuter' THEN 1e0 ELSE 0e0 END) AS commuter_ratio "
    "FROM sessions GROUP BY 1"
)
FEATURE_DOUBLES = ("avg_energy_kwh", "avg_duration_min", "avg_cost_usd", "avg_distance_km", "avg_temperature_c",
                   "dc_fast_ratio", "commuter_ratio")


@query("station_features", STATION_FEATURES, FEATURE_DOUBLES)
def _(spark, sf_dir):
    return R.station_features(sessions(spark, sf_dir))


@query("join_features", STATION_FEATURES, FEATURE_DOUBLES)
def _(spark, sf_dir):
    return R.station_features_joined(sessions(spark, sf_dir))


@query("share_of", "SELECT charging_station_id, avg(CASE WHEN user_type = 'Commuter' THEN 1e0 ELSE 0e0 END) AS share "
       "FROM sessions GROUP BY 1", ("share",))
def _(spark, sf_dir):
    from voltrail.functions.scalar import share_of
    return sessions(spark, sf_dir).groupBy(STATION).agg(share_of("user_type", "Commuter").alias("share"))


# --- series, top-k, sets --------------------------------------------------------------------------

TOP50 = {"top50": "SELECT charging_station_id FROM sessions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50"}


@query("scoped_series", "SELECT 'all' AS scope, session_date AS ds, CAST(sum(total_sessions) AS BIGINT) AS y FROM daily "
       "GROUP BY 2 UNION ALL SELECT 'top50', session_date, CAST(sum(total_sessions) AS BIGINT) FROM daily WHERE "
       "charging_station_id IN (SELECT charging_station_id FROM top50) GROUP BY 2 "
       "UNION ALL SELECT 'station', session_date, CAST(sum(total_sessions) AS BIGINT) FROM daily WHERE "
       "charging_station_id = 'Station_7' GROUP BY 2", extra=TOP50)
def _(spark, sf_dir):
    df = sessions(spark, sf_dir)
    daily = R.daily_agg(df)
    scopes = {
        "all": R.scoped_series(daily),
        "top50": R.scoped_series(daily, top=R.top_scope(df)),
        "station": R.scoped_series(daily, station="Station_7"),
    }
    parts = [s.select(F.lit(n).alias("scope"), "ds", "y") for n, s in scopes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("history_span", "SELECT min(session_date) AS first_day, max(session_date) AS last_day, "
       "count(DISTINCT session_date) AS history_days FROM daily")
def _(spark, sf_dir):
    return R.history_span(R.scoped_series(R.daily_agg(sessions(spark, sf_dir))))


@query("top_energy_stations", "SELECT charging_station_id, sum(energy_consumed_kwh) AS total_energy_kwh FROM sessions "
       "GROUP BY 1 ORDER BY total_energy_kwh DESC, charging_station_id LIMIT 10", ("total_energy_kwh",))
def _(spark, sf_dir):
    return R.top_energy_stations(sessions(spark, sf_dir))


@query("top_session_stations", "SELECT charging_station_id, count(*) AS sessions FROM sessions "
       "GROUP BY 1 ORDER BY sessions DESC, charging_station_id LIMIT 10")
def _(spark, sf_dir):
    return R.top_session_stations(sessions(spark, sf_dir))


@query("top50_scope", "SELECT charging_station_id FROM top50", extra=TOP50)
def _(spark, sf_dir):
    return R.top_scope(sessions(spark, sf_dir))


@query("semi_scope", "SELECT row_id, charging_station_id FROM sessions WHERE charging_station_id IN "
       "(SELECT charging_station_id FROM top50)", extra=TOP50)
def _(spark, sf_dir):
    df = sessions(spark, sf_dir)
    return J.keep_members(df.select("row_id", STATION), R.top_scope(df), top_n=True)


def _placed_sql(report: str, order: str, label: str, value: str, source: str) -> str:
    return (f"SELECT '{report}' AS report, row_number() OVER (ORDER BY {order}) AS place, {label} AS label, "
            f"CAST({value} AS DOUBLE) AS value FROM {source}")


RULE_PROFILE = "(SELECT cluster, count(*) AS n FROM labels GROUP BY 1)"
ORDERED = " UNION ALL ".join([
    _placed_sql("hourly_demand", "start_hour", "CAST(start_hour AS VARCHAR)", "n", "(SELECT start_hour, count(*) AS n FROM sessions GROUP BY 1)"),
    _placed_sql("station_demand", "n DESC, charging_station_id", "charging_station_id", "n",
                "(SELECT charging_station_id, count(*) AS n FROM sessions GROUP BY 1)"),
    _placed_sql("avg_charging_duration", "m DESC, charging_station_id", "charging_station_id", "m",
                "(SELECT charging_station_id, avg(charging_duration_minutes) AS m FROM sessions GROUP BY 1)"),
    _placed_sql("monthly_trends", "y, m", "concat(y, '-', m)", "n", "(SELECT strftime(charging_start_time, '%Y') AS y, "
                "strftime(charging_start_time, '%m') AS m, count(*) AS n FROM long_sessions GROUP BY 1, 2)"),
    _placed_sql("station_master", "charging_station_id, charging_station_location, charger_type, charging_rate_kw NULLS FIRST",
                "concat(charging_station_id, ' / ', charging_station_location, ' / ', charger_type)", "charging_rate_kw",
                "(SELECT DISTINCT charging_station_id, charging_station_location, charger_type, charging_rate_kw FROM sessions)"),
    _placed_sql("missing_report", "m DESC, c", "c", "m", "(SELECT 'battery_capacity_kwh' AS c, count(*) - count(battery_capacity_kwh) AS m FROM "
                "raw_sessions UNION ALL SELECT 'energy_consumed_kwh', count(*) - count(energy_consumed_kwh) FROM raw_sessions UNION ALL SELECT "
                "'charging_rate_kw', count(*) - count(charging_rate_kw) FROM raw_sessions UNION ALL SELECT 'user_id', count(*) - count(user_id) "
                "FROM raw_sessions)"),
    _placed_sql("cluster_counts", "cluster", "CAST(cluster AS VARCHAR)", "n", RULE_PROFILE),
])


@query("ordered_reports", ORDERED, ("value",))
def _(spark, sf_dir):
    """Every ordered report, whole: its place is read from the rows as they come, part by part, and not computed again."""
    from voltrail.models.segments import cluster_counts
    from voltrail.operators.profile import missing_report
    from voltrail.sources.mapping import rule_labels
    df = sessions(spark, sf_dir)
    labels = R.station_features(df).join(rule_labels(df), STATION)
    text = lambda *names: F.concat_ws(" / ", *[F.col(n).cast("string") for n in names])
    reports = {
        "hourly_demand": (R.hourly_demand(df), text("start_hour"), "total_sessions"),
        "station_demand": (R.station_demand(df), text(STATION), "sessions"),
        "avg_charging_duration": (R.avg_charging_duration(df), text(STATION), "avg_duration_minutes"),
        "monthly_trends": (R.monthly_trends(long_sessions(spark, sf_dir)), F.concat_ws("-", "year", "month"), "sessions"),
        "station_master": (R.station_master(df), text(STATION, "charging_station_location", "charger_type"), "charging_rate_kw"),
        "missing_report": (missing_report(raw_sessions(spark, sf_dir), ["battery_capacity_kwh", ENERGY, "charging_rate_kw", "user_id"]),
                           text("column"), "missing_count"),
        "cluster_counts": (cluster_counts(labels).orderBy("cluster"), text("cluster"), "station_count"),
    }
    parts = [
        J.numbered(report).select(F.lit(name).alias("report"), "place", label.alias("label"), F.col(value).cast("double").alias("value"))
        for name, (report, label, value) in reports.items()
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


@query("raw_to_features", "SELECT user_id, charging_station_id, charging_start_time, station_session_load_7d, minutes_since_prev_session, "
       "soc_delta_pct FROM features_of_files", ("station_session_load_7d", "minutes_since_prev_session", "soc_delta_pct"), extra={
           "features_of_files": "SELECT *, state_of_charge_end_pct - state_of_charge_start_pct AS soc_delta_pct, "
                                "CAST(count(*) OVER (PARTITION BY charging_station_id ORDER BY charging_start_time RANGE BETWEEN INTERVAL 7 DAY "
                                "PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS DOUBLE) AS station_session_load_7d, "
                                "date_diff('microsecond', lag(charging_start_time) OVER (PARTITION BY charging_station_id ORDER BY "
                                "charging_start_time, row_id), charging_start_time) / 6e7 AS minutes_since_prev_session FROM sessions"})
def _(spark, sf_dir):
    """Raw files without a row number, from the CSV to the feature table."""
    from voltrail.operators.features import engineer_features
    raw = with_raw_headers(raw_sessions(spark, sf_dir)).orderBy("Row ID").drop("Row ID")
    path = OUT.write_csv(raw, scratch_path(spark, "raw-csv"))
    done = engineer_features(IN.load_clean(spark, path))
    return done.select("user_id", STATION, "charging_start_time", "station_session_load_7d", "minutes_since_prev_session", "soc_delta_pct")


@query("distinct_stations", "SELECT DISTINCT charging_station_id FROM sessions WHERE charging_station_id IS NOT NULL")
def _(spark, sf_dir):
    return C.distinct_stations(sessions(spark, sf_dir))
