"""Station history against brute force, for any size of the slices."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from voltrail.operators import windows as W
from voltrail.schema import MINUTES, ROW_ID, START, STATION
from voltrail.sources.mapping import long_sessions, sessions

SCHEMA = f"{ROW_ID} bigint, {STATION} string, {START} timestamp_ntz, {MINUTES} double, temperature_degc double"
FEATURES = ["minutes_since_prev_session", "prev_session_duration", "station_session_load_7d",
            "station_utilization_ratio_7d", "station_avg_duration_7d", "temperature_station_anomaly"]


def brute_force(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, group in rows.groupby(STATION):
        group = group.sort_values([START, ROW_ID])
        for i, (_, row) in enumerate(group.iterrows()):
            age = row[START] - group[START]
            week = group[(age > pd.Timedelta(0)) & (age <= pd.Timedelta(days=7))]
            month = group[(age > pd.Timedelta(0)) & (age <= pd.Timedelta(days=30))]
            past = group.iloc[:i]
            previous = past.iloc[-1] if i else None
            mean = week[MINUTES].mean() if len(week) and week[MINUTES].sum() else past[MINUTES].mean()
            anomaly = row["temperature_degc"] - month["temperature_degc"].mean()
            out.append({
                ROW_ID: row[ROW_ID],
                "minutes_since_prev_session": (row[START] - previous[START]).total_seconds() / 60 if i else np.nan,
                "prev_session_duration": previous[MINUTES] if i else np.nan,
                "station_session_load_7d": float(len(week)),
                "station_utilization_ratio_7d": week[MINUTES].sum() / 10080,
                "station_avg_duration_7d": mean,
                "temperature_station_anomaly": 0.0 if np.isnan(anomaly) else anomaly,
            })
    return pd.DataFrame(out).sort_values(ROW_ID).reset_index(drop=True)


def collected(df) -> pd.DataFrame:
    return df.toPandas().sort_values(ROW_ID).reset_index(drop=True)


def skewed_rows(n=400, seed=1) -> pd.DataFrame:
    """Half of all sessions at one station, many at equal times, with a day step for exact window edges."""
    rng = np.random.default_rng(seed)
    days = rng.integers(0, 60, n)
    half_day = rng.integers(0, 2, n)
    temperature = rng.integers(-20, 70, n) / 2
    return pd.DataFrame({
        ROW_ID: np.arange(n),
        STATION: np.where(rng.random(n) < 0.5, "hot", [f"s{i}" for i in rng.integers(0, 8, n)]),
        START: pd.Timestamp("2024-01-01") + pd.to_timedelta(days, "D") + pd.to_timedelta(12 * half_day, "h"),
        MINUTES: rng.integers(0, 50, n) / 4,
        "temperature_degc": np.where(rng.random(n) < 0.1, np.nan, temperature),
    })


@pytest.mark.parametrize("slice_rows", [W.SLICE_ROWS, 60, 7])
def test_station_context_equals_brute_force(to_spark, slice_rows):
    rows = skewed_rows()
    df = to_spark(rows, SCHEMA)
    found = collected(W.station_context(df.repartition(5), slice_rows=slice_rows))
    pd.testing.assert_frame_equal(found[[ROW_ID, *FEATURES]], brute_force(rows), check_dtype=False)


@pytest.mark.parametrize("slice_rows", [W.SLICE_ROWS, 60, 7])
def test_previous_session_equals_brute_force(to_spark, slice_rows):
    rows = skewed_rows(seed=2)
    df = to_spark(rows, SCHEMA)
    found = collected(W.previous_session(df.repartition(3), slice_rows=slice_rows))
    pd.testing.assert_frame_equal(
        found[[ROW_ID, *FEATURES[:2]]], brute_force(rows)[[ROW_ID, *FEATURES[:2]]], check_dtype=False
    )


def test_seven_day_edge(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    data = [(1, 1, 1.0), (2, 1, 10.0), (3, 1, 100.0), (4, 3, 1000.0), (5, 8, 5.0), (6, 20, 7.0)]
    df = spark.createDataFrame([(i, "s", day(d), m, 0.0) for i, d, m in data], SCHEMA)
    found = collected(W.station_context(df))
    sums = (found["station_utilization_ratio_7d"] * 10080).round(6).tolist()
    # Day 1 lies inside [t-7d, t) of day 8; on day 20 the window is empty.
    assert sums == [0, 0, 0, 111, 1111, 0]
    assert found["station_avg_duration_7d"].iloc[5] == pytest.approx(1116 / 5)
    assert np.isnan(found["station_avg_duration_7d"].iloc[0])


def burst(n=3000) -> pd.DataFrame:
    """A third of all sessions at one station, most of them at one instant."""
    rng = np.random.default_rng(4)
    rows = skewed_rows(n)
    hot = np.arange(n) % 3 == 0
    rows[STATION] = np.where(hot, "hot", rows[STATION].replace("hot", "s0"))
    seconds = np.where(hot & (rng.random(n) < 0.8), 20 * 86400, rng.integers(0, 40 * 86400, n))
    rows[START] = pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, "s")
    return rows


def test_no_slice_is_large_in_a_burst(to_spark):
    rows = burst()
    df = to_spark(rows, SCHEMA)
    events = W._events(df, W.Frame())
    slices = W.sliced(events, 3 * len(rows), W.Frame(), 300).groupBy("_slice").count().toPandas()
    assert slices["count"].sum() == 3 * len(rows) and slices["count"].max() < 600


def test_a_burst_equals_brute_force(to_spark):
    rows = burst(600)
    found = collected(W.station_context(to_spark(rows, SCHEMA), slice_rows=40))
    pd.testing.assert_frame_equal(found[[ROW_ID, *FEATURES]], brute_force(rows), check_dtype=False)


def test_sums_leave_no_residue(to_spark):
    """Two-decimal minutes, then weeks of zero minutes: the past mean takes over, and nothing is negative."""
    n = 2000
    rng = np.random.default_rng(6)
    minutes = np.where(np.arange(n) < 1900, rng.integers(1, 30000, n) / 100, 0.0)
    start = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.where(np.arange(n) < 1900, np.arange(n) * 600, 90 * 86400 + np.arange(n) * 600), "s")
    rows = pd.DataFrame({ROW_ID: np.arange(n), STATION: "s", START: start, MINUTES: minutes, "temperature_degc": rng.integers(-100, 400, n) / 10})
    found = collected(W.station_context(to_spark(rows, SCHEMA), slice_rows=500))
    late = found[found[ROW_ID] > 1900]
    assert (late["station_utilization_ratio_7d"] == 0).all()
    past = [minutes[:i].sum() / i for i in late[ROW_ID]]
    assert late["station_avg_duration_7d"].to_numpy() == pytest.approx(np.array(past))


def test_infinite_and_missing_values(spark):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    inf, nan = float("inf"), float("nan")
    data = [(1, 0, 1.0, 5.0), (2, 1, inf, inf), (3, 2, 3.0, nan), (4, 3, nan, 7.0), (5, 9, 5.0, 9.0), (6, 40, 2.0, 1.0)]
    df = spark.createDataFrame([(i, "s", day(d), m, t) for i, d, m, t in data], SCHEMA)
    found = collected(W.station_context(df))
    assert (found["station_utilization_ratio_7d"] * 10080).round(6).tolist() == [0, 1, inf, inf, 3, 0]
    assert found["station_avg_duration_7d"].tolist()[1:5] == [1, inf, inf, 1.5]
    assert found["temperature_station_anomaly"].tolist()[3:] == [-inf, -inf, 0]


def test_no_sessions(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.station_context(empty).isEmpty() and W.previous_session(empty).isEmpty()


def test_same_result_for_any_partitioning(spark, sf_dir):
    for source in (sessions, long_sessions):
        df = source(spark, sf_dir).select(ROW_ID, STATION, START, MINUTES, "temperature_degc")
        a = collected(W.station_context(df))
        b = collected(W.station_context(df.repartition(7, ROW_ID), slice_rows=500))
        pd.testing.assert_frame_equal(a, b)
