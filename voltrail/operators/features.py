"""Feature table for the duration models: scalar features, station history and cluster label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltrail.functions import scalar as S
from voltrail.operators.joins import attach_cluster
from voltrail.operators.windows import SLICE_ROWS, Frame, station_context
from voltrail.schema import ENERGY, START


def scalar_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "soc_delta_pct": S.soc_delta("state_of_charge_start_pct", "state_of_charge_end_pct"),
        "is_weekend": S.is_weekend("day_of_week"),
        "session_month": F.month(START),
        "temperature_band": S.temperature_band("temperature_degc"),
        "start_hour_bin": S.start_hour_bin("start_hour"),
        "energy_to_capacity_ratio": S.energy_to_capacity(ENERGY, "battery_capacity_kwh"),
        "weather_stress_index": S.weather_stress("temperature_degc"),
        "humidity_proxy": S.humidity_proxy("temperature_degc"),
    })


def engineer_features(
    sessions: DataFrame, clusters: DataFrame | None = None, frame: Frame = Frame(), slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """All derived features of every session. One range shuffle serves all history windows.

    The row number is carried along; sort by it (``restore_order``) where the input order matters.
    """
    with_history = station_context(sessions, frame, slice_rows)
    return scalar_features(attach_cluster(with_history, clusters))
