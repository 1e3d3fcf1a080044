"""Column expressions; all are built-ins, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voltrail.schema import WEEKEND_DAYS

Col = Column | str


def _c(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: Col, low: float | None = None, high: float | None = None) -> Column:
    """Clamp that keeps nulls (``greatest``/``least`` alone would skip them)."""
    value = _c(value)
    bounded = value
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    return F.when(value.isNotNull(), bounded)


def safe_divide(a: Col, b: Col, default: float | None = 0.0) -> Column:
    """``a / b``, or the default where the denominator is 0 or null."""
    ratio = _c(a) / F.nullif(_c(b), F.lit(0.0))
    return ratio if default is None else F.when(_c(b).isNull() | (_c(b) == 0), F.lit(float(default))).otherwise(ratio)


def soc_delta(start: Col, end: Col) -> Column:
    return _c(end) - _c(start)


def is_weekend(day_name: Col) -> Column:
    return F.coalesce(_c(day_name).isin(WEEKEND_DAYS), F.lit(False)).cast("int")


# Right-closed band edges and names.
TEMPERATURE_BANDS = [(0, "freezing"), (10, "cold"), (20, "mild"), (30, "warm"), (None, "hot")]
HOUR_BANDS = [(6, "overnight"), (12, "morning"), (18, "afternoon"), (24, "evening")]


def right_closed_band(value: Col, bands: list[tuple[float | None, str]], unknown: str = "unknown") -> Column:
    value = _c(value)
    label = None
    for edge, name in bands:
        hit = value.isNotNull() if edge is None else value <= edge
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(unknown)


def temperature_band(temperature: Col) -> Column:
    return right_closed_band(temperature, TEMPERATURE_BANDS)


def start_hour_bin(hour: Col) -> Column:
    return F.when(_c(hour) >= 0, right_closed_band(hour, HOUR_BANDS)).otherwise("unknown")


def energy_to_capacity(energy: Col, capacity: Col) -> Column:
    return clip(safe_divide(energy, capacity, 0.0), 0.0, 5.0)


def weather_stress(temperature: Col) -> Column:
    return F.abs(_c(temperature) - 22)


def humidity_proxy(temperature: Col) -> Column:
    return clip(100 - F.abs(_c(temperature) - 20) * 3, 0.0, 100.0)


def hour_block(hour: Col, width: int = 4) -> Column:
    return (F.floor(_c(hour) / width) * width).cast("int")


def energy_needed(initial_soc: Col, target_soc: Col, capacity: Col) -> Column:
    return (_c(target_soc) - _c(initial_soc)) / 100 * _c(capacity)


def served_duration(minutes: Col) -> Column:
    """Clamp to 5..240 minutes, one decimal."""
    return F.bround(clip(minutes, 5.0, 240.0), 1)


def served_sessions(yhat: Col) -> Column:
    """One decimal, never negative. Ties are seen at six decimals, so the last bits of a fit do not decide them."""
    return clip(F.bround(F.round(_c(yhat), 6), 1), low=0.0)


def iso_date(day: Col) -> Column:
    return F.date_format(_c(day), "yyyy-MM-dd")


def short_date(day: Col) -> Column:
    return F.date_format(_c(day), "MMM dd")


def share_of(column: Col, value: str) -> Column:
    """Share of rows equal to ``value``; a null counts as another value."""
    return F.avg(F.when(_c(column) == value, 1.0).otherwise(0.0))


def rmse_of(error: Col) -> Column:
    return F.sqrt(F.avg(_c(error) * _c(error)))


def epoch_micros(ts: Col) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def valid_forecast_request(days: Col) -> Column:
    return _c(days).between(1, 365)


def valid_duration_request(energy: Col, hour: Col, weekday: Col) -> Column:
    return (_c(energy) > 0) & _c(hour).between(0, 23) & _c(weekday).between(0, 6)
