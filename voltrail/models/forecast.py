"""Daily demand forecasts for all stations at once.

Additive model: linear trend, a weekday effect shrunk towards 0, and a band from the in-sample
residuals. Fitting is a handful of windows over the daily table, all on one shuffle by station; the
weekday step and the final roll-up reuse that partitioning. A station has at most one row per day, so
its group is bounded by the calendar however many sessions it had.
"""

from __future__ import annotations

import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.functions.quantiles import exact_quantiles
from voltrail.functions.scalar import clip, iso_date, served_sessions, short_date, valid_forecast_request
from voltrail.operators.joins import size_checked
from voltrail.operators.windows import holdout_split, rolling14
from voltrail.schema import STATION
from voltrail.session import cut_lineage

# Model settings.
WEEKDAY_SHRINKAGE = 3
MODEL_MIN_DAYS = 10
MODEL_NAME, BASELINE_NAME = "Trend + weekly", "Rolling baseline"

EFFECTS = [f"effect_{d}" for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")]


def band_width(ci: float) -> float:
    """Normal quantile for a central band of ``ci`` percent."""
    return NormalDist().inv_cdf(0.5 + ci / 200)


def in_sample(series: DataFrame, key: str = STATION, train: Column | None = None) -> DataFrame:
    """Adds trend, weekday effect and fitted value to every day; ``train`` limits the rows fitted on."""
    used = F.lit(True) if train is None else train
    whole = Window.partitionBy(key)
    same_weekday = Window.partitionBy(key, "weekday")
    x = F.datediff("ds", F.min("ds").over(whole)).cast("double")
    y = F.when(used, F.col("y").cast("double"))
    trend = F.col("intercept") + F.col("slope") * F.col("x")
    return (
        series.withColumn("first_day", F.min("ds").over(whole))
        .withColumns({"x": x, "weekday": F.weekday("ds")})
        .withColumns({
            "slope": F.regr_slope(y, F.col("x")).over(whole),
            "intercept": F.regr_intercept(y, F.col("x")).over(whole),
        })
        .withColumn("trend", trend)
        .withColumn(
            "weekday_effect",
            F.coalesce(F.sum(y - F.col("trend")).over(same_weekday), F.lit(0.0))
            / (F.count(y).over(same_weekday) + WEEKDAY_SHRINKAGE),
        )
        .withColumn("yhat", F.col("trend") + F.col("weekday_effect"))
    )


def fit(series: DataFrame, key: str = STATION) -> DataFrame:
    """One row of coefficients per series of at least two days (shorter ones are left out)."""
    fitted = in_sample(series, key)
    return (
        fitted.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("train_rows"),
            F.min("ds").alias("first_day"),
            F.max("ds").alias("last_day"),
            F.max("slope").alias("slope"),
            F.max("intercept").alias("intercept"),
            F.coalesce(F.stddev_samp(F.col("y") - F.col("yhat")), F.lit(0.0)).alias("sigma"),
            *[
                F.coalesce(F.max(F.when(F.col("weekday") == i, F.col("weekday_effect"))), F.lit(0.0)).alias(name)
                for i, name in enumerate(EFFECTS)
            ],
        )
        .filter(F.col("train_rows") >= 2)
    )


def predict(points: DataFrame, ci: float = 80) -> DataFrame:
    """Fitted value and band on rows that hold a date ``ds`` and the coefficients."""
    effect = F.element_at(F.array(*[F.col(c) for c in EFFECTS]), F.weekday("ds") + 1)
    yhat = F.col("intercept") + F.col("slope") * F.datediff("ds", "first_day") + effect
    spread = F.col("sigma") * band_width(ci)
    return points.withColumn("yhat", yhat).withColumns({
        "yhat_lower": F.col("yhat") - spread,
        "yhat_upper": F.col("yhat") + spread,
    })


def _days(first: Column, count: Column) -> Column:
    return F.explode(F.sequence(first, F.date_add(first, count - 1)))


def future(coefficients: DataFrame, horizon: int, key: str = STATION, ci: float = 80) -> DataFrame:
    """The ``horizon`` days after the last day of each series."""
    dates = _days(F.date_add("last_day", 1), F.lit(horizon))
    return predict(coefficients.withColumn("ds", dates), ci).select(key, "ds", "yhat", "yhat_lower", "yhat_upper")


def forecast(series: DataFrame, horizon: int = 30, key: str = STATION, ci: float = 80) -> DataFrame:
    """History days and future days of every series, with bands.

    The coefficients are spread over the series by windows on the same partitioning, and the last day of
    a series carries the future days: one pass, no join.
    """
    whole = Window.partitionBy(key)
    fitted = in_sample(series, key).filter(F.col("slope").isNotNull())
    coefficients = {
        "last_day": F.max("ds").over(whole),
        "sigma": F.coalesce(F.stddev_samp(F.col("y") - F.col("yhat")).over(whole), F.lit(0.0)),
        **{
            name: F.coalesce(F.max(F.when(F.col("weekday") == i, F.col("weekday_effect"))).over(whole), F.lit(0.0))
            for i, name in enumerate(EFFECTS)
        },
    }
    ahead = F.sequence(F.date_add("ds", 1), F.date_add("ds", horizon))
    days = F.when(F.col("ds") == F.col("last_day"), F.concat(F.array("ds"), ahead)).otherwise(F.array("ds"))
    points = fitted.withColumns(coefficients).withColumn("ds", F.explode(days))
    return predict(points, ci).select(key, "ds", "yhat", "yhat_lower", "yhat_upper")


def _mape() -> Column:
    return F.avg(F.abs(F.col("y") - F.col("yhat")) / F.nullif(F.abs(F.col("y").cast("double")), F.lit(0.0)))


def metrics(series: DataFrame, key: str = STATION) -> DataFrame:
    """In-sample MAE, RMSE and MAPE per series; days without sessions do not enter the MAPE."""
    error = F.col("y") - F.col("yhat")
    return in_sample(series, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("train_rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        _mape().alias("mape"),
    ).filter(F.col("train_rows") >= 2)


def leaderboard(scores: DataFrame, key: str = STATION) -> DataFrame:
    return scores.orderBy("mae", key)


def leaderboard_summary(scores: DataFrame) -> DataFrame:
    """Stations trained and the median errors, as one row."""
    scores = cut_lineage(scores)
    medians = exact_quantiles(scores, ["mae", "rmse"], [0.5])
    middle = medians.agg(*[
        F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"median_{c}") for c in ("mae", "rmse")
    ])
    return scores.agg(F.count(F.lit(1)).alias("stations_trained")).withColumns({
        c: middle.select(c).scalar() for c in middle.columns
    })


def holdout(series: DataFrame, key: str = STATION) -> DataFrame:
    """Errors on the last days of a series after fitting without them; null below 14 days."""
    split = holdout_split(series, [key])
    fitted = in_sample(split, key, train=F.col("is_test") == 0)
    test = F.col("is_test") == 1
    y = F.when(test, F.col("y").cast("double"))
    error = y - F.col("yhat")
    total = F.var_pop(y) * F.count(y)
    return fitted.groupBy(key).agg(
        F.count(F.lit(1)).alias("history_days"),
        F.count(y).alias("test_days"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.sum(error * error) / F.nullif(total, F.lit(0.0))).alias("r2"),
    )


def naive(
    series: DataFrame, horizon: int = 30, key: str = STATION, ci: float = 95, start_date: dt.date | None = None
) -> DataFrame:
    """Flat forecast from the last 14 days; all null for a series of fewer than 7 days.

    Starts the day after the series ends, or at ``start_date``.
    """
    last = rolling14(series, [key]).groupBy(key).agg(
        F.max("ds").alias("last_day"),
        F.max_by(F.struct("rolling_mean", "rolling_std"), "ds").alias("_r"),
    )
    z = 1.96 if ci >= 95 else 1.64
    first = F.date_add("last_day", 1) if start_date is None else F.lit(start_date)
    half = F.col("_r.rolling_std") * z
    return (
        last.withColumn("ds", _days(first, F.lit(horizon)))
        .withColumn("yhat", F.bround("_r.rolling_mean", 1))
        .select(
            key,
            "ds",
            "yhat",
            clip(F.col("yhat") - half, low=0.0).alias("yhat_lower"),
            (F.col("yhat") + half).alias("yhat_upper"),
        )
    )


def auto(series: DataFrame, horizon: int = 30, key: str = STATION, ci: float = 95) -> DataFrame:
    """Trend model for series of at least ten days, rolling baseline for shorter ones."""
    counted = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    long = counted.filter(F.col("_n") >= MODEL_MIN_DAYS).drop("_n")
    short = counted.filter(F.col("_n") < MODEL_MIN_DAYS).drop("_n")
    model = future(fit(long, key), horizon, key, ci).withColumn("model", F.lit(MODEL_NAME))
    baseline = naive(short, horizon, key, ci).withColumn("model", F.lit(BASELINE_NAME))
    return model.unionByName(baseline).withColumnsRenamed(
        {"ds": "Date", "yhat": "Predicted", "yhat_lower": "Lower", "yhat_upper": "Upper"}
    )


def summary(forecasts: DataFrame, key: str = STATION) -> DataFrame:
    """Day of the first maximum, mean and total over the horizon; null predictions are left out.

    Days of a flat trend repeat weekly but for the last bits, so they are compared at six decimals.
    """
    first_peak = F.min_by("Date", F.struct(-F.round("Predicted", 6), F.col("Date")))
    return forecasts.filter(F.col("Predicted").isNotNull()).groupBy(key).agg(
        short_date(first_peak).alias("peak_day"),
        F.avg("Predicted").alias("avg_daily"),
        F.sum("Predicted").alias("total_period"),
    )


def serve(requests: DataFrame, coefficients: DataFrame, start_date: dt.date | None = None) -> DataFrame:
    """Dated points for each valid request of a known station: never negative, one decimal.

    ``coefficients`` should be a stored table. Unknown stations are listed by ``unknown_stations``.
    """
    known = requests.filter(valid_forecast_request("days")).join(size_checked(coefficients), STATION)
    first = F.date_add("last_day", 1) if start_date is None else F.lit(start_date)
    points = predict(known.withColumn("ds", _days(first, F.col("days"))))
    return points.select(
        "request_id", STATION, iso_date("ds").alias("date"), served_sessions("yhat").alias("sessions")
    )


# --- richer per-station model ---------------------------------------------------------------------

WAVES = 3
GROUP_SCHEMA = f"{STATION} string, train_rows bigint, slope double, mae double, rmse double"


FORECAST_SCHEMA = f"{STATION} string, ds date, yhat double"


def _design(days: pd.Series, first: pd.Timestamp) -> np.ndarray:
    x = (days - first).dt.days.to_numpy(float)
    angle = 2 * np.pi * days.dt.dayofweek.to_numpy(float)[:, None] * np.arange(1, WAVES + 1) / 7
    return np.column_stack([np.ones_like(x), x, np.sin(angle), np.cos(angle)])


def _waves(rows: pd.DataFrame) -> tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray]:
    """Trend plus three weekly sine/cosine pairs by ridge regression on one station's days."""
    rows = rows.sort_values("ds")
    days = pd.to_datetime(rows["ds"])
    y = rows["y"].to_numpy(float)
    design = _design(days, days.iloc[0])
    penalty = np.diag([0.0, 0.0] + [1.0] * (2 * WAVES))
    return days, design, y, np.linalg.lstsq(design.T @ design + penalty, design.T @ y, rcond=None)[0]


def _fit_waves(rows: pd.DataFrame) -> pd.DataFrame:
    _, design, y, beta = _waves(rows)
    error = y - design @ beta
    return pd.DataFrame({
        STATION: [rows[STATION].iloc[0]],
        "train_rows": [len(rows)],
        "slope": [beta[1]],
        "mae": [np.abs(error).mean()],
        "rmse": [np.sqrt((error**2).mean())],
    })


def per_group_model(series: DataFrame) -> DataFrame:
    """One small regression per station in Arrow batches; a group is one row per calendar day."""
    return series.groupBy(STATION).applyInPandas(_fit_waves, GROUP_SCHEMA)


def per_group_forecast(series: DataFrame, horizon: int = 30) -> DataFrame:
    """The richer model's days after each series, one row per station and day."""
    def ahead(rows: pd.DataFrame) -> pd.DataFrame:
        days, _, _, beta = _waves(rows)
        future = pd.Series(pd.date_range(days.iloc[-1] + pd.Timedelta(days=1), periods=horizon))
        return pd.DataFrame({STATION: rows[STATION].iloc[0], "ds": future.dt.date, "yhat": _design(future, days.iloc[0]) @ beta})

    return series.groupBy(STATION).applyInPandas(ahead, FORECAST_SCHEMA)
