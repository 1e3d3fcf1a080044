"""Median-based duration estimates and the error tables shared by all predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.functions.quantiles import exact_quantiles
from voltrail.functions.scalar import clip, hour_block, rmse_of
from voltrail.operators.joins import size_checked
from voltrail.schema import ENERGY, MINUTES, STATION
from voltrail.session import cut_lineage

LEVELS = {
    "block": ["charger_type", "day_of_week", "hour_block"],
    "charger": ["charger_type", "hour_block"],
}


def duration_medians(sessions: DataFrame) -> DataFrame:
    """Median minutes at three levels in one stored table (a row per charger, weekday and 4-hour block).

    Level ``all`` holds the overall medians of minutes and energy.
    """
    blocks = sessions.withColumn("hour_block", hour_block("start_hour"))
    columns = ["charger_type", "day_of_week", "hour_block"]
    parts = []
    for level, by in LEVELS.items():
        medians = exact_quantiles(blocks, [MINUTES], [0.5], by)
        parts.append(medians.select(
            F.lit(level).alias("level"),
            *[F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in columns],
            F.col("value").alias("median_minutes"),
            F.lit(None).cast("double").alias("median_energy"),
        ))
    overall = exact_quantiles(blocks, [MINUTES, ENERGY], [0.5])
    parts.append(overall.agg(
        F.lit("all").alias("level"),
        *[F.lit(None).cast("int" if c == "hour_block" else "string").alias(c) for c in columns],
        F.max(F.when(F.col("column") == MINUTES, F.col("value"))).alias("median_minutes"),
        F.max(F.when(F.col("column") == ENERGY, F.col("value"))).alias("median_energy"),
    ))
    return cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def estimate_duration(requests: DataFrame, medians: DataFrame, energy: str = "energy_kwh") -> DataFrame:
    """Adds ``predicted_minutes``.

    A (charger, weekday) seen before uses the median of its 4-hour block, another one the charger's
    block; where that block is empty, the overall median. The result is scaled by the energy asked for.
    """
    def level(name: str) -> DataFrame:
        return medians.filter(F.col("level") == name)

    block = level("block").select(*LEVELS["block"], F.col("median_minutes").alias("_block"))
    charger = level("charger").select(*LEVELS["charger"], F.col("median_minutes").alias("_charger"))
    pairs = level("block").select("charger_type", "day_of_week").distinct().withColumn("_pair", F.lit(True))
    overall = level("all").select(F.struct("median_minutes", "median_energy")).scalar()

    looked_up = (
        requests.withColumn("hour_block", hour_block("start_hour"))
        .join(size_checked(block), LEVELS["block"], "left")
        .join(size_checked(charger), LEVELS["charger"], "left")
        .join(size_checked(pairs), ["charger_type", "day_of_week"], "left")
        .withColumn("_all", overall)
    )
    base = F.when(F.col("_pair"), F.col("_block")).otherwise(F.col("_charger"))
    ratio = F.col(energy) / F.greatest(F.col("_all.median_energy"), F.lit(1.0))
    estimate = F.coalesce(base, F.col("_all.median_minutes")) * clip(ratio, 0.6, 1.6)
    return looked_up.withColumn("predicted_minutes", estimate).drop("_block", "_charger", "_pair", "_all")


def duration_range(predictions: DataFrame) -> DataFrame:
    """Optimistic and conservative duration around the estimate."""
    p = F.col("predicted_minutes")
    return predictions.withColumns({
        "optimistic_minutes": clip(p * 0.85, low=5.0),
        "conservative_minutes": p * 1.15,
    })


# --- error tables ---------------------------------------------------------------------------------

def eval_metrics(predictions: DataFrame, actual: str = MINUTES, predicted: str = "predicted_minutes") -> DataFrame:
    """MAE, RMSE and R2 in one pass."""
    error = F.col(actual) - F.col(predicted)
    total = F.var_pop(actual) * F.count(actual)
    return predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.sum(error * error) / F.nullif(total, F.lit(0.0))).alias("r2"),
    )


def residuals_by_station(
    predictions: DataFrame, actual: str = MINUTES, predicted: str = "predicted_minutes"
) -> DataFrame:
    """Sessions, MAE, bias (actual minus predicted) and RMSE per station, worst first."""
    residual: Column = F.col(actual) - F.col(predicted)
    return (
        predictions.filter(F.col(STATION).isNotNull())
        .select(STATION, residual.alias("residual"))
        .groupBy(STATION)
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.avg(F.abs("residual")).alias("mae"),
            F.avg("residual").alias("bias"),
            rmse_of("residual").alias("rmse"),
        )
        .orderBy(F.desc("mae"), STATION)
    )


def worst_residual_stations(residuals: DataFrame, n: int = 5) -> DataFrame:
    return residuals.orderBy(F.desc("mae"), STATION).limit(n)
