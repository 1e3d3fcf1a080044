"""Beta-binomial shrinkage of rates between the levels of a hierarchy, by grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows that a prior is worth at least and at most.
WEAKEST, STRONGEST = 0.5, 10000.0


def overall_rate() -> Column:
    """Rate of all groups (n, bad) together; one half where there is nothing."""
    return (F.sum("bad") + 0.5) / (F.sum("n") + 1.0)


def _worth(level: DataFrame, parent_rate: str) -> DataFrame:
    """One row: the worth of the prior above this level's groups (n, bad), by the method of moments."""
    p = F.col(parent_rate)
    spread = F.sum(F.pow(F.col("bad") - F.col("n") * p, F.lit(2.0)) - F.col("n") * p * (1 - p))
    room = F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    rho = F.coalesce(spread / F.when(room > 0, room), F.lit(0.0))
    return level.agg((1 / F.least(F.greatest(rho, F.lit(1 / (STRONGEST + 1))), F.lit(1 / (WEAKEST + 1))) - 1).alias("worth"))


def shrunk(level: DataFrame, parent_rate: str, rate: str) -> DataFrame:
    """Adds ``rate``, the posterior mean of the level's groups below their parent's rate, and ``weight``, what it rests on."""
    return level.crossJoin(F.broadcast(_worth(level, parent_rate))) \
        .withColumn(rate, (F.col("bad") + F.col("worth") * F.col(parent_rate)) / (F.col("n") + F.col("worth"))) \
        .withColumn("weight", F.col("n") + F.col("worth")).drop("worth")
