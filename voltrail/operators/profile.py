"""Column profiles: one aggregation pass over all columns, then a small reshape of its single row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voltrail.functions.quantiles import exact_quantiles
from voltrail.functions.scalar import clip
from voltrail.schema import MINUTES, STATION


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _is_missing(df: DataFrame, column: str) -> Column:
    test = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(column)
    return test


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent per column, worst first."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(_is_missing(df, c)).alias(f"m_{c}") for c in columns]
    )
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing_count"), F.col("n")) for c in columns]
    return (
        counted.select(F.inline(F.array(*cells)))
        .select("column", "missing_count", (F.col("missing_count") * 100.0 / F.nullif("n", F.lit(0))).alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "column")
    )


def missing_report_short(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Only columns with missing values, percent to two decimals."""
    full = missing_report(df, columns).filter(F.col("missing_count") > 0)
    return full.withColumn("missing_pct", F.bround("missing_pct", 2)).orderBy(F.desc("missing_count"), "column")


# The quartiles of a numeric summary.
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


# Seven buffers per column: twelve columns stay below the 100 fields up to which Spark generates code.
MOMENT_COLUMNS = 12


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            (F.sum(F.col(c).cast("double")) / F.nullif(F.count(c), F.lit(0))).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ).alias(c)
        for c in columns
    ]).select(F.inline(F.array(*[F.col(c) for c in columns])))


NUMERIC_SCHEMA = "column string, count bigint, mean double, std double, min double, " \
                 + "".join(f"{name} double, " for name in QUARTILES) + "max double"


def _without_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with NaN as null: a NaN is a missing value."""
    kept = {c: F.col(c) for c in columns}
    for c in columns:
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            kept[c] = F.when(~F.isnan(c), F.col(c))
    return df.select(*[v.alias(c) for c, v in kept.items()])


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Count, mean, deviation and quartiles of each numeric column; NaN is skipped. No numeric column, no rows."""
    columns = list(numeric_columns(df) if columns is None else columns)
    if not columns:
        return df.sparkSession.createDataFrame([], NUMERIC_SCHEMA)
    df = _without_nan(df, columns)
    parts = [_moments(df, columns[i:i + MOMENT_COLUMNS]) for i in range(0, len(columns), MOMENT_COLUMNS)]
    moments = reduce(DataFrame.unionByName, parts)
    ranks = exact_quantiles(df, columns, list(QUARTILES.values()), **options)
    wide = ranks.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in QUARTILES.items()]
    )
    return moments.join(wide, "column").select("column", "count", "mean", "std", "min", *QUARTILES, "max")


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over all text columns; pre-aggregated per task before the shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


CATEGORY_SCHEMA = "column string, count bigint, unique bigint, top string, freq bigint"


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, most common value (smallest on a tie) and its count, per text column."""
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], CATEGORY_SCHEMA)
    return _value_counts(df, columns).groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def category_top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10, max_columns: int = 5) -> DataFrame:
    """Distinct count and the ``n`` most common values of the given columns, or of the first ``max_columns`` text columns.

    The rank limit is applied in every task before the shuffle (window group limit), so a column with
    very many values sends only ``n`` candidates per task.
    """
    columns = text_columns(df)[:max_columns] if columns is None else list(columns)
    counts = _value_counts(df, columns)
    # Reads ``n`` as well, so that both branches are one plan and share its shuffle.
    unique = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("unique_values"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("place", place).filter(F.col("place") <= n)
    return top.join(unique, "column").select(
        "column", "unique_values", F.col("place").cast("bigint").alias("place"), "value", F.col("n").alias("value_count")
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the least and greatest value; NaN is skipped, empty bins are left out."""
    number_or_nan = F.col(column).cast("double")
    value = F.when(~F.isnan(number_or_nan), number_or_nan)
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    spread = F.col("_e.high") - F.col("_e.low")
    number = F.when(spread == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_e.low")) / F.nullif(spread, F.lit(0.0)) * bins), F.lit(bins - 1))
    ).cast("int")
    edge = F.col("low") + (F.col("high") - F.col("low")) * F.col("bin") / bins
    return (
        df.select(value.alias("_v")).filter(F.col("_v").isNotNull())
        .withColumn("_e", ends)
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("_e.low").alias("low"), F.max("_e.high").alias("high"))
        .select("bin", edge.alias("bin_start"), "n")
        .orderBy("bin")
    )


def duration_histogram(df: DataFrame, charger_type: str | None = None, bins: int = 50) -> DataFrame:
    chosen = df if charger_type is None else df.filter(F.col("charger_type") == charger_type)
    return histogram(chosen, MINUTES, bins)


def sessions_per_station_hist(df: DataFrame, bins: int = 30) -> DataFrame:
    """How many stations fall in each bin of sessions per station."""
    per_station = df.filter(F.col(STATION).isNotNull()).groupBy(STATION).agg(F.count(F.lit(1)).alias("sessions"))
    return histogram(per_station, "sessions", bins)


PAIR_SCHEMA = "x int, y int, n double, sx double, sy double, sxx double, syy double, sxy double"


def _pair_sums(batches: Iterator[pd.DataFrame], shift: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sums over pairwise complete rows of one task, as one small row per pair."""
    total = None
    for batch in batches:
        values = batch.to_numpy(dtype=float) - shift
        known = ~np.isnan(values)
        v, k = np.where(known, values, 0.0), known.astype(float)
        sums = np.stack([k.T @ k, v.T @ k, (v * v).T @ k, v.T @ v])
        total = sums if total is None else total + sums
    if total is not None:
        n, sx, sxx, sxy = total
        x, y = np.indices(n.shape)
        grids = [x, y, n, sx, sx.T, sxx, sxx.T, sxy]
        yield pd.DataFrame(dict(zip(["x", "y", "n", "sx", "sy", "sxx", "syy", "sxy"], [g.ravel() for g in grids])))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of all numeric pairs over pairwise complete rows, long form, both orders.

    All pairs in one scan: each task turns its Arrow batches into pair sums by matrix products and emits
    one row per pair. One ``corr`` per pair would need several hundred aggregation buffers, which
    Spark runs without code generation. Values are shifted by the column means, so the sums do not cancel.
    """
    columns = list(columns or numeric_columns(df))
    # One number per column.
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    shift = np.array([means[c] or 0.0 for c in columns])
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sums = (
        values.mapInPandas(lambda batches: _pair_sums(batches, shift), PAIR_SCHEMA)
        .groupBy("x", "y")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    spread = F.sqrt(
        (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
        * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    )
    raw = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(spread, F.lit(0.0))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        names[F.col("x")].alias("column_x"), names[F.col("y")].alias("column_y"), clip(raw, -1.0, 1.0).alias("corr")
    )
