"""Refresh of the stored daily table: only days whose files changed are built again.

Sessions lie in one folder for each day (``session_date=...``). A day's fingerprint sums up path, size and time of its files; the
fingerprints of the last refresh lie beside the daily table. They are written last, so that a refresh which was interrupted
is done again. Days whose folder is gone or empty are no longer shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.operators.reports import DATE, daily_agg
from voltrail.session import cut_lineage
from voltrail.sources.readers import path_exists


def fingerprints(spark: SparkSession, sessions_path: str) -> DataFrame:
    """session_date, files, bytes, mark: one row for each day. The files are listed and not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(sessions_path)
    return files.groupBy(F.col(DATE).cast("date").alias(DATE)).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("mark"),
    )


def changed_days(now: DataFrame, before: DataFrame | None) -> DataFrame:
    return (now if before is None else now.join(before, now.columns, "left_anti")).select(DATE)


def refresh_daily(spark: SparkSession, sessions_path: str, daily_path: str) -> DataFrame:
    """The daily table of the sessions below ``sessions_path``, brought up to date at ``daily_path``."""
    seen_path = f"{daily_path}-seen"
    now = cut_lineage(fingerprints(spark, sessions_path))
    known = path_exists(spark, daily_path) and path_exists(spark, f"{seen_path}/_SUCCESS")
    sessions = spark.read.parquet(sessions_path)
    if known:
        # As many dates as the calendar has days.
        days = [r[0] for r in changed_days(now, spark.read.parquet(seen_path)).collect()]
        sessions = sessions.filter(F.col(DATE).isin(days))
    if not known or days:
        daily = daily_agg(sessions.drop(DATE)).hint("rebalance", F.col(DATE))
        daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(daily_path)
    now.write.mode("overwrite").parquet(seen_path)
    return spark.read.parquet(daily_path).join(now.select(DATE), DATE, "left_semi")
