"""Writers. Tables stay partitioned files; nothing passes through the driver."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.operators.reports import DATE, daily_agg, hourly_agg, station_master
from voltrail.schema import STATION


# The CSV writer's default format stops at milliseconds.
FULL_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Standard quoting: a quote inside a cell is doubled.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "timestampFormat": FULL_TIME, "timestampNTZFormat": FULL_TIME}


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    if partition_by:
        # Rows of one partition value meet first, so a day is a few files and not one per task.
        # AQE splits a day that is too large for one task.
        df.hint("rebalance", F.col(partition_by)).write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def register_table(df: DataFrame, name: str = "ev_sessions", managed: bool = False, buckets: int = 0, key: str = STATION,
                   sort_by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Make ``df`` a SQL table of this name, replacing an earlier one.

    With ``buckets`` its rows are stored by a hash of ``key`` (at ``path``, else in the warehouse) and sorted within: tables of the
    same key and number of buckets join without an exchange, as do windows and aggregates by the key. Rows of a bucket meet
    before they are written, so a bucket is one file and one task: let the largest key fit one task, or leave the table unbucketed.
    """
    if buckets:
        writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort_by)
        (writer.option("path", path) if path else writer).saveAsTable(name)
    elif managed:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def export_all(sessions: DataFrame, folder: str) -> dict[str, str]:
    """The four BI extracts. The input is written once; the aggregates read that Parquet copy."""
    spark = sessions.sparkSession
    paths = {name: f"{folder}/{name}" for name in ("sessions_cleaned", "station_master", "daily_agg", "hourly_agg")}
    write_parquet(sessions, paths["sessions_cleaned"])
    stored = spark.read.parquet(paths["sessions_cleaned"])
    write_parquet(station_master(stored), paths["station_master"])
    write_parquet(daily_agg(stored), paths["daily_agg"], partition_by=DATE)
    write_parquet(hourly_agg(stored), paths["hourly_agg"])
    return paths


def save_coefficients(coefficients: DataFrame, path: str, model_type: str) -> str:
    """Fitted per-station coefficients with the metadata of the run."""
    saved = coefficients.withColumns({
        "saved_at_utc": F.lit(dt.datetime.now(dt.timezone.utc).isoformat()),
        "model_type": F.lit(model_type),
    })
    return write_parquet(saved, path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str, name: str | None = None, params: dict | None = None, scores: DataFrame | None = None) -> str:
    """Persist a fitted ML pipeline; with ``name``, a table ``<path>-metadata`` says what it is, with its settings and scores."""
    model.write().overwrite().save(path)
    if name is not None:
        about = {
            "saved_at_utc": F.lit(dt.datetime.now(dt.timezone.utc).isoformat()), "model_type": F.lit(name),
            "params": F.lit(json.dumps(params or {}, sort_keys=True)),
        }
        source = scores if scores is not None else SparkSession.active().range(1).drop("id")
        write_parquet(source.withColumns(about), f"{path}-metadata")
    return path
