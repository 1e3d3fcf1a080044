"""Report tables as Markdown rows with fixed number formats, and the report files.

A report is a table of lines (part, sort keys, text). Its long parts, one line per station, stay
distributed; only headings of a few lines are made on the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltrail.schema import SEGMENT_FEATURES, STATION


def _fixed(column: str, digits: int) -> Column:
    # The pattern form rounds the stored binary value, half to even, and groups no thousands.
    text = F.call_function("format_number", F.col(column).cast("double"), F.lit("0." + "0" * digits))
    return F.coalesce(text, F.lit("n/a"))


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")


def forecast_table(scores: DataFrame) -> DataFrame:
    """One line per station, best first."""
    line = _line(F.col(STATION), F.col("train_rows").cast("string"), _fixed("mae", 2), _fixed("rmse", 2), _fixed("mape", 3))
    return scores.orderBy("mae", STATION).select(STATION, line)


def duration_table(scores: DataFrame) -> DataFrame:
    """One line per compared model, in the order of the comparison."""
    line = _line(F.col("model"), _fixed("mae", 2), _fixed("rmse", 2), _fixed("r2", 3))
    return scores.orderBy("place").select("model", line)


def segment_table(profile: DataFrame) -> DataFrame:
    """One line per cluster with its feature means."""
    line = _line(F.col("cluster").cast("string"), *[_fixed(c, 2) for c in SEGMENT_FEATURES])
    return profile.orderBy("cluster").select("cluster", line)


# --- report files ---------------------------------------------------------------------------------

LINES = "part int, first_key double, second_key string, line string"


def _heading(spark: SparkSession, part: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(part, float(i), "", text) for i, text in enumerate(lines)], LINES)


def _body(part: int, table: DataFrame, first_key: Column, second_key: Column, line: Column) -> DataFrame:
    return table.select(
        F.lit(part).alias("part"), first_key.cast("double").alias("first_key"),
        second_key.cast("string").alias("second_key"), line,
    )


def _title(text: str) -> list[str]:
    return [f"# {text}", "", f"- Run timestamp (UTC): {dt.datetime.now(dt.timezone.utc).isoformat()}"]


def _columns(names: list[str]) -> list[str]:
    return ["| " + " | ".join(names) + " |", "| --- | " + " | ".join(["---:"] * (len(names) - 1)) + " |"]


def forecast_report(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """Stations trained, median errors and the leaderboard."""
    top = summary.first()
    medians = [
        f"- Median {name.upper()}: " + ("n/a" if top[f"median_{name}"] is None else f"{top[f'median_{name}']:.2f}")
        for name in ("mae", "rmse")
    ]
    heading = _title("Demand forecast") + [f"- Stations trained: {top['stations_trained']}", *medians, ""]
    if not top["stations_trained"]:
        heading.append("No station has enough history.")
    else:
        heading += _columns(["Station", "Training Rows", "MAE", "RMSE", "MAPE"])
    line = _line(F.col(STATION), F.col("train_rows").cast("string"), _fixed("mae", 2), _fixed("rmse", 2), _fixed("mape", 3))
    return _heading(scores.sparkSession, 0, heading).unionByName(_body(1, scores, F.col("mae"), F.col(STATION), line))


def duration_report(scores: DataFrame, best_params: dict) -> DataFrame:
    """Compared models, and the settings of the best one."""
    spark = scores.sparkSession
    rows = scores.orderBy("mae", "place").collect()  # one row per compared model
    best = rows[0]
    heading = _title("Duration prediction") + [
        f"- Models compared: {len(rows)}",
        f"- Best model: {best['model']} (MAE {best['mae']:.2f}, RMSE {best['rmse']:.2f}, R2 {best['r2']:.3f})",
        "",
        *_columns(["Model", "MAE", "RMSE", "R2"]),
    ]
    line = _line(F.col("model"), _fixed("mae", 2), _fixed("rmse", 2), _fixed("r2", 3))
    settings = ["", "## Best settings", *[f"- {k}: {v}" for k, v in sorted(best_params.items())]]
    body = _body(1, scores, F.col("place"), F.col("model"), line)
    return _heading(spark, 0, heading).unionByName(body).unionByName(_heading(spark, 2, settings))


def segment_report(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """Stations per cluster and the mean features of each cluster."""
    spark = counts.sparkSession
    totals = counts.agg(F.max("total_stations").alias("stations"), F.max("total_clusters").alias("clusters")).first()
    heading = _title("Station segmentation") + [
        f"- Stations segmented: {totals['stations']}", f"- Clusters discovered: {totals['clusters']}", "",
        "## Cluster counts", *_columns(["Cluster", "Stations"]),
    ]
    cluster = F.col("cluster").cast("string")
    sizes = _body(1, counts, F.col("cluster"), cluster, _line(cluster, F.col("station_count").cast("string")))
    middle = ["", "## Feature averages", *_columns(["Cluster", *SEGMENT_FEATURES])]
    means = _body(3, profile, F.col("cluster"), cluster, _line(cluster, *[_fixed(c, 2) for c in SEGMENT_FEATURES]))
    return (
        _heading(spark, 0, heading).unionByName(sizes).unionByName(_heading(spark, 2, middle)).unionByName(means)
    )


def write_report(report: DataFrame, path: str) -> str:
    """The lines as text files whose names sort in the order of the report."""
    report.orderBy("part", "first_key", "second_key").select("line").write.mode("overwrite").text(path)
    return path
