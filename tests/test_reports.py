import glob

import pytest

from voltrail.models import forecast as M, segments as G
from voltrail.operators import reports as R, tables as T
from voltrail.plans import forecasting as FQ, modelling as Q
from voltrail.schema import STATION
from voltrail.session import scratch_path
from voltrail.sources import sinks as OUT
from voltrail.sources.mapping import sessions


def lines_of(path):
    return [line.rstrip("\n") for part in sorted(glob.glob(f"{path}/part-*")) for line in open(part, encoding="utf-8")]


def local_path(spark, label):
    return scratch_path(spark, label).removeprefix("file:")


def test_forecast_report_is_in_order(spark, sf_dir):
    scores = M.metrics(FQ.station_days(spark, sf_dir))
    path = T.write_report(T.forecast_report(scores, M.leaderboard_summary(scores)), local_path(spark, "report"))
    lines = lines_of(path)
    assert lines[0] == "# Demand forecast" and lines[3].startswith("- Stations trained: ")
    table = lines[lines.index("| --- | ---: | ---: | ---: | ---: |") + 1:]
    expected = [r[STATION] for r in M.leaderboard(scores).collect()]
    assert [line.split(" | ")[0].removeprefix("| ") for line in table] == expected


def test_duration_report_names_the_best_model(spark, sf_dir):
    scores = Q.compared(spark, sf_dir)
    lines = [r["line"] for r in T.duration_report(scores, {"b": 2, "a": 1}).orderBy("part", "first_key").collect()]
    best = min(scores.collect(), key=lambda r: r["mae"])["model"]
    assert any(line.startswith(f"- Best model: {best} (MAE ") for line in lines)
    assert lines[-2:] == ["- a: 1", "- b: 2"]


def test_segment_report_has_counts_and_means(spark, sf_dir):
    labels = Q.segmentation(spark, sf_dir).labels
    report = T.segment_report(G.cluster_counts(labels), G.cluster_profile(labels))
    lines = [r["line"] for r in report.orderBy("part", "first_key").collect()]
    assert lines.index("## Cluster counts") < lines.index("## Feature averages")
    assert len([line for line in lines if line.startswith("| 0 |")]) == 2


def test_missing_numbers_print_as_not_available(spark):
    scores = spark.createDataFrame([("s", 3, 0.5, 0.25, None)], f"{STATION} string, train_rows int, mae double, rmse double, mape double")
    assert T.forecast_table(scores).first()["line"] == "| s | 3 | 0.50 | 0.25 | n/a |"


def test_exports_hold_the_four_tables(spark, sf_dir):
    df = sessions(spark, sf_dir)
    paths = OUT.export_all(df, scratch_path(spark, "exports"))
    daily = spark.read.parquet(paths["daily_agg"])
    assert daily.select(STATION, "session_date", "total_sessions").exceptAll(
        R.daily_agg(df).select(STATION, "session_date", "total_sessions")).isEmpty()
    assert spark.read.parquet(paths["sessions_cleaned"]).count() == df.count()
    # The day is a folder, so a day range prunes files.
    plan = daily.filter("session_date = date '2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_date" in plan


def test_coefficients_keep_their_metadata(spark, sf_dir):
    found = FQ.station_coefficients(spark, sf_dir)
    assert {"saved_at_utc", "model_type"} <= set(found.columns)
    assert found.count() == M.fit(FQ.station_days(spark, sf_dir)).count()


def test_top_scope_needs_no_count(spark, sf_dir):
    df = sessions(spark, sf_dir)
    series = R.scoped_series(R.daily_agg(df), top=R.top_scope(df, 3))
    top = {r[STATION] for r in R.top_session_stations(df, 3).collect()}
    expected = R.daily_agg(df).filter(R.F.col(STATION).isin(list(top))).agg(R.F.sum("total_sessions")).first()[0]
    assert series.agg(R.F.sum("y")).first()[0] == expected


@pytest.mark.parametrize("name", ["daily_agg", "hourly_agg"])
def test_extracts_name_the_missing_column(spark, name):
    with pytest.raises(ValueError, match="missing"):
        getattr(R, name)(spark.range(1))
