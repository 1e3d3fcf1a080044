"""Incremental refresh of the daily table, bucketed tables and permutation importance."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from voltrail.models.permutation import permutation_importance
from voltrail.operators.joins import label_totals
from voltrail.operators.reports import daily_agg
from voltrail.schema import ENERGY, MINUTES, START, STATION
from voltrail.sources import sinks as OUT
from voltrail.sources.refresh import refresh_daily

SCHEMA = f"{STATION} string, {START} timestamp_ntz, user_id string, {ENERGY} double, {MINUTES} double"


def some_sessions(spark, days, per_day=9):
    rng = random.Random(1)
    rows = [(f"Station_{rng.randrange(4)}" if rng.random() < 0.9 else None, dt.datetime(2024, 1, d, rng.randrange(24)), f"u{i}", float(i), 30.0 + i)
            for d in days for i in range(per_day)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("session_date", F.to_date(START))


def files_of(folder):
    return {os.path.join(root, name): os.stat(os.path.join(root, name)).st_mtime_ns
            for root, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_refresh_rewrites_changed_days_alone(spark, tmp_path):
    source, daily = str(tmp_path / "sessions"), str(tmp_path / "daily")
    some_sessions(spark, range(1, 8)).write.partitionBy("session_date").parquet(source)
    full = lambda: daily_agg(spark.read.parquet(source).drop("session_date"))
    assert rows_of(refresh_daily(spark, source, daily)) == rows_of(full())
    first = files_of(daily)

    assert rows_of(refresh_daily(spark, source, daily)) == rows_of(full())
    assert files_of(daily) == first

    some_sessions(spark, [3, 9], 2).write.mode("append").partitionBy("session_date").parquet(source)
    for path in files_of(source):
        if "2024-01-05" in path:
            os.unlink(path)
    assert rows_of(refresh_daily(spark, source, daily)) == rows_of(full())
    second = files_of(daily)
    changed = {p.split("session_date=")[1][:10] for p in second.keys() ^ first.keys()}
    assert changed == {"2024-01-03", "2024-01-09"}
    assert all(second[p] == first[p] for p in second.keys() & first.keys())


def test_interrupted_refresh_is_done_again(spark, tmp_path):
    source, daily = str(tmp_path / "sessions"), str(tmp_path / "daily")
    some_sessions(spark, range(1, 4)).write.partitionBy("session_date").parquet(source)
    refresh_daily(spark, source, daily)
    some_sessions(spark, [2], 3).write.mode("append").partitionBy("session_date").parquet(source)
    os.unlink(f"{daily}-seen/_SUCCESS")
    assert rows_of(refresh_daily(spark, source, daily)) == rows_of(daily_agg(spark.read.parquet(source).drop("session_date")))


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    sessions = some_sessions(spark, range(1, 20)).drop("session_date")
    labels = spark.createDataFrame([(f"Station_{i}", i % 2) for i in range(3)], f"{STATION} string, cluster int")
    left = OUT.register_table(sessions, "bucketed_sessions", buckets=4, sort_by=[START], path=str(tmp_path / "s"))
    right = OUT.register_table(labels, "bucketed_labels", buckets=4, path=str(tmp_path / "l"))
    found = label_totals(left, right)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found) == rows_of(label_totals(sessions, labels))
    assert {r.station_cluster_label for r in found.collect()} == {"0", "1", "unknown"}


def test_permutation_importance_finds_what_the_model_reads(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), rng.choice(["x", "y", None]), None if i % 50 == 0 else 0.0) for i in range(4000)]
    data = spark.createDataFrame(rows, "row_id long, planted double, weak double, noise string, at double").withColumn(
        "minutes", F.col("at") + 10 * F.col("planted") + F.col("weak"))
    predict = lambda df: df.withColumn("predicted", 10 * F.col("planted") + F.col("weak"))
    found = permutation_importance(data, ["noise", "weak", "planted"], predict, actual="minutes", predicted="predicted").collect()
    assert [r.feature for r in found] == ["planted", "weak", "noise"]
    assert abs(found[0].importance - 10 / 3) < 0.2 and abs(found[1].importance - 1 / 3) < 0.02 and found[2].importance == 0
    assert permutation_importance(data.limit(0), ["noise"], predict, actual="minutes", predicted="predicted").count() == 0
